"""Lognormal demand: parameters from two quantiles, tail probability, mean, quantile and shortfall."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the demand fit.
Z90 = 1.2815515655446004
MIN_SIGMA = 0.05
MAX_SIGMA = 1.5
MIN_MEDIAN = 1e-6
SIGMA_FLOOR_UNITS = 1.0

# Hart's rational approximation of the normal tail, highest power first.
_NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DENOMINATOR = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function as a native expression.

    Accurate to 1e-12: beyond seven standard deviations the tail is taken as zero. ``x`` is used
    many times, so it should be a plain column.
    """
    a = F.abs(x)
    tail = F.when(a < 7.07106781186547, F.exp(-a * a / 2.0) * _horner(_NUMERATOR, a) / _horner(_DENOMINATOR, a)).otherwise(0.0)
    return F.lit(0.5) + F.signum(x) * (F.lit(0.5) - tail)


def lognormal_params(q50: Column, q90: Column) -> tuple[Column, Column]:
    """(mu, sigma) with median q50 and 90th percentile q90, both guarded near zero; NULL stays NULL."""
    median = F.greatest(q50, F.lit(MIN_MEDIAN))
    base = F.greatest(median, F.lit(SIGMA_FLOOR_UNITS))
    ratio = F.ln(F.greatest(q90, median, base) / base) / Z90
    known = q50.isNotNull() & q90.isNotNull()
    return F.when(known, F.ln(median)), F.when(known, F.least(F.greatest(ratio, F.lit(MIN_SIGMA)), F.lit(MAX_SIGMA)))


def z_score(stock: Column, mu: Column, sigma: Column) -> Column:
    return (F.ln(F.greatest(stock, F.lit(MIN_MEDIAN))) - mu) / sigma


def prob_demand_exceeds(stock: Column, mu: Column, sigma: Column) -> Column:
    return F.when(stock <= 0, F.lit(1.0)).otherwise(1.0 - normal_cdf(z_score(stock, mu, sigma)))


def quantile(mu: Column, sigma: Column, z: Column) -> Column:
    return F.exp(mu + sigma * z)


def normal_quantile_of(level: Column, levels: set[float]) -> Column:
    """z of a column that takes only the given constant levels."""
    out = F.lit(None).cast("double")
    for q in sorted(levels):
        out = F.when(level == q, F.lit(NormalDist().inv_cdf(q))).otherwise(out)
    return out


def mean(mu: Column, sigma: Column) -> Column:
    return F.exp(mu + sigma * sigma / 2.0)


def expected_shortfall(stock: Column, mu: Column, sigma: Column) -> Column:
    """Expected demand beyond the stock; the whole mean when there is none."""
    z = z_score(stock, mu, sigma)
    return _shortfall(stock, mean(mu, sigma), normal_cdf(z), normal_cdf(z - sigma))


def _shortfall(stock: Column, m: Column, below: Column, below_weighted: Column) -> Column:
    lost = m * (1.0 - below_weighted) - F.greatest(stock, F.lit(MIN_MEDIAN)) * (1.0 - below)
    return F.when(stock <= 0, m).otherwise(F.greatest(lost, F.lit(0.0)))


def with_outcomes(df: DataFrame, stock: str, mu: str, sigma: str, *, exceeds: str, shortfall: str | None = None) -> DataFrame:
    """Adds P(demand > stock) and the expected shortfall; the scores are columns of their own, so each is computed once."""
    m, s, held = F.col(mu), F.col(sigma), F.col(stock)
    out = df.withColumn("_z", z_score(held, m, s)).withColumn("_below", normal_cdf(F.col("_z")))
    out = out.withColumn(exceeds, F.when(held <= 0, F.lit(1.0)).otherwise(1.0 - F.col("_below")))
    if shortfall:
        out = out.withColumn("_zs", F.col("_z") - s).withColumn("_below_weighted", normal_cdf(F.col("_zs")))
        out = out.withColumn(shortfall, _shortfall(held, mean(m, s), F.col("_below"), F.col("_below_weighted")))
    return out.drop("_z", "_zs", "_below", "_below_weighted")
