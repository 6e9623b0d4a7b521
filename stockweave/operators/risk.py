"""Stock-out risk: daily demand, cover and probability alerts, look-ahead labels and their evaluation."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockweave.functions import dist
from stockweave.functions.calendar import week_start
from stockweave.functions.metrics import alert_metrics, lead_time_to_alert
from stockweave.functions.quantiles import grouped_quantiles, join_groups
from stockweave.params import SERIES

METHODS = ("cover", "prob", "iforest")
# The threshold sweep and the anomaly features.
COVER_SWEEP = (3, 5, 7, 10, 14, 21, 28)
PROB_SWEEP = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
ANOMALY_FEATURES = ("log_cover", "p_stockout_7d", "sales_ratio_1d", "sales_ratio_7d", "on_hand_change_3d", "promo_flag")
HIGH_RISK_PROB = 0.75


# ------------------------------------------------------------------ demand per day
def share_arrays(daily: DataFrame, end: date | Column, weeks: int = 26) -> DataFrame:
    """Per series the seven weekday shares (Monday first) of the last ``weeks`` weeks; 1/7 where unknown."""
    last = end if isinstance(end, Column) else F.lit(end)
    recent = daily.filter((F.col("date") <= last) & (F.col("date") > F.date_sub(last, 7 * weeks)) & F.col("sell_out_pzs").isNotNull())
    y, dow = F.col("sell_out_pzs"), F.weekday("date")
    sums = recent.groupBy(*SERIES).agg(F.sum(y).alias("total"), *[F.sum(F.when(dow == d, y)).alias(f"d{d}") for d in range(7)])
    return sums.select(*SERIES, F.array(*[F.coalesce(F.try_divide(f"d{d}", "total"), F.lit(1.0 / 7)) for d in range(7)]).alias("shares"))


def weekday_shares(daily: DataFrame, end: date | Column, weeks: int = 26) -> DataFrame:
    return share_arrays(daily, end, weeks).select(*SERIES, F.posexplode("shares").alias("dow", "share"))


def daily_forecast(forecast: DataFrame, daily: DataFrame, shares_end: date | Column, start: date | Column, end: date | Column) -> DataFrame:
    """Weekly q50 and q90 spread over the days of [start, end] by weekday share.

    Days before the first forecast week borrow it. The few weeks and the seven shares of a series
    travel as one small map and array, so the days are exploded after a single join on the series.
    """
    first_week = forecast.agg(F.min("target_week")).scalar()
    weeks = forecast.groupBy(*SERIES).agg(
        F.map_from_entries(F.collect_list(F.struct("target_week", F.struct("q50", "q90")))).alias("weeks")
    )
    first, last = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    days = weeks.join(share_arrays(daily, shares_end), list(SERIES), "left").withColumn("date", F.explode(F.sequence(first, last)))
    week = F.try_element_at("weeks", F.greatest(week_start(F.col("date")), F.col("first_week")))
    share = F.coalesce(F.element_at("shares", F.weekday("date") + 1), F.lit(1.0 / 7))
    return days.withColumn("first_week", first_week).select(
        *SERIES, "date", (week["q50"] * share).alias("d50"), (week["q90"] * share).alias("d90")
    )


# ------------------------------------------------------------------ scoring
def forward_demand(daily_fc: DataFrame, days: int = 7) -> DataFrame:
    """Expected demand of the next ``days`` days, today excluded; partial at the end, NULL on the last row."""
    ahead = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(1, days)
    return daily_fc.withColumn("fwd50", F.sum("d50").over(ahead)).withColumn("fwd90", F.sum("d90").over(ahead))


def score_days(
    inventory: DataFrame, daily_fc: DataFrame, daily: DataFrame, series: DataFrame, prob_threshold: float = 0.5, lookahead: int = 7
) -> DataFrame:
    """Cover, stock-out probability, trailing features and the two rule alerts per series and day."""
    key = list(SERIES)
    x = (
        inventory.join(forward_demand(daily_fc, lookahead), [*key, "date"])
        .join(series.select(*SERIES, "cluster", "lead_time_days", "safety_stock_days"), key, "left")
        .join(daily.select(*SERIES, "date", "sell_out_pzs", "promo_flag"), [*key, "date"], "left")
    )
    mu, sigma = dist.lognormal_params(F.col("fwd50"), F.col("fwd90"))
    x = x.withColumns({"daily_mean_7d": F.col("fwd50") / lookahead, "_mu": mu, "_sigma": sigma})
    floor = F.lit(1e-6)
    x = dist.with_outcomes(x, "on_hand", "_mu", "_sigma", exceeds="p_stockout_7d").withColumns({
        "cover_days": F.when(F.col("daily_mean_7d").isNotNull(), F.col("on_hand") / F.greatest("daily_mean_7d", floor)),
        "cover_threshold": F.col("lead_time_days") + F.col("safety_stock_days"),
    }).drop("_mu", "_sigma")
    by_date = Window.partitionBy(*SERIES).orderBy("date")
    week = by_date.rowsBetween(-6, 0)
    before = F.lag("on_hand", 3).over(by_date)
    x = x.withColumns({
        "sales_7d": F.sum("sell_out_pzs").over(week),
        "exp_7d": F.sum("d50").over(week),
        "on_hand_change_3d": F.coalesce((F.col("on_hand") - before) / F.when(before.isNotNull(), F.greatest(before, F.lit(1.0))), F.lit(0.0)),
    })

    def ratio(num: str, den: str) -> Column:
        known = F.when(F.col(den).isNotNull(), F.col(num) / F.greatest(F.col(den), floor))
        return F.least(F.coalesce(known, F.lit(1.0)), F.lit(10.0))

    return x.withColumns({
        "sales_ratio_1d": ratio("sell_out_pzs", "d50"),
        "sales_ratio_7d": ratio("sales_7d", "exp_7d"),
        "log_cover": F.log1p(F.when(F.col("cover_days").isNotNull(), F.least("cover_days", F.lit(365.0)))),
        "promo_flag": F.coalesce("promo_flag", F.lit(0)),
        "alert_cover": F.coalesce(F.col("cover_days") < F.col("cover_threshold"), F.lit(False)),
        "alert_prob": F.coalesce(F.col("p_stockout_7d") > prob_threshold, F.lit(False)),
    })


def label_lookahead(scored: DataFrame, event_share: float = 0.25, lookahead: int = 7) -> DataFrame:
    """Event flag, "any event in the next days" label (NULL unless all are observed) and episode onsets."""
    day = F.datediff("date", F.lit(date(1970, 1, 1)))
    ahead = Window.partitionBy(*SERIES).orderBy(day).rangeBetween(1, lookahead)
    by_date = Window.partitionBy(*SERIES).orderBy(day)
    events = scored.withColumn("event", F.coalesce(F.col("stockout_store_share") >= event_share, F.lit(False)))
    return events.withColumns({
        "label_7d": F.when(F.count(F.lit(1)).over(ahead) == lookahead, F.max(F.col("event").cast("int")).over(ahead)),
        "episode_onset": F.col("event") & F.coalesce(~F.lag("event").over(by_date), F.lit(False)),
    })


# ------------------------------------------------------------------ evaluation
def _by_method(labeled: DataFrame, methods: tuple[str, ...], *cols: str) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"alert_{m}").alias("alert")) for m in methods])
    return labeled.select(*cols, F.explode(kinds).alias("_m")).select(*cols, "_m.method", "_m.alert")


def evaluate_methods(labeled: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Confusion metrics and median cover at alert per method over the evaluable days."""
    rows = _by_method(labeled.filter(F.col("label_7d").isNotNull()), methods, "label_7d", "cover_days")
    rows = rows.withColumn("_cover", F.when(F.col("alert"), F.col("cover_days")))
    table = rows.groupBy("method").agg(*alert_metrics(F.col("alert"), F.col("label_7d") == 1))
    return join_groups(table, grouped_quantiles(rows, ["method"], {"median_cover_at_alert": ("_cover", 0.5)}), ["method"])


def threshold_sweep(labeled: DataFrame) -> DataFrame:
    """Confusion metrics at every cover and probability threshold, in one pass."""
    points = [F.struct(F.lit("cover").alias("method"), F.lit(float(k)).alias("threshold"), (F.col("cover_days") < k).alias("alert")) for k in COVER_SWEEP]
    points += [F.struct(F.lit("prob").alias("method"), F.lit(p).alias("threshold"), (F.col("p_stockout_7d") > p).alias("alert")) for p in PROB_SWEEP]
    rows = labeled.filter(F.col("label_7d").isNotNull()).select("label_7d", F.explode(F.array(*points)).alias("p")).select("label_7d", "p.*")
    alert = F.coalesce("alert", F.lit(False))
    return rows.groupBy("method", "threshold").agg(*alert_metrics(alert, F.col("label_7d") == 1))


def lead_time_table(labeled: DataFrame, methods: tuple[str, ...] = METHODS, max_lead: int = 7) -> DataFrame:
    """Episode onsets, how many were alerted before and the median lead, per method."""
    onsets = labeled.filter("episode_onset").select(*SERIES, "date")
    leads = None
    for m in methods:
        one = lead_time_to_alert(labeled.filter(f"alert_{m}").select(*SERIES, "date"), onsets, max_lead).withColumn("method", F.lit(m))
        leads = one if leads is None else leads.unionByName(one)
    table = leads.groupBy("method").agg(F.count(F.lit(1)).alias("n_onsets"), F.count("lead_time_days").alias("n_onsets_alerted"))
    found = join_groups(table, grouped_quantiles(leads, ["method"], {"median_lead_time_days": ("lead_time_days", 0.5)}), ["method"])
    # a method without onsets has its row too
    every = labeled.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    return every.join(found, "method", "left").fillna(0, ["n_onsets", "n_onsets_alerted"])


# ------------------------------------------------------------------ alert list
def severity(methods: tuple[str, ...] = METHODS) -> Column:
    high = (F.col("p_stockout_7d") > HIGH_RISK_PROB) | (F.col("cover_days") < F.col("lead_time_days"))
    any_alert = F.col(f"alert_{methods[0]}")
    for m in methods[1:]:
        any_alert = any_alert | F.col(f"alert_{m}")
    return F.when(high, "high").when(any_alert, "medium").otherwise("none")


def inventory_tail(inventory: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    return inventory.filter((F.col("date") > F.lit(as_of - timedelta(days=days))) & (F.col("date") <= F.lit(as_of)))


def alert_list(scored: DataFrame, as_of: date, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Alerts of the as-of day, most urgent first."""
    extra = ["alert_iforest", "iforest_score"] if "iforest" in methods else []
    rows = scored.filter(F.col("date") == F.lit(as_of)).withColumn("severity", severity(methods))
    return rows.select(
        *SERIES, "cluster", "date", "on_hand", "stores_reporting", "stockout_store_share", "daily_mean_7d",
        F.col("fwd50").alias("demand_7d_p50"), F.col("fwd90").alias("demand_7d_p90"),
        "cover_days", "cover_threshold", "p_stockout_7d", "alert_cover", "alert_prob", *extra, "severity",
    ).orderBy("severity", F.desc("p_stockout_7d"), *SERIES)
