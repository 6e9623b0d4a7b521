"""Mixing to target weights with soft membership: posteriors of a classifier, rates by projected-gradient least squares.

A logistic regression over word presence is fitted on labelled documents and gives every document a posterior over the
domains. Rates r_d >= 0 are sought whose expected domain totals E = sum of r_d * T_d * p_d (T_d tokens, p_d posterior)
meet the targets t, or come nearest to them: least squares with the residual weighted by the inverse W of M = sum of
T_d * p_d * p_d', and, of all such rates, those nearest to 1 (documents weighing as their tokens). A small weight e on that
distance makes a fixed point of the projected gradient r_d = max(0, 1 - p_d' y) with y = W (E - t) / e, so the few dual values y
are all that is sought: Newton steps with halving on a convex function of y. A step is one aggregation with map-side
combine; what the driver holds is a matrix of domains, and rates are never written. The slopes g_d = p_d' W (E - t) tell how far
E is from the nearest totals: with s = max(0, -min g_d), no more than s + sqrt(s^2 + 2 (E' W (E - t) + s * sum of E)). A document is then taken
floor(r) times, and once more with the odds of the rest, drawn from a hash of the document.

Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import Stages, sampled, unused

#: The classifier is fitted on about so many labelled documents, chosen by a hash of doc_id, and uses so many words.
MAX_LABELLED, MAX_WORDS = 5_000, 1_000
#: Weight of the penalty on the regression's squared coefficients, and its iterations.
PENALTY, ITERATIONS = 0.002, 60
#: The totals come this near to the targets, or to the nearest totals there are. An evaluation is one aggregation.
CLOSE, SOLVED, ROUNDING, MAX_EVALUATIONS = 1e-4, 1e-12, 1e-14, 400
#: Weights of the rates' distance from 1 beside the residual, tried in turn until the totals are near enough.
PULLS = tuple(10.0**-e for e in range(5, 16, 2))


def with_tokens(documents: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), n_tokens, tokens: the distinct words and a few marks of a text's shape."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.lower(text).alias("low"), text.alias("text"))
    words = F.array_remove(F.split("low", "[ \t\n\x0b\f\r]+"), "")
    rows = rows.select("doc_id", "mark", "text", words.alias("words")).withColumn("kinds", F.array_distinct("words"))
    letters = F.greatest(F.length("text"), F.lit(1))
    shape = F.array(
        F.lit("#"),
        F.concat(F.lit("#signs "), F.round(F.least(F.regexp_count("text", F.lit("[#$%&!|*]")) / letters * 20, F.lit(6))).cast("int").cast("string")),
        F.concat(F.lit("#kinds "), F.round(F.size("kinds") / F.greatest(F.size("words"), F.lit(1)) * 10).cast("int").cast("string")),
    )
    return rows.select("doc_id", "mark", F.size("words").cast("long").alias("n_tokens"), F.concat(shape, "kinds").alias("tokens"))


class Classifier:
    """Intercepts and a table of words with a weight for each domain (columns w0, w1, ...)."""

    def __init__(self, domains: list[str], priors: list[float], words: DataFrame | None) -> None:
        self.domains, self.priors, self.words = domains, priors, words

    def logits(self, tokens: DataFrame) -> DataFrame:
        """doc_id, mark, n_tokens, s0, s1, ... (sums of the weights), from ``with_tokens``; a repeated row counts once."""
        keys = ["doc_id", "mark", "n_tokens"] + [c for c in tokens.columns if c not in ("doc_id", "mark", "n_tokens", "tokens")]
        sums = [f"s{k}" for k in range(len(self.domains))]
        if self.words is None:
            return tokens.select(*keys).distinct().select(*keys, *[F.lit(0.0).alias(s) for s in sums])
        spread = tokens.select(*keys, F.explode("tokens").alias("word"))
        # every row has the token "#", which the table holds with zero weights: its count tells repeated rows
        met = spread.join(F.broadcast(self.words), "word")  # MAX_WORDS rows
        rows = F.sum(F.when(F.col("word") == "#", 1))
        return met.groupBy(*keys).agg(*[(F.sum(f"w{k}") / rows).alias(s) for k, s in enumerate(sums)])

    def posteriors(self, tokens: DataFrame) -> DataFrame:
        """doc_id, mark, n_tokens, p0, p1, ... which add up to 1."""
        out = self.logits(tokens)
        return softmax(out, [F.lit(p) + F.col(f"s{k}") for k, p in enumerate(self.priors)], [f"p{k}" for k in range(len(self.domains))]).drop(*[f"s{k}" for k in range(len(self.domains))])


def softmax(rows: DataFrame, scores: list, names: list[str]) -> DataFrame:
    raw = [f"_{n}" for n in names]
    rows = rows.withColumns(dict(zip(raw, scores)))
    top = F.greatest(*raw) if len(raw) > 1 else F.col(raw[0])
    rows = rows.withColumns({r: F.exp(F.col(r) - top) for r in raw})
    total = sum((F.col(r) for r in raw), F.lit(0.0))
    return rows.withColumns({n: F.col(r) / total for n, r in zip(names, raw)}).drop(*raw)


def fit(documents: DataFrame, labelled: DataFrame, domains: dict[str, float], stages: Stages) -> Classifier:
    """A classifier from ``labelled`` (doc_id, domain); only the named domains count, a document's first in order.

    Without labelled documents the posterior of every document is the target shares; ``domains`` gives those.
    """
    names = sorted(domains)
    labels = labelled.filter(F.col("domain").isin(names)).groupBy(F.col("doc_id").cast("long").alias("l")).agg(F.min("domain").alias("domain"))
    n = labels.count()
    labels = sampled(labels, "l", "mixing", MAX_LABELLED, n)
    chosen = documents.select("doc_id", "text").join(F.broadcast(labels), F.col("doc_id").cast("long") == F.col("l")).drop("l")  # MAX_LABELLED rows
    sample = with_tokens(chosen).join(F.broadcast(labels), F.col("doc_id") == F.col("l")).drop("l")
    sample = stages.put("sample", sample.dropDuplicates(["doc_id"]))
    present = [d for d in names if d in {r["domain"] for r in sample.select("domain").distinct().collect()}]
    if not present:
        return Classifier(names, [math.log(max(domains[d], 1e-9)) for d in names], None)
    if len(present) == 1:
        return Classifier(names, [0.0 if d in present else -50.0 for d in names], None)

    # the words that tell most about the domains: sum over domains of n * log(n / expected n)
    spread = sample.select("domain", F.explode("tokens").alias("word")).groupBy("word", "domain").agg(F.count(F.lit(1)).alias("n"))
    sizes = sample.groupBy("domain").agg((F.count(F.lit(1)) / F.lit(sample.count())).alias("share"))
    totals = spread.groupBy("word").agg(F.sum("n").alias("all"))
    told = spread.join(F.broadcast(sizes), "domain").join(totals, "word").groupBy("word").agg(F.sum(F.col("n") * F.log(F.col("n") / (F.col("all") * F.col("share")))).alias("told"))
    vocabulary = [r["word"] for r in told.filter("word <> '#'").orderBy(F.desc("told"), "word").limit(MAX_WORDS).collect()]
    presence = CountVectorizerModel.from_vocabulary(vocabulary or ["#"], "tokens", "features").setBinary(True)
    number = sum((F.when(F.col("domain") == d, float(i)).otherwise(0.0) for i, d in enumerate(present)), F.lit(0.0))
    regression = LogisticRegression(family="multinomial", regParam=PENALTY, maxIter=ITERATIONS)
    model = regression.fit(presence.transform(sample).select("features", number.alias("label")))
    weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    of = {d: i for i, d in enumerate(present)}
    table = [("#", *[0.0] * len(names))]
    table += [(w, *[float(weights[of[d], j]) if d in of else 0.0 for d in names]) for j, w in enumerate(vocabulary)]
    schema = "word string, " + ", ".join(f"w{k} double" for k in range(len(names)))
    words = stages.put("words", documents.sparkSession.createDataFrame(table, schema))
    return Classifier(names, [float(intercepts[of[d]]) if d in of else -50.0 for d in names], words)


def solve(at: Callable, lowest: Callable, targets: list[float]) -> np.ndarray:
    """Dual values y of the rates max(0, 1 - p' y), from two aggregations over the documents.

    ``at(y)`` gives the totals, half the sum of squared rates and the curvature (M of the documents not clipped);
    ``lowest(v)`` the smallest p' v. Ends where every total is within CLOSE of its target, or of the nearest totals that
    rates >= 0 have; raises otherwise.
    """
    target, dual = np.array(targets), np.zeros(len(targets))
    totals, half, curve = at(dual)
    metric = curve + np.eye(len(targets)) * 1e-6
    weights = np.linalg.inv(metric)
    evaluations, off = 1, math.inf
    for pull in PULLS:
        gradient = totals - target - pull * metric @ dual
        while np.abs(totals - target).max() >= CLOSE and np.abs(gradient).max() > SOLVED + ROUNDING * np.abs(dual).max() and evaluations < MAX_EVALUATIONS:
            step, value = np.linalg.solve(curve + pull * metric, gradient), half + target @ dual + pull / 2 * dual @ metric @ dual
            along, was, size = gradient @ step, np.abs(gradient).max(), 1.0
            while evaluations < MAX_EVALUATIONS:
                moved = dual + size * step
                totals, half, curve = at(moved)
                evaluations += 1
                gradient = totals - target - pull * metric @ moved
                lower = half + target @ moved + pull / 2 * moved @ metric @ moved <= value - 1e-4 * size * along
                if lower or np.abs(gradient).max() < was / 2 or size < 1e-6:  # near the end values differ by less than rounding
                    break
                size /= 2
            dual = moved
            if size < 1e-6:
                break
        if np.abs(totals - target).max() < CLOSE:
            return dual
        # the distance to the nearest totals is no more than this (see the module's text)
        slope = weights @ (totals - target)
        short = max(0.0, -lowest(slope))
        off = short + math.sqrt(short * short + 2 * max(0.0, slope @ totals + short * totals.sum()))
        if off < CLOSE:
            return dual
    raise RuntimeError(f"mixing rates not found in {evaluations} evaluations: totals {totals.tolist()} for targets {targets}, up to {off:.2g} from the nearest")


def fit_rates(posteriors: DataFrame, targets: list[float]) -> DataFrame:
    """``posteriors`` (n_tokens, p0, p1, ...) with a column rate; ``targets`` are shares of the present total of tokens."""
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    total = posteriors.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return posteriors.withColumn("rate", F.lit(1.0))

    def along(v: np.ndarray) -> Column:
        return sum((F.col(f"p{i}") * float(x) for i, x in enumerate(v)), F.lit(0.0))

    def at(dual: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        share, raw = F.col("n_tokens") / float(total), 1.0 - along(dual)
        rows = posteriors.select("*", F.greatest(F.lit(0.0), raw).alias("rate"), share.alias("share"), F.when(raw > 0, share).otherwise(0.0).alias("kept"))
        sums = [F.sum(F.col("rate") * F.col("share") * F.col(f"p{i}")) for i in range(k)] + [F.sum(F.col("rate") * F.col("rate") * F.col("share")) / 2]
        got = [float(x) for x in rows.agg(*sums, *[F.sum(F.col("kept") * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs]).first()]
        curve = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k + 1 :]):
            curve[i, j] = curve[j, i] = x
        return np.array(got[:k]), got[k], curve

    dual = solve(at, lambda v: float(posteriors.agg(F.min(along(v))).first()[0]), targets)
    return posteriors.withColumn("rate", F.greatest(F.lit(0.0), 1.0 - along(dual)))


def mixing_rates(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], seed: str = "mix") -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, mark, n_tokens, p_<domain> for each, rate, copies.

    ``labelled`` has doc_id and domain; ``targets`` gives each domain's share of the tokens after mixing (scaled to sum 1).
    Null text has no tokens and keeps the prior. Repeated rows share one row. Where targets can't be met with rates >= 0
    (no document has the domain), the nearest totals are. Other columns aren't read; no rows give no rows.
    """
    if not targets or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets are nonnegative shares, not all of them zero")
    stages = Stages(documents.sparkSession, "mixing")
    shares = {d: t / sum(targets.values()) for d, t in sorted(targets.items())}
    model = fit(documents, labelled, shares, stages)
    known = stages.put("posteriors", model.posteriors(with_tokens(documents)))
    rates = fit_rates(known, list(shares.values()))
    # a hash in [0, 1) of the document decides about the part of a copy
    draw = F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")
    return rates.select("doc_id", "mark", "n_tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(shares)], "rate", copies.alias("copies"))


def mixed(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], seed: str = "mix") -> DataFrame:
    """The documents, each as often as its rate says, with all columns; repeated rows are each taken so."""
    take = mixing_rates(documents, labelled, targets, seed).filter("copies > 0")
    id_, mark, copies, copy = map(unused, ("id", "mark", "copies", "copy"))
    take = take.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("copies").alias(copies))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(mark))
    return documents.join(take, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*documents.columns)


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain from quality and toxic: toxic, else good or plain; rows with a null that matters have none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain"))
    return labels.select("doc_id", domain.alias("domain")).filter("domain is not null")


#: Shares of tokens that the registered query and the pipeline ask for.
TARGETS = {"good": 0.90, "plain": 0.08, "toxic": 0.02}
