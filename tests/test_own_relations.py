"""A run on the user's own relations, read from CSV, and what stops it."""

import dataclasses
from datetime import date

import pytest
from pyspark.sql import functions as F

from stockweave.operators import gates as G
from stockweave.operators import risk as R
from stockweave.operators.validate import SchemaError
from stockweave.params import SERIES, Params
from stockweave.plans.forecast import apply_selection
from stockweave.plans.pipeline import Pipeline
from stockweave.sources import adapter, files
from tests.util import frame

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    """The four relations as CSV files."""
    folder = tmp_path_factory.mktemp("own")
    made = adapter.raw_relations(spark, SF, "flag_all")
    for f in dataclasses.fields(made):
        files.write_csv(getattr(made, f.name), f"{folder}/{f.name}")
    return adapter.RawRelations(**{f.name: files.read_csv(spark, f"{folder}/{f.name}") for f in dataclasses.fields(made)})


def test_from_csv_to_the_order_file(spark, own, tmp_path):
    r = Pipeline.of(spark, own, Params(), models=("ma4",))
    r.validate()
    card = r.run(anomalies=False)
    assert card.count() > 30 and r.orders().count() > 0
    r.publish(str(tmp_path), anomalies=False)
    back = files.read_csv(spark, f"{tmp_path}/orders")
    assert back.count() == r.orders().count()
    assert back.select(F.max(F.length(F.regexp_extract("order_qty", r"\.(\d+)", 1)))).first()[0] <= 4
    assert {"forecast_final", "forecast_risk_eval", "alerts", "orders", "order_summary", "scorecard"} <= {p.name for p in tmp_path.iterdir()}


@pytest.mark.parametrize("relation, change, words", [
    ("sell_out", lambda df: df.withColumn("sell_out_pzs", F.lit("-1")), "negative"),
    ("sell_out", lambda df: df.drop("cedis"), "missing columns"),
    ("sell_out", lambda df: df.union(df.limit(1)), "duplicate"),
    ("sell_out", lambda df: df.withColumn("date", F.lit("1970-01-01")).dropDuplicates(["upc", "cedis"]), "outside"),
    ("stores", lambda df: df.union(df.limit(1)), "duplicate"),
    ("stores", lambda df: df.limit(1), "stores missing"),
    ("catalog", lambda df: df.withColumn("upc", F.lit("999")).limit(1), "products missing"),
    ("inventory", lambda df: df.withColumn("store_nbr", F.lit(None).cast("string")), "null"),
])
def test_broken_relations_stop_the_run(spark, own, relation, change, words):
    broken = dataclasses.replace(own, **{relation: change(getattr(own, relation))})
    with pytest.raises(SchemaError, match=words):
        Pipeline.of(spark, broken, Params(), models=("ma4",)).validate()


def test_a_series_without_a_value_takes_the_fallback(spark):
    cols = "upc long, cedis string, cluster string, origin_label string, origin date, h int, model string, q50 double, n_weeks_at_origin long"
    rows = [(1, "A", "A-X", "final", date(2001, 1, 1), 1, m, q, 60) for m, q in (("gbt", None), ("ma4", 3.0))]
    rows += [(2, "A", "A-X", "final", date(2001, 1, 1), 1, m, q, 60) for m, q in (("gbt", 7.0), ("ma4", 3.0))]
    rows += [(3, "A", "A-X", "final", date(2001, 1, 1), 1, "ma4", 5.0, 60)]
    selection = frame(spark, [("A-X", "gbt")], "cluster string, selected_model string")
    series = frame(spark, [(i, "A", False, False) for i in (1, 2, 3)], "upc long, cedis string, is_discontinued boolean, is_high_promo boolean")
    out = {r.upc: (r.model, r.q50) for r in apply_selection(frame(spark, rows, cols), selection, series, 26).collect()}
    assert out == {1: ("ma4", 3.0), 2: ("gbt", 7.0), 3: ("ma4", 5.0)}


def test_methods_without_onsets_have_a_row(spark):
    cols = "upc long, cedis string, date date, episode_onset boolean, alert_cover boolean, alert_prob boolean"
    labeled = frame(spark, [(1, "A", date(2001, 1, 1), False, True, False)], cols)
    rows = R.lead_time_table(labeled, ("cover", "prob")).collect()
    assert sorted((r.method, r.n_onsets, r.n_onsets_alerted, r.median_lead_time_days) for r in rows) == [("cover", 0, 0, None), ("prob", 0, 0, None)]


def test_a_failed_hard_gate_raises_after_the_scorecard_is_written(spark, own, monkeypatch):
    r = Pipeline.of(spark, own, dataclasses.replace(Params(), max_wape_selected=-1.0), models=("ma4",))
    with pytest.raises(G.GateError, match="selected_wape"):
        r.run(anomalies=False, strict=True)
    assert not r.scorecard(anomalies=False).filter("status = 'FAIL'").isEmpty()
    assert {c for c in SERIES} <= set(r.orders().columns)
