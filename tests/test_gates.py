import pytest
from pyspark.sql import functions as F

from stockweave.operators import gates as G


def card(spark, *gates):
    return {r.gate: r for r in G.scorecard(G.gate_rows(spark.range(1), list(gates))).collect()}


def test_operators_and_status(spark):
    got = card(
        spark,
        G.gate("a", "le_ok", F.lit(0.1), "<=", 0.2, "hard"), G.gate("a", "le_bad", F.lit(0.3), "<=", 0.2, "hard"),
        G.gate("a", "ge_ok", F.lit(0.5), ">=", 0.5, "soft"), G.gate("a", "eq_ok", F.lit(3.0), "==", 3.0, "hard"),
        G.gate("a", "in_ok", F.lit(0.9), "in", (0.85, 0.97), "hard"), G.gate("a", "in_bad", F.lit(0.98), "in", (0.85, 0.97), "soft", "note"),
        G.gate("a", "nan", F.lit(float("nan")), ">=", 0.0, "soft"), G.gate("a", "null", F.lit(None).cast("double"), ">=", 0.0, "hard"),
    )
    assert {k: r.status for k, r in got.items()} == {
        "le_ok": "pass", "le_bad": "FAIL", "ge_ok": "pass", "eq_ok": "pass", "in_ok": "pass", "in_bad": "warn", "nan": "warn", "null": "FAIL",
    }
    assert got["in_bad"].threshold == "[0.85, 0.97]" and got["in_bad"].note == "note"


def test_failed_hard_gate_raises(spark):
    ok = G.scorecard(G.gate_rows(spark.range(1), [G.gate("a", "x", F.lit(1.0), "<=", 0.5, "soft")]))
    G.require_pass(ok)
    with pytest.raises(G.GateError, match="x"):
        G.require_pass(G.scorecard(G.gate_rows(spark.range(1), [G.gate("a", "x", F.lit(1.0), "<=", 0.5, "hard")])))
