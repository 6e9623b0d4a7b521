"""Extra columns whose names the operators use inside come out unchanged."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stockweave.llm import common, langid, pii
from tests.llm.test_pipeline import corpus

NAMES = [
    "_kept", "_stay", "_id", "_mark", "_copies", "_copy", "_marked", "_parts", "_new", "_cell", "mark", "rate", "copies", "tokens", "n_tokens", "domain", "l", "s", "set", "rep",
    "label", "owner", "blob", "unit", "sha", "norm", "keep_id", "kept", "component_id", "lang_pred", "score", "held_out", "p0", "features", "share", "hub",
]


def documents(spark):
    rows = [(*r, *[f"{c}{r[0]}" for c in NAMES]) for r in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:4]])
def test_stages_keep_them(spark, tmp_path, stage):
    docs = documents(spark)
    spark.createDataFrame([(r[0], 1, 0) for r in corpus() if r[0] % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in NAMES)


def test_pseudonyms_keep_them(spark):
    out = pii.pseudonymise(documents(spark).withColumn("text", F.concat(F.lit("card 4111 1111 1111 1111 of "), "text")), "k")
    rows = out.collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in NAMES) and sum(r.n_private for r in rows) > 100


def test_a_document_is_judged_by_its_own_text_whatever_its_id(spark):
    docs = spark.createDataFrame([*corpus(), (0, "999 888", "aa", "s", 7), (None, corpus()[1][1], "aa", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = langid.keep_known(docs).collect()
    assert "999 888" not in {r.text for r in kept} and any(r.doc_id is None for r in kept) and any(r.doc_id == 0 for r in kept)


def test_a_sample_of_very_many_rows_is_not_empty(spark):
    ids = spark.range(2_000_000).select(F.col("id").alias("doc_id"))
    assert common.sampled(ids, "doc_id", "x", 5000, 10**11).count() < 20
    assert 4000 < common.sampled(ids, "doc_id", "x", 5000, 2_000_000).count() < 6000
    few = common.sampled(ids, "doc_id", "x", 5000, 10**9).collect()
    assert 2 <= len(few) <= 30 and {r.doc_id for r in few} <= {r.doc_id for r in common.sampled(ids, "doc_id", "x", 5000, 10**7).collect()}


def test_an_empty_sample_with_labelled_rows_raises(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "123", "en")], "doc_id long, text string, lang string")
    assert langid.train(rows).languages == []  # no letter to learn from
    monkeypatch.setattr(langid, "sampled", lambda rows, *_: rows.filter("false"))
    with pytest.raises(ValueError, match="empty"):
        langid.train(rows)


def test_caches_of_other_operators_are_emptied():
    common.cache_of("one")["x"] = 1
    assert common.cache_of("one") == {"x": 1}
    common.cache_of("two")["y"] = 2
    assert common.cache_of("one") == {} and common.cache_of("two") == {}
