"""The pipeline's stages on a small corpus, each held against plain Python on its own input."""

import random

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from stockweave.llm import bpe
from tests.llm.test_partenum import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(2)
    stems = {"aa": ["bani", "kuna", "tamo", "rilu", "sedo"], "bb": ["schrot", "zwerg", "knall", "pflug", "stumpf"]}
    rows = []
    for i in range(120):
        lang = rng.choice(list(stems))
        words = [rng.choice(stems[lang]) + rng.choice(["", "s", "e", "en", "or"]) for _ in range(rng.choice([8, 40, 90]))]
        rows.append([i, " ".join(words + (["scum", "idiot"] if i % 9 == 0 else [])), lang])
    rows += [[200 + i, rows[i][1].replace(" ", "  "), rows[i][2]] for i in range(15)]
    rows += [[300 + i, rows[i][1] + " fin", rows[i][2]] for i in range(20, 40)]
    rows += [[400, None, "aa"], [401, "", "bb"], [402, "123 456", None]]
    return [(*r, "s", len(r[1] or "")) for r in rows]


def test_stages(spark, tmp_path):
    rows = corpus()
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, int("scum" in (r[1] or ""))) for r in rows if r[0] % 2 == 0 or r[0] % 9 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "mixing", "byte_bpe"]
    kept = {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")] or name == "byte_bpe"

    texts = {r[0]: r[1] for r in rows}
    known = {r.doc_id for r in kept["language_id"]}
    assert known == set(texts) - {400, 401, 402}
    best: dict[str, int] = {}
    for i in sorted(known, key=lambda i: (-len(texts[i]), i)):
        best.setdefault("".join(texts[i].split()), i)
    assert {r.doc_id for r in kept["exact_dedup"]} == set(best.values()) and 200 in best.values()
    near = brute([(i, texts[i]) for i in best.values()])
    assert {r.doc_id for r in kept["ngram_jaccard"]} == {c for _, c in near.values()}
    mixed = [r.doc_id for r in kept["mixing"]]
    good = {r.doc_id for r in kept["ngram_jaccard"] if "scum" not in r.text}
    assert set(mixed) <= {r.doc_id for r in kept["ngram_jaccard"]} and len(good & set(mixed)) >= 0.95 * len(good)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert len(kept["byte_bpe"]) == len(mixed)
    for r in kept["byte_bpe"]:
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == own.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded) == texts[r.doc_id].encode()
