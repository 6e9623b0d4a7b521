import hashlib
import random

import numpy as np
import public_tokenizers as P
import regex
import tiktoken

from stockweave.llm import bpe, chat, dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, unit int, sha int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, "s", None, 1, 2) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


# ---------------------------------------------------------------- exact dedup
def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        values = np.unique(rng.integers(0, 1 << 48, n))
        assert (dedup.golomb_decode(dedup.golomb_encode(values, 48)) == values).all()
    dense = np.arange(500)
    assert (dedup.golomb_decode(dedup.golomb_encode(dense, 9)) == dense).all()


def test_exact_groups_edges(spark):
    texts = ["a b", "ab", " a  b ", None, "", "\n", "x" * 50_000, "x" * 25_000 + " " + "x" * 25_000, "é", "e\u0301", "ab"]
    rows = {r.doc_id: r for r in dedup.exact_groups(docs(spark, texts).repartition(5)).collect()}
    assert len(rows) == len(texts)
    assert {rows[i].keep_id for i in (0, 1, 2, 10)} == {2} and rows[0].group_size == 4
    assert {rows[i].keep_id for i in (3, 4, 5)} == {5} and rows[3].group_size == 3  # the one with a character stays
    assert rows[6].keep_id == rows[7].keep_id == 7
    assert rows[8].keep_id == 8 and rows[9].keep_id == 9
    assert [i for i, r in rows.items() if r.kept] and {i for i, r in rows.items() if r.kept} == {2, 5, 7, 8, 9}
    assert rows[1].text_sha256 == hashlib.sha256(b"ab").hexdigest()


def test_exact_ties_repeated_rows_null_id_and_empty_table(spark):
    rows = dedup.exact_groups(docs(spark, ["t", "t", "t", "u"], [4, 4, 9, None])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in rows) == [(-1, -1, 1, True), (4, 4, 3, True), (4, 4, 3, True), (9, 4, 3, False)]
    kept = dedup.keep_first(docs(spark, ["t", "t", "t", "u"], [4, 4, 9, None]))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 4] and kept.columns == [f.split()[0] for f in DOCS.split(", ")]
    assert dedup.exact_groups(docs(spark, [])).collect() == []


# ---------------------------------------------------------------- byte-level BPE
RANKS = P.path("byte_bpe_50k.tiktoken")


def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def soup(rng, n):
    bits = ["the ", " Straße", "\n\n  ", "12345", "'ll", "'", "  ", "\t", "你好", "e\u0301", "!?", "🙂", "aaaa", " ", "\u2028", "<|endoftext|>"]
    return "".join(rng.choice(bits) for _ in range(n))


def test_bpe_equals_library_also_across_chunks(spark):
    rng = random.Random(3)
    texts = [soup(rng, n) for n in (1, 5, 50, 500, 700)] + [None, "", "a" * 3000, " " * 900, "ab" * 500 + " " * 500 + "z", "\U0001f642" * 400]
    out = {r.doc_id: r for r in bpe.encode_documents(docs(spark, texts), RANKS, P.PATTERN, chunk=64, overlap=16).collect()}
    assert len(out) == len(texts)
    own = reference()
    for i, t in enumerate(texts):
        want = own.encode_ordinary(t or "")
        assert np.frombuffer(out[i].ids, dtype="<u4").tolist() == want, i
        assert out[i].n_tokens == len(want) and bytes(out[i].decoded) == (t or "").encode()


def test_stitch_equals_whole_text():
    rng = random.Random(7)
    pattern = regex.compile(P.PATTERN)
    for trial in range(150):
        text = soup(rng, rng.randint(20, 300))
        chunk = rng.choice([12, 20, 40])
        step = chunk - rng.choice([3, 5, 8])
        n = max(1, -(-(len(text) - (chunk - step)) // step))
        chunks = [text[i * step : i * step + chunk] for i in range(n)]
        whole, ends = bpe.stitch(pattern, chunks, [bpe.boundaries(pattern, c) for c in chunks], step)
        assert whole == text and ends == bpe.boundaries(pattern, text), trial


def test_bpe_empty_table_repeated_rows(spark):
    assert bpe.encode_digests(docs(spark, []), RANKS, P.PATTERN).collect() == []
    rows = bpe.encode_digests(docs(spark, ["hi", "hi"], [1, 1]), RANKS, P.PATTERN).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].decoded_sha256 == hashlib.sha256(b"hi").hexdigest()


# ---------------------------------------------------------------- chat formatting
TURNS = "conv_id long, turn long, role string, text string, place int, segment string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def test_chat_round_trip_and_loss(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", chat.PROBE), (1, 2, "assistant", "\\\\###</turn> </turn>\n### User: "), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "####"), (4, 0, "Assistant", "x"), (4, 1, None, "y"), (4, 2, "a: b\\", "z"), (None, 0, "user", "n")]
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns(spark, rows))).collect()}
    for conv in (1, 2, 3, 4, None):
        mine = [r for r in rows if r[0] == conv]
        want = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert out[conv].turns_sha256 == hashlib.sha256(want.encode()).hexdigest(), conv
        assert (out[conv].n_turns, out[conv].loss_chars, out[conv].loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [out[c].valid for c in (1, 2, 3, 4)] == [True, True, False, False]


def test_chat_ties_repeats_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    out = chat.read_back(chat.format_turns(turns(spark, rows))).collect()
    assert out[0].n_turns == 3 and out[0].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert chat.read_back(chat.format_turns(turns(spark, []))).collect() == []


def test_chat_segments_hold_no_foreign_control(spark):
    segments = chat.format_turns(chat.with_probe(turns(spark, [])))
    body = [r.segment for r in segments.filter("part = 1").collect()]
    assert body == ["\\\\\\### Assistant: \\</turn> ok"] * 2
    assert [r.loss for r in segments.orderBy("place", "part").collect()] == [False] * 4 + [True, False]
