import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from stockweave.llm import secrets as S

PATTERNS = {
    "assign": re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
SCHEMA = "doc_id long, text string, base string, run int, random string, hits array<string>, assign int, secret boolean"


def plain_base(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            enough = {"assign": lambda m: len(m[1]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}[kind](m)
            if enough:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def plain(text, scores, threshold=S.THRESHOLD):
    base = plain_base(text or "")
    extra = []
    for m in re.finditer("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", text or ""):
        codes = [0, *[S.ALPHABET.index(c) + 1 for c in m[0]]]
        score = sum(scores[a * 68 + b] for a, b in zip(codes, codes[1:]))
        if score >= threshold and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            extra.append((m.start(), 3, m.end(), "random"))
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    kinds = [k for *_, k in base]
    return (*[kinds.count(k) for k in PATTERNS], hashlib.sha256(join(base).encode()).hexdigest(), join(base + extra), len(extra))


def token(rng, n, alphabet=S.ALPHABET[:62]):
    return "".join(rng.choice(alphabet) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "b", 1, "r", ["h"], 2, True) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(5)
    known = [(token(rng, 40, "0123456789abcdef"), True) for _ in range(1500)] + [(token(rng, 36), True) for _ in range(3000)]
    words = ["get", "set", "user", "name", "config", "value", "index", "stream", "table", "partition", "window", "record", "Batch", "Path", "Filter", "_id", "-count", "2024", "4111"]
    plain_names = [("".join(rng.choice(words) for _ in range(4)), False) for _ in range(3000)] + [(token(rng, 16, "0123456789"), False) for _ in range(200)]
    return S.train(spark.createDataFrame([*known, *plain_names, (None, True), ("", False), ("x", None)], "value string, secret boolean"))


def test_base_and_added_spans_equal_plain_python(spark, scores):
    rng = random.Random(8)
    glue = [" ", "\n", "", "é", "\U0001f512", "=", ": ", "'", "\"", "\t", "K", "ſ"]
    bits = ["password", "PassWord", "paſſword", "secret", "token=", "TOKEN = \"", "api_key:", "apikey =", "passwd", "AKIA", "AKIAABCDEFGHIJKL", "abcdefgh", "short", "deadbeef" * 4, "0" * 31, "getUserNameConfig", "a.b=c-d_e/f+g"]
    rows = []
    for i in range(400):
        rows.append((i, "".join(rng.choice(bits + [token(rng, 20), token(rng, 33, "0123456789abcdef")]) + rng.choice(glue) for _ in range(rng.randint(0, 12)))))
    rows += [(900, "token = secret: abcdefghij"), (901, "token=token=abcdefgh"), (902, "AKIAXXXXXXXXTOKEN=abcdefghijkl"), (903, None), (904, ""), (905, "abcdefghAKIA" + "Z" * 20), (None, "password=hunter2222"), (5, rows[5][1]), (5, rows[5][1])]
    got = sorted((tuple(r) for r in S.find_secrets(frame(spark, rows), scores).collect()), key=str)
    assert got == sorted(((d, *plain(t, scores)) for d, t in rows), key=str)


def test_many_matches_in_one_long_text(spark, scores):
    rng = random.Random(2)
    text = "é ".join(rng.choice(["token=abcdefgh", token(rng, 24), "AKIA" + "Q" * 16, "word"]) for _ in range(4000))
    got = S.find_secrets(frame(spark, [(1, text)]), scores).first()
    assert tuple(got)[1:] == plain(text, scores)


def test_models_tell_held_out_strings_apart(spark, scores):
    rng = random.Random(77)
    secret = [token(rng, 24) for _ in range(100)] + [token(rng, 32, "0123456789abcdef") for _ in range(100)]
    names = ["".join(rng.sample(["user", "table", "stream", "record", "config", "Filter", "window", "Path"], 4)) for _ in range(200)]
    table = spark.createDataFrame([(v, True) for v in secret] + [(v, False) for v in names], "v string, secret boolean")
    got = table.select("secret", (S.ratio(F.col("v"), scores) >= S.THRESHOLD).alias("hit")).groupBy("secret", "hit").count().collect()
    counts = {(r.secret, r.hit): r["count"] for r in got}
    assert counts.get((True, True), 0) >= 195 and counts.get((False, True), 0) == 0


def test_training_from_documents_finds_unlisted_keys_and_leaves_prose_alone(spark):
    rng = random.Random(1)
    stems = ["ther", "ing", "onde", "schaft", "keit", "ation", "ment", "leque"]
    word = lambda: "".join(rng.choice(stems) for _ in range(rng.randint(1, 5)))
    styles = [word, lambda: rng.choice(S.ALPHABET[:26]) + word(), lambda: word().upper(), lambda: str(rng.randrange(10**9, 10**10))]
    prose = lambda: " ".join(rng.choice(styles)() for _ in range(60))
    rows = [(i, prose() + f" token = \"{token(rng, 40, '0123456789abcdef')}\" " + prose()) for i in range(40)]
    rows += [(100 + i, prose() + f" {token(rng, 32)} card 4111111111111111 " + prose()) for i in range(4)] + [(200 + i, prose()) for i in range(120)]
    got = {r.doc_id: r for r in S.scan(frame(spark, rows)).collect()}
    assert all(got[i].n_assign == 1 and got[i].n_hex == 1 and got[i].n_random == 0 for i in range(40))
    assert all(got[100 + i].n_random == 1 for i in range(4)) and all(got[200 + i].spans == "" for i in range(120))


def test_sample_is_bounded_and_the_same_at_every_size(spark):
    rows = [(i, "plainwords here") for i in range(50)]
    few = S.labelled_strings(frame(spark, rows), max_docs=10)
    assert few.filter("not secret").count() == 10
    assert S.labelled_strings(frame(spark, [(None, "plainwords")])).count() == 0
    assert S.scan(frame(spark, [])).collect() == []


def test_no_training_data_gives_equal_odds(spark):
    assert set(S.train(spark.createDataFrame([], "value string, secret boolean"))) == {0}


def test_the_scan_has_no_python(spark, scores):
    plan = S.find_secrets(frame(spark, [(1, "x")]), scores)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
