import hashlib
import random
import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.llm import langid, licences, mixing, pii

DOCS = "doc_id long, text string, lang string, n long, word string, rate int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, "w", 3) for i, t, lang in rows], DOCS)


# ---------------------------------------------------------------- language ID
STEMS = {"aa": ["bani", "kuna", "tamo", "rilu"], "bb": ["schrot", "zwerg", "knall", "pflug"], "cc": ["eauxi", "oisel", "aimon", "veuve"]}


def texts(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(STEMS[lang]) + rng.choice(["", "s", "e", "en"]) for _ in range(20)), lang) for i, lang in ((i, rng.choice(list(STEMS))) for i in range(n))]


def test_langid_held_out_accuracy_and_whole_result(spark):
    rows = texts(400)
    out = langid.identify(frame(spark, rows)).collect()
    assert len(out) == 400
    lang = {i: x for i, _, x in rows}
    held = [r for r in out if r.held_out]
    assert 50 < len(held) < 150 and all(r.lang_pred == lang[r.doc_id] and 0.9 < r.score <= 1 for r in held)


def test_langid_backs_off_for_unseen_words(spark):
    model = langid.train(frame(spark, texts(300)))
    out = langid.predict(frame(spark, [(1, "Schrotpflug zwergknall", None), (2, "eauxoisel", None)]), model).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {1: "bb", 2: "cc"}
    assert "schrotpflug" not in model.words


def test_langid_never_reads_the_answer(spark):
    model = langid.train(frame(spark, texts(200)))
    a = langid.predict(frame(spark, [(1, "bani kuna", "aa")]), model).first()
    b = langid.predict(frame(spark, [(99, "bani kuna", "cc")]), model).first()
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score)


def test_langid_edges(spark):
    rows = texts(100) + [(200, None, "aa"), (201, "", None), (202, "12 34 !", "bb"), (203, "½ ²", None), (204, "x" * 50_000, None), (None, "bani", None), (205, "bani", None), (205, "bani", None)]
    out = langid.identify(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (200, 201, 202, 203))
    assert by[204].lang_pred in STEMS and by[None].lang_pred == "aa" and not by[None].held_out
    assert langid.identify(frame(spark, [])).collect() == []
    assert [r.lang_pred for r in langid.identify(frame(spark, [(1, "no labels", None)])).collect()] == ["und"]
    kept = langid.keep_known(frame(spark, rows))
    assert kept.count() == len(rows) - 5 + 1 - (by[204].score < 0.5) and kept.columns == [f.split()[0] for f in DOCS.split(", ")]


# ---------------------------------------------------------------- pseudonyms
def luhn(number):
    digits = [int(c) for c in number if c.isdigit()]
    return sum(d if i % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(reversed(digits))) % 10 == 0


def feistel(left, right, lefts, rights, kind, key):
    """The permutation once more, in plain Python."""
    a, b = left, right
    for i in range(pii.ROUNDS):
        digest = int(hashlib.sha256(f"{key}:{kind}:{i}:{b}".encode()).hexdigest()[:12], 16)
        a, b = b, (a + digest) % (lefts if i % 2 == 0 else rights)
    return a, b


def rewritten(spark, values, key="k"):
    rows = pii.pseudonymise(frame(spark, [(i, v, None) for i, v in enumerate(values)]), key).collect()
    return {r.doc_id: r for r in rows}


def test_pii_keeps_formats_and_matches_plain_python(spark):
    start = date(1800, 1, 1)
    values = ["4111 1111 1111 1111", "4111111111111111", "192.168.7.9", "2020-02-29", "02/29/2020", "29.02.2020", "123-45-6789", "+1 (988) 555-2485", "988-555-2485"]
    out = rewritten(spark, values)
    assert all(out[i].n_private == 1 and re.sub(r"\d", "9", out[i].text) == re.sub(r"\d", "9", v) for i, v in enumerate(values) if i != 2)
    card = out[1].text
    half = feistel(1111111, 1111111, 10**7, 10**7, "card", "k")
    assert card[:15] == f"4{half[0]:07d}{half[1]:07d}" and luhn(card) and out[0].text.replace(" ", "") == card
    a, b = feistel(192 * 256 + 168, 7 * 256 + 9, 65536, 65536, "ip", "k")
    assert out[2].text == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    day = (date(2020, 2, 29) - start).days
    a, b = feistel(day // 233, day % 233, 627, 233, "date", "k")
    new = start + timedelta(days=a * 233 + b)
    assert [out[i].text for i in (3, 4, 5)] == [f"{new:%Y-%m-%d}", f"{new:%m/%d/%Y}", f"{new:%d.%m.%Y}"]
    a, b = feistel(123 - 1, 44 * 9999 + 6788, 898, 989901, "ssn", "k")
    assert out[6].text == f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    assert out[7].text[-8:] == out[8].text[-8:] and out[7].text[4:7] == out[8].text[:3]


def test_pii_is_a_permutation_and_keyed(spark):
    values = [f"10.0.{i}.{j}" for i in range(3) for j in range(100)]
    one, two = rewritten(spark, values), rewritten(spark, values, "other")
    assert len({r.text for r in one.values()}) == 300 and sum(one[i].text == two[i].text for i in one) < 3


def test_pii_leaves_the_rest_alone(spark):
    values = ["4111111111111112", "1.2.3.4.5", "300.1.1.1", "2021-02-30", "000-12-3456", "version 10.2", "no", "", None, "a\x01b\x02c 1", "id 12345678901234567890123"]
    out = rewritten(spark, values)
    assert all(out[i].text == v and out[i].n_private == 0 for i, v in enumerate(values))


def test_pii_inside_texts_ties_repeats_long_empty(spark):
    long = "wörd " * 20_000 + "a.b@mail.example.com 192.168.7.9\x01"
    df = frame(spark, [(1, "x a.b@mail.example.com y A.B@mail.example.com", None), (1, "x a.b@mail.example.com y A.B@mail.example.com", None), (2, long, None)])
    rows = pii.pseudonymise(df.withColumn("n_private", F.lit("old")), "k").collect()
    assert len(rows) == 3 and {r.n_private for r in rows} == {2}
    one, two, big = sorted(rows, key=lambda r: len(r.text))
    assert one.text == two.text and len(set(re.findall(r"\S+@\S+", one.text))) == 1 and "mail.example" not in one.text
    assert big.text.startswith("wörd " * 20_000) and big.text.endswith("\x01")
    assert pii.pseudonymise(df.filter("false"), "k").collect() == []


# ---------------------------------------------------------------- licences
def plain_scan(text, threshold=licences.THRESHOLD):
    units = (text or "").split("\n") + [p for p in re.split("\n[ \t\r]*\n", text or "") if "\n" in p]
    sets = {n: set(licences.bigram_set(t)) for n, t in licences.TEMPLATES.items()}
    hits = []
    for u in units:
        w = re.sub("[^a-z0-9]+", " ", u.lower()).split()
        g = {f"{a} {b}" for a, b in zip(w, w[1:])}
        hits.append([(2 * len(g & s) / (len(g) + len(s)), n) for n, s in sets.items() if g and 2 * len(g & s) / (len(g) + len(s)) >= threshold])
    flat = sorted((-d, n) for h in hits for d, n in h)
    return sum(map(bool, hits)), flat[0][1] if flat else None, -flat[0][0] if flat else None, sorted({n for _, n in flat})


def test_licences_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [None, "", "\n\n", "one", "license", "x " * 30_000 + "\nReleased under the MIT License."]
    for _ in range(150):
        words = list(rng.choice(list(licences.TEMPLATES.values())).split())
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(["the", "License", "foo", "2.0"])
        line = rng.choice([" ", "  ", ", "]).join(words)
        if rng.random() < 0.3:
            line = line.replace(" ", "\n", 1)
        rows.append(rng.choice(["", "some text before\n", "para\n\n"]) + line + rng.choice(["", "\nafter it", "\n \nnext para\nof two"]))
    out = licences.scan(frame(spark, [(i, t, None) for i, t in enumerate(rows)])).collect()
    assert len(out) == len(rows)
    for r in out:
        n, best, dice, names = plain_scan(rows[r.doc_id])
        assert (r.n_units, r.licence, list(r.licences)) == (n, best, names) and (dice is None) == (r.dice is None) and abs((dice or 0) - (r.dice or 0)) < 1e-12, rows[r.doc_id]


def test_licences_repeats_empty_table(spark):
    df = frame(spark, [(1, "Released under the MIT License.", None)] * 2)
    assert [r.licence for r in licences.scan(df).collect()] == ["MIT", "MIT"]
    assert licences.scan(df.filter("false")).collect() == []


# ---------------------------------------------------------------- mixing
def mixed_corpus(n=300):
    rng = random.Random(9)
    kinds = {"x": ["red", "blue", "green"], "y": ["cat", "dog", "cow"]}
    rows, labels = [], []
    for i in range(n):
        kind = "x" if rng.random() < 0.7 else "y"
        rows.append((i, " ".join(rng.choice(kinds[kind] + ["and", "of"]) for _ in range(rng.choice([5, 20, 60]))), kind))
        if i % 3 == 0:
            labels.append((i, kind))
    return rows, labels


def test_mixing_meets_targets_with_nonnegative_rates(spark):
    rows, labels = mixed_corpus()
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string")
    out = mixing.mixing_rates(df, lab, {"x": 2, "y": 2}).collect()
    assert len(out) == 300 and all(r.rate >= 0 and abs(r.p_x + r.p_y - 1) < 1e-9 for r in out)
    total = sum(r.n_tokens for r in out)
    assert abs(sum(r.rate * r.n_tokens * r.p_y for r in out) / total - 0.5) < 1e-3
    kind = {i: k for i, _, k in rows}
    assert sum((r.p_y > 0.5) == (kind[r.doc_id] == "y") for r in out) >= 295
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in out)
    taken = mixing.mixed(df, lab, {"x": 2, "y": 2})
    assert taken.columns == df.columns and taken.count() == sum(r.copies for r in out)


def test_mixing_clips_at_zero(spark):
    rows, labels = mixed_corpus()
    out = mixing.mixing_rates(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string"), {"x": 0, "y": 1}).collect()
    total = sum(r.n_tokens for r in out)
    assert min(r.rate for r in out) == 0 and abs(sum(r.rate * r.n_tokens * r.p_y for r in out) / total - 1) < 0.02


def test_mixing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    df = frame(spark, [(1, None, None), (2, "", None), (3, "a b", None), (3, "a b", None), (None, "c", None)])
    out = mixing.mixing_rates(df, none, {"x": 3, "y": 1}).collect()
    assert len(out) == 4 and all(abs(r.rate - 1) < 1e-6 and abs(r.p_x - 0.75) < 1e-9 for r in out)
    assert mixing.mixed(df, none, {"x": 3, "y": 1}).count() == 5
    assert mixing.mixing_rates(df.filter("false"), none, {"x": 1}).collect() == []
    with pytest.raises(ValueError):
        mixing.mixing_rates(df, none, {"x": 0})
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 1), (5, None, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.domain for r in mixing.label_domains(labels).collect()} == {1: "good", 2: "plain", 3: "toxic", 4: "toxic"}


def plain_rates(n, p, targets):
    """``mixing.solve`` over arrays: rates and totals."""
    n = n / n.sum()

    def at(dual):
        raw = 1 - p @ dual
        rate = np.maximum(raw, 0)
        return (rate * n) @ p, (rate**2 * n).sum() / 2, (p * (n * (raw > 0))[:, None]).T @ p

    rate = np.maximum(1 - p @ mixing.solve(at, lambda v: (p @ v).min(), targets), 0)
    return rate, (rate * n) @ p


def hot_domain(soft, rows=4000):
    rng = np.random.default_rng(5)
    p = np.exp(rng.normal(0, 1, (rows, 3)) + soft * np.eye(3)[rng.choice(3, rows, p=[0.98, 0.01, 0.01])])
    return rng.integers(5, 400, rows), p / p.sum(axis=1, keepdims=True)


def test_mixing_meets_targets_with_soft_posteriors_and_a_hot_domain(spark):
    n, p = hot_domain(2.5)
    df = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(n, p)], "n_tokens long, p0 double, p1 double, p2 double").coalesce(2)
    out = mixing.fit_rates(df, [0.3, 0.4, 0.3]).collect()
    got = sum(r.rate * r.n_tokens * np.array([r.p0, r.p1, r.p2]) for r in out) / n.sum()
    assert len(out) == 4000 and min(r.rate for r in out) == 0 and np.abs(got - [0.3, 0.4, 0.3]).max() < mixing.CLOSE
    rate, _ = plain_rates(n, p, [0.3, 0.4, 0.3])
    assert np.abs(np.array([r.rate for r in out]) - rate).max() < 1e-6


@pytest.mark.parametrize("soft", [0.5, 1.0, 2.5, 6.0])
@pytest.mark.parametrize("targets", [[0.3, 0.4, 0.3], [0.9, 0.08, 0.02], [0.4, 0.3, 0.3]])
def test_mixing_targets_within_reach_are_met(soft, targets):
    rate, totals = plain_rates(*hot_domain(soft), targets)
    assert rate.min() >= 0 and np.abs(totals - targets).max() < mixing.CLOSE


def test_mixing_finds_the_nearest_totals_where_targets_are_out_of_reach():
    n, p = np.array([10, 30, 20, 40]), np.array([[0.5, 0.5], [0.6, 0.4], [0.8, 0.2], [0.55, 0.45]])
    w = np.linalg.inv((p * (n / 100)[:, None]).T @ p + np.eye(2) * 1e-6)
    best = p[0] * (p[0] @ w @ [0.1, 0.9]) / (p[0] @ w @ p[0])  # on the edge of the cone, the first row's ray
    rate, totals = plain_rates(n, p, [0.1, 0.9])
    assert np.abs(totals - best).max() < mixing.CLOSE and rate[1:].max() < 0.01
    rate, totals = plain_rates(np.array([10, 30]), np.array([[1.0, 1e-22]] * 2), [0.7, 0.3])
    assert np.abs(totals - [0.7, 0]).max() < 1e-3


def test_mixing_raises_when_no_solution_is_reached(monkeypatch):
    monkeypatch.setattr(mixing, "MAX_EVALUATIONS", 1)
    with pytest.raises(RuntimeError, match="mixing rates not found"):
        plain_rates(*hot_domain(1.0), [0.3, 0.4, 0.3])


def test_langid_model_comes_to_the_driver_as_columns(spark):
    counts = spark.createDataFrame([("aa", "x", 3), ("bb", "x", 2), ("aa", "y", 4), ("bb", "z", 1)], "lang string, item string, n long")
    rows, totals = langid.most_frequent(counts, 2)
    assert rows.schema.names == ["item", "lang", "n"] and rows.num_rows == 3  # an Arrow table, no Row objects
    items, table = langid.log_frequencies(rows, ["aa", "bb"], totals, 0.5)
    assert items == {"x": 0, "y": 1} and totals == {"aa": 7, "bb": 3}
    assert np.allclose(np.exp(table), [[3.5 / 8, 2.5 / 4], [4.5 / 8, 0.5 / 4]])


def test_sketch_levels_hold_one_array_of_all_cells():
    import tracemalloc

    from stockweave.llm import sketch

    class Sent:
        def __getattr__(self, name):
            return lambda *_: self

        def collect(self):
            return ({"piece": i, "counts": np.full(sketch.PIECE, i, dtype=np.int64).tobytes()} for i in range(sketch.CELLS // sketch.PIECE))

    tracemalloc.start()
    levels = sketch.levels(Sent())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(levels) == sketch.CELLS and levels[0] == 0 and levels[-1] > 0
    assert peak < 12 * sketch.CELLS
