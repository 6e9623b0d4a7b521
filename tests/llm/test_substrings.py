import hashlib
import random

import numpy as np
import pytest

from stockweave.llm import substrings
from stockweave.llm.fmindex import FMIndex


def longest_in_smaller(sequences, documents):
    out = []
    for s, d in zip(sequences, documents):
        reach = [0] * len(s)
        for t, e in zip(sequences, documents):
            for i in range(len(s)) if e < d else ():
                for j in range(len(t)):
                    k = 0
                    while i + k < len(s) and j + k < len(t) and s[i + k] == t[j + k]:
                        k += 1
                    reach[i] = max(reach[i], k)
        out.append(reach)
    return out


@pytest.mark.parametrize("seed", range(25))
def test_matching_statistics_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    sequences = [rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 15))) for _ in range(int(rng.integers(1, 12)))]
    sequences += [s.copy() for s in sequences[: seed % 3]]
    documents = rng.integers(0, 6, len(sequences))
    wide = max(map(len, sequences))
    streams = np.zeros((len(sequences), wide), dtype=np.int64)
    for i, s in enumerate(sequences):
        streams[i, wide - len(s) :] = s
    got = FMIndex(sequences, documents).matching_statistics(streams, documents)
    assert [got[i, wide - len(s) :].tolist() for i, s in enumerate(sequences)] == longest_in_smaller(sequences, documents)


def brute(rows):
    first = {}
    for i, text in rows:
        words = (text or "").split()
        for a in range(len(words) - 49):
            key = tuple(words[a : a + 50])
            first[key] = min(first.get(key, 1 << 62), i)
    out = []
    for i, text in rows:
        words = (text or "").split()
        gone = [False] * len(words)
        for a in range(len(words) - 49):
            if first[tuple(words[a : a + 50])] < i:
                gone[a : a + 50] = [True] * 50
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", 3) for i, t in rows], "doc_id long, text string, doc int, place string, mask int").repartition(3)
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(df).collect())


def test_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (49, 50, 51, 60, 130, 300)]
    rows = []
    for i in range(120):
        body = [rng.choice(words) for _ in range(rng.choice([0, 3, 30, 80, 200]))]
        for _ in range(rng.choice([0, 1, 2])):
            p = rng.choice(passages)
            a = rng.randrange(3)
            at = rng.randrange(len(body) + 1)
            body[at:at] = p[a:] if rng.random() < 0.8 else p[a : len(p) // 2] + ["edit"] + p[len(p) // 2 :]
        rows.append((i * 7 % 120, rng.choice([" ", "\n", "  "]).join(body)))
    rows += [(500, None), (501, ""), (502, "x " * 400), (503, "x " * 90), (504, " ".join(["a", "b"] * 60))]
    rows += [(600 + k, rows[3][1]) for k in range(5)]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(70))
    rows = [(1, text), (1, text), (2, text)]
    assert [r[2] for r in run(spark, rows)] == [0, 0, 70]
    assert run(spark, []) == []


def test_null_id_is_the_largest(spark):
    text = " ".join(f"t{i}" for i in range(70))
    df = spark.createDataFrame([(None, text), (5, text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).collect()} == {None: 70, 5: 0}
