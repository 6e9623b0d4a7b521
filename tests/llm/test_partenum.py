import random

import numpy as np

from stockweave.llm import partenum


def brute(rows):
    """Smallest reachable doc_id by comparing every pair."""
    sets = {i: partenum.word_shingles((t or "").encode()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n long, gid string, size int")


def corpus(seed, n, passage=""):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows, i = [], 0
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 60, 90, 300]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 40])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[: max(1, int(len(copy) * rng.uniform(0.7, 1)))]
            rows.append((i, (passage if rng.random() < 0.5 else "") + rng.choice([" ", "\n", "\t "]).join(copy).title()))
            i += 1
    rng.shuffle(rows)
    return rows


def got(spark, rows):
    out = partenum.near_groups(frame(spark, rows).repartition(3)).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def test_equals_brute_force(spark):
    rows = corpus(5, 250) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE  two"), (9005, "two one")]
    assert got(spark, rows) == brute(rows)


def test_equals_brute_force_with_a_common_passage(spark):
    rows = corpus(6, 200, "it is a passage that stands at the head of half of all the documents here and that is long ")
    assert got(spark, rows) == brute(rows)


def test_threshold_is_met_exactly(spark):
    words = [f"v{i}" for i in range(200)]
    rows = [(1, " ".join(words[:11])), (2, " ".join(words[:10]) + " z"), (3, " ".join(words[:9]) + " y x")]  # 7 shingles each: 6/8 and 5/9 shared with 1
    assert got(spark, rows) == brute(rows)
    assert brute(rows)[2][1] == 1 and brute(rows)[3][1] == 3 or brute(rows)[3][1] == 1


def test_signatures_miss_no_similar_pair():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.choice([1, 2, 3, 4, 7, 30, 47, 64, 65, 90, 250, 257, 400, 1100]))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        worst = n // 4
        b = base[int(rng.integers(0, worst + 1)) :]
        a = np.unique(base)
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, max(0, int(len(b) / 0.75) - n), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 75 * (len(a) + len(b) - shared):
            continue
        level = lambda s: (s >> np.uint64(7) & np.uint64(15)).astype(np.uint8)
        assert len(np.intersect1d(partenum.signatures(a, level(a)), partenum.signatures(b, level(b)))), (len(a), len(b))


def test_empty_table_repeated_rows_null_id(spark):
    assert partenum.near_groups(frame(spark, [])).collect() == []
    text = " ".join("abcdefgh")
    rows = [(3, text), (3, text), (None, text), (2, "other words")]
    out = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in partenum.near_groups(frame(spark, rows)).collect())
    assert out == [(-1, 4, 3), (2, 1, 2), (3, 4, 3), (3, 4, 3)]
    kept = partenum.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and len(kept.columns) == 5


def passage_documents(seed, n, shared, own, copies):
    """Documents that are a common passage for the most part, with words of their own; some have near copies."""
    rng = random.Random(seed)
    passages = [[f"p{k}x{i}" for i in range(shared)] for k in range(2)]
    rows = []
    while len(rows) < n:
        text = passages[rng.random() < 0.3] + ([f"s{i}" for i in range(own)] if rng.random() < 0.4 else []) + [f"d{len(rows)}x{i}" for i in range(rng.randint(own // 2, 2 * own))]
        for c in range(rng.choice([1, 1, copies])):
            rows.append((len(rows), " ".join(text + [f"c{len(rows)}x{i}" for i in range(c % 3)])))
    return rows


def test_documents_of_mostly_one_passage_equal_brute_force(spark):
    rows = passage_documents(3, 220, 70, 25, 3) + passage_documents(4, 60, 80, 9, 2)[:60]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert got(spark, rows) == brute(rows)


def test_large_groups_on_hub_and_feature_get_hubs_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(partenum, "FEW_OPEN", 4)
    rows = passage_documents(7, 160, 60, 24, 4)
    assert got(spark, rows) == brute(rows)


def test_what_members_share_outside_the_hub(spark):
    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(4000):
        core = set(range(60))
        make = lambda: {*rng.choice(60, int(rng.integers(30, 61)), replace=False).tolist()} | {*(100 + rng.choice(40, int(rng.integers(0, 30)), replace=False)).tolist()}
        h, a, b = sorted((make(), make(), make()), key=len)
        a, b = (a, b) if rng.random() < 0.5 else (b, a)
        near = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
        if near(a, b) and not near(a, h):
            hits += 1
            assert core and len((a & b) - h) >= partenum.needed_outside(len(a), len(h), len(a & h), True)
            assert len((a & b) - h) >= partenum.needed_outside(len(b), len(h), len(b & h), not near(b, h))
    assert hits > 50


def test_null_and_shared_ids_lose_no_link(spark):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    near = lambda words, tail: " ".join(words + [tail])
    rows = [(None, " ".join(a)), (None, " ".join(b)), (7, near(a, "x")), (8, near(b, "y")), (9, near(b, "z"))]
    out = {(r.doc_id, r.component_id) for r in partenum.near_groups(frame(spark, rows)).collect()}
    assert out == {(None, 7), (None, 8), (7, 7), (8, 8), (9, 8)}
    rows = [(1, " ".join(a)), (1, " ".join(b)), (8, near(b, "y"))]
    assert {(r.doc_id, r.component_id) for r in partenum.near_groups(frame(spark, rows)).collect()} == {(1, 1), (8, 1)}


def far_from_the_hub(seed, groups, each):
    """Near copies of texts that hold most of a shorter one, but are not near it: every group hangs on the shorter one's features."""
    rng = random.Random(seed)
    hub = [f"h{i}" for i in range(80)]
    rows = [" ".join(hub)]
    for g in range(groups):
        base = hub + [f"g{g}x{i}" for i in range(36)]
        for c in range(each):
            at = rng.randrange(100, 112)
            rows.append(" ".join(base[:at] + [f"c{g}x{c}"] + base[at + 1 :]))
    return list(enumerate(rows))


def test_open_groups_make_no_rows_for_features_or_pairs(spark, monkeypatch):
    rows, put, made = far_from_the_hub(1, 12, 12), partenum.Stages.put, {}

    def counted(self, name, df):
        out = put(self, name, df)
        made[name] = out.count()
        return out

    monkeypatch.setattr(partenum.Stages, "put", counted)
    assert got(spark, rows) == brute(rows)
    made.pop("first"), made.pop("groups")  # pieces of the sketch, members by signature
    assert max(made.values()) <= 6 * len(rows), made


def test_blocks_of_open_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(partenum, "FEW_OPEN", 7)
    rows = [(i, t) for i, (_, t) in enumerate(far_from_the_hub(2, 9, 9) + passage_documents(8, 100, 60, 24, 4))]
    assert got(spark, rows) == brute(rows)
