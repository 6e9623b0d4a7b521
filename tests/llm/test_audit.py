import random
from collections import Counter

import numpy as np
import pytest

from stockweave.llm import audit

DOCS = "doc_id long, text string, lang string, source string, n string, part int, fails int, digest string, good long, salt long"


def by_hand(docs, labels):
    """Every order walked document by document."""
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(smallest.get(t or "", d), d)
    out = Counter()
    parts = {lang or "" for *_, lang in docs}
    for d, t, lang in docs:
        text, words = t or "", (t or "").encode().split()
        bad = "".join(f for f, x in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            any(c in "#$%&*|" for c in text), d is not None and d > smallest[text])) if x)
        good, toxic = any(i == d and q == 1 for i, q, _ in labels), any(i == d and x == 1 for i, _, x in labels)
        for order in audit.ORDERS:
            gone = False
            for step, f in enumerate(order, 1):
                key = (lang or "", order, step)
                if f in bad:
                    out[*key, "redundant" if gone else "removed"] += 1
                    if not gone:
                        out[lang or "", f, "shapley"] += 1
                        out[*key, "good_lost"] += good and d is not None
                        out[*key, "toxic_lost"] += toxic and d is not None
                    gone = True
                out[*key, "unique_fails"] += bad == f
                out[*key, "kept"] += not gone
    return {
        (p, o, s + 1, *[out[p, o, s + 1, m] for m in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")], out[p, f, "shapley"])
        for p in parts for o in audit.ORDERS for s, f in enumerate(o)
    }


def run(spark, docs, labels):
    rows = [(d, t, lang, "s", "x", 1, 2, "y", 3, 4) for d, t, lang in docs]  # extra columns named like inner ones
    return {tuple(r) for r in audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}


def test_equals_a_walk_through_every_order(spark):
    rng = random.Random(3)
    texts = [None, "", " ".join(f"w{i}" for i in range(250)), "a b " * 150, "ABC " * 3 + "x " * 260, "# " + " ".join(f"é{i}" for i in range(199)), "Zürich é " * 120, "x y z " * 210]
    docs = [(i, rng.choice(texts), rng.choice([None, "", "en", "de", "fr"])) for i in range(60)]
    docs += [docs[3], docs[3], (None, texts[2], "en"), (None, texts[2], "en"), (5, texts[2], "fr"), (7, texts[3] * 2000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert run(spark, docs, labels) == by_hand(docs, labels)


def test_no_documents_and_no_labels(spark):
    assert run(spark, [], []) == set()
    got = run(spark, [(1, None, None)], [])
    assert len(got) == 600 and {r[0] for r in got} == {""}


def test_contraction_equals_sums_over_the_cells():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (2, 2, 2, 2, 2, 3))
    axes = rng.integers(0, 3, (40, 5))
    for got, row in zip(audit.contract(counts, axes), axes):
        cut = tuple({0: 0, 1: 1, 2: slice(None)}[a] for a in row)
        want = counts[cut].reshape(-1, 3).sum(axis=0)
        assert (got == want).all()


@pytest.mark.parametrize("letter", range(5))
def test_axes_follow_the_filters(letter):
    got = audit.tensor(np.array([1 << letter]), np.array([[7, 1, 0]]))
    at = tuple(int(i == letter) for i in range(5))
    assert got[at].tolist() == [7, 1, 0] and got.sum() == 8
