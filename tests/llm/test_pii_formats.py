import re

from stockweave.llm import pii
from tests.llm.test_langid_pii_licences_mixing import frame, luhn


def rewritten(spark, values):
    rows = pii.pseudonymise(frame(spark, [(i, v, None) for i, v in enumerate(values)]), "k").collect()
    return [(r.text, r.n_private) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_marked_phones_of_any_area_code_are_replaced(spark):
    values = ["+1 (017) 555-7713", "+1 (171) 555-2028", "(017) 155-7713", "+1 017-555-7713", "+10175557713", "+1 (988) 555-2485"]
    out = rewritten(spark, values)
    shape = lambda s: re.sub(r"\d", "9", s)
    assert all(n == 1 and t != v and shape(t) == shape(v) for (t, n), v in zip(out, values))
    last = [re.sub(r"\D", "", t)[-10:] for t, _ in out]
    assert last[0] == last[3] == last[4] and all((x[0] < "2" or x[3] < "2") for x in last[:5]) and last[5][0] >= "2" and last[5][3] >= "2"
    many = rewritten(spark, [f"+1 ({i:03d}) {e:03d}-7713" for i in range(0, 1000, 37) for e in range(0, 1000, 41)])
    assert len({t for t, _ in many}) == len(many)


def test_cards_beside_other_numbers_are_replaced(spark):
    card, grouped, amex = "4111111111111111", "4111 1111 1111 1111", "3782 822463 10005"
    rest = ["{} 12 apples", "12 {}", "2024 {}", "{} 123", "pay {} 5 times", "41 {} 7"]
    values = [r.format(c) for r in rest for c in (card, grouped, amex)]
    for (t, n), v in zip(rewritten(spark, values), values):
        assert n == 1 and not any(c in t for c in (card, grouped, amex)), (v, t)
        assert re.sub(r"\d", "9", t) == re.sub(r"\d", "9", v)
    (text, n), (other, m) = rewritten(spark, [f"{card} 190.137.223.204", f"{card} {card}"])
    assert n == 2 and "190.137.223.204" not in text and luhn(text.split()[0])
    assert m == 2 and card not in other


def test_cards_in_other_groupings_still_are(spark):
    values = ["41 11111 111 111111", "4111-1111-1111-1111", "6304 0000 0000 0000 000"]
    assert [n for _, n in rewritten(spark, values)] == [int(luhn(v)) for v in values]
