"""Private values replaced by format-preserving pseudonyms: a keyed Feistel permutation within each format.

Recognised and validated: payment cards (Luhn), North American phone numbers, social security numbers, IPv4 addresses and
dates from 1800 to 2199. Each kind is a pair of numbers (l, r) with l < L and r < R, permuted by eight Feistel rounds whose
round function is SHA-256 of key, kind, round and half. So a value keeps its format and validity, different values stay
different and equal values stay equal in all documents, however they are punctuated. E-mail addresses, which are no
numbers, become keyed digests in the form of an address.

All of it is one column expression for each row: no exchange, no Python. A text is split around its matches; those that
fail validation stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import unused

ROUNDS = 8

#: The formats, as regular expressions; the first that fits a match names its kind.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
QUADS = r"(?:[3-6]\d|2[2-7])\d\d(?:[ -]\d{4}){3}"
CARD = rf"(?:\d{{13,19}}|{QUADS}(?:[ -]\d{{3}})?|3\d{{3}}[ -]\d{{6}}[ -]\d{{4,5}})(?![\w-])"
KINDS = {
    "email": r"(?<![\w.+-])[\w.+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}",
    "iso_date": r"(?<![\d.-])(?:1[89]|2[01])\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
    "us_date": r"(?<![\d/])(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:1[89]|2[01])\d\d(?![\d/])",
    "eu_date": r"(?<![\d.])(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.(?:1[89]|2[01])\d\d(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    # +1 or brackets mark a phone, so any digits do; the rest is held to the numbering plan
    "phone": r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)[ .-]?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}|(?:1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[ .-]?)?[2-9]\d\d[ .-][2-9]\d\d[ .-]\d{4})(?![\w-])",
    # one run or regular groups; else any grouping, but not over the start of a card in regular form or into an address or date
    "card": rf"(?<![\w.-])(?:{CARD}|\d(?:\d|[ -](?!{CARD})\d){{12,18}}(?![\w-]|[./]\d))",
}
#: 400 years of the calendar have 146,097 days, which is 627 * 233.
DATE_FORMATS = {"iso_date": "yyyy-MM-dd", "us_date": "MM/dd/yyyy", "eu_date": "dd.MM.yyyy"}


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to the value of an expression that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def text_literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(left: str, right: str, lefts: str, rights: str, kind: str, key: str) -> str:
    """A struct (a, b): the permuted pair. The halves change places each round, so their moduli take turns."""
    digest = f"cast(conv(substr(sha2(concat_ws(':', {text_literal(key)}, '{kind}', cast(i as string), cast(s.b as string)), 256), 1, 12), 16, 10) as bigint)"
    step = f"named_struct('a', s.b, 'b', (s.a + {digest}) % if(i % 2 = 0, {lefts}, {rights}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({left} as bigint), 'b', cast({right} as bigint)), (s, i) -> {step})"


def digits_of(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def luhn_sum(digits: str) -> str:
    """Luhn sum of a digit string, the last digit counting once."""
    x = f"cast(substr({digits}, length({digits}) - j + 1, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0L, (t, j) -> t + if(j % 2 = 1, cast({x} as bigint), (2 * {x}) div 10 + (2 * {x}) % 10))"


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order by those of ``digits``."""
    return f"array_join(transform(sequence(1, length({shape})), p -> if(substr({shape}, p, 1) between '0' and '9', substr({digits}, length({digits_of(f'substr({shape}, 1, p)')}), 1), substr({shape}, p, 1))), '')"


def card(key: str) -> str:
    """The first digit (issuer class) stays, the check digit is made anew, the digits between are permuted."""
    half = "((length(d) - 2) div 2)"
    left, right = f"substr(d, 2, {half})", f"substr(d, 2 + {half}, length(d) - 2 - {half})"
    pair = feistel(left, right, f"cast(pow(10, {half}) as bigint)", f"cast(pow(10, length(d) - 2 - {half}) as bigint)", "card", key)
    body = f"concat(substr(d, 1, 1), lpad(cast(f.a as string), {half}, '0'), lpad(cast(f.b as string), length(d) - 2 - {half}, '0'))"
    checked = let("n", body, f"concat(n, cast((10 - {luhn_sum('concat(n, 0)')} % 10) % 10 as string))")
    made = let("f", pair, let("g", checked, refill("m", "g")))
    valid = let("d", digits_of("m"), f"if({luhn_sum('d')} % 10 = 0, {made}, null)")
    # three digits after four groups are part of the card or a number beside it
    beside = f"if(m rlike {text_literal('^' + QUADS + '[ -][0-9]{3}$')}, concat({let('m', 'substr(m, 1, 19)', valid)}, substr(m, 20)), null)"
    return f"coalesce({valid}, {beside})"


def phone(key: str) -> str:
    """Numbers of the numbering plan (area and exchange from 200) stay such; the 3.6e9 others are permuted among themselves."""
    pair = feistel("substr(d, -10, 3) - 200", "substr(d, -7, 7) - 2000000", "800L", "8000000L", "phone", key)
    made = "concat(substr(d, 1, length(d) - 10), cast(200 + f.a as string), cast(2000000 + f.b as string))"
    area, rest = "cast(substr(d, -10, 3) as bigint)", "cast(substr(d, -7, 7) as bigint)"
    place = f"if({area} < 200, {area} * 10000000 + {rest}, 2000000000 + ({area} - 200) * 2000000 + {rest})"
    other = feistel("n div 60000", "n % 60000", "60000L", "60000L", "phone-other", key)
    number = "if(x < 2000000000, x, 2000000000 + ((x - 2000000000) div 2000000) * 10000000 + (x - 2000000000) % 2000000)"
    remade = let("n", place, let("f", other, let("x", "f.a * 60000 + f.b", f"concat(substr(d, 1, length(d) - 10), lpad(cast({number} as string), 10, '0'))")))
    planned = f"{area} >= 200 and {rest} >= 2000000"
    return let("d", digits_of("m"), let("g", f"if({planned}, {let('f', pair, made)}, {remade})", refill("m", "g")))


def ssn(key: str) -> str:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area = "(cast(substr(m, 1, 3) as int) - if(cast(substr(m, 1, 3) as int) > 666, 2, 1))"
    pair = feistel(area, "(cast(substr(m, 5, 2) as int) - 1) * 9999 + cast(substr(m, 8, 4) as int) - 1", "898L", "989901L", "ssn", key)
    made = "concat_ws('-', lpad(cast(f.a + if(f.a >= 665, 2, 1) as string), 3, '0'), lpad(cast(f.b div 9999 + 1 as string), 2, '0'), lpad(cast(f.b % 9999 + 1 as string), 4, '0'))"
    valid = "substr(m, 1, 3) not in ('000', '666') and substr(m, 1, 1) <> '9' and substr(m, 5, 2) <> '00' and substr(m, 8, 4) <> '0000'"
    return f"if({valid}, {let('f', pair, made)}, null)"


def ip(key: str) -> str:
    half = lambda a, b: f"(cast(o[{a}] as bigint) * 256 + cast(o[{b}] as bigint))"
    pair = feistel(half(0, 1), half(2, 3), "65536L", "65536L", "ip", key)
    made = "concat_ws('.', f.a div 256, f.a % 256, f.b div 256, f.b % 256)"
    return let("o", "split(m, '[.]')", let("f", pair, made))


def date(kind: str, key: str) -> str:
    """Any day of the 400 years may become any other; the same day gets the same pseudonym in each of the formats."""
    fmt = DATE_FORMATS[kind]
    pair = feistel("d div 233", "d % 233", "627L", "233L", "date", key)
    made = f"date_format(date_add(date'1800-01-01', cast(f.a * 233 + f.b as int)), '{fmt}')"
    day = f"datediff(try_to_date(m, '{fmt}'), date'1800-01-01')"
    return let("d", day, f"if(d is null, null, {let('f', pair, made)})")


def email(key: str) -> str:
    made = "concat('u', substr(h, 1, 12), '@m', substr(h, 13, 8), '.invalid')"
    return let("h", f"sha2(concat_ws(':', {text_literal(key)}, 'email', lower(m)), 256)", made)


def pseudonym(key: str) -> str:
    """Pseudonym of a match ``m``, null if it isn't valid."""
    makers = {"email": email(key), **{k: date(k, key) for k in DATE_FORMATS}, "ssn": ssn(key), "ip": ip(key), "phone": phone(key), "card": card(key)}
    whole = {k: text_literal("^(?:" + p + ")$") for k, p in KINDS.items()}
    return "case " + " ".join(f"when m rlike {whole[k]} then {makers[k]}" for k in KINDS) + " end"


def pseudonymise(documents: DataFrame, key: str) -> DataFrame:
    """All columns with ``text`` rewritten, and ``n_private``: how many values were replaced.

    Null text stays null with 0; a text without matches stays as it is, to the byte. Repeated rows are each rewritten. A
    column n_private of the input is replaced. Characters U+0001 and U+0002 in a text come out unharmed.
    """
    mark, esc = "\x01", "\x02"
    every = "|".join(KINDS.values())
    safe = F.when(F.col("text").rlike(f"[{mark}{esc}]"), F.replace(F.replace("text", F.lit(esc), F.lit(esc + "\x04")), F.lit(mark), F.lit(esc + "\x03"))).otherwise(F.col("text"))
    # without a digit or an @ there is nothing to find
    marked = F.when(F.col("text").rlike("[0-9@]"), F.regexp_replace(safe, f"(?:{every})", f"{mark}$0{mark}")).otherwise(safe)
    marks, pieces, new = map(unused, ("marked", "parts", "new"))
    parts = F.when(F.col(marks).contains(mark), F.split(marks, mark))
    # after the split every second part is a match
    made = f"transform({pieces}, (m, k) -> if(k % 2 = 0, named_struct('t', m, 'hit', 0), {let('q', pseudonym(key), 'named_struct(' + chr(39) + 't' + chr(39) + ', coalesce(q, m), ' + chr(39) + 'hit' + chr(39) + ', if(q is null, 0, 1))')}))"
    plain = F.coalesce(F.array_join(F.col(f"{new}.t"), ""), F.col(marks))
    back = F.when(plain.contains(esc), F.replace(F.replace(plain, F.lit(esc + "\x03"), F.lit(mark)), F.lit(esc + "\x04"), F.lit(esc))).otherwise(plain)
    rest = [c for c in documents.columns if c not in ("text", "n_private")]
    out = documents.select(*rest, marked.alias(marks)).withColumn(pieces, parts)
    out = out.select(*rest, marks, F.expr(made).alias(new))
    hits = F.coalesce(F.aggregate(F.col(f"{new}.hit"), F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    order = [c for c in documents.columns if c != "n_private"]
    return out.select(*rest, back.alias("text"), hits.alias("n_private")).select(*order, "n_private")
