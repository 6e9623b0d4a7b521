"""Secret scan: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The patterns find assignments, access keys and long hex runs. Runs of 16 or more identifier characters that no pattern touches are
scored by two first-order Markov models over characters: the sum of log P(next | last, random) - log P(next | last, ordinary), in
thousandths and rounded for each pair, so sums are exact integers. A run whose sum reaches the threshold is a further span.

Both models are counted from labelled strings. The query labels a bounded sample of its documents: what the patterns find, and strings
made of a hash in hex, base64 and capitals with digits, are random; other runs of eight or more characters are ordinary. Everything
is column expressions: counting is one small aggregation, the scan one expression for each document.

Positions come from cutting a text at its matches: the lengths of pieces and matches, summed up, are the starts. Sums run over
blocks, so the work for a text of n matches grows like n and not like its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties of start, and their patterns. All of assign's group 2 counts for its length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
LEAST_VALUE = 8
#: A run that the models score, and one that teaches them what is ordinary.
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
SHORT_RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Documents whose strings train the models; those with the smallest hashes of their ids, the same at every size of the input.
MAX_DOCS = 5000
#: Thousandths of the natural logarithm: a run is random if it is e ** 16 times as likely under that model.
THRESHOLD = 16_000
#: Weight, in counts, of a character's overall frequency in its frequency after another.
BACKOFF = 10.0
#: Numbers that one loop of a running sum goes over.
BLOCK = 256


def running(values: Column, first: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running merge of an array, in blocks."""
    empty = F.slice(values, 1, 0)

    def inside(block: Column, start: Column) -> Column:
        add = lambda acc, x: F.struct(merge(acc["last"], x).alias("last"), F.concat(acc["all"], F.array(merge(acc["last"], x))).alias("all"))
        return F.aggregate(block, F.struct(start.alias("last"), empty.alias("all")), add, lambda acc: acc["all"])

    numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    starts = F.concat(F.array(first), inside(F.transform(blocks, lambda b: F.aggregate(b, first, merge)), first))
    return F.when(F.size(values) == 0, empty).otherwise(F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), inside)))


def hits(name: str, pattern: str, text: str = "text") -> list[Column]:
    """The matches of a pattern and the pieces of the text before each: columns ``<name>`` and ``<name>_gaps``."""
    none = F.array().cast("array<string>")
    some = F.col(text).rlike(pattern)
    found = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(some, F.transform(F.split(text, pattern, -1), F.length)).otherwise(none.cast("array<int>"))
    return [found.alias(name), gaps.alias(f"{name}_gaps")]


def spans_of(name: str, rank: int) -> Column:
    """start, rank, end and the matched string of each match, in order."""
    lengths = F.transform(name, F.length)
    ends = running(F.zip_with(F.slice(f"{name}_gaps", F.lit(1), F.size(name)), lengths, lambda g, n: g + n), F.lit(0), lambda a, b: a + b)
    return F.zip_with(name, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), m.alias("match")))


def base_spans(documents: DataFrame) -> DataFrame:
    """doc_id, text and base: array of (start, rank, end) by start, then kind; rank 0 assign, 1 access, 2 hex."""
    docs = documents.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("*", *hits("assign", ASSIGN), *hits("access", ACCESS), *hits("hex", HEX))
    long_enough = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= LEAST_VALUE
    docs = docs.select("doc_id", "text", F.filter(spans_of("assign", 0), long_enough).alias("assign"), spans_of("access", 1).alias("access"), spans_of("hex", 2).alias("hex"))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return docs.select("doc_id", "text", F.array_sort(F.concat(bare("assign"), bare("access"), bare("hex"))).alias("base"))


def labelled_strings(documents: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """value, secret: strings of the ``max_docs`` documents with the smallest MD5 of their ids (ties all in; null ids none)."""
    named = documents.filter("doc_id is not null").select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    last = named.orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]
    sample = documents.filter(F.md5(F.col("doc_id").cast("string").cast("binary")) <= F.lit(last)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    coded = F.base64(F.unhex(digest))
    made = F.array(F.substring(digest, 1, 40), coded, F.upper(F.regexp_replace(coded, "[+/=]", "")))
    values = F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= LEAST_VALUE)
    found = F.concat(values, F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    known = F.transform(F.concat(made, found), lambda v: F.struct(v.alias("value"), F.lit(True).alias("secret")))
    other = F.transform(F.regexp_extract_all(rest, F.lit(SHORT_RUN), F.lit(0)), lambda v: F.struct(v.alias("value"), F.lit(False).alias("secret")))
    return sample.select(F.explode(F.concat(known, other)).alias("s")).select("s.value", "s.secret")


def train(labelled: DataFrame) -> list[int]:
    """Scores of (last, next), row by row of last; row 0 is the start, characters outside the alphabet have code 0.

    Thousandths of the log-likelihood ratio. Without strings of a class all its characters are as likely.
    """
    codes = F.transform(F.split("value", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), F.slice("codes", F.lit(1), F.size("codes") - 1)), "codes", lambda a, b: F.struct(a.alias("last"), b.alias("next")))
    usable = labelled.filter("length(value) > 0 and secret is not null").select("secret", codes.alias("codes"))
    counted = usable.select("secret", F.explode(pairs).alias("p")).groupBy("secret", "p.last", "p.next").agg(F.count(F.lit(1)).alias("n"))
    size = len(ALPHABET) + 1
    counts = {s: [[0] * size for _ in range(size)] for s in (True, False)}
    for r in counted.collect():  # 2 x 68 x 68 rows at most
        counts[r["secret"]][r["last"]][r["next"]] += r["n"]

    def likelihood(table: list[list[int]]) -> list[float]:
        """log P(next | last); a character rarely or never seen as last leans on how often the next one occurs at all."""
        anywhere = [1 + sum(row[b] for row in table) for b in range(size)]
        return [math.log((n + BACKOFF * anywhere[b] / sum(anywhere)) / (sum(row) + BACKOFF)) for row in table for b, n in enumerate(row)]

    return [round(1000 * (x - y)) for x, y in zip(likelihood(counts[True]), likelihood(counts[False]))]


def ratio(value: Column, scores: list[int]) -> Column:
    """Log-likelihood ratio of a string, in thousandths."""
    table = F.expr(f"cast(split('{','.join(map(str, scores))}', ',') as array<int>)")
    step = lambda acc, c: F.struct(F.instr(F.lit(ALPHABET), c).alias("last"), (acc["sum"] + F.element_at(table, acc["last"] * (len(ALPHABET) + 1) + F.instr(F.lit(ALPHABET), c) + 1)).alias("sum"))
    return F.aggregate(F.split(value, ""), F.struct(F.lit(0).alias("last"), F.lit(0).alias("sum")), step, lambda acc: acc["sum"])


def clear_of(spans: str, base: str) -> Column:
    """The spans that overlap none of the base spans; both in order of start."""
    ends = "ends"  # running maximum of the ends of all base spans so far, null-free
    both = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("mine"), s["end"].alias("end"))), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("mine"), s["end"].alias("end")))))
    before = running(F.transform(both, lambda s: F.when(s["mine"] == 0, s["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    after = F.reverse(running(F.reverse(F.transform(both, lambda s: F.when(s["mine"] == 0, s["start"]).otherwise(2**31 - 1))), F.lit(2**31 - 1), lambda a, b: F.least(a, b)))
    placed = F.transform(F.arrays_zip(both.alias("s"), before.alias(ends), after.alias("starts")), lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["mine"].alias("mine"), z["s"]["end"].alias("end"), ((z["s"]["start"] >= z[ends]) & (z["s"]["end"] <= z["starts"])).alias("clear")))
    kept = F.filter(placed, lambda s: (s["mine"] == 1) & s["clear"])
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end")))


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in ("assign", "access", "hex", "random")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(documents: DataFrame, scores: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Positions are code points, ends exclusive; ``spans`` has base and further (``random``) spans by start. Null or empty text: no
    spans. Repeated rows each have a row; a null doc_id is kept; other columns aren't read; no rows give no rows.
    """
    docs = base_spans(documents)
    docs = docs.select("doc_id", "base", *hits("run", RUN))
    docs = docs.select("doc_id", "base", F.filter(spans_of("run", 3), lambda s: ratio(s["match"], scores) >= threshold).alias("run"))
    docs = docs.select("doc_id", "base", F.when(F.size("run") > 0, clear_of("run", "base")).otherwise(F.slice("base", 1, 0)).alias("random"))
    docs = docs.select("doc_id", "base", "random", listed(F.col("base")).alias("joined"), F.when(F.size("random") > 0, F.array_sort(F.concat("base", "random"))).otherwise(F.col("base")).alias("every"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return docs.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.col("joined").cast("binary"), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"), F.size("random").cast("long").alias("n_random"))


def scan(documents: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``find_secrets`` with models trained from the documents themselves."""
    return find_secrets(documents, train(labelled_strings(documents, max_docs)))
