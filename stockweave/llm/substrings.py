"""Substring dedup: words covered by a 50-word window that also starts in a document with a smaller id are removed.

Every window has an anchor, the rarest of its 8-word grams (by a count sketch over all documents, then by hash), which
its content alone decides. Consecutive windows with one anchor form a stretch of 50 to 92 words. Equal windows have equal
anchors, so they meet among the stretches of that anchor:

1. Each document sends its stretches as hashes. Anchors that occur in one document only go; what is left is reduced to
   distinct stretches, each with its smallest document, with map-side combine. A passage that very many documents share
   gives few distinct stretches, because the grams at its border, which mix in other words, are rarer and become anchors.
2. Distinct stretches of anchors that have several are fetched as word sequences. A window holds the 21 words before its
   anchor or the 21 after it, so a stretch that shares neither with another can't match and goes; a repeated line in
   different surroundings ends here. The others are dealt into shards by anchor. A shard
   builds an FM-index over its stretches and streams each of them against it: matching statistics by backward search,
   counting only matches in documents smaller than the stretch's first. Windows whose match reaches 50 words are reported.
3. A stretch in another document than its first is reported whole, one in its first document as the index says. The
   reports of a document meet its text, and the covered words go.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm import sketch
from stockweave.llm.common import Stages, WordHashes, finish, grams, utf8, width
from stockweave.llm.fmindex import FMIndex

WINDOW, GRAM = 50, 8
#: A window has so many words before its anchor, or so many after it.
HALF = (WINDOW - GRAM) // 2
#: Words that a shard's index holds on average.
SHARD_WORDS = 300_000
#: Stands for a null doc_id: larger than any.
NO_ID = (1 << 63) - 1

U = np.uint64


def anchors(hashes: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of a document's words: first window, number of windows, hash of the anchor."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    g = grams(hashes, GRAM)
    order = (level[sketch.cell_of(g)].astype(np.uint64) << U(58)) | (g >> U(6))
    span = WINDOW - GRAM + 1
    at = np.empty(n, dtype=np.int64)
    for a in range(0, n, 65_536):  # a bounded view at a time
        b = min(n, a + 65_536)
        at[a:b] = np.lib.stride_tricks.sliding_window_view(order[a : b + span - 1], span).argmin(axis=1)
    at += np.arange(n)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return first, np.diff(first, append=n), g[at[first]]


def content(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each stretch's words, from prefix sums of powers."""
    base = U(0xD1342543DE82EF95)
    n = len(hashes)
    power = np.empty(n + 1, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(np.full(n, base, dtype=np.uint64), out=power[1:])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(finish(hashes) * power[:n], dtype=np.uint64)])
    inverse = U(pow(int(base), -1, 1 << 64))
    back = np.empty(n + 1, dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(np.full(n, inverse, dtype=np.uint64), out=back[1:])
    end = first + count + WINDOW - 1
    return finish((total[end] - total[first]) * back[first] + count.astype(np.uint64))


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's piece of the sketch over the 8-word grams of its documents."""
    hashes, cells, any_ = WordHashes(), np.zeros(sketch.CELLS, dtype=np.int32), False
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if len(words := text.split()) >= WINDOW:
                any_ = True
                sketch.add(cells, grams(hashes.array(words), GRAM))
    if any_:
        blobs = sketch.pieces(cells)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names=["piece", "counts"])


def stretches(rareness: Broadcast):
    """Rows (anchor, content, doc, place): place holds the first window and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, level = WordHashes(), rareness.value
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if len(words := text.split()) >= WINDOW:
                    h = hashes.array(words)
                    first, count, anchor = anchors(h, level)
                    found.append((anchor.view(np.int64), content(h, first, count).view(np.int64), np.full(len(first), doc), first << 8 | count))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["anchor", "content", "doc", "place"])

    return run


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of listed stretches, as 64-bit hashes, and the hashes of the anchor with 21 words before and after, where it has them."""
    hashes = WordHashes()
    for batch in batches:
        rows: list[tuple] = []
        for doc, text, listed in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "listed"))):
            h = hashes.array(text.split())
            anchor_at, half_at = grams(h, GRAM).view(np.int64), grams(h, GRAM + HALF).view(np.int64)
            for s in listed:
                a, n = s["place"] >> 8, s["place"] & 255
                end = a + n + WINDOW - 1
                at = a + int((anchor_at[a : end - GRAM + 1] == s["anchor"]).argmax())
                left = int(half_at[at - HALF]) if at - HALF >= a else None
                right = int(half_at[at]) if at + GRAM + HALF <= end else None
                rows.append((s["anchor"], s["content"], doc, h[a:end].tobytes(), left, right))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["anchor", "content", "doc", "words", "left", "right"])


def search(rows: pa.Table) -> pa.Table:
    """One shard: a bit for each window of a stretch that stands in a document smaller than the stretch's first."""
    sequences = [np.frombuffer(w, dtype=np.uint64) for w in rows.column("words").to_pylist()]
    _, symbols = np.unique(np.concatenate(sequences), return_inverse=True)
    cuts = np.cumsum([len(s) for s in sequences])[:-1]
    sequences = np.split(symbols + 1, cuts)
    _, documents = np.unique(rows.column("doc").to_numpy(), return_inverse=True)
    index = FMIndex(sequences, documents)
    longest = max(map(len, sequences))
    masks = np.zeros(len(sequences), dtype=np.int64)
    for a in range(0, len(sequences), 20_000):
        part = sequences[a : a + 20_000]
        streams = np.zeros((len(part), longest), dtype=np.int64)
        for i, s in enumerate(part):
            streams[i, longest - len(s) :] = s
        reach = index.matching_statistics(streams, documents[a : a + 20_000]) >= WINDOW
        for i, s in enumerate(part):
            at = np.flatnonzero(reach[i, longest - len(s) :])
            masks[a + i] = int((np.int64(1) << at).sum())
    return pa.table({"anchor": rows.column("anchor"), "content": rows.column("content"), "mask": pa.array(masks)})


def cut(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Documents without the covered words."""
    for batch in batches:
        out: list[tuple] = []
        for doc, text, reports in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "reports"))):
            words = text.split()
            removed = 0
            if reports:
                edges = np.zeros(len(words) + 1, dtype=np.int32)
                for r in reports:
                    first, mask = r["place"] >> 8, r["mask"]
                    starts = first + np.flatnonzero(np.int64(mask) >> np.arange(WINDOW) & 1)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + WINDOW, -1)
                covered = np.cumsum(edges[:-1]) > 0
                removed = int(covered.sum())
                kept = [w for w, c in zip(words, covered.tolist()) if not c]
            else:
                kept = words
            joined = b" ".join(kept)
            out.append((doc, len(words), removed, hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace") if keep else None))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


CUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove_repeats(documents: DataFrame, texts_too: bool = True) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space;
    null unless ``texts_too``).

    Words are split at ASCII white space and unchanged; null text has none. Windows are judged on the input. A null doc_id is
    larger than any. Rows that share a doc_id are one document to the rule, which never sets them against each other, and
    share their reports, so they ought to be repeats of one row. Other columns aren't read; no rows give no rows.
    """
    spark = documents.sparkSession
    stages = Stages(spark, "substrings")
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), utf8("text"))
    rareness = spark.sparkContext.broadcast(sketch.levels(texts.select("text").mapInArrow(count_grams, "piece int, counts binary")))
    placed = stages.put("placed", texts.mapInArrow(stretches(rareness), "anchor long, content long, doc long, place long"))

    shared = placed.groupBy("anchor").agg(F.min("doc").alias("d1"), F.max("doc").alias("d2")).filter("d1 < d2").select("anchor")
    met = stages.put("met", placed.join(shared.hint("merge"), "anchor"))
    distinct = stages.put("distinct", met.groupBy("anchor", "content").agg(F.min(F.struct("doc", "place")).alias("one")).select("anchor", "content", "one.doc", "one.place"))
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor")
    listed = distinct.join(several.hint("merge"), "anchor").groupBy("doc").agg(F.collect_list(F.struct("anchor", "content", "place")).alias("listed"))
    wanted = texts.join(listed.hint("shuffle_hash"), texts.doc_id == listed.doc).select("doc", "text", "listed")
    fetched = stages.put("fetched", wanted.mapInArrow(fetch, "anchor long, content long, doc long, words binary, left long, right long").dropDuplicates(["anchor", "content"]))
    sides = fetched.select(F.explode(F.array("left", "right")).alias("half")).filter("half is not null")
    twice = sides.groupBy("half").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("half")
    for side in ("left", "right"):
        fetched = fetched.join(twice.select(F.col("half").alias(f"{side}_twice")).hint("merge"), F.col(side) == F.col(f"{side}_twice"), "left")
    fetched = stages.put("alike", fetched.filter("left_twice is not null or right_twice is not null").select("anchor", "content", "doc", "words"))
    total = fetched.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_WORDS))
    dealt = fetched.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    masks = stages.put("masks", dealt.repartition(max(shards, width(spark)), "shard").groupBy("shard").applyInArrow(search, "anchor long, content long, mask long"))

    firsts = distinct.join(masks, ["anchor", "content"], "left").select("anchor", "content", F.col("doc").alias("first"), F.coalesce("mask", F.lit(0)).alias("mask"))
    whole = F.expr("shiftleft(1L, cast(place & 255 as int)) - 1L")
    found = met.join(firsts, ["anchor", "content"]).select("doc", "place", F.when(F.col("doc") > F.col("first"), whole).otherwise(F.col("mask")).alias("mask"))
    reports = stages.put("reports", found.filter("mask <> 0").groupBy("doc").agg(F.collect_list(F.struct("place", "mask")).alias("reports")))
    final = texts.join(reports.hint("shuffle_hash"), texts.doc_id == reports.doc, "left").select("doc_id", "text", "reports").mapInArrow(lambda batches: cut(batches, texts_too), CUT)
    return final.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
