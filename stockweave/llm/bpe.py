"""Byte-level BPE: overlapping chunks, pre-tokenised in parallel, stitched where their boundaries meet again.

A text of more than ``CHUNK`` characters is cut into chunks that overlap by ``OVERLAP`` and each chunk is pre-tokenised by
itself, in any task. A match of the pattern depends only on the text from its start to the character after its end. So
once a boundary of one chunk is a boundary of the next, both go on alike, and the matches of the first chunk that end two
characters before its end are those of the whole text. The stitch takes over at the first common boundary; where an
overlap has none (a run without boundaries longer than the overlap), matching goes on from the last sure boundary over
the joined text until it meets the next chunk again. Then the pieces are merged by rank.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import cache_of

#: Characters of a chunk and of what it shares with the next one.
CHUNK, OVERLAP = 32_768, 256
#: Pieces whose ids a worker keeps; emptied when full.
CACHE_PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder(dict):
    """Piece (as matched text) -> its ids as little-endian 32-bit bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = ids = array("I", self.merge(piece.encode("utf-8", "surrogatepass"))).tobytes()
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Join the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 128:
            return self.merge_long(piece)
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        none = len(ranks) + 1
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list: a piece of n bytes takes n log n steps."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, to = heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != to:
                continue  # one of the two has changed since
            end[i], end[j], after[i] = to, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := ranks.get(piece[before[i] : to])) is not None:
                heappush(heap, (r, before[i], to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, pieces: Iterable[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        whole = array("I")
        whole.frombytes(ids)
        return b"".join(map(self.tokens.__getitem__, whole))


def encoder_of(key: tuple, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The worker's encoder, with the pieces that its earlier tasks have met; one vocabulary is kept at a time."""
    kept = cache_of("bpe")
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(ranks, pattern)
    return kept[key]


def boundaries(pattern: regex.Pattern, text: str) -> list[int]:
    """Ends of the matches in a chunk; they lie end to end from 0."""
    return [m.end() for m in pattern.finditer(text)]


def stitch(pattern: regex.Pattern, chunks: list[str], ends: list[list[int]], step: int) -> tuple[str, list[int]]:
    """The whole text and its boundaries from chunks that start every ``step`` characters and each one's own boundaries."""
    text = "".join(c[:step] for c in chunks[:-1]) + chunks[-1]
    out: list[int] = []
    at, k = 0, 0  # matched up to here; chunk whose boundaries are followed
    while at < len(text):
        last = k == len(chunks) - 1
        start = k * step
        sure = len(text) if last else start + len(chunks[k]) - 2
        i = 0 if at == start else bisect_left(ends[k], at - start)
        synced = at == start or (i < len(ends[k]) and ends[k][i] == at - start)
        if not synced:  # the chunk cuts a match here: go on by hand until it agrees
            at = pattern.match(text, at).end()
            out.append(at)
            while k < len(chunks) - 1 and at >= (k + 1) * step:
                k += 1
            continue
        follow = [start + e for e in ends[k][i + (at != start) :] if start + e <= sure]
        if last:
            out.extend(follow)
            break
        known = {start + step + e for e in ends[k + 1]} | {start + step}
        meet = next((e for e in follow if e >= start + step and e in known), None)
        if meet is None:
            out.extend(follow)
            at = follow[-1] if follow else at
            if at < len(text):  # no common boundary in the overlap
                at = pattern.match(text, at).end()
                out.append(at)
            while k < len(chunks) - 1 and at >= (k + 1) * step:
                k += 1
        else:
            out.extend(e for e in follow if e <= meet)
            at, k = meet, k + 1
    return text, out


OUT = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), decoded (bytes) of every row; null text is empty, other columns are not read.

    Equal to cutting the whole text by ``pattern`` and merging each match by rank. Repeated rows each have a row.
    """
    return _encoded(documents, ranks_path, pattern, chunk, overlap, digest=False)


def encode_digests(documents: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """As ``encode_documents``, with SHA-256 of ids and decoded bytes in their place, taken in the task that made them."""
    return _encoded(documents, ranks_path, pattern, chunk, overlap, digest=True)


def _encoded(documents: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int, digest: bool) -> DataFrame:
    if not 2 < overlap < chunk:
        raise ValueError("an overlap is of 3 characters or more and shorter than a chunk")
    spark = documents.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary file: bounded, whatever the corpus
    key = (spark.sparkContext.applicationId, vocabulary._jbroadcast.id(), pattern)
    step = chunk - overlap
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    kind = "string" if digest else "binary"
    ddl = f"doc_id long, n_tokens long, {names[0]} {kind}, {names[1]} {kind}"

    def made(ids: list, encoded: list[bytes], encoder: Encoder) -> pa.RecordBatch:
        decoded = [encoder.decode(e) for e in encoded]
        hashed = (lambda b: hashlib.sha256(b).hexdigest()) if digest else (lambda b: b)
        columns = [pa.array(ids, pa.int64()), pa.array([len(e) // 4 for e in encoded], pa.int64())]
        columns += [pa.array([hashed(b) for b in part], pa.string() if digest else pa.binary()) for part in (encoded, decoded)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(key, vocabulary.value, pattern)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                encoded = [encoder.encode(encoder.pieces(t)) for t in part.column("text").to_pylist()]
                yield made(part.column("doc_id").to_pylist(), encoded, encoder)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            ends = [array("I", boundaries(compiled, t)).tobytes() for t in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "row", "k", "chunk")), pa.array(ends, pa.binary())], names=["doc_id", "row", "k", "chunk", "ends"])

    def joined(rows: pa.Table) -> pa.Table:
        encoder = encoder_of(key, vocabulary.value, pattern)
        rows = rows.sort_by("k")
        ends = [array("I") for _ in range(rows.num_rows)]
        for e, raw in zip(ends, rows.column("ends").to_pylist()):
            e.frombytes(raw)
        text, stops = stitch(encoder.pattern, rows.column("chunk").to_pylist(), [list(e) for e in ends], step)
        pieces = (text[a:b] for a, b in zip([0, *stops], stops))
        return pa.Table.from_batches([made(rows.column("doc_id").to_pylist()[:1], [encoder.encode(pieces)], encoder)])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = texts.filter(F.length("text") <= chunk).mapInArrow(whole, ddl)
    long = texts.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    k = F.explode(F.sequence(F.lit(0), F.ceil((F.length("text") - overlap) / step).cast("int") - 1)).alias("k")
    chunks = long.select("doc_id", "row", "text", k).select("doc_id", "row", "k", F.expr(f"substr(text, k * {step} + 1, {chunk})").alias("chunk"))
    dealt = chunks.repartition("row", "k").mapInArrow(cut, "doc_id long, row long, k int, chunk string, ends binary")
    return short.unionByName(dealt.groupBy("row").applyInArrow(joined, ddl))
