"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of word shingles. Set sizes fall into bands; a band's scheme cuts the feature domain (all shingle
hashes) into partitions, and a set's signatures are its projections on them. Sets a and b with Jaccard >= 3/4 differ in at
most (|a| + |b|) / 7 features, so at most k(a) of the partitions where a has a feature can differ, k(a) following from the
largest partner a can have in the scheme. If a has features in k(a) + t partitions, t or more of its signatures are
shared. Signatures have one order for all sets, rare ones first; the rarest of the t shared ones is among the first
k(a) + 1 of a and, likewise, the first k(b) + 1 of b. Those are exchanged, so no similar pair is missed. A set that may
have a partner in the next band also takes part in that band's scheme.

Rareness comes from a count sketch over the shingles of all documents. It orders signatures and so decides how many
candidates appear, never which pairs are found: a passage that many documents share is at the end of the order.

The first signature that a and b share tells more: all that come before it in a's order, and in b's, differ. With most
partitions holding one feature, those that do are different features of the two sides, so the pair is similar only if their
number on both sides together is at most (|a| + |b|) / 7. An owner leaves out the members of a group that no other member
of a fitting size can meet this way; of documents that only share a passage, few are left.

Equal sets are one class, known by a 64-bit hash, before anything is exchanged. In a large group of sets that share a
signature all are compared with its smallest set, the hub, so a group of near copies costs one comparison for each member
and not one for each pair. Parity bits come first: each feature flips one bit of a set's bitmap, so two sets differ in at
least as many features as bits, which rules out nearly all pairs that only share a passage. The texts of the others are
fetched and compared word by word.

What the hub leaves open, members outside the hub's component, is compared inside the group: its texts are dealt in blocks,
each two of which meet in one task, and a task gives only the links that join what is not yet joined. Let h be no larger than
b, and a and b be similar but a and h not. Then a and b share more features than a and h, so they share some outside h;
members with too few of them, or with no partner that parity bits allow, are left out. The others are compared by wider
bits, then by features, and a link by its words; pairs that earlier links have joined are passed over, so near copies cost few comparisons.
What is left grows, for an open group, with its members times its components, and no row is made for a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm import sketch
from stockweave.llm.common import Stages, WordHashes, finish, grams, narrowed, unused, utf8
from stockweave.llm.graph import components

SHINGLE = 5
#: Largest size of the first band, whose partitions hold one feature each; each later band reaches four times as far.
FIRST_BAND, RATIO = 64, 4
#: Partitions for each feature of the largest set of a band, from the second band on: few hold more than one feature.
SPREAD = 8
#: Sets with a ratio of sizes below 4/3 are in the same or in neighbouring classes of this ratio.
SIZE_CLASS = 1.34
#: Signatures that one owner gets on average, and a task holds before it sends them.
OWNER_SIGNATURES, SEND_SIGNATURES = 1_500_000, 1_000_000
#: Groups of at most so many sets are compared pair by pair at once.
FEW = 8
#: Members and features that one block of an open group has about; larger groups are dealt to several blocks.
FEW_OPEN, BLOCK_FEATURES = 4000, 2_000_000
#: Pairs that are compared by features at once, and bits for each feature of the bitmaps before that.
AT_ONCE, WIDE = 64, 4

U = np.uint64


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    return np.unique(grams(hashes.array(text.lower().split()), SHINGLE))


def set_hash(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two sums over mixed features: the id of the set, and a second one to notice ids that collide."""
    one = int(finish(s ^ U(2 * seed + 1)).sum(dtype=np.uint64))
    two = int(finish(s + U(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return one - (1 << 64) * (one >= 1 << 63), two - (1 << 64) * (two >= 1 << 63)


def schemes(size: int) -> list[tuple[int, int, int]]:
    """(upper end of the band that names the scheme, its partitions or 0 for one each feature, k) for a set of a size."""
    upper = FIRST_BAND
    while upper < size:
        upper *= RATIO
    largest = 4 * size // 3
    out = [(upper, 0 if upper == FIRST_BAND else SPREAD * upper, (size + min(upper, largest)) // 7)]
    if largest > upper:
        out.append((upper * RATIO, SPREAD * upper * RATIO, (size + largest) // 7))
    return out


def signatures(s: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set that are exchanged, and how many single features come before each in the order.

    ``level``: rareness of each feature, low is rare. The k + 1 first in the order exist unless the features crowd into k
    partitions; for random hashes that has a chance below 1e-9, and then all signatures of the set are sent.
    """
    out, before = [], []
    for name, parts, k in schemes(len(s)):
        if parts:
            part = (s >> U(32)) * U(parts) >> U(32)  # features are sorted, so partitions are runs
            starts = np.flatnonzero(np.diff(part, prepend=part[0] + U(1)))
            sig, rare = np.add.reduceat(finish(s), starts) + part[starts], np.minimum.reduceat(level, starts)
            single = np.diff(starts, append=len(s)) == 1
        else:
            sig, rare, single = s, level, np.ones(len(s), dtype=bool)
        sig = finish(sig + U(name * 0x2545F4914F6CDD1D % (1 << 64)))
        order = (rare.astype(np.uint64) << U(58)) | (sig >> U(6))
        first = np.argpartition(order, k)[: k + 1] if len(sig) > k + 1 else np.arange(len(sig))
        first = first[np.argsort(order[first])]
        out.append(sig[first])
        before.append(np.cumsum(single[first]) - single[first])
    return np.concatenate(out), np.concatenate(before).astype(np.int32)


def parity(s: np.ndarray) -> bytes:
    """A bit for each cell, as many as the end of the set's band: whether the features in it are odd in number."""
    upper = schemes(len(s))[0][0]
    cells = finish(s ^ U(0x6A09E667F3BCC908)) & U(upper - 1)
    return np.packbits((np.bincount(cells.astype(np.int64), minlength=upper) & 1).astype(np.uint8)).tobytes()


def differ_at_least(a: bytes, b: bytes) -> int:
    """Features in which two sets differ at least, from their bits; the longer bitmap is folded to the shorter."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


FIRST = pa.schema([("doc_id", pa.int64()), ("set", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("piece", pa.int32()), ("counts", pa.binary())])
FIRST_DDL = "doc_id long, set long, other long, n long, bits binary, piece int, counts binary"


def describe(seed: int):
    """First pass: a row for each document with the id and size of its set; the task's piece of the sketch at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        cells = np.zeros(sketch.CELLS, dtype=np.int32)
        for batch in batches:
            n = batch.num_rows
            sets, others, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            bits: list[bytes | None] = [None] * n
            for i, text in enumerate(batch.column("text").to_pylist()):
                if len(s := shingles(text, hashes)):
                    sets[i], others[i] = set_hash(s, seed)
                    sizes[i] = len(s)
                    if sets[i] not in seen:
                        seen.add(sets[i])
                        bits[i] = parity(s)
                        sketch.add(cells, s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets), pa.array(others), pa.array(sizes), pa.array(bits, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=FIRST)
        if seen:
            blobs = sketch.pieces(cells)
            k = len(blobs)
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(blobs, pa.binary())], schema=FIRST)

    return run


def send(rareness: Broadcast, owners: int, seed: int):
    """Second pass: signatures of each set that the task meets for the first time, packed by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, level = WordHashes(), set(), rareness.value
        held: list[np.ndarray] = []
        ahead: list[np.ndarray] = []
        ids: list[int] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            sig, before = np.concatenate(held), np.concatenate(ahead)
            who = np.repeat(np.arange(len(held)), [len(h) for h in held])
            to = ((sig >> U(40)) * U(owners) >> U(24)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            sig, before, who, to = sig[order], before[order], who[order], to[order]
            cuts = np.searchsorted(to, np.arange(owners + 1))
            names, blobs = [], []
            all_ids, all_sizes = np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64)
            for owner, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    mine, count = np.unique(who[a:b], return_counts=True)
                    head = np.array([b - a, len(mine)], dtype=np.int64)
                    blobs.append(b"".join(x.tobytes() for x in (head, sig[a:b], before[a:b], all_ids[mine], all_sizes[mine].astype(np.int32), count.astype(np.int32))))
                    names.append(owner)
            for part in (held, ahead, ids, sizes):
                part.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["owner", "blob"])

        waiting = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if len(s := shingles(text, hashes)):
                    name = set_hash(s, seed)[0]
                    if name not in seen:
                        seen.add(name)
                        for part, values in zip((held, ahead), signatures(s, level[sketch.cell_of(s)])):
                            part.append(values)
                        ids.append(name)
                        sizes.append(len(s))
                        waiting += len(held[-1])
                        if waiting >= SEND_SIGNATURES:
                            yield flush()
                            waiting = 0
        if held:
            yield flush()

    return run


GROUPS = pa.schema([("gid", pa.int64()), ("set", pa.int64()), ("n", pa.int64()), ("hub", pa.int64()), ("hub_n", pa.int64()), ("size", pa.int64())])
GROUPS_DDL = "gid long, set long, n long, hub long, hub_n long, size long"


def meeting(sig: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which rows may have their first shared signature with another row of their group; rows come by signature and size."""
    kind = np.floor(np.log(sizes) / math.log(SIZE_CLASS)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (kind[1:] != kind[:-1])]))
    lengths = np.diff(starts, append=len(sig))
    slack = sizes - 7 * before.astype(np.int64)
    most = np.maximum.reduceat(slack, starts)
    best = most.copy()
    beside = (sig[starts][1:] == sig[starts][:-1]) & (kind[starts][1:] == kind[starts][:-1] + 1)
    best[1:][beside] = np.maximum(best[1:], most[:-1])[beside]
    best[:-1][beside] = np.maximum(best[:-1], most[1:])[beside]
    return slack + np.repeat(best, lengths) >= 0


def shared_by_several(sig: np.ndarray) -> np.ndarray:
    """Rows whose signature another row has too; rows come by signature."""
    same = sig[1:] == sig[:-1]
    shared = np.zeros(len(sig), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    return shared


def meet(rows: pa.Table) -> pa.Table:
    """One owner: of small groups of sets that share a signature the pairs (size 2), of large ones the members.

    Each combination of members comes once. ``hub`` is the first of a pair, or the member with the fewest features.
    """
    sig, before, sets, sizes = [], [], [], []
    for blob in rows.column("blob").to_pylist():
        n, m = (int(x) for x in np.frombuffer(blob, dtype=np.int64, count=2))
        at = 16 + 12 * n
        count = np.frombuffer(blob, dtype=np.int32, count=m, offset=at + 12 * m)
        sig.append(np.frombuffer(blob, dtype=np.uint64, count=n, offset=16))
        before.append(np.frombuffer(blob, dtype=np.int32, count=n, offset=16 + 8 * n))
        sets.append(np.repeat(np.frombuffer(blob, dtype=np.int64, count=m, offset=at), count))
        sizes.append(np.repeat(np.frombuffer(blob, dtype=np.int32, count=m, offset=at + 8 * m), count))
    sig, before, sets, sizes = (np.concatenate(x) for x in (sig, before, sets, sizes))
    order = np.argsort(sig, kind="stable")
    order = order[shared_by_several(sig[order])]
    sig, before, sets, sizes = sig[order], before[order], sets[order], sizes[order]
    order = np.lexsort((sets, sizes, sig))
    sig, before, sets, sizes = sig[order], before[order], sets[order], sizes[order].astype(np.int64)
    fresh = np.ones(len(sig), dtype=bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (sets[1:] != sets[:-1])  # a set that several tasks have sent
    sig, before, sets, sizes = sig[fresh], before[fresh], sets[fresh], sizes[fresh]
    if len(sig):
        stay = meeting(sig, sizes, before)
        sig, sets, sizes = sig[stay], sets[stay], sizes[stay]
        stay = shared_by_several(sig)
        sig, sets, sizes = sig[stay], sets[stay], sizes[stay]
    if len(sig) == 0:
        return GROUPS.empty_table()
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    lengths = np.diff(starts, append=len(sig))
    gid = np.add.reduceat(finish(sets.astype(np.uint64) ^ U(0x1234567)), starts)
    _, one = np.unique(gid, return_index=True)
    columns: list[list[np.ndarray]] = []
    for size in range(2, FEW + 1):
        at = starts[one[lengths[one] == size]]
        i, j = np.triu_indices(size, 1)
        a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        fit = np.minimum(sizes[a], sizes[b]) * 100 >= np.maximum(sizes[a], sizes[b]) * 75
        a, b = a[fit], b[fit]
        columns.append([np.zeros(len(a), np.int64), sets[b], sizes[b], sets[a], sizes[a], np.full(len(a), 2)])
    one = one[lengths[one] > FEW]
    if len(one):
        pick = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[one], lengths[one])])
        wide = lambda x: np.repeat(x[one], lengths[one])
        columns.append([wide(gid).view(np.int64), sets[pick], sizes[pick], wide(sets[starts]), wide(sizes[starts]), wide(lengths)])
    return pa.Table.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*columns)], schema=GROUPS)


def may_be_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their parity bits don't rule out."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")))
        good = [7 * differ_at_least(x, y) <= n + m for n, m, x, y in rows]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def word_shingles(text: bytes) -> set[tuple[bytes, ...]]:
    words = text.lower().split()
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def similar(a: set, b: set) -> bool:
    shared = len(a & b)
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose word shingles reach the similarity; rows come sorted by ``a``, so its set is kept."""
    last, mine = None, set()
    for batch in batches:
        good = []
        for a, b, first, second in zip(*(c.to_pylist() for c in batch.columns)):
            if a != last:
                last, mine = a, word_shingles(first)
            if similar(mine, word_shingles(second)):
                good.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], names=["a", "b"])


def with_ids(seed: int):
    """Set id and text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [set_hash(s, seed)[0] if len(s := shingles(t, hashes)) else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column("text")], names=["set", "text"])

    return run


def needed_outside(n: int, hub_n: int, inside: int, odd: bool) -> int:
    """Features outside the hub that a set shares at least with any partner it is to meet there."""
    partner = max(hub_n, math.ceil(3 * n / 4))
    needed = -(-3 * (n + partner) // 7) - inside
    if not odd:  # its partner is not similar to the hub, so they share less than 3/7 of both sizes with the hub
        needed = max(needed, 3 * (n - hub_n) // 7 + 1)
    return max(needed, 1)


def wide_bits(features: list[np.ndarray]) -> np.ndarray:
    """Parity bits of many sets, of one width: at least ``WIDE`` bits for each feature of the largest."""
    width = max(64, 1 << (WIDE * max(map(len, features)) - 1).bit_length())
    out = np.empty((len(features), width // 64), dtype=np.uint64)
    for row, s in zip(out, features):
        cells = finish(s ^ U(0xBB67AE8584CAA73B)) & U(width - 1)
        row[:] = np.packbits((np.bincount(cells.astype(np.int64), minlength=width) & 1).astype(np.uint8)).view(np.uint64)
    return out


HOPEFUL_DDL = "hub long, cell int, set long, label long, odd boolean, side int, cross boolean"


def hopeful(rows: pa.Table) -> pa.Table:
    """One or two blocks of an open group: the members, and the hub, that parity bits leave a partner of another label."""
    out = rows.select([c.split()[0] for c in HOPEFUL_DDL.split(", ")])
    odd, n, label = (rows.column(c).to_numpy() for c in ("odd", "n", "label"))
    is_hub = rows.column("set").to_numpy() == rows.column("hub")[0].as_py()
    side = rows.column("side").to_numpy() if rows.column("cross")[0].as_py() else np.arange(len(n))
    bits = [np.frombuffer(b, dtype=np.uint64) for b in rows.column("bits").to_pylist()]
    width = np.array([len(b) for b in bits])
    folded = {w: np.array([np.bitwise_xor.reduce(b.reshape(-1, w), axis=0) if len(b) >= w else np.zeros(w, np.uint64) for b in bits]) for w in set(width.tolist())}
    keep = np.zeros(len(n), dtype=bool)
    for i in np.flatnonzero(odd).tolist():
        fit = ~is_hub & (label != label[i]) & (side != side[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * 75)
        for w, bitmaps in folded.items():
            others = np.flatnonzero(fit & (np.minimum(width, width[i]) == w))
            near = others[7 * np.bitwise_count(bitmaps[others] ^ bitmaps[i]).sum(axis=1, dtype=np.int64) <= n[others] + n[i]]
            keep[near] = True
            keep[i] |= len(near) > 0
    return out.filter(pa.array(keep | is_hub)) if keep.any() else out.slice(0, 0)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def settle(rows: pa.Table) -> pa.Table:
    """One or two blocks of an open group: links that join members of different labels, none between what they have joined.

    Pairs have an odd member; of two blocks only pairs across are compared. The hub comes along for its features.
    """
    names, odd = rows.column("set").to_numpy(), rows.column("odd").to_numpy(zero_copy_only=False)
    is_hub = names == rows.column("hub")[0].as_py()
    if not odd.any():
        return LINKS.empty_table()
    hashes = WordHashes()
    core = shingles(rows.column("text")[int(np.argmax(is_hub))].as_py(), hashes)
    at, features = [], []
    for i in np.flatnonzero(~is_hub)[np.argsort(~odd[~is_hub], kind="stable")].tolist():
        s = shingles(rows.column("text")[i].as_py(), hashes)
        inside = int(np.isin(s, core, assume_unique=True).sum())
        if len(s) - inside >= needed_outside(len(s), len(core), inside, bool(odd[i])):
            at.append(i)
            features.append(s)
    if len(at) < 2:
        return LINKS.empty_table()
    names, first = names[at], int(odd[at].sum())  # odd members come first
    side = rows.column("side").to_numpy()[at] if rows.column("cross")[0].as_py() else np.arange(len(at))
    root = np.unique(rows.column("label").to_numpy()[at], return_inverse=True)[1]
    n, bits = np.array([len(s) for s in features]), wide_bits(features)
    dense = np.unique(np.concatenate(features), return_inverse=True)[1]
    dense = np.split(dense, np.cumsum(n)[:-1])
    mine = np.zeros(max(int(d.max()) for d in dense) + 1, dtype=bool)
    words = lambda i: word_shingles(rows.column("text")[at[i]].as_py())
    found: list[tuple[int, int]] = []
    for i in range(first):
        rest = slice(i + 1, None)
        fit = (root[rest] != root[i]) & (side[rest] != side[i]) & (np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * 75)
        others = i + 1 + np.flatnonzero(fit)
        others = others[7 * np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64) <= n[others] + n[i]]
        mine[dense[i]] = True
        while len(others):
            some, others = others[:AT_ONCE], others[AT_ONCE:]
            shared = np.add.reduceat(mine[np.concatenate([dense[j] for j in some])], np.cumsum(n[some]) - n[some], dtype=np.int64)
            for j in some[100 * shared >= 75 * (n[some] + n[i] - shared)].tolist():
                if root[j] != root[i] and similar(words(i), words(j)):
                    found.append((int(names[i]), int(names[j])))
                    root[root == root[j]] = root[i]
            others = others[root[others] != root[i]]
        mine[dense[i]] = False
    return pa.Table.from_arrays([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], schema=LINKS)


def near_groups(documents: DataFrame, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id.

    Words are lower-cased in A-Z; a set holds the distinct 5-word shingles, of fewer words the whole sequence. Sets link when
    100 * shared >= 75 * united. component_id is the smallest doc_id that links reach, class_id the smallest with an equal
    set. No words (or null text): 0 shingles and the document's own id. Repeated rows, and rows that share a doc_id with
    different texts, each have a row; a null doc_id is no component's smallest unless alone. Other columns aren't read; no
    rows give no rows.
    """
    spark = documents.sparkSession
    stages = Stages(spark, "partenum")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text"))
    first = stages.put("first", texts.mapInArrow(describe(seed), FIRST_DDL))
    docs = first.filter("piece is null").select("doc_id", "set", "other", "n", "bits")
    classes = stages.put("classes", docs.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("other").alias("o1"), F.max("other").alias("o2"), F.first("bits", ignorenulls=True).alias("bits")))
    total, collide = classes.agg(F.sum("n"), F.count(F.when(F.col("o1") != F.col("o2"), 1))).first()
    if collide:
        raise ValueError("two different sets have one id; use another seed")
    rareness = spark.sparkContext.broadcast(sketch.levels(first.filter("piece is not null")))
    owners = max(1, math.ceil(0.45 * (total or 0) / OWNER_SIGNATURES))
    sent = texts.mapInArrow(send(rareness, owners, seed), "owner int, blob binary")
    groups = stages.put("groups", sent.repartition(owners, "owner").groupBy("owner").applyInArrow(meet, GROUPS_DDL))

    edges = groups.filter("set <> hub").filter("least(n, hub_n) * 100 >= greatest(n, hub_n) * 75")
    edges = edges.select(F.least("hub", "set").alias("a"), F.greatest("hub", "set").alias("b")).distinct()
    named = groups.select("set").union(groups.select("hub")).distinct()
    known_sets = stages.put("sets", classes.select("set", "n", "bits", "rep").join(named, "set"))
    members = stages.put("members", groups.filter("size > 2").select("hub", "hub_n", "set", "n").distinct())

    def fetched(sets: DataFrame, name: str) -> DataFrame:
        """set and a text of it, for a column of set ids. Found by the id of each text, as several texts may have one doc_id."""
        wanted = stages.put(f"wanted-{name}", known_sets.join(sets.distinct(), "set").select("set", "rep"))
        held = narrowed(texts, "doc_id", wanted.select("rep"), with_ids(seed), "set long, text binary")
        return stages.put(f"texts-{name}", held.join(wanted.select("set").hint("shuffle_hash"), "set").dropDuplicates(["set"]))

    side = lambda x: known_sets.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    likely = edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    likely = stages.put("likely", likely.mapInArrow(may_be_near, "a long, b long"))
    held = fetched(likely.select(F.col("a").alias("set")).union(likely.select("b")), "likely")
    with_b = likely.join(held.withColumnsRenamed({"set": "b", "text": "second"}), "b")
    with_a = with_b.join(held.withColumnsRenamed({"set": "a", "text": "first"}).hint("merge"), "a")
    links = stages.put("links", with_a.select("a", "b", "first", "second").mapInArrow(compare, "a long, b long"))
    labels = stages.put("labels", components(links, stages, "cc"))

    label_of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
    known = members.join(label_of("set"), "set", "left").join(label_of("hub"), "hub", "left")
    label = F.coalesce("l_set", "set")
    known = known.select("hub", "set", "n", label.alias("label"), (label != F.coalesce("l_hub", "hub")).alias("odd"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / FEW_OPEN, F.sum("n") / BLOCK_FEATURES)).cast("int")
    some = known.groupBy("hub").agg(blocks.alias("blocks"), F.bool_or("odd").alias("open")).filter("open").select("hub", "blocks")
    known = stages.put("open", known.join(some, "hub"))
    if not known.isEmpty():
        # each two blocks meet in one cell, to which the hub goes as well
        cell = (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("cell")
        blocked = known.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
        blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        at_home = blocked.filter("set <> hub").select("hub", cell, "set", "n", "label", "odd", (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") != F.col("other")).alias("cross"))
        hubs = blocked.filter("set = hub").select("hub", "blocks", "n", "label", "other", F.explode(F.sequence(F.lit(0), F.col("other"))).alias("block"))
        hubs = hubs.select("hub", cell, F.col("hub").alias("set"), "n", "label", F.lit(False).alias("odd"), F.lit(0).alias("side"), (F.col("block") != F.col("other")).alias("cross"))
        rows = at_home.unionByName(hubs).join(known_sets.select("set", "bits"), "set")
        rows = stages.put("hopeful", rows.groupBy("hub", "cell").applyInArrow(hopeful, HOPEFUL_DDL))
        rows = rows.join(fetched(rows.select("set"), "open"), "set")
        more = stages.put("more", rows.groupBy("hub", "cell").applyInArrow(settle, "a long, b long"))
        if not more.isEmpty():
            labels = stages.put("labels-all", components(links.unionByName(more), stages, "cc-all"))

    least = classes.join(labels, F.col("set") == F.col("node"), "left").select("set", "rep", F.coalesce("label", "set").alias("label"))
    smallest = least.groupBy("label").agg(F.min("rep").alias("component"))
    ids = stages.put("ids", least.join(smallest, "label").select(F.col("set").alias("s"), "rep", "component"))
    out = docs.join(ids, (docs.set == ids.s) & (docs.n > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component, the smallest doc_id, with all columns; repeated rows of it count once."""
    name = unused("stay")
    stay = near_groups(documents).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    kept = documents.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
