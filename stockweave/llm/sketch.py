"""A count sketch over hashed features of all documents; it orders work by rareness and never decides a result."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of the sketch, and of one of the pieces in which tasks send it.
CELLS, PIECE = 1 << 22, 1 << 16


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def add(cells: np.ndarray, hashes: np.ndarray) -> None:
    np.add.at(cells, cell_of(hashes), 1)


def pieces(cells: np.ndarray) -> list[bytes]:
    return [zlib.compress(cells[at : at + PIECE].astype(np.int32).tobytes(), 1) for at in range(0, CELLS, PIECE)]


def add_pieces(rows: pa.Table) -> pa.Table:
    total = np.zeros(PIECE, dtype=np.int64)
    for blob in rows.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(blob), dtype=np.int32)
    return pa.table({"piece": rows.column("piece")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def levels(sent: DataFrame) -> np.ndarray:
    """Rareness of each cell from the tasks' pieces: 0 up to what chance gives, then twice the logarithm. 4 MB, always."""
    counts = np.zeros(CELLS, dtype=np.int64)
    for r in sent.select("piece", "counts").groupBy("piece").applyInArrow(add_pieces, "piece int, counts binary").collect():
        counts[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["counts"], dtype=np.int64)
    mean = counts.mean()
    out = np.zeros(CELLS, dtype=np.uint8)
    for at in range(0, CELLS, PIECE):  # by pieces, so the driver holds no other array of all cells
        beyond = (counts[at : at + PIECE] - mean) / (3 * np.sqrt(mean) + 1)  # a cell of rare features holds mean +- its root
        out[at : at + PIECE] = np.clip(np.log2(np.maximum(beyond, 1.0)) * 2, 0, 63)
    return out
