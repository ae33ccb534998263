"""Meetings of all pairs of rows, block by block, that shuffle no row.

Rows are packed into blocks, each of them one row of a stored table.  A task reads two groups of blocks and meets their
pairs, so what is written is one copy of the rows, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.plans.storage import SHUFFLE_CLEANUP, stored

#: Rows of a block; files that blocks are dealt to; bytes of blocks that are handed to Python at once.
BLOCK, FILES, BATCH_BYTES = 4096, 32, 32 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Block, numbers of its rows, their coordinates.
Block = tuple[int, np.ndarray, np.ndarray]


def packed(points: DataFrame, block_of: Callable[[np.ndarray], np.ndarray], blocks: int, width: int) -> DataFrame:
    """Points (number, at) as a stored table of blocks: block, number and at as bytes, in the order of numbers."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.array(block_of(np.asarray(b.column("number"))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([own, b.column("number"), b.column("at")], names=["block", "number", "at"])

    def pack(rows: pa.Table) -> pa.Table:
        number = rows.column("number").to_numpy()
        order = np.argsort(number)
        at = np.asarray(rows.column("at").combine_chunks().flatten(), dtype=float).reshape(len(number), width)
        return pa.table({"block": rows.column("block").slice(0, 1), "number": pa.array([number[order].tobytes()], pa.binary()), "at": pa.array([at[order].tobytes()], pa.binary())})

    placed = points.select("number", "at").mapInArrow(place, "block int, number long, at array<double>")
    placed = placed.repartition(max(1, min(blocks, FILES)), "block")
    return stored(placed.groupBy("block").applyInArrow(pack, "block int, number binary, at binary"), "blocks")


def met(blocks: DataFrame, work: Callable[[Iterator[tuple[Block, Block]]], Iterator[pa.RecordBatch]], schema: str, first: int, apart: int | None = None) -> DataFrame:
    """What work gives for pairs of blocks i <= j, each once: i below ``first``, and at most ``apart`` between them.

    Work is called once a task.  An action over the result runs within ``whole_blocks``.
    """
    left, right = blocks.toDF("i", "n", "a"), blocks.toDF("j", "m", "b")
    near = (F.col("i") <= F.col("j")) & (F.col("i") < first)
    if apart is not None:
        near = near & (F.col("j") - F.col("i") <= apart)

    def block(batch: pa.RecordBatch, r: int, names: str) -> Block:
        i, n, a = (batch.column(c)[r] for c in names)
        number = np.frombuffer(n.as_buffer(), dtype=np.int64)
        return i.as_py(), number, np.frombuffer(a.as_buffer(), dtype=float).reshape(len(number), -1)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work((block(b, r, "ina"), block(b, r, "jmb")) for b in batches for r in range(b.num_rows))

    return left.hint("shuffle_replicate_nl").join(right, near).mapInArrow(pairs, schema)


@contextmanager
def whole_blocks(spark: SparkSession, width: int, block: int) -> Iterator[None]:
    """For a while, as many pairs of blocks go to Python at once as BATCH_BYTES hold, and a query's shuffle files go with it."""
    wanted = {BATCH_ROWS: str(max(1, BATCH_BYTES // (16 * (width + 1) * block))), SHUFFLE_CLEANUP: "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def gaps(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of a and b; those of (a, b) and (b, a) are the same to the last bit."""
    return _gaps(a[:, None], b[None], metric)


def gap(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of a from those of b in the same places, as ``gaps`` has them."""
    return np.concatenate([np.zeros(0), *(_gaps(a[s : s + BLOCK], b[s : s + BLOCK], metric) for s in range(0, len(a), BLOCK))])


def _gaps(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        d = np.abs(a[..., i] - b[..., i])
        if metric == "euclidean":
            out += d * d
        elif metric == "cityblock":
            out += d
        else:
            np.maximum(out, d, out=out)
    return np.sqrt(out) if metric == "euclidean" else out


class Squares:
    """Squared distances of rows of a from all of b by one product of matrices, and how far off they may be."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        self.left = np.column_stack([a * -2.0, aa, np.ones(len(a))])
        self.right = np.column_stack([b, np.ones(len(b)), bb]).T.copy()
        self.scale = float(aa.max(initial=0.0) + bb.max(initial=0.0))
        self.error = 8 * (a.shape[1] + 4) * np.finfo(float).eps * self.scale

    def __getitem__(self, rows: slice) -> np.ndarray:
        return self.left[rows] @ self.right


def united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's component (its smallest node) when links a, b come to those of parent."""
    parent = parent.copy()
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
