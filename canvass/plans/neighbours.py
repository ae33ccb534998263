"""Nearest rows, exact, without a meeting of all pairs.

Rows lie in cells around pivots.  A first meeting with a query's own cell bounds
the distance of its k-th nearest row; the triangle inequality and the planes
between pivots then rule cells out, and the query visits only the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from canvass.plans.storage import stored

#: Rows of a cell on average, as long as MAX_CELLS of them are enough; pivots and cell statistics go to every task.
CELL, MAX_CELLS = 2048, 2048
#: Rows and queries that meet in one task: larger cells are cut by hashes.
CHUNK, QUERY_CHUNK = 8192, 16384


def vector(*columns) -> F.Column:
    """Numbers as one array of doubles in which both zeros are alike."""
    return F.array(*(c.cast("double") + F.lit(0.0) for c in columns))


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no or several chunks
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by differences, so that equal ones are equal in every meeting."""
    d = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d += (a[:, i, None] - b[:, i]) ** 2
    return np.sqrt(d)


def _best(q: np.ndarray, o: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many, places, distances) of the k nearest of ``o`` for each of ``q``, the first of equals, within a limit."""
    count, place, far = [], [np.empty(0, dtype=np.int64)], [np.empty(0)]
    for a in range(0, len(q), 64):
        d = _distances(q[a : a + 64], o)
        most = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(o) else np.full(len(d), np.inf)
        if limit is not None:
            most = np.minimum(most, limit[a : a + 64])
        for row, m in zip(d, most, strict=True):
            some = np.flatnonzero(row <= m)
            some = some[np.argsort(row[some], kind="stable")[:k]]
            count.append(len(some))
            place.append(some)
            far.append(row[some])
    return np.array(count, dtype=np.int64), np.concatenate(place), np.concatenate(far)


def _lists(others: pa.Table, keys: Sequence[str], count: np.ndarray, place: np.ndarray, far: np.ndarray) -> pa.Array:
    """For each query its found rows as structs of distance and keys."""
    take = lambda c: pa.concat_arrays(x.chunks) if (x := others.column(c).take(pa.array(place))).num_chunks else pa.array([], x.type)
    items = pa.StructArray.from_arrays([pa.array(far), *(take(c) for c in keys)], names=["__dist", *keys])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), items)


def nearest(
    rows: DataFrame, keys: Sequence[str], k: int, width: int, queries: DataFrame | None = None, cell: int = CELL, chunk: int = CHUNK, query_chunk: int = QUERY_CHUNK
) -> DataFrame:
    """The k nearest rows of each distinct query: __at, __near (structs of __dist and the keys, in this order).

    ``rows`` hold __at, a vector of ``width`` numbers, and the key columns, whose order decides between equally near rows;
    ``queries`` hold __at, and by default they are the rows themselves.  Vectors and keys are not null.  Rows alike in
    their vector count only as far as k of them, which cannot change a result.  Fewer than k rows are all of them.

    The driver holds at most MAX_CELLS pivots and counts.  A task meets ``chunk`` rows and ``query_chunk`` queries, whatever
    lies in one cell.  Where no cell can be ruled out (values in many dimensions), each query visits every cell.
    """
    spark = rows.sparkSession
    rank = F.row_number().over(Window.partitionBy("__at").orderBy(*keys))
    points = stored(rows.select("__at", *keys).withColumn("__r", rank).where(F.col("__r") <= k), "points")
    found_type = T.ArrayType(T.StructType([T.StructField("__dist", T.DoubleType()), *(points.schema[c] for c in keys)]))
    n = points.count()
    chosen = points.where("__r = 1").orderBy(F.xxhash64("__at"), "__at").limit(min(n // cell + 1, MAX_CELLS)).select("__at").collect()
    if not chosen:
        asked = rows.select("__at") if queries is None else queries.select("__at").distinct()
        return asked.withColumn("__near", F.array().cast(found_type))
    pivots = np.array([r[0] for r in chosen], dtype=float).reshape(len(chosen), width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("__at"), width)
            own, far = np.empty(len(x), dtype=np.int32), np.empty(len(x))
            for a in range(0, len(x), 256):
                d = _distances(x[a : a + 256], pivots)
                own[a : a + 256] = at = d.argmin(axis=1)
                far[a : a + 256] = d[np.arange(len(d)), at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(far)], names=[*b.schema.names, "__cell", "__far"])

    placed = lambda df: df.mapInArrow(assign, T.StructType([*df.schema, T.StructField("__cell", T.IntegerType()), T.StructField("__far", T.DoubleType())]))
    cells = stored(placed(points), "cells")
    asked = cells.where("__r = 1").select("__at", "__cell") if queries is None else stored(placed(queries.select("__at").distinct()).select("__at", "__cell"), "queries")

    def per_cell(df: DataFrame, *aggs) -> dict[int, tuple]:
        """Statistics of cells, of which there are at most MAX_CELLS."""
        return {r[0]: tuple(r)[1:] for r in df.groupBy("__cell").agg(*aggs).collect()}

    stats = per_cell(cells, F.count("*"), F.max("__far"))
    size = np.array([stats.get(i, (0, 0.0))[0] for i in range(len(pivots))])
    radius = np.array([stats.get(i, (0, 0.0))[1] for i in range(len(pivots))])
    chunks = size // chunk + 1
    between = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 0)) if len(pivots) * len(pivots) * width <= 1 << 26 else np.stack([_distances(p[None], pivots)[0] for p in pivots])

    def parts(of: dict[int, tuple]) -> DataFrame:
        return spark.createDataFrame([(i, int(of.get(i, (0,))[0] // query_chunk + 1), int(chunks[i])) for i in range(len(pivots))], "__cell int, __parts int, __chunks int")

    def meet(left: DataFrame, right: DataFrame, of: dict[int, tuple], function, schema: T.StructType) -> DataFrame:
        """Queries and rows of a cell by chunks of both: queries (with __chunk) once, rows once for each part of the queries."""
        table = F.broadcast(parts(of))
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # of one table: their columns need own names
        q = left.join(table.select("__cell", "__parts"), "__cell").withColumn("__part", F.pmod(F.xxhash64("__at"), "__parts").cast("int")).drop("__parts")
        o = right.join(table, "__cell").withColumn("__chunk", F.pmod(F.xxhash64(*keys), "__chunks").cast("int"))
        o = o.select("__at", *keys, "__cell", "__chunk", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
        by = ("__cell", "__chunk", "__part")
        return q.groupBy(*by).cogroup(o.groupBy(*by)).applyInArrow(function, schema)

    order = [(c, "ascending") for c in keys]
    no_others = not len(pivots) > 1 and chunks[0] == 1

    def first(queries: pa.Table, others: pa.Table) -> pa.Table:
        others = others.sort_by(order)
        q, o = _matrix(queries.column("__at"), width), _matrix(others.column("__at"), width)
        own = queries.column("__cell").to_numpy()
        count, place, far = _best(q, o, k)
        limit = np.full(len(q), np.inf)
        full = count == k
        limit[full] = far[np.cumsum(count)[full] - 1]
        visits: list[np.ndarray] = []
        for a in range(0, 0 if no_others else len(q), 256):
            d = _distances(q[a : a + 256], pivots)
            c, at = own[a : a + 256], np.arange(len(d))
            reach = np.argsort(d + radius, axis=1)
            enough = (np.cumsum(size[reach], axis=1) >= k).argmax(axis=1)
            if size.sum() >= k:
                limit[a : a + 256] = np.minimum(limit[a : a + 256], ((d + radius)[at, reach[at, enough]]) * (1 + 1e-12))
            t = limit[a : a + 256, None]
            slack = 1e-9 * (d + radius)
            gap = between[c]
            plane = np.where(gap > 1e-6 * d, (d * d - (d[at, c] ** 2)[:, None]) / np.maximum(2 * gap, 1e-300), 0.0)
            near = (np.maximum(d - radius, plane) <= t + slack) & (size > 0)
            near[at, c] = chunks[c] > 1
            visits += [np.flatnonzero(v).astype(np.int32) for v in near]
        targets = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([len(v) for v in visits] or [0] * len(q))]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *visits]))
        )
        names = ["__at", "__cell", "__limit", "__found", "__targets"]
        return pa.Table.from_arrays([queries.column("__at"), queries.column("__cell"), pa.array(limit), _lists(others, keys, count, place, far), targets], names=names)

    def later(queries: pa.Table, others: pa.Table) -> pa.Table:
        others = others.sort_by(order)
        q, o = _matrix(queries.column("__at"), width), _matrix(others.column("__at"), width)
        count, place, far = _best(q, o, k, queries.column("__limit").to_numpy())
        some = pa.array(count > 0)
        return pa.Table.from_arrays([queries.column("__at"), _lists(others, keys, count, place, far)], names=["__at", "__found"]).filter(some)

    at_field, found_field = T.StructField("__at", T.ArrayType(T.DoubleType())), T.StructField("__found", found_type)
    first_schema = T.StructType([at_field, T.StructField("__cell", T.IntegerType()), T.StructField("__limit", T.DoubleType()), found_field, T.StructField("__targets", T.ArrayType(T.IntegerType()))])
    own_counts = per_cell(asked, F.count("*"))
    # rows of other chunks than the first are met later, like those of other cells
    table = F.broadcast(parts({}).select("__cell", "__chunks"))
    beginning = cells.join(table, "__cell").where(F.pmod(F.xxhash64(*keys), "__chunks") == 0).drop("__chunks")
    start = stored(meet(asked.withColumn("__chunk", F.lit(0)), beginning, own_counts, first, first_schema).where(F.col("__at").isNotNull()), "nearest")
    if no_others:
        return start.select("__at", F.col("__found").alias("__near"))
    visits = start.select("__at", "__limit", F.col("__cell").alias("__own"), F.explode("__targets").alias("__cell"))
    target_counts = per_cell(visits, F.count("*"))
    visits = visits.join(table, "__cell").withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
    visits = visits.where((F.col("__own") != F.col("__cell")) | (F.col("__chunk") > 0)).select("__at", "__limit", "__cell", "__chunk")
    more = meet(visits, cells, target_counts, later, T.StructType([at_field, found_field]))
    merged = start.select("__at", "__found").unionByName(more).groupBy("__at").agg(F.flatten(F.collect_list("__found")).alias("__found"))
    return merged.select("__at", F.slice(F.array_sort("__found"), 1, k).alias("__near"))
