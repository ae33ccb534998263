"""Product codes of vectors: exact integer Lloyd rounds that rescan only what may have moved.

Components become integers ``floor(SCALE * x)``; a vector is cut into ``PARTS`` equal parts, and each part
position has a codebook of its own.  After the first assignment a part knows its slack: the distance to its second
nearest entry less that to its own.  As long as the cumulative drift of its entry and of the others (the largest
one) is below the slack, its nearest entry is certainly the same.  So every block of vectors keeps, for each part
position and entry, a heap keyed by slack plus the drift so far.  A round pops only keys that the drift has reached,
rescans those parts exactly and pushes them on the heap of the entry that they now belong to.  Keys are fixed-point
integers rounded down, so a doubtful part is always rescanned and ties always end at the lower index.

A block is one row of a table in the shared folder: its rows, integers, codes and heaps, and what its moves add to
the sums of each entry.  A round is one narrow map over the blocks and one aggregation of those sums; the driver sees
a codebook (``PARTS * ENTRIES`` entries, whatever the table holds), and a lost executor costs the blocks it had in work.

Defined results: rows go whose vector is null or holds null, NaN or infinite components; vectors that are shorter than
the longest kept one, or than a multiple of ``PARTS``, count as filled up with zeros (an empty vector is all zeros);
integers beyond +-2**27 are taken as +-2**27, so that every distance is exact in 64 bits; a null id is coded, but never
gives an entry; of repeated ids the smallest vector comes first; fewer rows than entries make a smaller codebook;
repeated rows are coded alike; an empty table gives no rows; further columns pass through, but for those named ``code``
or ``error``, which the results replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.llm.storage import dropped, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are held within this, so that squares of differences add up in 64 bits.
LARGEST = 1 << 27
#: Rows of a block at most; keys have 16 binary places and the row's place in their last bits.
BLOCK_ROWS, PLACE_BITS, FRACTION = 4096, 12, 1 << 16
#: Slack of a part without a second entry.
ALONE = float(1 << 33)
#: Keys of groups that equal labels are spread over for the sums of errors.
SALTS = 32

Codebook = np.ndarray  # part, entry, component


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of width integers; the vectors are finite."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    sizes = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.asarray(vectors.flatten())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):  # infinite is beyond the limit as well
        out[row, at] = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return out


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of equals), its squared distance, and the slack to the second nearest."""
    d = np.zeros((len(points), len(entries)), dtype=np.int64)
    for j in range(points.shape[1]):
        gap = points[:, j, None] - entries[None, :, j]
        d += gap * gap
    rows = np.arange(len(points))
    own = d.argmin(axis=1)
    best = d[rows, own]
    if len(entries) == 1:
        return own, best, np.full(len(points), ALONE)
    d[rows, own] = np.iinfo(np.int64).max
    return own, best, np.sqrt(d.min(axis=1).astype(float)) - np.sqrt(best.astype(float))


def drifts(old: Codebook, new: Codebook) -> np.ndarray:
    """By part and entry: how far the entry has moved plus how far any other has, at most."""
    moved = np.sqrt(((new - old) ** 2).sum(axis=2).astype(float))
    if moved.shape[1] < 2:
        return moved
    top = np.sort(moved, axis=1)
    others = np.where(np.arange(moved.shape[1]) == moved.argmax(axis=1)[:, None], top[:, -2:-1], top[:, -1:])
    return moved + others


class Heaps:
    """The heaps of a block: for each part position, those of its entries."""

    def __init__(self, parts: int, entries: int) -> None:
        self.heaps: list[list[list[int]]] = [[[] for _ in range(entries)] for _ in range(parts)]

    @staticmethod
    def key(slack: np.ndarray, drift: np.ndarray) -> np.ndarray:
        return np.floor((slack + drift) * FRACTION).astype(np.int64)

    def push(self, part: int, entries: np.ndarray, keys: np.ndarray, places: np.ndarray) -> None:
        heaps = self.heaps[part]
        for e, item in zip(entries.tolist(), ((keys << PLACE_BITS) | places).tolist(), strict=True):
            heappush(heaps[e], item)

    def fill(self, part: int, entries: np.ndarray, keys: np.ndarray, places: np.ndarray) -> None:
        """All parts at once: a sorted list is a heap."""
        items = (keys << PLACE_BITS) | places
        order = np.lexsort((items, entries))
        cuts = np.searchsorted(entries[order], np.arange(len(self.heaps[part]) + 1)).tolist()
        items = items[order].tolist()
        self.heaps[part] = [items[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def pop(self, part: int, drift: np.ndarray) -> np.ndarray:
        """Places of the parts whose key the drift of their entry has reached (one more unit for what was rounded)."""
        out, mask = [], (1 << PLACE_BITS) - 1
        for heap, reached in zip(self.heaps[part], (np.ceil(drift * FRACTION).astype(np.int64) + 1).tolist(), strict=True):
            limit = (reached + 1) << PLACE_BITS
            while heap and heap[0] < limit:
                out.append(heappop(heap) & mask)
        return np.array(sorted(out), dtype=np.int64)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(h) for part in self.heaps for h in part]
        return np.array([x for part in self.heaps for h in part for x in h], dtype=np.int64), np.array(sizes, dtype=np.int32)

    @classmethod
    def unpacked(cls, items: np.ndarray, sizes: np.ndarray, parts: int) -> Heaps:
        out = cls(parts, len(sizes) // parts)
        at, items = 0, items.tolist()
        for i, n in enumerate(sizes.tolist()):
            out.heaps[i // (len(sizes) // parts)][i % (len(sizes) // parts)] = items[at : at + n]
            at += n
        return out


def _moves(points: np.ndarray, places: np.ndarray, entries: np.ndarray, sign: int, n: int) -> np.ndarray:
    """What these parts add to (or take from) the count and component sums of each entry."""
    out = np.zeros((n, points.shape[1] + 1), dtype=np.int64)
    np.add.at(out, entries, sign * np.column_stack([np.ones(len(places), dtype=np.int64), points[places]]))
    return out


def _packed_points(x: np.ndarray) -> bytes:
    return (x.astype(np.int16) if not len(x) or np.abs(x).max() < 1 << 15 else x.astype(np.int32)).tobytes()


def _unpacked_points(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = np.int16 if len(data) == 2 * rows * width else np.int32
    return np.frombuffer(data, dtype=kind).reshape(rows, width).astype(np.int64)


def _state(rows: pa.Array, x: bytes, codes: np.ndarray, heaps: Heaps, moves: np.ndarray, popped: int, schema: pa.Schema) -> pa.RecordBatch:
    items, sizes = heaps.packed()
    listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], type=pa.int32()), rows)
    cells = [pa.array([x], type=pa.binary()), pa.array([codes.astype(np.uint8).tobytes()], type=pa.binary())]
    cells += [pa.array([v.ravel().tolist()], type=pa.list_(t)) for v, t in ((items, pa.int64()), (sizes, pa.int32()), (moves, pa.int64()))]
    return pa.RecordBatch.from_arrays([listed.cast(schema.field(0).type), *cells, pa.array([popped], type=pa.int64())], names=schema.names)


def _first(codebook: Codebook, width: int):
    """Blocks of rows with their first assignment."""
    parts, entries = codebook.shape[:2]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(a, BLOCK_ROWS)
                x = integers(some.column("__v"), width)
                split, places = x.reshape(len(x), parts, -1), np.arange(len(x))
                codes, heaps, moves = np.zeros((len(x), parts), dtype=np.int64), Heaps(parts, entries), []
                for p in range(parts):
                    codes[:, p], _, slack = nearest(split[:, p], codebook[p])
                    heaps.fill(p, codes[:, p], Heaps.key(slack, np.zeros(1)), places)
                    moves.append(_moves(split[:, p], places, codes[:, p], 1, entries))
                schema = pa.schema([pa.field(n, t) for n, t in zip(_NAMES, [pa.list_(some.schema.field("__row").type), *_KINDS], strict=True)])
                yield _state(some.column("__row"), _packed_points(x), codes, heaps, np.array(moves), codes.size, schema)

    return blocks


def _again(codebook: Codebook, drift: np.ndarray, width: int):
    """Blocks after another round: drift is the cumulative one of each entry."""
    parts, entries = codebook.shape[:2]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, x, codes, heaps = _opened(batch, i, parts, width)
                split, moves, popped = x.reshape(len(x), parts, -1), np.zeros((parts, entries, width // parts + 1), dtype=np.int64), 0
                for p in range(parts):
                    places = heaps.pop(p, drift[p])
                    if not len(places):
                        continue
                    popped += len(places)
                    to, _, slack = nearest(split[places, p], codebook[p])
                    heaps.push(p, to, Heaps.key(slack, drift[p][to]), places)
                    moved = to != codes[places, p]
                    gone = places[moved]
                    moves[p] = _moves(split[:, p], gone, codes[gone, p], -1, entries) + _moves(split[:, p], gone, to[moved], 1, entries)
                    codes[places, p] = to
                yield _state(rows, batch.column("x")[i].as_py(), codes, heaps, moves, popped, batch.schema)

    return blocks


def _opened(batch: pa.RecordBatch, i: int, parts: int, width: int) -> tuple[pa.Array, np.ndarray, np.ndarray, Heaps]:
    rows = batch.column("rows")[i].values
    codes = np.frombuffer(batch.column("codes")[i].as_py(), dtype=np.uint8).reshape(len(rows), parts).astype(np.int64)
    heaps = Heaps.unpacked(*(np.asarray(batch.column(c)[i].values) for c in ("items", "sizes")), parts)
    return rows, _unpacked_points(batch.column("x")[i].as_py(), len(rows), width), codes, heaps


_NAMES = ["rows", "x", "codes", "items", "sizes", "moves", "popped"]
_KINDS = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
_REST = "x binary, codes binary, items array<long>, sizes array<int>, moves array<long>, popped long"


def _coded(codebook: Codebook, width: int):
    """Rows of the blocks with code and error."""
    parts = codebook.shape[0]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, x, codes, _ = _opened(batch, i, parts, width)
                split = x.reshape(len(x), parts, -1)
                error = sum(((split[:, p] - codebook[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                hexed = codes.astype(np.uint8).tobytes().hex()
                text = [hexed[a : a + 2 * parts] for a in range(0, len(hexed), 2 * parts)]
                yield pa.RecordBatch.from_arrays([rows, pa.array(text, type=pa.string()), pa.array(error, type=pa.int64())], names=["__row", "code", "error"])

    return out


def _sums(state: DataFrame) -> np.ndarray:
    """Moves of all blocks added up, of any size; as many numbers as a codebook has and one for each entry."""
    each = state.select(F.posexplode("moves").alias("at", "v")).where("v <> 0")
    rows = each.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = np.zeros(max([r["at"] for r in rows], default=-1) + 1, dtype=object)
    for r in rows:
        out[r["at"]] = int(r["v"])
    return out


def vector_codes(
    df: DataFrame, vector: str, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebook, list[int]]:
    """Rows of df that have a usable vector with code (hexadecimal) and error, the final codebook, and the number of
    parts that each assignment looked at.  The codebook starts with the vectors of the smallest keys.
    The vectors themselves are not returned; ``entries`` is 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark, rest = df.sparkSession, [c for c in df.columns if c not in (vector, "code", "error")]
    usable = df.where(F.forall(F.col(vector).cast("array<double>"), lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))))
    rows = usable.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("__row"), F.col(vector).cast("array<double>").alias("__v"))
    kind = rows.schema["__row"].dataType
    empty = spark.createDataFrame([], T.StructType([*kind.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    longest = rows.agg(F.max(F.size("__v"))).first()[0]
    if longest is None:
        return empty, np.zeros((parts, 0, 0), dtype=np.int64), []
    width = max(1, -(-longest // parts)) * parts
    k = F.col(f"__row.`{key}`")
    start = rows.where(k.isNotNull()).select(k.alias("k"), "__v").orderBy("k", "__v").limit(entries).collect()
    first = integers(pa.array([r["__v"] for r in start] or [[]], type=pa.list_(pa.float64())), width)
    codebook = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    state_type = T.StructType([T.StructField("rows", T.ArrayType(kind)), *T.StructType.fromDDL(_REST).fields])
    state = stored(rows.mapInArrow(_first(codebook, width), state_type), "vector-blocks")
    sums, drift, looked = _sums(state), np.zeros(codebook.shape[:2]), []
    shape = (parts, codebook.shape[1], width // parts + 1)
    sums = np.concatenate([sums, np.zeros(int(np.prod(shape)) - len(sums), dtype=object)]).reshape(shape)
    for turn in range(rounds):
        looked.append(state.agg(F.sum("popped")).first()[0])
        updated = codebook.copy()
        for p, e in np.ndindex(*codebook.shape[:2]):
            if sums[p, e, 0]:
                updated[p, e] = [int(s) // int(sums[p, e, 0]) for s in sums[p, e, 1:]]
        drift = drift + drifts(codebook, updated)
        codebook, before = updated, state
        state = stored(before.mapInArrow(_again(codebook, drift, width), state_type), "vector-blocks")
        dropped(before)
        if turn + 1 < rounds:
            more = _sums(state)
            sums = sums + np.concatenate([more, np.zeros(sums.size - len(more), dtype=object)]).reshape(shape)
    looked.append(state.agg(F.sum("popped")).first()[0])
    coded = state.mapInArrow(_coded(codebook, width), T.StructType([T.StructField("__row", kind), *T.StructType.fromDDL("code string, error long").fields]))
    return coded.select("__row.*", "code", "error"), codebook, looked


def codebook_digest(codebook: Codebook) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebook.ravel().tolist())).encode()).hexdigest()


def label_sums(df: DataFrame, by: str, value: str, to: str, spread: Sequence[str]) -> DataFrame:
    """Add the sum of value over rows with an equal ``by`` (nulls together); rows of one label meet in SALTS groups."""
    sums = df.groupBy(by).agg(F.sum(value).alias(to)).select(F.col(by).alias("__by"), to, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salted = df.withColumn("__own", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return salted.join(sums, salted[by].eqNullSafe(sums["__by"]) & (salted["__own"] == sums["__salt"])).drop("__own", "__by", "__salt")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    coded, codebook, _ = vector_codes(vectors, "embedding", "vec_id")
    found = label_sums(coded, "label", "error", "label_error", ["vec_id", "code"])
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebook)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by plain aggregation: every part against every entry in each of the three assignments."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS (
  SELECT x.vec_id, x.label, x.rn, x.p, x.v, arg_min(c.e, (d, c.e)) AS e, min(d) AS d
  FROM x JOIN c{i} AS c ON c.p = x.p,
    LATERAL (SELECT list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.v, c.v)]) AS d)
  GROUP BY ALL
)""")
        if i < ROUNDS:
            steps.append(f"""
m{i} AS (
  SELECT p, e, list(m ORDER BY j) AS v FROM (
    SELECT p, e, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
    FROM (SELECT p, e, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j) GROUP BY ALL)
  ) GROUP BY ALL
),
c{i + 1} AS (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN m{i} AS m USING (p, e))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS f, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn
  FROM embeddings WHERE embedding IS NOT NULL AND len([1 for z in embedding if z IS NULL OR NOT isfinite(z)]) = 0
),
wide AS (SELECT CAST(greatest(1, ceil(max(len(f)) / {PARTS}.0)) AS BIGINT) AS w FROM kept),
q AS (
  SELECT vec_id, label, rn, w,
    [CAST(greatest(least(floor(coalesce(f[k], 0) * {SCALE}), {LARGEST}), -{LARGEST}) AS BIGINT) for k in range(1, w * {PARTS} + 1)] AS v
  FROM kept, wide
),
x AS (SELECT vec_id, label, rn, p, v[p * w + 1 : p * w + w] AS v FROM q, (SELECT unnest(range({PARTS})) AS p)),
c0 AS (SELECT p, rn - 1 AS e, v FROM x WHERE rn <= {ENTRIES} AND vec_id IS NOT NULL),{",".join(steps)},
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS}),
coded AS (
  SELECT rn, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY rn
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, book
"""


OP11_SQL = _sql()
