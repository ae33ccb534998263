"""Collocations: phrases of two to ``LONGEST`` words whose parts keep each other company, for each language.

N-grams are first counted in count-min sketches, ``DEPTH`` rows of counters that stop at 255 for each order.  A task
sends its sketch as sorted places with their counts, in compressed slices, so that what is shuffled grows with the texts
and hardly with the width; slices are added up one after the other, and what remains of a counter is one bit: whether it
reaches ``least``.  Sketches never count too little, so an n-gram one of whose bits is missing is certainly rare, and
so is every longer one around it: orders 1 and 2 are sketched first, longer ones in a second pass and only where all
the shorter n-grams in them may be frequent.  A last pass counts exactly, as words and not as hashes, what survives.
Its sums are exact whatever the sketches let through; only these rows are shuffled, pre-aggregated.  Then counts
of both parts are joined to each cut of a candidate, and a candidate gets the largest count of a longer one around it.

The width follows the number of words (one counter for ``LOAD`` pairs, a quarter of that for the other orders), up to
``MAX_WIDTH``; the bits that are sent out have 0.44 bytes for each counter of that, 117 MB at most.  Beyond
``LOAD * MAX_WIDTH`` words (some 8 billion) the sketches let more of the rare n-grams through to the last pass, whose rows
are then up to all distinct n-grams of each stretch of texts; results stay the same.

Defined results: A-Z are lower-cased, pieces end at ``.,;:!?`` and line ends, words are runs without blanks and tabs;
a null or empty text has no words, a null language is ``und``; repeated rows count as often as they occur; ties in the
ranking are broken by count and then by the phrase's bytes; an empty table, or one without frequent phrases, gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import wordhash
from canvass.llm.storage import documents, stored

LEAST, LONGEST, COVERED, TOP = 30, 4, 80, 2000
DEPTH, LOAD, MIN_WIDTH, MAX_WIDTH = 2, 32, 1 << 16, 1 << 28
#: Slices of a row of a sketch, the value at which counters stop, and places that are sent together.
SLICES, FULL, FLUSH = 64, 255, 4_000_000
#: Bytes of texts whose n-grams are counted together, before anything is shuffled.
CHUNK_BYTES = 4 << 20

_U = np.uint64
#: What parts words: blanks, tabs and the ends of pieces.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_BREAKS = _ENDS.copy()
_BREAKS[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts, and the hashes of n-grams that stay within a piece."""

    def __init__(self, texts: pa.Array, langs: list[str]) -> None:
        data, offsets = wordhash.buffers(texts)
        self.low, offsets = _LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
        self.names = sorted(set(langs))
        number = {v: i for i, v in enumerate(self.names)}
        self.salts = np.array([int.from_bytes(blake2b(v.encode(), digest_size=8).digest()) for v in self.names], dtype=np.uint64)
        of_text = np.array([number[v] for v in langs], dtype=np.int32)
        found, pieces = [], 0
        for a, b in wordhash.chunks(offsets):  # what is computed of a stretch is many times its size
            some, ends = self.low[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            hashes, at = wordhash.word_hashes(some, ends, False, _BREAKS)
            starts, stops, _ = wordhash.word_bounds(some, ends, _BREAKS)
            text = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(at))
            piece = (np.cumsum(_ENDS[some], dtype=np.int32)[starts] if len(starts) else text) + text + np.int32(pieces)
            found.append((hashes, (starts + offsets[a]).astype(np.int32), (stops + offsets[a]).astype(np.int32), piece, of_text[a:b][text]))
            pieces = int(piece[-1]) + 1 if len(piece) else pieces
        kinds = (np.uint64, np.int32, np.int32, np.int32, np.int32)
        self.hashes, self.starts, self.ends, self.piece, self.lang = (np.concatenate([np.empty(0, dtype=k), *c]) for k, c in zip(kinds, zip(*found, strict=True) if found else [()] * 5, strict=True))
        self.n_words = np.bincount(self.lang, minlength=len(self.names))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams start, and the hash of each with its language."""
        grams = wordhash.ngram_hashes(self.hashes, n)
        at = np.flatnonzero(self.piece[: len(grams)] == self.piece[n - 1 :]) if len(grams) else np.empty(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            return at, wordhash.mix(grams[at] + self.salts[self.lang[at]] * _U(2 * n + 1))

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.low[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + n))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of the rows of batches, about limit bytes of texts at a time; longer texts come alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, offsets = wordhash.buffers(batch.column("text"))
        for a, b in wordhash.chunks(offsets, limit):
            held.append(batch.slice(a, b - a))
            size += int(offsets[b] - offsets[a])
            if size >= limit:
                yield _words(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield _words(held)


def _words(held: list[pa.RecordBatch]) -> Words:
    texts, langs = (pa.chunked_array([b.column(c) for b in held]) for c in ("text", "lang"))
    return Words(texts, langs.to_pylist())


def width_of(n: int, width: int) -> int:
    """Counters of a row of the sketch of n-grams of n words."""
    return width if n == 2 else width // 4


def places(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The counter of each hash in a row of a sketch."""
    return (hashes >> _U(32 * row) & _U(width - 1)).astype(np.uint32)


def packed(places_: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted places and their counts: gaps by bytes of the same rank, as the higher ones are nearly all 0."""
    gaps = np.diff(places_, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return pa.compress(gaps.T.tobytes() + counts.astype(np.uint8).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: pa.Buffer, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 5 * n, codec="zstd"), dtype=np.uint8)
    gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.int64), raw[4 * n :]


def candidates(words: Words, bits: dict[int, np.ndarray], width: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By order: starts and hashes of the n-grams that may be frequent by what is known, as may be all n-grams in them."""
    alive = np.ones(len(words.hashes) + 1, dtype=bool)
    for n in range(1, longest + 1):
        at, hashes = words.ngrams(n)
        ok = alive[at] & alive[at + 1] if n > 1 else alive[at]
        for row in range(DEPTH if n in bits else 0):
            p = places(hashes, row, width_of(n, width))
            ok &= (bits[n][row][p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        at, hashes = at[ok], hashes[ok]
        alive = np.zeros(len(alive), dtype=bool)
        alive[at] = True
        yield n, at, hashes


def _sketches(known, width: int, orders: tuple[int, ...]):
    """Sketches of the orders, in slices, of FLUSH places at a time."""

    def sent(waiting: dict[tuple[int, int], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (n, row), some in waiting.items():
            found, counts = np.unique(np.concatenate(some), return_counts=True)
            size = width_of(n, width) // SLICES
            cuts = np.searchsorted(found, np.arange(SLICES + 1) * size)
            whole = [s for s in range(SLICES) if cuts[s] < cuts[s + 1]]
            data = [packed(found[cuts[s] : cuts[s + 1]] - np.uint32(s * size), np.minimum(counts[cuts[s] : cuts[s + 1]], FULL)) for s in whole]
            columns = [[n] * len(whole), [row] * len(whole), whole, [int(cuts[s + 1] - cuts[s]) for s in whole], data]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, [*[pa.int32()] * 4, pa.binary()], strict=True)], names=["n", "row", "slice", "size", "counts"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, waiting, held = known.value if known else {}, {}, 0
        for words in chunks(batches):
            for n, _, hashes in candidates(words, bits, width, max(orders)):
                for row in range(DEPTH if n in orders and len(hashes) else 0):
                    waiting.setdefault((n, row), []).append(places(hashes, row, width_of(n, width)))
                    held += len(hashes)
            if held >= FLUSH:
                yield from sent(waiting)
                waiting, held = {}, 0
        yield from sent(waiting)

    return fill


def _merged(width: int, least: int):
    """Slices of all tasks added up one after the other; whether each counter reaches least, as bits."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("n", "row", "slice", "size")), strict=True)
            for i, (n, row, part, size) in enumerate(keys):
                own = sums.setdefault((n, row, part), np.zeros(width_of(n, width) // SLICES, dtype=np.uint8))
                at, counts = unpacked(batch.column("counts")[i].as_buffer(), size)
                own[at] = np.minimum(own[at].astype(np.uint16) + counts, FULL)
        for key, own in sums.items():
            bits = np.packbits(own >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([*(pa.array([v], type=pa.int32()) for v in key), pa.array([bits], type=pa.binary())], names=["n", "row", "slice", "bits"])

    return merge


def frequent_bits(texts: DataFrame, width: int, least: int, longest: int) -> dict[int, np.ndarray]:
    """For each order the bits of its rows: whether the merged counter reaches least."""
    out: dict[int, np.ndarray] = {}
    for orders in ((1, 2), tuple(range(3, longest + 1))):
        if not orders:
            continue
        known = texts.sparkSession.sparkContext.broadcast(out) if out else None
        slices = texts.mapInArrow(_sketches(known, width, orders), "n int, row int, slice int, size int, counts binary")
        found = {n: np.zeros((DEPTH, width_of(n, width) // 8), dtype=np.uint8) for n in orders}
        for r in slices.repartition("n", "row", "slice").mapInArrow(_merged(width, least), "n int, row int, slice int, bits binary").toLocalIterator():
            size = len(r["bits"])
            found[r["n"]][r["row"], r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["bits"], dtype=np.uint8)
        out = out | found
    return out


def _counted(shared, width: int, longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for words in chunks(batches):
            langs, phrases, sizes, times = list(words.names), [None] * len(words.names), [0] * len(words.names), words.n_words.tolist()
            for n, at, hashes in candidates(words, bits, width, longest):
                _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                starts = at[first]
                phrases += [words.phrase(i, n) for i in starts.tolist()]
                langs += [words.names[i] for i in words.lang[starts].tolist()]
                sizes += [n] * len(starts)
                times += counts.tolist()
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            found = (langs, (p if p is None else p.decode("utf-8", "replace") for p in phrases), sizes, times)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(found, kinds, strict=True)], names=["lang", "phrase", "n", "f"])

    return count


def sketch_width(n_words: int) -> int:
    width = MIN_WIDTH
    while width < MAX_WIDTH and width * LOAD < n_words:
        width *= 2
    return width


def ngram_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, width: int | None = None) -> DataFrame:
    """Exact counts of all n-grams that occur least times or more: lang, phrase, n (words), f; the row without a phrase
    has a language's number of words."""
    if not 1 <= least <= FULL:
        raise ValueError(f"least is 1 to {FULL}")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    if width is not None and (width < 2048 or width & (width - 1)):
        raise ValueError("width is a power of 2 from 2048 on")
    if width is None:  # the width needs no exact number: a word has about six bytes
        width = sketch_width((texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // 6)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_bits(texts, width, least, longest))
    rows = texts.mapInArrow(_counted(shared, width, longest), "lang string, phrase string, n int, f long")
    return rows.groupBy("lang", "phrase", "n").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull())


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, width: int | None = None) -> DataFrame:
    """The best top phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = stored(ngram_counts(docs, least, longest, width), "ngram-counts")
    grams = counts.where(F.col("phrase").isNotNull())
    words = F.split("phrase", " ")
    cuts = grams.where("n > 1").select("lang", "phrase", "n", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "n", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("rest")
    )
    part = lambda c, f: grams.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    exact = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    scored = scored.withColumn("score", F.expr(f"({exact('a')} * 2000000BD) div ({exact('l')} + {exact('r')})"))
    best = scored.groupBy("lang", "phrase", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    around = grams.where("n > 2").select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_times("longer", 100) < _times("a", covered)))
    total = counts.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n_lang"))
    free = free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = free.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank").where(F.col("rank") <= top)
    # as many rows as there are languages with a frequent phrase, top for each at most
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_lang").alias("n"), "score")


def _times(c: str, factor: int) -> Column:
    return F.col(c).cast("decimal(20,0)") * F.lit(factor).cast("decimal(10,0)")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), total AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m))
  GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM g WHERE m > 1
), s AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * c.a // (l.f + r.f) AS BIGINT) AS score
  FROM c JOIN g AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : c.k], ' ')
  JOIN g AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1 : c.m], ' ')
), best AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, ws, m, a, unnest(range(1, len(ws) - m + 2)) AS i
        FROM (SELECT DISTINCT lang, ws, a, unnest(range(2, len(ws))) AS m FROM c))
  GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, total.n, b.score,
    row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank
  FROM best AS b JOIN total USING (lang) LEFT JOIN inside USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 80 * b.a
) WHERE rank <= 2000
"""
