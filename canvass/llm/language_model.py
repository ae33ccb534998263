"""Stupid-backoff language-model scores of all documents under the counts of all documents.

With n-grams of up to ``order`` words, a word w after the words v scores
c(v w) / c(v) if v w was counted ``MIN_COUNT`` times or more, else ``BACKOFF`` times
its score after v without its first word; without words before it, c(w) / N.  v are
the order - 1 words before w, or as many as there are.  A document's score is the sum
of the logarithms.  Counts are of the whole corpus.

The work is relational.  Texts are exploded into n-grams (64-bit hashes), one row
for each n-gram of a block of about ``BLOCK_BYTES`` of texts with its count in the
block, so that even the most common pair is one row of a block.  The count table
is a sum over these rows, partitioned by hash; it is joined to the exploded rows
where they lie (a window does both), and what a block does not know yet (other blocks have the n-gram
too) goes back to it, where scores are summed for each document.  Words and pairs
go in one step, each longer order in a step of its own: an n-gram is counted no more
often than the two shorter ones in it, so a longer step explodes only those whose two
parts have ``MIN_COUNT``; no score can use another.

Only on their way rows travel as arrays: those of one block whose hashes begin with the
same ``BUCKET_BITS`` bits.  A block has so many arrays at most, whatever the corpus holds,
and the volume grows in proportion to it.  One shuffle of the texts serves all steps.

Defined results: words are runs of non-space characters, A-Z in lower case; a
null or empty text has no words, score 0 and a null mean; n_backoff counts the words
that were backed off from their longest context; repeated rows count as
often as they occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm import wordhash
from canvass.llm.storage import documents, stored

MIN_COUNT, BACKOFF = 2, 0.4
#: Bytes of texts in a block, and for each partition of the count table.
BLOCK_BYTES, PART_BYTES = 16 << 20, 16 << 20
#: The order of ``op9_stupid_backoff_order3``.
ORDER = 3
#: First bits of a hash that the n-grams of an array share; there are so many units of work at most for the count table.
BUCKET_BITS = 14
#: The rest of a hash travels as a byte that repeats along a sorted array, a short and an int.
TOP_BITS = 64 - 48 - BUCKET_BITS
#: Answers that a block looks at together.
ANSWER_ROWS = 1024
_LISTS = "bucket int, block long, top array<tinyint>, high array<smallint>, low array<int>, n array<int>"
_SCORES = "doc_id long, n_words long, n_backoff long, n_single long, log_score double"


class _Block:
    """The words of a block's texts one after the other, and the totals of n-grams that end in them."""

    def __init__(self, texts: pa.Table) -> None:
        words = [w.copy() for w in wordhash.hashed_texts(texts.column("text"), fold=True)]
        self.doc_id = texts.column("doc_id")
        self.words = np.concatenate([np.empty(0, dtype=np.uint64), *words])
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        del words
        pa.default_memory_pool().release_unused()
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)))
        self.place = np.arange(len(self.words), dtype=np.int32) - np.repeat(self.begin[:-1], self.sizes).astype(np.int32)  # in its text
        self.totals: dict[int, np.ndarray] = {}

    def ending(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams end that a score can need, and their hashes."""
        at = np.flatnonzero(self.place >= n - 1).astype(np.int32)
        if n == 1:
            return at, self.words
        if n > 2:
            shorter = self.totals[n - 1] >= MIN_COUNT
            at = at[shorter[at] & shorter[at - 1]]
        hashes = np.empty(len(at), dtype=np.uint64)
        for part in _slices(len(at)):
            ends = at[part]
            first = ends[0] - (n - 1)
            hashes[part] = wordhash.ngram_hashes(self.words[first : ends[-1] + 1], n)[ends - (n - 1) - first]
        return at, hashes

    def learn(self, n: int, answers: pa.Table) -> None:
        """Totals of order n: those of the answers, and of n-grams without an answer the block's own counts."""
        at, hashes = self.ending(n)
        known = np.unique(hashes)
        which = np.empty(len(hashes), dtype=np.int32)
        for part in _slices(len(hashes)):  # by search, not by sorting: half of the memory
            which[part] = np.searchsorted(known, hashes[part])
        del hashes
        own = np.bincount(which, minlength=len(known))
        for batch in answers.to_batches(max_chunksize=ANSWER_ROWS) if len(known) else ():
            grams, totals = _totals(batch)
            to = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            mine = known[to] == grams
            own[to[mine]] = totals[mine]
        self.totals[n] = np.zeros(len(self.words), dtype=np.int64)
        for part in _slices(len(at)):
            self.totals[n][at[part]] = own[which[part]]

    def learn_all(self, answers: pa.Table, last: int) -> None:
        for n in range(1, last + 1):
            self.learn(n, answers)


def _slices(n: int, words: int = 1 << 18) -> Iterator[slice]:
    """Pieces of a block's arrays, so that what is computed of them on the way stays small."""
    return (slice(a, min(a + words, n)) for a in range(0, n, words))


def _totals(answers: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some answers and their totals."""
    whole = lambda c, bits: np.asarray(pc.list_flatten(answers.column(c))).astype(np.int64) & ((1 << bits) - 1)
    sizes = np.asarray(pc.list_value_length(answers.column("low")), dtype=np.int64)
    grams = np.repeat(np.asarray(answers.column("bucket")).astype(np.uint64), sizes) << np.uint64(48 + TOP_BITS)
    grams |= (whole("top", TOP_BITS) << 48 | whole("high", 16) << 32 | whole("low", 32)).view(np.uint64)
    return grams, whole("more", 32) << 15 | whole("total", 15)


def _counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and how often they occur; sorts the hashes where they are, to hold less."""
    hashes.sort()
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = hashes[1:] != hashes[:-1]
    starts = np.flatnonzero(first).astype(np.int32)
    return hashes[starts], np.diff(starts, append=np.int32(len(hashes)))


def _exploder(step: int):
    """A block's distinct n-grams of a step with their counts, as sorted arrays by the first bits of their hashes."""

    def explode(texts: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        if not len(texts):
            return _LISTS_SCHEMA.empty_table()
        who = texts.column("block")[0].as_py()
        block = _Block(texts)
        if answers is not None:
            block.learn_all(answers, step - 1)
        grams = [block.ending(n)[1] for n in ((1, 2) if step == 2 else (step,))]
        del block
        counts = [_counted(grams.pop()) for _ in range(len(grams))]
        entries, times = (np.concatenate(c) for c in zip(*counts, strict=True))
        del counts
        order = np.argsort(entries)
        entries, times = entries[order], times[order]
        del order
        buckets, starts = np.unique(entries >> np.uint64(48 + TOP_BITS), return_index=True)
        at = pa.array(np.append(starts, len(entries)).astype(np.int32))
        arrays = [
            (entries >> np.uint64(48) & np.uint64((1 << TOP_BITS) - 1)).astype(np.int8),
            (entries >> np.uint64(32)).astype(np.uint16).view(np.int16),
            entries.astype(np.uint32).view(np.int32),
            times,
        ]
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in arrays]
        return pa.Table.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(np.full(len(buckets), who, dtype=np.int64)), *lists], schema=_LISTS_SCHEMA)

    return explode if step > 2 else lambda texts: explode(texts)


_LISTS_SCHEMA = pa.schema(
    [
        ("bucket", pa.int32()),
        ("block", pa.int64()),
        ("top", pa.list_(pa.int8())),
        ("high", pa.list_(pa.int16())),
        ("low", pa.list_(pa.int32())),
        ("n", pa.list_(pa.int32())),
    ]
)


def _answers(lists: DataFrame, n_parts: int) -> DataFrame:
    """Exploded rows with the total of their n-gram, of n-grams that other blocks have too; arrays by block and bucket again.

    The count table lies in n_parts hash partitions with the rows that it is the sum of, so that a window joins the two
    without another shuffle.  An n-gram has no more rows than there are blocks.
    """
    rows = lists.repartition(n_parts, "bucket").select("bucket", "block", F.inline(F.arrays_zip("top", "high", "low", "n")))
    whole = lambda c, bits: F.col(c).cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    rest = F.shiftleft(whole("top", TOP_BITS), 48).bitwiseOR(F.shiftleft(whole("high", 16), 32)).bitwiseOR(whole("low", 32))
    rows = rows.select("bucket", "block", rest.alias("rest"), "n")
    signed = lambda v, bits: v.bitwiseAND(F.lit((1 << bits) - 1)).bitwiseXOR(F.lit(1 << (bits - 1))) - F.lit(1 << (bits - 1))
    same = Window.partitionBy("rest", "bucket")
    return (
        rows.withColumn("all", F.sum("n").over(same))
        .where(F.col("all") > F.col("n"))
        .groupBy("bucket", "block")
        .agg(
            F.collect_list(F.shiftright("rest", 48).cast("tinyint")).alias("top"),
            F.collect_list(signed(F.shiftright("rest", 32), 16).cast("smallint")).alias("high"),
            F.collect_list(signed(F.col("rest"), 32).cast("int")).alias("low"),
            F.collect_list(F.col("all").bitwiseAND(F.lit(32767)).cast("smallint")).alias("total"),
            F.collect_list(F.shiftright("all", 15).cast("int")).alias("more"),
        )
    )


def _scorer(order: int):
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(texts)
        block.learn_all(answers, order)
        sums = np.zeros((3, len(block.sizes)))
        for texts_at in _slices(len(block.sizes), 256):
            words = slice(block.begin[texts_at.start], block.begin[texts_at.stop])
            log = np.log(np.maximum(block.totals[1][words], 1))
            backed = np.zeros(len(log), dtype=bool)
            single = np.ones(len(log), dtype=bool)  # scored by the word alone: its count is yet to be divided by N
            for n in range(2, order + 1):
                later = np.flatnonzero(block.place[words] >= n - 1)  # the others have no such context to back off from
                total = block.totals[n][words][later]
                hit = total >= MIN_COUNT
                log[later[~hit]] += np.log(BACKOFF)
                log[later[hit]] = np.log(total[hit]) - np.log(block.totals[n - 1][words][later[hit] - 1])
                backed[later], single[later[hit]] = ~hit, False
            sizes = block.sizes[texts_at]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            for row, x in zip(sums, (backed, single, log), strict=True):
                row[texts_at] = np.bincount(owner, weights=x, minlength=len(sizes))
        return pa.Table.from_arrays(
            [block.doc_id, pa.array(block.sizes), *(pa.array(x.astype(np.int64)) for x in sums[:2]), pa.array(sums[2])],
            names=[x.split()[0] for x in _SCORES.split(", ")],
        )

    return score


def backoff_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, order: int = 2, part_bytes: int = PART_BYTES) -> DataFrame:
    """Score of each row of docs with n-grams of up to order words: doc_id, n_words, n_backoff, log_score, mean_log_score."""
    if order < 1:
        raise ValueError("order is 1 or more")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks, n_parts = int(size // block_bytes) + 1, int(size // part_bytes) + 1
    # rows repeated with one id and text are in as many blocks as input partitions
    blocks = docs.select(
        F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_blocks)).alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
    ).repartition(n_blocks, "block")
    found: list[DataFrame] = []
    for step in range(2, max(order, 2) + 1):
        told = blocks.groupBy("block") if not found else blocks.groupBy("block").cogroup(reduce(DataFrame.union, found).groupBy("block"))
        found.append(_answers(told.applyInArrow(_exploder(step), _LISTS), n_parts))
    answers = reduce(DataFrame.union, found)
    scores = stored(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(order), _SCORES), "scores")
    n_all = scores.agg(F.sum("n_words")).first()[0] or 1
    score = F.col("log_score") - F.col("n_single") * F.log(F.lit(float(max(n_all, 1))))
    return scores.select("doc_id", "n_words", "n_backoff", score.alias("log_score"), F.try_divide(score, F.col("n_words")).alias("mean_log_score"))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", "n_words", "n_backoff", *(F.round(c, 4).alias(c) for c in ("log_score", "mean_log_score")))


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(backoff_scores(documents(spark, sf_dir)))


def op9_stupid_backoff_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(backoff_scores(documents(spark, sf_dir), order=ORDER))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), t AS (
  SELECT doc_id, words[i] AS w2, CASE WHEN i > 1 THEN words[i - 1] END AS w1
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)
), u AS (
  SELECT w2 AS word, count(*) AS c FROM t GROUP BY w2
), b AS (
  SELECT w1, w2, count(*) AS c FROM t WHERE w1 IS NOT NULL GROUP BY w1, w2
), n AS (
  SELECT count(*) AS n FROM t
), s AS (
  SELECT t.doc_id, CAST(t.w1 IS NOT NULL AND b.c < 2 AS INTEGER) AS backed,
    CASE WHEN t.w1 IS NULL THEN ln(u2.c) - ln(n.n)
         WHEN b.c >= 2 THEN ln(b.c) - ln(u1.c)
         ELSE ln(0.4) + ln(u2.c) - ln(n.n) END AS log
  FROM t JOIN u AS u2 ON u2.word = t.w2 LEFT JOIN u AS u1 ON u1.word = t.w1
  LEFT JOIN b ON b.w1 = t.w1 AND b.w2 = t.w2 CROSS JOIN n
), g AS (
  SELECT doc_id, CAST(sum(backed) AS BIGINT) AS n_backoff, sum(log) AS log_score FROM s GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_backoff, 0) AS n_backoff,
  round(coalesce(log_score, 0), 4) AS log_score, round(log_score / len(words), 4) AS mean_log_score
FROM w LEFT JOIN g USING (doc_id)
"""

OP9_ORDER3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), t AS (
  SELECT doc_id, words[i] AS w3, CASE WHEN i > 1 THEN words[i - 1] END AS w2, CASE WHEN i > 2 THEN words[i - 2] END AS w1
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)
), u AS (
  SELECT w3 AS a, count(*) AS c FROM t GROUP BY ALL
), b AS (
  SELECT w2 AS a, w3 AS b, count(*) AS c FROM t WHERE w2 IS NOT NULL GROUP BY ALL
), d AS (
  SELECT w1 AS a, w2 AS b, w3 AS c3, count(*) AS c FROM t WHERE w1 IS NOT NULL GROUP BY ALL
), n AS (
  SELECT count(*) AS n FROM t
), s AS (
  SELECT t.doc_id, CAST(CASE WHEN w2 IS NULL THEN FALSE WHEN w1 IS NULL THEN b2.c < 2 ELSE d.c < 2 END AS INTEGER) AS backed,
    CASE WHEN w2 IS NULL THEN ln(u3.c) - ln(n.n)
         WHEN d.c >= 2 THEN ln(d.c) - ln(b1.c)
         WHEN b2.c >= 2 THEN ln(b2.c) - ln(u2.c) + CASE WHEN w1 IS NULL THEN 0 ELSE ln(0.4) END
         ELSE ln(u3.c) - ln(n.n) + ln(0.4) + CASE WHEN w1 IS NULL THEN 0 ELSE ln(0.4) END END AS log
  FROM t JOIN u AS u3 ON u3.a = t.w3 LEFT JOIN u AS u2 ON u2.a = t.w2
  LEFT JOIN b AS b2 ON b2.a = t.w2 AND b2.b = t.w3 LEFT JOIN b AS b1 ON b1.a = t.w1 AND b1.b = t.w2
  LEFT JOIN d ON d.a = t.w1 AND d.b = t.w2 AND d.c3 = t.w3 CROSS JOIN n
), g AS (
  SELECT doc_id, CAST(sum(backed) AS BIGINT) AS n_backoff, sum(log) AS log_score FROM s GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_backoff, 0) AS n_backoff,
  round(coalesce(log_score, 0), 4) AS log_score, round(log_score / len(words), 4) AS mean_log_score
FROM w LEFT JOIN g USING (doc_id)
"""
