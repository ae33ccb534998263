"""Quality rules: base rules, then an isolation forest on the rule statistics.

Statistics are per document and computed for all of them in one narrow map.  The
forest is grown from a bounded sample of labelled rows (``MAX_FIT_ROWS``, those
with the smallest hash of their id; good ones grow the trees, all give the span of the cuts) and is
a few MB whatever the corpus holds; every document is scored.  The threshold is the anomaly score above which
no more than ``GOOD_LOSS`` of *all* labelled good rows lie.

Defined results: a null or empty text has no words and fails the base rules;
ties at the threshold are kept; with labelled rows but no good one the threshold
is ``DEFAULT_THRESHOLD``, and with no labelled row only the base rules decide; repeated rows are judged alike; further columns pass
through.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.llm import wordhash
from canvass.llm.storage import documents, stored

MAX_FIT_ROWS = 20_000
TREES, SUBSAMPLE, DEPTH = 100, 256, 10
GOOD_LOSS = 0.002
DEFAULT_THRESHOLD = 0.6
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
_SYMBOLS = b"#*$%&|<>"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _repeated(words: np.ndarray) -> int:
    """Words that lie in some 5-word window that occurs at least twice."""
    windows = wordhash.ngram_hashes(words, WINDOW)
    if len(windows) < 2:
        return 0
    ordered = np.argsort(windows, kind="stable")
    same = windows[ordered[1:]] == windows[ordered[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    twice = np.zeros(len(windows), dtype=bool)
    twice[ordered[1:][same]] = True
    twice[ordered[:-1][same]] = True
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def text_statistics(text: bytes, words: np.ndarray) -> tuple[int, ...]:
    """COUNTS of one text, given the hashes of its words."""
    solid = text.translate(None, b" \t\n\r\x0b\x0c")
    lines = [x for x in text.split(b"\n") if x.strip()]
    continuation = len(solid) - len(solid.translate(None, bytes(range(0x80, 0xC0))))
    letters = solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return (
        len(words),
        len(solid) - continuation,
        len(solid) - len(solid.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        len(solid) - len(letters),
        len(solid) - len(solid.translate(None, _MARKS)),
    )


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _statistics(texts: pa.Array) -> pa.Array:
    rows = [
        text_statistics(t.as_py() or b"", words)
        for t, words in zip(texts, wordhash.hashed_texts(texts, fold=False), strict=True)
    ]
    columns = np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(columns[:, j]) for j in range(len(COUNTS))], names=list(COUNTS))


def rule_statistics(text: Column) -> Column:
    """Struct of COUNTS for each text."""
    return _statistics(text.cast("binary"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def features(counts: np.ndarray) -> np.ndarray:
    """Ratios that do not depend on a text's length."""
    c = dict(zip(COUNTS, counts.astype(np.float64).T, strict=True))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack(
        [
            chars / words,
            c["n_symbols"] / chars,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_upper"] / chars,
            c["n_marks"] / chars,
        ]
    )


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random axis-parallel splits over subsamples; complete trees in flat arrays.

    Half of the cuts fall in the range of a node's rows, half in the box that the
    splits above have left of ``span`` (the lowest and highest value of each
    feature over all labelled rows).  A cut of the second kind often has all
    fitted rows on one side: what lies on the other is isolated at once.
    """

    def __init__(self, rows: np.ndarray, span: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(rows))
        self.depth = DEPTH
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, dtype=np.int16)
        self.cut = np.zeros((trees, nodes))
        self.length = np.zeros((trees, nodes))
        for t in range(trees):
            take = rng.choice(len(rows), self.size, replace=False)
            self._grow(t, 0, rows[take], span.copy(), 0, rng)

    def _grow(self, t: int, node: int, rows: np.ndarray, box: np.ndarray, depth: int, rng: np.random.Generator) -> None:
        bounds = box
        if len(rows) and rng.random() < 0.5:
            bounds = np.array([rows.min(axis=0), rows.max(axis=0)])
        open_ = np.flatnonzero(bounds[1] > bounds[0])
        if depth == self.depth or len(rows) <= 1 or not len(open_):
            self.length[t, node] = depth + float(_mean_path(len(rows)))
            return
        f = int(rng.choice(open_))
        cut = max(rng.uniform(bounds[0, f], bounds[1, f]), np.nextafter(bounds[0, f], np.inf))
        self.feature[t, node], self.cut[t, node] = f, cut
        left, below, above = rows[:, f] < cut, box.copy(), box.copy()
        below[1, f] = above[0, f] = cut
        self._grow(t, 2 * node + 1, rows[left], below, depth + 1, rng)
        self._grow(t, 2 * node + 2, rows[~left], above, depth + 1, rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score of each row: near 1 for rows that random splits part soon, below 0.5 for common ones."""
        total = np.zeros(len(rows))
        at_all = np.arange(len(rows))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = rows[at_all, np.maximum(f, 0)] >= cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** (-(total / len(self.feature)) / max(float(_mean_path(self.size)), 1e-9))


def _clashless(labels: DataFrame, keep: str) -> DataFrame:
    """One label per id: the smallest, should an id be labelled twice."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(keep).isNotNull()).groupBy("doc_id").agg(F.min(keep).alias("__label"))


def fit(
    stats: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, good_loss: float = GOOD_LOSS
) -> Callable[[DataFrame], DataFrame]:
    """Grow the forest and set its threshold on a table with ``doc_id`` and a struct ``rules`` of COUNTS.

    The table is read twice: give a stored one.  Returns what adds ``anomaly`` and ``kept`` to a table with ``rules``.
    """
    spark = stats.sparkSession
    fair = stats.where(~base_failed(F.col("rules"))).select("doc_id", "rules")
    labelled = fair.join(_clashless(labels, "quality"), "doc_id")
    sample = labelled.orderBy(F.xxhash64("doc_id"), "rules").limit(max_fit_rows).select("__label", "rules.*").collect()
    rows = features(np.array([r[1:] for r in sample], dtype=np.int64).reshape(len(sample), len(COUNTS)))
    good = rows[np.array([r[0] for r in sample], dtype=np.int64) == 1]
    if not len(good):
        good = rows if len(rows) else features(np.zeros((1, len(COUNTS)), dtype=np.int64))
    span = np.array([(rows if len(rows) else good).min(axis=0), (rows if len(rows) else good).max(axis=0)])
    forest = spark.sparkContext.broadcast(IsolationForest(good, span))

    @F.arrow_udf(T.DoubleType())
    def anomaly(rules: pa.Array) -> pa.Array:
        rows = np.column_stack([np.asarray(rules.field(c)) for c in COUNTS])
        return pa.array(forest.value.score(features(rows)))

    limit = (
        labelled.where("__label = 1")
        .select(F.percentile_approx(anomaly("rules"), F.lit(1 - good_loss), F.lit(100_000)).alias("q"))
        .first()["q"]
    )
    if limit is None:
        limit = DEFAULT_THRESHOLD if len(rows) else 1.0
    limit = float(limit)

    def judge(table: DataFrame) -> DataFrame:
        scored = table.withColumn("anomaly", anomaly("rules"))
        return scored.withColumn("kept", ~base_failed(F.col("rules")) & (F.col("anomaly") <= F.lit(limit)))

    return judge


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that base rules and forest keep, with the columns of docs."""
    ruled = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", rule_statistics(F.col("text")).alias("rules"))
    ruled = stored(ruled, "rules")  # once: the forest reads its numbers, the verdict all of it
    return fit(ruled, labels)(ruled).where("kept").select("doc.*")


def op3_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(documents(spark, sf_dir).select("doc_id", rule_statistics(F.col("text")).alias("rules")), "rules")
    judged = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))(stats)
    counts = [F.col(f"rules.{c}").alias(c) for c in COUNTS[:5]]
    return judged.select("doc_id", *counts, base_failed(F.col("rules")).alias("base_failed"), "kept", "anomaly")
