"""I-Match document fingerprints, with DataFrame functions only.

Terms that are neither too common nor too rare carry a document: those whose
document frequency lies between ``LOW`` and ``HIGH`` of all documents.  There are
at most (mean distinct terms of a document) / LOW of them however large the
corpus is: the lexicon is the set of their hashes, a table in the shared folder,
which a scalar subquery gives to the tasks as one array of short arrays.  A
fingerprint hashes the sorted distinct lexicon terms of a text, once for each of
several random subsets of the lexicon: ``LEVELS`` gives how many subsets there
are of which share of the lexicon, dense ones for short texts and sparse ones for
long ones.  An edit changes only the subsets that its terms fall into.

Likeness of two fingerprints: the share of equal ones among the subsets filled in
either, at the level where it is largest of those with ``MIN_FILLED`` or more
filled (if none has, over all levels); equal fingerprints are alike to 1.

Defined results: a null or empty text has an empty fingerprint (all subsets
unfilled); equal texts have equal ones; repeated rows are fingerprinted alike;
an empty table gives no rows; rows with null ids come last in the descending
order, rows of one id in the order of their texts; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm.storage import documents, stored

LOW, HIGH = 0.001, 0.2
#: (one in how many terms, groups of subsets, subsets in a group)
LEVELS = ((16, 4, 4), (128, 4, 8), (1024, 4, 8))
MIN_FILLED = 4
UNFILLED, DIGITS = "----", 4
BUCKET_ROWS, MOST_BUCKETS = 512, 16_384
#: Lexicon terms that one look-up compares with, on average.
SLOT_TERMS = 4


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms of a text: lower case, parted by white space and punctuation."""
    terms = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+")
    return F.transform(F.filter(F.array_distinct(terms), lambda t: t != ""), lambda t: F.xxhash64(t))


def band(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Hashes of the terms in the band, as a stored table of column ``term``."""
    n = docs.count()
    counts = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return stored(counts.where((F.col("df") >= low * n) & (F.col("df") <= high * n)).select("term"), "lexicon")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the terms in the band, sorted."""
    return sorted(r["term"] for r in band(docs, low, high).collect())  # bounded by the band


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _subset(terms: Column) -> Column:
    return F.when(F.size(terms) == 0, UNFILLED).otherwise(F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(terms), F.lit(65536)))), DIGITS, "0"))


def _level(terms: Column, level: int, one_in: int, groups: int, per_group: int) -> Column:
    """The subset hashes of one level, as one string."""
    pick = lambda h: F.pmod(F.xxhash64(h, F.lit(level)), F.lit(one_in))
    kept = F.filter(
        F.transform(terms, lambda h: F.struct(pick(h).alias("k"), h.alias("h"))), lambda x: x["k"] < groups * per_group
    )
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    of_group = lambda all_, g: F.filter(all_, lambda x: F.floor(x["k"] / per_group) == g)
    hashes = lambda mine, g: F.concat_ws(
        "",
        F.transform(
            numbers(per_group),
            lambda i: _subset(F.transform(F.filter(mine, lambda x: x["k"] == g * per_group + i), lambda x: x["h"])),
        ),
    )
    return _let(
        kept,
        lambda all_: F.concat_ws("", F.transform(numbers(groups), lambda g: _let(of_group(all_, g), lambda m: hashes(m, g)))),
    )


def _slot(term: Column, n: int) -> Column:
    return F.pmod(term, F.lit(n)).cast("int")


def _slots(lexicon: DataFrame, n: int) -> Column:
    """A lexicon as one value: an array of n arrays, each of the terms with its place as remainder."""
    slots = lexicon.sparkSession.range(n).select(F.col("id").cast("int").alias("slot"))
    filled = lexicon.groupBy(_slot(F.col("term"), n).alias("slot")).agg(F.collect_list("term").alias("terms"))
    terms = F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms")
    listed = slots.join(filled, "slot", "left").agg(F.array_sort(F.collect_list(F.struct("slot", terms))).alias("slots"))
    return listed.select(F.col("slots.terms")).scalar()


def with_fingerprint(docs: DataFrame, text: str, name: str, terms: DataFrame | list[int]) -> DataFrame:
    """Add the fingerprint of a text column as a string of DIGITS characters for each subset, under a lexicon's terms."""
    if not isinstance(terms, DataFrame):
        terms = docs.sparkSession.createDataFrame([(t,) for t in terms], "term long")
    n = max(1, terms.count() // SLOT_TERMS)
    known = lambda slots: F.filter("__terms", lambda t: F.array_contains(slots[_slot(t, n)], t))
    found = docs.withColumns({"__terms": term_hashes(F.col(text)), "__slots": _slots(terms, n)})
    found = found.withColumn("__terms", F.array_sort(_let(F.col("__slots"), known))).drop("__slots")
    return found.withColumn(name, _let(F.col("__terms"), lambda t: F.concat(*(_level(t, i, *level) for i, level in enumerate(LEVELS))))).drop("__terms")


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    counts, at = [], 0
    for _, groups, per_group in LEVELS:
        n = groups * per_group
        piece = lambda c, i: F.substring(c, i * DIGITS + 1, F.lit(DIGITS))
        of = F.sequence(F.lit(at), F.lit(at + n - 1))
        pairs = F.transform(of, lambda i: F.struct(piece(a, i).alias("x"), piece(b, i).alias("y")))
        filled = F.filter(pairs, lambda p: (p["x"] != UNFILLED) | (p["y"] != UNFILLED))
        counts.append(
            _let(filled, lambda f: F.struct(F.size(f).alias("filled"), F.size(F.filter(f, lambda p: p["x"] == p["y"])).alias("equal")))
        )
        at += n
    total = lambda c, k: reduce(lambda x, y: x + y, (c[i][k] for i in range(len(LEVELS))))
    share = lambda equal, filled: F.coalesce(F.try_divide(equal, filled).cast("double"), F.lit(0.0))
    best = lambda c: F.greatest(
        *(F.when(c[i]["filled"] >= MIN_FILLED, share(c[i]["equal"], c[i]["filled"])) for i in range(len(LEVELS)))
    )
    return F.when(a == b, 1.0).otherwise(
        _let(F.array(*counts), lambda c: F.coalesce(best(c), share(total(c, "equal"), total(c, "filled"))))
    )


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key, by a coarse and a fine step."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    coarse = below(F.array(*map(F.lit, bounds[::step])))
    fine = F.slice(F.array(*map(F.lit, bounds)), F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below(fine))


def with_next(docs: DataFrame, keep: list[str], add: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Add next_<column> for each column of keep: that of the next row by descending doc_id, the first after the last.

    Rows are dealt by ranges of ids, each of which also gets a copy of the first row of the next range; one shuffle.
    ``add`` gives rows further columns, which may be in keep; they are not computed to find those first rows.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    n = docs.count()
    parts = min(MOST_BUCKETS, -(-n // BUCKET_ROWS)) or 1
    cuts = [i / parts for i in range(1, parts)]
    bounds = (docs.select(F.percentile_approx(key, cuts, 50_000).alias("b")).first()["b"] or []) if cuts else []
    rows = docs.withColumn("__bucket", _bucket(key, sorted(set(bounds))))
    heads = sorted((r["__bucket"], r["k"]) for r in rows.groupBy("__bucket").agg(F.max("doc_id").cast("long").alias("k")).collect())
    if not heads:
        return add(docs).select("*", *(F.col(c).alias(f"next_{c}") for c in keep))
    # the first row of each range, under the range before it in descending order
    into = [(b, key, heads[(i + 1) % len(heads)][0]) for i, (b, key) in enumerate(heads)]
    target = docs.sparkSession.createDataFrame(into, "__from int, __first long, __into int")
    tie = [F.xxhash64("text"), F.col("text")]
    ghosts = (
        rows.join(F.broadcast(target), (F.col("__bucket") == F.col("__from")) & F.col("doc_id").eqNullSafe(F.col("__first")))
        .groupBy("__into")
        .agg(F.min_by(F.struct(*docs.columns), F.struct(*(t.alias(f"t{i}") for i, t in enumerate(tie)))).alias("row"))
        .select("row.*", F.col("__into").alias("__bucket"), F.lit(True).alias("__ghost"))
    )
    order = Window.partitionBy("__bucket").orderBy("__ghost", F.col("doc_id").desc_nulls_last(), *tie)
    return (
        add(rows.withColumn("__ghost", F.lit(False)).unionByName(ghosts))
        .select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in keep))
        .where(~F.col("__ghost"))
        .drop("__ghost", "__bucket")
    )


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = band(docs)
    rows = with_next(docs, ["text", "fingerprint"], lambda df: with_fingerprint(df, "text", "fingerprint", terms))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    return with_fingerprint(rows, "edited", "edited_fingerprint", terms).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
