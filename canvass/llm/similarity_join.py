"""N-gram Jaccard join by prefix filters under several global orders of tokens.

If two sets of n and m tokens have a Jaccard similarity of at least t, then at
most n - ceil(t * n) tokens of the first are outside the second; so under *any*
order that all documents share, both have a common token among their first
n - ceil(t * n) + 1.  This job uses several such orders and lets a document, or a
pair, through only if every one of them allows it:

1. by token hash: the first tokens of each document (a little more than the
   prefix) are counted; who has more tokens there that no other set has than the
   bound allows cannot have a partner.  Sets that are equal count once.
2. over whole sets of those who are left: the same bound on all tokens.
3. rarest first (document frequency, then hash) gives the candidate pairs, if
   sizes and the tokens left from the common one on allow it; orders by the
   frequency's magnitude with other hashes must have a common prefix token as
   well.

Every pair that comes through is verified exactly on the whole sets.  Linked
documents are looked for as components: in two rounds each prefix token links
its documents to one of them (linear in their number), and only documents that
are then still in different components, but share a prefix token, are paired.  So
a group of a thousand copies costs a thousand links and not a million pairs, and
no link between different components is lost.

Defined results: words are runs of non-space characters with A-Z in lower case; a
text with fewer than five words is one token, one without words (or null) has none
and is linked with nothing; equal sets are linked; rows repeated with one id are
in one component; null ids may be linked and count as the smallest only where no
other id is in the component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import wordhash
from canvass.llm.components import connected_components
from canvass.llm.storage import documents, dropped, stored

N_WORDS = 5
PERCENT = 75
#: How much longer the first filter's token lists are than the prefix, as a share of the set.
MORE = 20


def allowance(n: Column) -> Column:
    """Tokens of a set of n that a similar set may lack: n - ceil(PERCENT * n / 100)."""
    return n - F.ceil(n * F.lit(PERCENT) / F.lit(100)).cast("long")


def _head(n: int) -> int:
    return min(n, n - -(-n * PERCENT // 100) + 1 + n // MORE)


@dataclass(frozen=True)
class Naming:
    """How a shingle set is made and named: by the first node_bits of a digest, or by its last 63 if others have those too."""

    n_words: int = N_WORDS
    node_bits: int = 63
    shared: frozenset[int] = frozenset()

    def name(self, tokens: np.ndarray) -> tuple[int, int]:
        """The name, and the part of the digest that it leaves out."""
        digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
        first, last = digest >> (128 - self.node_bits), digest & ((1 << 63) - 1)
        return (last, first) if first in self.shared else (first, last)


def _sets(batch: pa.RecordBatch, naming: Naming) -> Iterator[tuple[np.ndarray, int, int]]:
    """Shingle set of each row, its name and the rest of its digest."""
    for words in wordhash.hashed_texts(batch.column("text"), fold=True):
        tokens = wordhash.shingle_set(words, naming.n_words)
        yield tokens, *(naming.name(tokens) if len(tokens) else (-1, 0))


def _profiler(naming: Naming) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(tokens), node, check) for tokens, node, check in _sets(batch, naming)]
            columns = np.array(rows, dtype=np.int64).reshape(len(rows), 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(columns[:, j]) for j in range(3))],
                names=["doc_id", "n_shingles", "node", "check"],
            )

    return profile


def _header(naming: Naming) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, nodes, size = [], [], 0
            for mine, node, _ in _sets(batch, naming):
                mine = mine[: _head(len(mine))]
                tokens.append(mine.view(np.int64))
                nodes.append(np.full(len(mine), node, dtype=np.int64))
                size += len(mine)
                if size >= 1 << 19:
                    yield _flat(tokens, nodes)
                    tokens, nodes, size = [], [], 0
            if size:
                yield _flat(tokens, nodes)

    def _flat(tokens: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(nodes))], names=["token", "node"]
        )

    return heads


def _setter(naming: Naming) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lists, size = [], [], 0
            for tokens, node, _ in _sets(batch, naming):
                nodes.append(node)
                lists.append(tokens.view(np.int64))
                size += len(tokens)
                if size >= 1 << 19:
                    yield _listed(nodes, lists)
                    nodes, lists, size = [], [], 0
            if nodes:
                yield _listed(nodes, lists)

    def _listed(nodes: list[int], lists: list[np.ndarray]) -> pa.RecordBatch:
        at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, type=pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(lists)))],
            names=["node", "tokens"],
        )

    return whole


def _without_alone(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """The nodes (node, n) that may have a partner, after the tokens (token, node) that one node alone has."""
    alone = (
        tokens.groupBy("token")
        .agg(F.min("node").alias("node"), F.max("node").alias("other"))
        .where("node = other")
        .groupBy("node")
        .agg(F.count("*").alias("alone"))
    )
    return nodes.join(alone, "node", "left").where(F.coalesce("alone", F.lit(0)) <= allowance(F.col("n"))).select("node", "n")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of shared tokens under three orders, of rows with a set's node, n and found (its shared tokens and their
    document frequencies): by frequency, by its magnitude, and by half of that, each then by another hash.

    Tokens that no other set has come first under each of them and take their part of the prefix.
    """
    for batch in batches:
        nodes, sizes, found = batch.column("node"), batch.column("n").to_numpy(), batch.column("found")
        offsets, flat = found.offsets.to_numpy(), found.values
        tokens, dfs = flat.field("token").to_numpy(), flat.field("df").to_numpy()
        kept, p0, rest, others = [], [], [], ([], [])
        for i, n in enumerate(sizes.tolist()):
            own, df = tokens[offsets[i] : offsets[i + 1]], dfs[offsets[i] : offsets[i + 1]]
            alone = n - len(own)
            take = n - -(-n * PERCENT // 100) + 1 - alone
            if take <= 0:
                continue
            first = np.lexsort((own, df))[:take]
            magnitude = np.floor(np.log2(df))
            kept.append(i)
            p0.append(own[first])
            rest.append(n - alone - np.arange(len(first)))
            for k, rank in enumerate((magnitude, magnitude // 2)):
                mixed = wordhash.mix(own.view(np.uint64) + np.uint64(k + 1))
                others[k].append(own[np.lexsort((mixed, rank))[:take]])
        if not kept:
            continue
        at = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in p0]))).astype(np.int32))
        listed = lambda parts, at=at: pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts)))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(p0)), pa.array(np.concatenate(rest))], names=["token", "rest"])
        take_rows = pa.array(kept, type=pa.int64())
        yield pa.RecordBatch.from_arrays(
            [nodes.take(take_rows), batch.column("n").take(take_rows), pa.ListArray.from_arrays(at, pairs), listed(others[0]), listed(others[1])],
            names=["node", "n", "p0", "p1", "p2"],
        )


def candidates(sets: DataFrame) -> DataFrame:
    """Sets (node, n, tokens) with their prefixes of shared tokens under three orders.

    p0 has with each token how many tokens of the set are left from it on.
    """
    each = sets.select("node", "n", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    listed = each.join(shared, "token").groupBy("node", "n").agg(F.collect_list(F.struct("token", "df")).alias("found"))  # of one document
    return listed.mapInArrow(
        _prefixes, "node long, n long, p0 array<struct<token:bigint,rest:bigint>>, p1 array<bigint>, p2 array<bigint>"
    )


def _fits(a: str, b: str) -> Column:
    """Whether two sets of n tokens, of which ``rest`` are left from a common one on, may be similar.

    If that token is their first common one then no more than the smaller rest is common.  A similar pair passes at its
    first common token, and what fails there fails at all later ones.
    """
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    return ((100 + PERCENT) * F.least(f"{a}.rest", f"{b}.rest") >= PERCENT * n) & (
        100 * F.least(f"{a}.n", f"{b}.n") >= PERCENT * F.greatest(f"{a}.n", f"{b}.n")
    )


def _verified(pairs: DataFrame, ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b), those that every order lets through and whose sets are similar."""
    side = lambda k: ranked.select(*(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "p1", "p2")))
    likely = (
        pairs.join(side("a"), F.col("a") == F.col("node_a"))
        .join(side("b"), F.col("b") == F.col("node_b"))
        .where((100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & F.arrays_overlap("p1_a", "p1_b") & F.arrays_overlap("p2_a", "p2_b"))
        .select("a", "b")
    )
    whole = lambda k: sets.select(F.col("node").alias(f"node_{k}"), F.col("tokens").alias(f"t_{k}"))
    common = F.size(F.array_intersect("t_a", "t_b"))
    return (
        likely.join(whole("a"), F.col("a") == F.col("node_a"))
        .join(whole("b"), F.col("b") == F.col("node_b"))
        .where(100 * common >= PERCENT * (F.size("t_a") + F.size("t_b") - common))
        .select("a", "b")
    )


def similar_components(docs: DataFrame, n_words: int = N_WORDS, node_bits: int = 63) -> DataFrame:
    """For each row of docs: doc_id, n_shingles and component_id, the smallest id it is linked with."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    naming, known = Naming(n_words, node_bits), None
    while naming != known:  # once, but for sets that share the first half of their digest
        known = naming
        rows = stored(texts.mapInArrow(_profiler(naming), "doc_id long, n_shingles long, node long, check long"), "profile")
        nodes = (
            rows.where("n_shingles > 0")
            .groupBy("node")
            .agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("first_id"), F.min("check").alias("low"), F.max("check").alias("high"))
        )
        nodes = stored(nodes, "nodes")
        shared = nodes.where("low <> high").select("node").collect()  # of n sets about n * n / 2**64
        naming = replace(naming, shared=naming.shared | {r["node"] for r in shared})
    if shared:
        raise ValueError("two different sets share both halves of their digests")
    heads = texts.mapInArrow(_header(naming), "token long, node long")
    left = stored(_without_alone(nodes.select("node", "n"), heads), "left")
    ids = left.join(nodes.select("node", "first_id"), "node").select("first_id").distinct()
    sets = (
        texts.join(ids, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
        .mapInArrow(_setter(naming), "node long, tokens array<long>")
        .dropDuplicates(["node"])
        .join(left, "node")
        .select("node", "n", "tokens")
    )
    whole = stored(sets, "sets")
    few = _without_alone(whole.select("node", "n"), whole.select(F.explode("tokens").alias("token"), "node"))
    sets = stored(whole.join(few.select("node"), "node", "left_semi"), "sets-left")
    dropped(whole)
    ranked = stored(candidates(sets), "ranked")
    own = (F.col("p0")[0]["rest"] / F.col("n")).alias("shared")  # the share of tokens that other sets have too
    postings = stored(ranked.select("node", "n", own, F.explode("p0").alias("p")).select("node", "n", "shared", "p.*"), "postings")
    label = components = None
    links = None
    # first the document with the fewest tokens of its own is the hub: copies are alike to it before they are to another
    for rank in (F.col("shared"), -F.col("node").cast("double")):
        mine = postings if label is None else _open(postings, label)
        hub = mine.groupBy("token").agg(F.max(F.struct(rank.alias("rank"), "node", "n", "rest")).alias("h")).select("token", "h.*")
        met = (
            mine.alias("x")
            .join(hub.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.node") != F.col("y.node")) & _fits("x", "y"))
            .groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
            .agg(F.count("*").alias("common"))
        )
        if label is not None:
            met = _across(met, label)
        # a node tries the hub with which it has most in common; what that leaves unlinked is for the last step
        pairs = met.groupBy("a").agg(F.max(F.struct("common", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b"))
        found = stored(_verified(pairs.distinct(), ranked, sets), "links")
        links = found if links is None else links.union(found)
        components = connected_components(links)
        label = _labels(ranked, components)
    last = _verified(_paired(_open(postings, label), label), ranked, sets)
    components = connected_components(links.union(last))
    of_node = nodes.select("node", "first_id").join(components, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), "first_id"
    )
    of_node = stored(of_node, "of-node")
    for table in (left, sets, ranked, postings):  # the result reads rows and of_node alone
        dropped(table)
    least = of_node.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = of_node.join(least, "component").select("node", "component_id")
    out = rows.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return out


def _labels(ranked: DataFrame, components: DataFrame) -> DataFrame:
    return stored(
        ranked.select("node").join(components, "node", "left").select("node", F.coalesce("component", "node").alias("component")),
        "labels",
    )


def _open(postings: DataFrame, label: DataFrame) -> DataFrame:
    """The postings of tokens whose documents are in more than one component."""
    named = postings.join(label, "node")
    several = named.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return postings.join(several.select("token"), "token", "left_semi")


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    side = lambda k: label.select(F.col("node").alias(f"node_{k}"), F.col("component").alias(f"component_{k}"))
    return (
        pairs.join(side("a"), F.col("a") == F.col("node_a"))
        .join(side("b"), F.col("b") == F.col("node_b"))
        .where("component_a <> component_b")
        .select(*pairs.columns)
    )


def _paired(postings: DataFrame, label: DataFrame) -> DataFrame:
    """Distinct pairs of nodes of different components that share a token at which they may be similar.

    Components that share a token are paired first, as far as the best of their members fit, and members only then: no
    pair within a component is made.
    """
    named = stored(postings.join(label, "node"), "named")
    met = named.groupBy("token", "component").agg(
        F.count("*").alias("size"), F.min("n").alias("n"), F.max("n").alias("most"), F.max("rest").alias("rest")
    )
    x, y = met.alias("x"), met.alias("y")
    may = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component"))
    may = may & ((100 + PERCENT) * F.least("x.rest", "y.rest") >= PERCENT * (F.col("x.n") + F.col("y.n")))
    may = may & (100 * F.col("x.most") >= PERCENT * F.col("y.n")) & (100 * F.col("y.most") >= PERCENT * F.col("x.n"))
    side = lambda k: F.struct(*(F.col(f"{k}.{c}") for c in ("component", "n", "most", "rest")))
    smaller = F.col("x.size") <= F.col("y.size")
    pairs = x.join(y, may).select(
        F.col("x.token").alias("token"),
        F.when(smaller, F.col("x.component")).otherwise(F.col("y.component")).alias("c"),  # its members come first
        F.when(smaller, side("y")).otherwise(side("x")).alias("d"),
    )
    first, second = named.alias("f"), named.alias("g")
    fits_some = (100 + PERCENT) * F.least("f.rest", "p.d.rest") >= PERCENT * (F.col("f.n") + F.col("p.d.n"))
    fits_some = fits_some & (100 * F.col("f.n") >= PERCENT * F.col("p.d.n")) & (100 * F.col("p.d.most") >= PERCENT * F.col("f.n"))
    return (
        pairs.alias("p")
        .join(first, (F.col("p.token") == F.col("f.token")) & (F.col("p.c") == F.col("f.component")) & fits_some)
        .select(F.col("p.token").alias("token"), F.col("p.d.component").alias("d"), F.col("f.node").alias("node"), F.col("f.n").alias("n"), F.col("f.rest").alias("rest"))
        .alias("f")
        .join(second, (F.col("f.token") == F.col("g.token")) & (F.col("f.d") == F.col("g.component")) & _fits("f", "g"))
        .select(F.least("f.node", "g.node").alias("a"), F.greatest("f.node", "g.node").alias("b"))
        .distinct()
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each component of similar ones, that with the smallest id; with the columns of docs.

    Of rows repeated with one id the smallest stays; rows without an id all stay.
    """
    found = stored(similar_components(docs), "components").where("doc_id IS NOT NULL")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    marked = stored(ids.where("doc_id <> component_id OR n > 1").select("doc_id", F.expr("doc_id = component_id").alias("repeated")), "marked")
    alone = docs.join(marked.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = marked.where("repeated").select("doc_id")
    if repeated.isEmpty():  # else each text is shuffled once more
        return alone
    first = (
        docs.join(repeated, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min(F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "text")))).alias("row"))
        .select("doc_id", "row.*")
    )
    return alone.unionByName(first.select(*docs.columns))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))
