"""Concept formation: a tree of concepts over numbers and categories, grown by category utility.

A concept is a set of sums that add up: rows, and for each number its count, sum and sum of squares, for each category
its count.  So a tree can be grown from rows or from the concepts of other trees.  Rows are dealt into groups of
``GROUP_ROWS`` by a hash of their keys, each group grows a tree of at most ``LEAVES`` leaves in the order of the hash,
and the leaves of ``FAN`` trees at a time go through one more tree until one is left; then all rows are sorted into it,
from the root down.  The result depends on keys and values, not on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, codes
from canvass.functions.columns import finite
from canvass.plans.storage import stored

GROUP_ROWS, LEAVES, FAN = 2048, 64, 16
#: Levels of all nominal columns together.
MAX_LEVELS = 2000
_DENSITY = 1 / (2 * np.sqrt(np.pi))


@dataclass
class Space:
    """What concepts are about: numbers around a centre, and the levels of nominal columns one after the other."""

    centre: np.ndarray
    levels: list[list[str]]
    acuity: float = 0.1
    cutoff: float = 0.0

    def __post_init__(self) -> None:
        self.p = len(self.centre)
        self.begin = np.cumsum([0, *(len(v) for v in self.levels)])
        self.width = 1 + 3 * self.p + int(self.begin[-1])

    def items(self, numbers: np.ndarray, nominal: np.ndarray) -> np.ndarray:
        """Rows as concepts of one row; nan and -1 stand for nulls."""
        n, p = len(numbers), self.p
        out = np.zeros((n, self.width))
        out[:, 0] = 1
        known = ~np.isnan(numbers)
        x = np.where(known, numbers - self.centre, 0.0)
        out[:, 1 : 1 + p], out[:, 1 + p : 1 + 2 * p], out[:, 1 + 2 * p : 1 + 3 * p] = known, x, x * x
        for j in range(nominal.shape[1]):
            some = np.flatnonzero(nominal[:, j] >= 0)
            out[some, 1 + 3 * p + self.begin[j] + nominal[some, j]] = 1
        return out

    def score(self, s: np.ndarray) -> np.ndarray:
        """Rows times the expected number of guesses: densities of numbers (no narrower than acuity) and squared shares."""
        p = self.p
        count = s[..., 1 : 1 + p]
        least = np.maximum(count, 1)
        mean = s[..., 1 + p : 1 + 2 * p] / least
        spread = np.sqrt(np.maximum(s[..., 1 + 2 * p : 1 + 3 * p] / least - mean * mean, self.acuity**2))
        out = s[..., 0] * ((count > 0) / spread).sum(axis=-1) * _DENSITY
        if self.width > 1 + 3 * p:
            out = out + (s[..., 1 + 3 * p :] ** 2).sum(axis=-1) / np.maximum(s[..., 0], 1)
        return out


@dataclass
class Node:
    sums: np.ndarray
    children: list[Node] = field(default_factory=list)
    score: float | None = None


class Tree:
    """Insertion with the four moves: into the best child, a new one, the two best merged, the best one split."""

    def __init__(self, space: Space, leaves: int = LEAVES) -> None:
        self.space, self.most, self.leaves = space, leaves, 0
        self.root = Node(np.zeros(space.width))

    def utility(self, parts: float, n: float, k: int, whole: float) -> float:
        """parts: sum of the children's scores; whole: the parent's."""
        return (parts - whole) / (n * k)

    def insert(self, item: np.ndarray) -> None:
        node, space = self.root, self.space
        while True:
            if not node.children:
                if self.leaves == 0:
                    node.sums, self.leaves = node.sums + item, 1
                    return
                old, whole = node.sums, node.sums + item
                gain = self.utility(float(space.score(np.stack([old, item])).sum()), whole[0], 2, float(space.score(whole)))
                if self.leaves < self.most and gain > space.cutoff:
                    node.children, self.leaves = [Node(old), Node(item)], self.leaves + 1
                node.sums, node.score = whole, None
                return
            node.sums, node.score = node.sums + item, None
            node = self._step(node, item)
            if node is None:
                return

    def _step(self, node: Node, item: np.ndarray) -> Node | None:
        """The child to go on with, or None if the item has become a child."""
        space, split = self.space, False
        whole, n = float(space.score(node.sums)), node.sums[0]
        while True:
            sums = np.stack([c.sums for c in node.children])
            for c in node.children:
                if c.score is None:
                    c.score = float(space.score(c.sums))
            own = np.array([c.score for c in node.children])
            total, m = float(own.sum()), len(own)
            each = (total - own + space.score(sums + item) - whole) / (n * m)
            order = np.argsort(-each, kind="stable")
            best = int(order[0])
            moves = [(float(each[best]), 3, "into")]
            if self.leaves < self.most:
                moves.append((self.utility(total + float(space.score(item)), n, m + 1, whole), 2, "new"))
            if m > 2:
                second = int(order[1])
                both = float(space.score(sums[best] + sums[second] + item))
                moves.append((self.utility(total - own[best] - own[second] + both, n, m - 1, whole), 1, "merge"))
            if node.children[best].children and not split:
                parts = [c.sums for c in node.children[best].children]
                opened = np.concatenate([np.delete(sums, best, axis=0), parts])
                scores = space.score(opened)
                added = (float(scores.sum()) - scores + space.score(opened + item) - whole) / (n * len(opened))
                moves.append((float(added.max()), 0, "split"))
            move = max(moves)[2]
            if move == "new":
                node.children.append(Node(item))
                self.leaves += 1
                return None
            if move == "merge":
                a, b = node.children[best], node.children[second]
                joined = Node(a.sums + b.sums, [a, b])
                node.children = [c for c in node.children if c is not a and c is not b] + [joined]
                return joined
            if move == "split":
                node.children = [c for i, c in enumerate(node.children) if i != best] + node.children[best].children
                split = True
                continue
            return node.children[best]

    def ends(self) -> list[np.ndarray]:
        """Sums of the leaves, in order."""
        out, open_ = [], [self.root]
        while open_:
            node = open_.pop()
            if node.children:
                open_ += reversed(node.children)
            elif node.sums[0]:
                out.append(node.sums)
        return out


def _grown(space: Space, items: np.ndarray) -> Tree:
    tree = Tree(space)
    for item in items:
        tree.insert(item)
    return tree


def frontier(tree: Tree, k: int) -> list[list[Node]]:
    """k groups of concepts: the largest is opened while there are fewer, the smallest joins the one it fits best while there are more."""
    nodes = [c for c in tree.root.children] or [tree.root]
    while len(nodes) < k and any(c.children for c in nodes):
        largest = max((c for c in nodes if c.children), key=lambda c: c.sums[0])
        nodes = [c for c in nodes if c is not largest] + largest.children
    groups = [[c] for c in nodes]
    sums = [c.sums for c in nodes]
    while len(groups) > k:
        least = min(range(len(groups)), key=lambda i: sums[i][0])
        rest = [i for i in range(len(groups)) if i != least]
        own = tree.space.score(np.stack([sums[i] for i in rest]))
        best = rest[int(np.argmax(tree.space.score(np.stack([sums[i] + sums[least] for i in rest])) - own))]
        groups[best] += groups[least]
        sums[best] = sums[best] + sums[least]
        del groups[least], sums[least]
    order = sorted(range(len(groups)), key=lambda i: -sums[i][0])
    return [groups[i] for i in order]


def sorted_into(tree: Tree, groups: list[list[Node]], items: np.ndarray) -> np.ndarray:
    """The group of each item, from the root down to its first concept of a group by where its score adds most."""
    of = {id(c): g for g, group in enumerate(groups) for c in group}
    out = np.full(len(items), -1, dtype=np.int64)
    open_ = [(tree.root, np.arange(len(items)))]
    while open_:
        node, at = open_.pop()
        if id(node) in of:
            out[at] = of[id(node)]
        elif len(at):
            sums = np.stack([c.sums for c in node.children])
            gain = tree.space.score(items[at][:, None] + sums[None]) - tree.space.score(sums)[None]
            to = gain.argmax(axis=1)
            open_ += [(c, at[to == i]) for i, c in enumerate(node.children)]
    return out


def _space(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str], acuity: float, cutoff: float) -> Space:
    centre = list(df.agg(*(F.coalesce(F.avg(finite(c)), F.lit(0.0)) for c in numeric)).first()) if numeric else []
    levels: list[list[str]] = []
    for c in nominal:
        found = df.select(codes(df, c).alias("c")).where("c IS NOT NULL").distinct().orderBy("c").limit(MAX_LEVELS + 1).collect()
        levels.append([r["c"] for r in found])
    if sum(map(len, levels)) > MAX_LEVELS:
        raise CodebookError(f"nominal columns have more than {MAX_LEVELS} levels")
    return Space(np.array(centre, dtype=float), levels, acuity, cutoff)


@dataclass
class Concepts:
    """A concept tree, with the groups that rows are sorted into."""

    tree: Tree
    groups: list[list[Node]]
    numeric: Sequence[str]
    nominal: Sequence[str]

    def table(self, df: DataFrame) -> DataFrame:
        """One row a concept: concept, parent (null for the root), depth, n, cluster of its group, means and leading categories."""
        space, of, rows = self.tree.space, {id(c): g for g, group in enumerate(self.groups) for c in group}, []
        open_ = [(self.tree.root, None, 0, None)]
        while open_:
            node, parent, depth, group = open_.pop(0)
            group, me, s, p = of.get(id(node), group), len(rows), node.sums, space.p
            with np.errstate(invalid="ignore", divide="ignore"):
                means = space.centre + s[1 + p : 1 + 2 * p] / s[1 : 1 + p]
            tops = {}
            for j, c in enumerate(self.nominal):
                counts = s[1 + 3 * p + space.begin[j] : 1 + 3 * p + space.begin[j + 1]]
                if len(counts) and counts.max():
                    tops[c] = space.levels[j][int(counts.argmax())]
            rows.append((me, parent, depth, int(s[0]), group, {c: float(m) for c, m in zip(self.numeric, means, strict=True) if np.isfinite(m)}, tops))
            open_ += [(c, me, depth + 1, group) for c in node.children]
        return df.sparkSession.createDataFrame(rows, "concept int, parent int, depth int, n long, cluster int, means map<string, double>, leading map<string, string>")


def concept_tree(
    df: DataFrame, numeric: Sequence[str], key: str, k: int = 3, nominal: Sequence[str] = (), acuity: float = 0.1, cutoff: float = 0.0
) -> tuple[DataFrame, Concepts]:
    """df's keys with cluster (0 is the largest), and the tree.

    Nulls take no part in a concept's sums; an empty table has one empty concept and no rows.  Numbers should be of a
    scale (``prepared``), as acuity, the least spread of a concept, is one for all.
    """
    if not numeric and not nominal:
        raise CodebookError("concepts need a column")
    space = _space(df, numeric, nominal, acuity, cutoff)
    place = lambda c, levels: F.array_position(F.array(*map(F.lit, levels)), codes(df, c)) - 1 if levels else F.lit(-1)
    rows = df.select(
        F.col(key).alias("__key"),
        F.xxhash64(key).alias("__h"),
        F.array(*(F.coalesce(finite(c), F.lit(float("nan"))) for c in numeric)).cast("array<double>").alias("x"),
        F.array(*(F.coalesce(place(c, v), F.lit(-1)).cast("int") for c, v in zip(nominal, space.levels, strict=True))).cast("array<int>").alias("c"),
    )
    n = rows.count()

    def items(x: pd.Series, c: pd.Series) -> np.ndarray:
        numbers = np.array([list(v) for v in x], dtype=float).reshape(len(x), len(numeric))
        return space.items(numbers, np.array([list(v) for v in c], dtype=np.int64).reshape(len(c), len(nominal)))

    def leaves(tree: Tree, group: int) -> pd.DataFrame:
        ends = tree.ends()
        return pd.DataFrame({"g": [group // FAN] * len(ends), "o": range(len(ends)), "from": [group] * len(ends), "sums": ends})

    def first(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__h", "__key"])
        return leaves(_grown(space, items(part["x"], part["c"])), int(part["g"].iloc[0]))

    def again(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["from", "o"])
        return leaves(_grown(space, np.stack(part["sums"].to_list())), int(part["g"].iloc[0]))

    kind, groups = "g int, o int, from int, sums array<double>", n // GROUP_ROWS + 1
    state = stored(rows.withColumn("g", F.pmod("__h", F.lit(groups)).cast("int")).groupBy("g").applyInPandas(first, kind), "concepts")
    while groups > FAN:
        groups = -(-groups // FAN)
        state = stored(state.groupBy("g").applyInPandas(again, kind), "concepts")
    last = state.orderBy("from", "o").collect()  # LEAVES * FAN rows at most
    tree = _grown(space, np.array([r["sums"] for r in last]).reshape(len(last), space.width))
    found = Concepts(tree, frontier(tree, k), numeric, nominal)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = sorted_into(tree, found.groups, items(batch.column("x").to_pandas(), batch.column("c").to_pandas()))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(to.astype(np.int32))], names=["__key", "cluster"])

    schema = rows.select("__key").withColumn("cluster", F.lit(0)).schema
    return rows.select("__key", "x", "c").mapInArrow(label, schema).withColumnRenamed("__key", key), found
