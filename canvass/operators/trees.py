"""Decision trees and forests for classes and numbers, as tables of nodes, with the tree that speaks best for its forest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, codes
from canvass.functions.columns import finite
from canvass.operators.ranking import infer_task
from canvass.plans.primitives import wide_agg

#: Levels of a nominal feature, or classes of a target.
MAX_LEVELS = 100


@dataclass
class Node:
    """A node of a tree; leaves are numbered from the left."""

    feature: int | None = None
    threshold: float = 0.0
    prediction: float = 0.0
    leaf: int | None = None
    children: list[Node] = field(default_factory=list)


@dataclass
class Trees:
    """A fitted model over x (an array of features) and y, with what its numbers stand for."""

    model: object
    rows: DataFrame  # the table's columns, __x and __y
    task: str
    names: list[str]
    classes: list[str]
    single: bool

    def predictions(self) -> DataFrame:
        """Rows with predicted (a class or a number) and, for a single tree, leaf."""
        out = self._scored()
        columns = [c for c in self.rows.columns if c not in ("__x", "__y")]
        shown = F.array(*map(F.lit, self.classes))[F.col("__p").cast("int")] if self.classes else F.col("__p")
        leaf = [F.col("__leaf")[0].cast("int").alias("leaf")] if self.single else []
        return out.select(*(F.col(f"`{c}`") for c in columns), shown.alias("predicted"), *leaf)

    def _scored(self) -> DataFrame:
        out = self.model.transform(self.rows.withColumn("__v", array_to_vector("__x")))
        leaf = F.array(F.col("__l").cast("double")) if self.single else vector_to_array("__l")
        return out.withColumn("__leaf", leaf)

    @property
    def importances(self) -> dict[str, float]:
        return dict(zip(self.names, map(float, self.model.featureImportances.toArray()), strict=True))

    def roots(self) -> list[Node]:
        """The trees of the model, read from it node by node."""
        models = [self.model] if self.single else self.model.trees
        return [_read(m._java_obj.rootNode(), [0]) for m in models]

    def agreement(self) -> list[float]:
        """How far each tree speaks for the forest: the share of rows with the same class, or R squared to its numbers.

        All trees are scored in one pass over the rows."""
        scored = self._scored().select("__p", "__leaf")
        own = [self._of_leaf(i, root) for i, root in enumerate(self.roots())]
        if self.task == "classification":
            return [float(v or 0.0) for v in wide_agg(scored, [F.avg((o == F.col("__p")).cast("double")) for o in own])]
        spread = scored.agg(F.var_pop("__p")).first()[0] or 0.0
        return [1 - float(v or 0.0) / (spread or 1.0) for v in wide_agg(scored, [F.avg((o - F.col("__p")) ** 2) for o in own])]

    def _of_leaf(self, tree: int, root: Node) -> Column:
        return F.element_at(F.array(*(F.lit(n.prediction) for n in leaves(root))), F.col("__leaf")[tree].cast("int") + 1)

    def representative(self) -> int:
        """The tree that agrees most with the forest, the first of equals."""
        return int(np.argmax(self.agreement()))

    def nodes(self, tree: int = 0) -> DataFrame:
        """One row a node of a tree: node, parent, depth, feature, threshold (up to it rows go left), leaf, prediction, and of
        the fitted rows n and, by class, their number (or their mean)."""
        root = self.roots()[tree]
        grouped = self._scored().groupBy(F.col("__leaf")[tree].cast("int").alias("leaf"))
        counts: dict[int, np.ndarray] = {}
        if self.classes:
            for r in grouped.pivot("__y", list(map(float, range(len(self.classes))))).count().collect():
                counts[r["leaf"]] = np.array([r[i + 1] or 0 for i in range(len(self.classes))], dtype=float)
        else:
            for r in grouped.agg(F.count("*"), F.sum("__y")).collect():
                counts[r["leaf"]] = np.array([r[1], r[2]], dtype=float)
        rows: list[tuple] = []

        def walk(node: Node, parent: int | None, depth: int) -> np.ndarray:
            me = len(rows)
            rows.append(())
            width = len(self.classes) or 2
            total = counts.get(node.leaf, np.zeros(width)) if node.leaf is not None else sum(walk(c, me, depth + 1) for c in node.children)
            n = int(total.sum() if self.classes else total[0])
            mix = {c: int(v) for c, v in zip(self.classes, total, strict=True) if v} if self.classes else None
            mean = None if self.classes or not n else float(total[1] / n)
            shown = self.classes[int(node.prediction)] if self.classes else repr(node.prediction)
            rows[me] = (me, parent, depth, None if node.feature is None else self.names[node.feature], None if node.feature is None else node.threshold, node.leaf, shown, n, mix, mean)
            return total

        walk(root, None, 0)
        return self.rows.sparkSession.createDataFrame(rows, "node int, parent int, depth int, feature string, threshold double, leaf int, prediction string, n long, classes map<string, long>, mean double")


def _read(node, seen: list[int]) -> Node:
    if node.subtreeDepth() == 0:
        seen[0] += 1
        return Node(prediction=float(node.prediction()), leaf=seen[0] - 1)
    split = node.split()
    return Node(split.featureIndex(), float(split.threshold()), float(node.prediction()), None, [_read(node.leftChild(), seen), _read(node.rightChild(), seen)])


def leaves(node: Node) -> list[Node]:
    return [node] if node.leaf is not None else [leaf for c in node.children for leaf in leaves(c)]


def _levels(df: DataFrame, c: str) -> list[str]:
    found = df.select(codes(df, c).alias("c")).where("c IS NOT NULL").distinct().orderBy("c").limit(MAX_LEVELS + 1).collect()
    if len(found) > MAX_LEVELS:
        raise CodebookError(f"{c} has more than {MAX_LEVELS} levels")
    return [r["c"] for r in found]


def fit_trees(
    df: DataFrame, target: str, numeric: Sequence[str], nominal: Sequence[str] = (), task: str = "auto", depth: int = 5, trees: int = 1, seed: int = 42
) -> Trees:
    """One tree, or a forest of several, over complete rows.

    Nominal features are one indicator a level (``column = code``).  The task ``auto`` is classification for texts and few
    whole numbers.  A class's number is the place of its code in order; no complete row is an error.
    """
    task = infer_task(df, target) if task == "auto" else task
    if task not in ("classification", "regression") or not (numeric or nominal):
        raise CodebookError("trees need features, and classification or regression as their task")
    x, names = [finite(c) for c in numeric], list(numeric)
    for c in nominal:
        for level in _levels(df, c):
            x.append((codes(df, c) == level).cast("double"))
            names.append(f"{c} = {level}")
    classes = _levels(df, target) if task == "classification" else []
    y = (F.array_position(F.array(*map(F.lit, classes)), codes(df, target)) - 1).cast("double") if classes else finite(target)
    rows = df.withColumns({"__x": F.array(*x), "__y": y}).where(F.col("__y").isNotNull() & F.forall("__x", lambda v: v.isNotNull()))
    if not x or not rows.limit(1).count():
        raise CodebookError("no complete row to fit")
    common = {"featuresCol": "__v", "labelCol": "__y", "predictionCol": "__p", "leafCol": "__l", "maxDepth": depth, "seed": seed}
    if trees == 1:
        make = DecisionTreeClassifier if classes else DecisionTreeRegressor
        estimator = make(**common)
    else:
        make = RandomForestClassifier if classes else RandomForestRegressor
        estimator = make(**common, numTrees=trees)
    model = estimator.fit(rows.select("__y", array_to_vector("__x").alias("__v")))
    return Trees(model, rows, task, names, classes, trees == 1)
