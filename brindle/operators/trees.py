"""Gradient-boosted trees on encoded features: training with early stopping, importance and Shapley values.

The trees are those of Spark ML.  A number is a value (0 where missing) and a 0/1 column of
being missing; a category is the place of its level, with one more place for missing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.features import CATEGORICAL
from brindle.operators.splits import Encoder

LABEL, WEIGHT, VECTOR = "__label__", "__weight__", "__features__"


def columns_of(encoder: Encoder) -> list[tuple[str, str]]:
    """(model column, feature) in the order of the vector."""
    out = []
    for i, (n, k) in enumerate(encoder.features.items()):
        out.append((f"f{i}", n))
        if k != CATEGORICAL:
            out.append((f"f{i}_missing", n))
    return out


def encoded(df: DataFrame, encoder: Encoder, target: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """``keep`` columns, the vector, and the label."""
    cols = []
    for c, (i, (n, k)) in zip(encoder.columns(), enumerate(encoder.features.items()), strict=True):
        if k == CATEGORICAL:
            size = len(encoder.levels[n])
            meta = {"ml_attr": {"type": "nominal", "name": f"f{i}", "num_vals": size + 1}}
            cols.append(F.coalesce(c, F.lit(float(size))).alias(f"f{i}", metadata=meta))
        else:
            cols += [F.coalesce(c, F.lit(0.0)).alias(f"f{i}"), c.isNull().cast("double").alias(f"f{i}_missing")]
    label = [target.cast("double").alias(LABEL)] if target is not None else []
    kept = [F.col(f"`{k}`").alias(f"__k{j}") for j, k in enumerate(keep)]
    out = df.select(*kept, *label, *cols)
    out = VectorAssembler(inputCols=[c for c, _ in columns_of(encoder)], outputCol=VECTOR).transform(out)
    return out.select(*[F.col(f"__k{j}").alias(k) for j, k in enumerate(keep)], *([LABEL] if label else []), VECTOR)


def _classifier(params: dict, rounds: int, seed: int, encoder: Encoder, weighted: bool) -> GBTClassifier:
    widest = max([len(v) + 1 for v in encoder.levels.values()] + [2])
    own = dict(params)
    own["maxBins"] = max(own.get("maxBins", 32), widest)
    more = {"weightCol": WEIGHT} if weighted else {}
    return GBTClassifier(featuresCol=VECTOR, labelCol=LABEL, maxIter=rounds, seed=seed, **own, **more)


def train(df: DataFrame, encoder: Encoder, params: dict, rounds: int, seed: int, weighted: bool = False) -> GBTClassificationModel:
    return _classifier(params, rounds, seed, encoder, weighted).fit(df)


def train_early(fit: DataFrame, early: DataFrame, encoder: Encoder, params: dict, rounds: int, patience: int, seed: int) -> tuple[int, dict[str, list[float]]]:
    """The number of rounds with the least loss on the later part, before ``patience`` rounds without a better one.

    Spark's boosting cannot go on from a model, but its first rounds are the same whatever their number, so it is run
    for 2 * patience rounds, and for twice as many as long as it has not stopped: no more than twice the rounds needed.
    """
    tried = min(rounds, max(1, 2 * patience))
    while True:
        model = train(fit, encoder, params, tried, seed)
        # Spark's loss is twice the log loss
        later = [x / 2 for x in model.evaluateEachIteration(early)]
        best = stop = 0
        for stop, x in enumerate(later):
            if x < later[best]:
                best = stop
            elif stop - best >= patience:
                break
        if stop - best >= patience or tried == rounds:
            own = [x / 2 for x in model.evaluateEachIteration(fit)]
            return best + 1, {"fit": own[: stop + 1], "early_stop": later[: stop + 1]}
        tried = min(rounds, 2 * tried)


def probability(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    """Adds p, the probability of label 1, and margin, its log-odds."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    return out.withColumns({"p": vector_to_array("probability")[1], "margin": 2 * vector_to_array("rawPrediction")[1]}).drop("probability", "rawPrediction", "prediction")


@dataclass
class Node:
    cover: float
    value: float = 0.0
    gain: float = 0.0
    feature: int = -1
    threshold: float | None = None
    left_values: frozenset[float] | None = None
    left: Node | None = None
    right: Node | None = None


def _node(j) -> Node:
    """A tree from the JVM; models are small and on the driver."""
    cover = float(j.impurityStats().count())
    if j.subtreeDepth() == 0:
        return Node(cover, float(j.prediction()))
    split = j.split()
    node = Node(cover, float(j.prediction()), float(j.gain()), int(split.featureIndex()), left=_node(j.leftChild()), right=_node(j.rightChild()))
    if split.getClass().getSimpleName().startswith("Continuous"):
        node.threshold = float(split.threshold())
    else:
        node.left_values = frozenset(float(x) for x in split.leftCategories())
    return node


def trees_of(model: GBTClassificationModel) -> list[tuple[float, Node]]:
    roots = [_node(t._java_obj.rootNode()) for t in model.trees]
    # log-odds are twice the sum of the trees
    return [(2.0 * w, r) for w, r in zip(model.treeWeights, roots, strict=True)]


def importance(trees: list[tuple[float, Node]], names: list[str]) -> dict[str, dict[str, float]]:
    """By feature: weight (splits), total_gain, gain (mean), total_cover, cover (mean)."""
    out = {n: {"weight": 0.0, "total_gain": 0.0, "total_cover": 0.0} for n in dict.fromkeys(names)}

    def walk(node: Node) -> None:
        if node.left is None:
            return
        own = out[names[node.feature]]
        own["weight"] += 1
        own["total_gain"] += node.gain * node.cover
        own["total_cover"] += node.cover
        walk(node.left)
        walk(node.right)

    for _, root in trees:
        walk(root)
    return {n: v | {"gain": v["total_gain"] / max(1, v["weight"]), "cover": v["total_cover"] / max(1, v["weight"])} for n, v in out.items()}


def _paths(node: Node, path: tuple = ()) -> Iterator[tuple[float, tuple]]:
    if node.left is None:
        yield node.value, path
        return
    for child, is_left in ((node.left, True), (node.right, False)):
        yield from _paths(child, (*path, (node, is_left, child.cover / node.cover if node.cover else 0.5)))


def _goes(node: Node, is_left: bool, x: np.ndarray) -> np.ndarray:
    v = x[:, node.feature]
    left = v <= node.threshold if node.threshold is not None else np.isin(v, list(node.left_values))
    return left if is_left else ~left


def shapley(trees: list[tuple[float, Node]], x: np.ndarray, group: list[int]) -> tuple[np.ndarray, float]:
    """Contributions [rows, features] to the log-odds and their base value; group has the feature of each column.

    A leaf is a game: its value times, for each feature on its path, whether the row passes the
    feature's splits (if it plays) or the share of training rows that do (if it does not).
    Shapley values of a product follow from the coefficients of prod(share + passes * t).
    """
    out, base = np.zeros((len(x), max(group) + 1)), 0.0
    for weight, root in trees:
        for value, path in _paths(root):
            by: dict[int, list] = {}
            for node, is_left, part in path:
                z, o = by.get(group[node.feature], (1.0, np.ones(len(x), bool)))
                by[group[node.feature]] = (z * part, o & _goes(node, is_left, x))
            base += weight * value * math.prod(z for z, _ in by.values())
            m = len(by)
            for f, (z, o) in by.items():
                poly = [np.ones(len(x))]
                for g, (zg, og) in by.items():
                    if g != f:
                        grown = [zg * c for c in poly] + [np.zeros(len(x))]
                        for k, c in enumerate(poly):
                            grown[k + 1] = grown[k + 1] + og * c
                        poly = grown
                total = sum(c * (math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m)) for k, c in enumerate(poly))
                out[:, f] += weight * value * (o - z) * total
    return out, base
