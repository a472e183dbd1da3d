"""Boosted trees that grow leaf by leaf, on histograms of gradients and curvatures.

Features are cut into bins once; a row is then a few bytes, its label and its score so far. A tree starts as one
leaf and always splits the leaf with the largest gain, up to its number of leaves. Histograms are summed in
the tasks, added up over them by node and feature, and searched for the best split where they meet; one pass
serves all leaves whose histograms are not known yet, and the children that known leaves would have, so that a
tree takes far fewer passes than splits and still grows exactly leaf by leaf. Only the best split of
each group of features of a node reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.session import stage

BINS = 255
#: Trees after which the scores of rows are written anew; between, tasks add up the latest trees.
RENEW = 10
#: Bytes of partial histograms, of all passes of a fit, that the driver adds up itself; beyond, tasks do.
DIRECT_BYTES = 64 << 20
#: Features whose histograms of a node are added up and searched together.
GROUP = 7
LEAST_CURVATURE = 1e-3


@dataclass(frozen=True)
class Growth:
    """How trees grow: number, leaves, rows per leaf, L2 penalty of leaf values, learning rate."""

    rounds: int = 100
    leaves: int = 15
    least_rows: int = 30
    penalty: float = 1.0
    rate: float = 0.1

    def __post_init__(self):
        if self.rounds < 1 or self.leaves < 2 or self.least_rows < 1 or self.penalty < 0 or self.rate <= 0:
            raise ValueError("Rounds, leaves, rows per leaf and rate must be positive, the penalty not negative")


@dataclass
class Tree:
    """Arrays over nodes; a leaf has feature -1. A value goes left if it is at most the threshold of its node."""

    feature: np.ndarray
    place: np.ndarray  # bin of the threshold
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf_of(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        at, every = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = rows[every, feature] > bounds[at]
            at = np.where(inner, np.where(right, self.right[at], self.left[at]), at)


@dataclass(frozen=True)
class Boosted:
    """A fitted sum of trees over named features."""

    features: tuple[str, ...]
    base: float
    trees: tuple[Tree, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += tree.value[tree.leaf_of(x, tree.threshold)]
        return total

    def probability(self) -> Column:
        """Probability of the positive class, in Arrow batches; a missing value goes left everywhere."""
        model = self

        @F.pandas_udf("double")
        def scored(x: pd.DataFrame) -> pd.Series:
            return pd.Series(1.0 / (1.0 + np.exp(-model.margin(x.to_numpy(np.float64)))))

        return scored(F.struct(*self.features))


# ---------------------------------------------------------------- bins


def bin_bounds(rows: DataFrame, features: tuple[str, ...]) -> list[np.ndarray]:
    """Upper bounds of the bins of each feature, from its approximate quantiles: values of the feature itself."""
    levels = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(f, levels, 10_000).alias(f) for f in features], *[F.max(f).alias(f"{f}_most") for f in features]).first()
    return [np.array(sorted({v for v in found[f] or [] if v < found[f"{f}_most"]})) for f in features]


def binned(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b, column, "left") for b, column in zip(bounds, x.T)], axis=1).astype(np.uint8)


_ROWS = "bins binary, y double, score double"


def _binned_rows(rows: DataFrame, features: tuple[str, ...], target: str, bounds: list[np.ndarray], base: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1)
            bins = [row.tobytes() for row in binned(x, bounds)]
            yield pa.record_batch([pa.array(bins, pa.binary()), batch.column(len(features)), pa.array(np.full(len(bins), base))], ["bins", "y", "score"])

    return rows.select(*[F.col(f).cast("double") for f in features], F.col(target).cast("double")).mapInArrow(run, _ROWS)


def _arrays(batch: pa.RecordBatch, width: int, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and scores with the latest trees added."""
    packed = b"".join(batch.column(0).to_pylist())
    bins = np.frombuffer(packed, dtype=np.uint8).reshape(-1, width)
    score = batch.column(2).to_numpy(zero_copy_only=False).copy()
    for tree in trees:
        score += tree.value[tree.leaf_of(bins, tree.place)]
    return bins, batch.column(1).to_numpy(zero_copy_only=False), score


# ---------------------------------------------------------------- histograms


def histograms(bins: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """Sums of gradient, curvature and rows per (node, feature, bin); a negative node takes no part."""
    use = node >= 0
    bins, gradient, curvature, node = bins[use], gradient[use], curvature[use], node[use]
    size = nodes * 256
    out = np.zeros((3, bins.shape[1], size))
    for f in range(bins.shape[1]):
        key = node * 256 + bins[:, f]
        out[0, f] = np.bincount(key, gradient, size)
        out[1, f] = np.bincount(key, curvature, size)
        out[2, f] = np.bincount(key, minlength=size)
    return out.reshape(3, bins.shape[1], nodes, 256).transpose(2, 1, 3, 0)


@dataclass
class Split:
    gain: float
    feature: int
    place: int
    left: np.ndarray  # gradient, curvature and rows that go left
    right: np.ndarray


def best_split(sums: np.ndarray, growth: Growth) -> Split | None:
    """The split of a node with the largest gain that leaves enough rows and curvature on both sides.

    ``sums``: features x bins x (gradient, curvature, rows). Of equal gains the first feature and bin win.
    """
    left = np.cumsum(sums, axis=1)
    whole = left[0, -1]
    right = whole - left

    def worth(s):
        return s[..., 0] ** 2 / (s[..., 1] + growth.penalty + 1e-300)

    allowed = (left[..., 2] >= growth.least_rows) & (right[..., 2] >= growth.least_rows)
    allowed &= (left[..., 1] >= LEAST_CURVATURE) & (right[..., 1] >= LEAST_CURVATURE)
    gain = np.where(allowed, worth(left) + worth(right) - worth(whole), -np.inf)
    feature, place = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[feature, place] <= 1e-12:
        return None
    return Split(float(gain[feature, place]), int(feature), int(place), left[feature, place], right[feature, place])


_PARTS = "node int, first int, part int, sums binary"
_SPLITS = "node int, total array<double>, gain double, feature int, place int, left array<double>, right array<double>"


def _searched(growth: Growth):
    """Adds up the parts of each node and group of features, which come sorted, and finds the best split of each."""

    def split_of(key: tuple[int, int], sums: np.ndarray):
        sums = sums.reshape(-1, 256, 3)
        found = best_split(sums, growth)
        total = sums[0].sum(axis=0).tolist()
        if found is None:
            return key[0], total, None, None, None, None, None
        return key[0], total, found.gain, key[1] + found.feature, found.place, found.left.tolist(), found.right.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, total = [], None, None
        for batch in batches:
            for node, first, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                part = np.frombuffer(packed)
                if (node, first) == last:
                    total = total + part
                    continue
                if last is not None:
                    out.append(split_of(last, total))
                last, total = (node, first), part
        if last is not None:
            out.append(split_of(last, total))
        kinds = [pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        columns = zip(*out) if out else [[]] * len(kinds)
        yield pa.record_batch([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], [c.split()[0] for c in _SPLITS.split(", ")])

    return run


def _pass(rows: DataFrame, width: int, recent: list[Tree], tree: Tree, wanted: list[int], growth: Growth, direct: bool) -> list:
    """Sums and best split of the wanted nodes of a growing tree, over all rows; ``direct`` ones are their histograms.

    Parts are added in the order of the tasks, so that a fit has the same trees each time.
    """
    number = np.full(len(tree.feature), -1)
    number[wanted] = np.arange(len(wanted))
    keys = [(i, f) for i in range(len(wanted)) for f in range(0, width, GROUP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(wanted), width, 256, 3))
        part = TaskContext.get().partitionId()
        for batch in batches:
            bins, y, score = _arrays(batch, width, recent)
            p = 1.0 / (1.0 + np.exp(-score))
            total += histograms(bins, p - y, p * (1 - p), number[tree.leaf_of(bins, tree.place)], len(wanted))
        for i in range(len(wanted)):
            mine = [f for n, f in keys if n == i]
            sums = [total[i, f : f + GROUP].tobytes() for f in mine]
            columns = [pa.array([x] * len(mine), pa.int32()) for x in (i, part)]
            yield pa.record_batch([columns[0], pa.array(mine, pa.int32()), columns[1], pa.array(sums, pa.binary())], ["node", "first", "part", "sums"])

    parts = rows.mapInArrow(run, _PARTS)
    if direct:
        whole = np.zeros((len(wanted), width, 256, 3))
        for r in parts.collect():
            whole[r["node"], r["first"] : r["first"] + GROUP] += np.frombuffer(r["sums"]).reshape(-1, 256, 3)
        return list(whole)
    found = parts.repartition("node", "first").sortWithinPartitions("node", "first", "part").mapInArrow(_searched(growth), _SPLITS)
    out: list[tuple[np.ndarray, Split | None]] = [(np.zeros(3), None)] * len(wanted)
    for r in sorted(found.collect(), key=lambda r: (r["node"], -1 if r["feature"] is None else r["feature"])):
        total, best = np.array(r["total"]), out[r["node"]][1]
        if r["gain"] is not None and (best is None or r["gain"] > best.gain):
            best = Split(r["gain"], r["feature"], r["place"], np.array(r["left"]), np.array(r["right"]))
        out[r["node"]] = (total, best)
    return out


# ---------------------------------------------------------------- growth


@dataclass
class _Node:
    sums: np.ndarray
    split: Split | None = None
    known: bool = False
    children: list[int] = field(default_factory=list)


def _as_tree(nodes: list[_Node], inner: set[int], bounds: list[np.ndarray], growth: Growth) -> Tree:
    """The nodes as arrays; only ``inner`` ones split."""
    n = len(nodes)
    feature, place, threshold = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
    left, right, value = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for i, node in enumerate(nodes):
        if i in inner:
            feature[i], place[i] = node.split.feature, node.split.place
            threshold[i] = bounds[node.split.feature][node.split.place]
            left[i], right[i] = node.children
        value[i] = -growth.rate * node.sums[0] / (node.sums[1] + growth.penalty)
    return Tree(feature, place, threshold, left, right, value)


def grow(passes, bounds: list[np.ndarray], growth: Growth) -> Tree:
    """One tree. ``passes(tree, wanted)`` returns the histograms of the wanted leaves of a tree, or
    their sums and best splits."""
    nodes = [_Node(np.zeros(3))]
    frontier, inner = [0], set()

    def look():
        """Makes the frontier known, and with the same pass what its known leaves would be split into."""
        ahead = [c for i in frontier if nodes[i].known and nodes[i].split for c in nodes[i].children]
        wanted = [i for i in [*frontier, *ahead] if not nodes[i].known and (i == 0 or nodes[i].sums[2] >= 2 * growth.least_rows)]
        for i in {*frontier, *ahead} - set(wanted):
            nodes[i].known = True  # too small to be split
        if not wanted:
            return
        shape = _as_tree(nodes, inner | {i for i in frontier if nodes[i].split}, bounds, growth)
        for i, found in zip(wanted, passes(shape, wanted)):
            node = nodes[i]
            node.sums, node.split = found if isinstance(found, tuple) else (found[0].sum(axis=0), best_split(found, growth))
            node.known = True
            if node.split:
                node.children = [len(nodes), len(nodes) + 1]
                nodes.extend([_Node(node.split.left), _Node(node.split.right)])

    while len(frontier) < growth.leaves:
        if any(not nodes[i].known for i in frontier):
            look()
        ready = [i for i in frontier if nodes[i].split]
        if not ready:
            break
        best = max(ready, key=lambda i: (nodes[i].split.gain, -i))
        inner.add(best)
        frontier.remove(best)
        frontier.extend(nodes[best].children)
    return _as_tree(nodes, inner, bounds, growth)


def fit_boosting(rows: DataFrame, features: tuple[str, ...], target: str, growth: Growth | None = None) -> Boosted:
    """Fit to a 0/1 target. Rows are staged with their bins, and with their scores every ``RENEW`` trees."""
    growth = growth or Growth()
    facts = rows.agg(F.count(target).alias("n"), F.avg(target).alias("prior")).first()
    if not facts["n"] or not 0 < facts["prior"] < 1:
        raise ValueError("Boosting needs rows of both classes")
    base = float(np.log(facts["prior"] / (1 - facts["prior"])))
    bounds, width = bin_bounds(rows, features), len(features)
    table = stage(_binned_rows(rows, features, target, bounds, base), "binned-rows")
    parts = table.select(F.spark_partition_id()).distinct().count()
    direct = parts * 2 * growth.leaves * growth.rounds * width * 256 * 24 <= DIRECT_BYTES
    trees: list[Tree] = []
    recent: list[Tree] = []
    for _ in range(growth.rounds):
        latest = list(recent)
        tree = grow(lambda shape, wanted, t=table, r=latest: _pass(t, width, r, shape, wanted, growth, direct), bounds, growth)
        if len(tree.feature) == 1 or not (tree.feature >= 0).any():
            break  # nothing is left to be split
        trees.append(tree)
        recent.append(tree)
        if len(recent) == RENEW and len(trees) < growth.rounds:
            table, recent = stage(_renewed(table, width, list(recent)), "boosted-rows"), []
    return Boosted(tuple(features), base, tuple(trees))


def _renewed(rows: DataFrame, width: int, trees: list[Tree]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _arrays(batch, width, trees)[2]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score)], ["bins", "y", "score"])

    return rows.mapInArrow(run, _ROWS)
