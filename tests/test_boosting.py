"""Leaf-wise boosting: splits and growth against exhaustive search, fitted rows against Spark's own boosting."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from telemetry_ops.operators import boosting as B
from telemetry_ops.operators.scores import average_precision

NAMES = ("a", "b", "c", "d")


def draw(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(NAMES)))
    x[:, 2] = np.round(x[:, 2])  # ties
    x[:, 3] = 1.0  # nothing to split
    odds = 2 * np.where(x[:, 0] > 0.3, x[:, 1], -x[:, 1]) + x[:, 2]
    return x, (rng.random(n) < 1 / (1 + np.exp(-odds))).astype(int)


def table(spark, x, y):
    rows = [(*map(float, r), int(t), "clash") for r, t in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES) + ", y int, bins string")


def exhaustive(bins, g, h, growth):
    """The best split by trying every feature and bin."""
    best = None
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + growth.penalty)
    for f in range(bins.shape[1]):
        for b in range(256):
            left = bins[:, f] <= b
            if min(left.sum(), (~left).sum()) < growth.least_rows:
                continue
            gain = worth(left) + worth(~left) - worth(np.ones(len(g), bool))
            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, b)
    return best


def grown(bins, g, h, growth):
    """Leaf-wise growth on whole rows: leaves as sets of rows with their values."""
    leaves = [np.arange(len(g))]
    while len(leaves) < growth.leaves:
        found = [exhaustive(bins[m], g[m], h[m], growth) for m in leaves]
        ready = [i for i, s in enumerate(found) if s]
        if not ready:
            break
        i = max(ready, key=lambda i: found[i][0])
        m, (_, f, b) = leaves.pop(i), found[i]
        leaves += [m[bins[m, f] <= b], m[bins[m, f] > b]]
    return {tuple(m): -growth.rate * g[m].sum() / (h[m].sum() + growth.penalty) for m in leaves}


@pytest.mark.parametrize("seed", range(3))
def test_one_split_is_the_best_of_all(seed):
    x, y = draw(seed, 400)
    bounds = [np.unique(c)[:-1] for c in np.round(x, 1).T]
    bins, p = B.binned(np.round(x, 1), bounds), np.full(400, 0.4)
    growth = B.Growth(least_rows=30, penalty=1.0)
    (sums,) = B.histograms(bins, p - y, p * (1 - p), np.zeros(400, int), 1)
    assert sums[0, :, 2].sum() == 400
    split = B.best_split(sums, growth)
    gain, feature, place = exhaustive(bins, p - y, p * (1 - p), growth)
    assert (split.feature, split.place) == (feature, place) and split.gain == pytest.approx(gain)
    assert B.best_split(sums, B.Growth(least_rows=201)) is None


def test_trees_grow_leaf_by_leaf(spark):
    x, y = draw(5, 900)
    growth = B.Growth(rounds=1, leaves=7, least_rows=30, penalty=1.0)
    model = B.fit_boosting(table(spark, x, y).repartition(3), NAMES, "y", growth)
    bounds = B.bin_bounds(table(spark, x, y), NAMES)
    bins, p = B.binned(x, bounds), np.full(900, y.mean())
    want = grown(bins, p - y, p * (1 - p), growth)
    (tree,) = model.trees
    at = tree.leaf_of(x, tree.threshold)
    assert np.array_equal(at, tree.leaf_of(bins, tree.place))
    got = {tuple(np.flatnonzero(at == leaf)): tree.value[leaf] for leaf in np.unique(at)}
    assert got.keys() == want.keys() and len(got) == 7
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_passes_are_far_fewer_than_splits():
    x, y = draw(6, 3000)
    bounds = [np.unique(c)[:-1] for c in np.round(x, 1).T]
    bins, p, calls = B.binned(np.round(x, 1), bounds), np.full(3000, 0.5), []

    def passes(shape, wanted):
        calls.append(len(wanted))
        number = np.full(len(shape.feature), -1)
        number[wanted] = np.arange(len(wanted))
        return B.histograms(bins, p - y, p * (1 - p), number[shape.leaf_of(bins, shape.place)], len(wanted))

    tree = B.grow(passes, bounds, B.Growth(leaves=15))
    assert len(np.unique(tree.leaf_of(bins, tree.place))) == 15 and len(calls) <= 8


def test_ranks_held_out_rows_at_least_as_well_as_trees_by_level(spark):
    train, held = table(spark, *draw(7, 3000)).cache(), table(spark, *draw(8, 2000)).withColumnRenamed("y", "target").cache()
    model = B.fit_boosting(train, NAMES, "y", B.Growth(rounds=15))
    assert len(model.trees) == 15 and all(len(np.unique(t.leaf_of(draw(7, 3000)[0], t.threshold))) <= 15 for t in model.trees)
    other = GBTClassifier(featuresCol="x", labelCol="y", maxIter=15, maxDepth=4, minInstancesPerNode=30, stepSize=0.1, maxBins=255, seed=1)
    assembler = VectorAssembler(inputCols=list(NAMES), outputCol="x")
    level = other.fit(assembler.transform(train)).transform(assembler.transform(held))
    scored = held.select("target", F.lit("leaf").alias("candidate"), model.probability().alias("probability"))
    scored = scored.unionByName(level.select("target", F.lit("level").alias("candidate"), vector_to_array("probability")[1].alias("probability")))
    ap = {r["candidate"]: r["average_precision"] for r in average_precision(scored, ["candidate"]).collect()}
    assert ap["leaf"] >= ap["level"] - 1e-3 and ap["leaf"] > 0.8


def test_written_scores_change_nothing_and_bad_input_is_refused(spark, monkeypatch):
    rows = table(spark, *draw(9, 600)).repartition(2).cache()
    whole = B.fit_boosting(rows, NAMES, "y", B.Growth(rounds=5))
    monkeypatch.setattr(B, "RENEW", 2)
    monkeypatch.setattr(B, "DIRECT_BYTES", 0)  # tasks add the histograms up
    parts = B.fit_boosting(rows, NAMES, "y", B.Growth(rounds=5))
    x = draw(10, 50)[0]
    assert np.allclose(whole.margin(x), parts.margin(x), atol=1e-9)
    for bad in (rows.where("y = 1"), rows.where("false")):
        with pytest.raises(ValueError, match="both classes"):
            B.fit_boosting(bad, NAMES, "y")
    with pytest.raises(ValueError):
        B.Growth(leaves=1)


def test_histograms_stay_in_the_tasks(spark):
    x, y = draw(11, 600)
    rows = table(spark, x, y).repartition(4)
    growth = B.Growth(rounds=1, leaves=4)
    bounds = B.bin_bounds(rows, NAMES)
    binned = B._binned_rows(rows, NAMES, "y", bounds, 0.0)
    root = B.Tree(*(np.array([v]) for v in (-1, 0, 0.0, 0, 0, 0.0)))
    (whole,) = B._pass(binned, len(NAMES), [], root, [0], growth, True)
    ((sums, split),) = B._pass(binned, len(NAMES), [], root, [0], growth, False)
    want = B.best_split(whole, growth)
    assert np.allclose(sums, whole[0].sum(axis=0)) and (split.feature, split.place) == (want.feature, want.place)
    assert split.gain == pytest.approx(want.gain) and np.allclose(split.left, want.left) and np.allclose(split.right, want.right)
    assert sums.size + split.left.size + split.right.size == 9  # instead of the histograms
