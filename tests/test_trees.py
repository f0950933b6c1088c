"""Forests of any depth: both ways of growing, depth, bagging, inference in groups of trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from buildlens.operators import trees as TR


def table(spark, n=400, d=6, seed=1):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0.1)).astype(int)
    rows = [(i, int(y[i]), x[i, :4].tolist(), x[i, 4:].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "row long, y int, a array<double>, b array<float>").repartition(3), x, y


def nodes(model):
    return sorted(tuple(-1 if v is None else v for v in r) for r in model.nodes.collect())


@pytest.mark.parametrize("settings", [{"num_trees": 1, "bagging": False, "features": None}, {"num_trees": 5, "max_depth": 4}, {"num_trees": 4, "seed": 9}])
def test_distributed_and_local_growth_agree(spark, monkeypatch, settings):
    df, _, _ = table(spark)
    one = TR.fit(df, ["a", "b"], "y", "row", TR.TreeConfig(local=10**6, **settings), (1.0, 1.7))
    monkeypatch.setattr(TR, "HISTOGRAMS", 20_000)  # several passes per level
    two = TR.fit(df, ["a", "b"], "y", "row", TR.TreeConfig(local=3, **settings), (1.0, 1.7))
    assert nodes(one) == nodes(two)
    assert {r["tree"] for r in one.nodes.collect()} == set(range(settings["num_trees"]))
    if "max_depth" in settings:
        assert one.nodes.agg(F.max("depth")).first()[0] <= settings["max_depth"]


def test_trees_go_deeper_than_thirty(spark):
    rows = [(i, i % 2, [float(i)]) for i in range(120)]
    df = spark.createDataFrame(rows, "row long, y int, x array<double>")
    model = TR.fit(df, ["x"], "y", "row", TR.TreeConfig(num_trees=1, bagging=False, features=None, bins=120, local=50))
    assert model.nodes.agg(F.max("depth")).first()[0] > 30
    got = {r["row"]: r["score"] for r in TR.predict(model, df, ["x"]).collect()}
    assert got == {i: float(i % 2) for i in range(120)}  # every leaf is pure


def test_forest_learns_and_groups_of_trees_agree(spark, monkeypatch, tmp_out):
    df, x, y = table(spark, 600)
    model = TR.fit(df.where("row < 450"), ["a", "b"], "y", "row", TR.TreeConfig(num_trees=30))
    test = df.where("row >= 450")
    got = {r["row"]: r["score"] for r in TR.predict(model, test, ["a", "b"]).collect()}
    assert np.mean([(got[i] > 0.5) == (y[i] == 1) for i in got]) > 0.75
    TR.save(model, f"{tmp_out}/m")
    monkeypatch.setattr(TR, "MAX_NODES", 200)  # a few trees in each pass
    again = {r["row"]: r["score"] for r in TR.predict(TR.load(spark, f"{tmp_out}/m"), test, ["a", "b"]).collect()}
    assert again == pytest.approx(got)


def test_bags_follow_the_poisson_law():
    drawn = TR.bag_counts(np.arange(200_000), 3, 0)
    assert drawn.mean() == pytest.approx(1, abs=0.01) and (drawn == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert (drawn != TR.bag_counts(np.arange(200_000), 4, 0)).mean() > 0.5


def test_odd_tables(spark):
    kind = "row long, y int, x array<double>"
    same = TR.fit(spark.createDataFrame([(i, i % 2, [1.0, 2.0]) for i in range(8)], kind), ["x"], "y", "row", TR.TreeConfig(num_trees=2, bagging=False))
    assert [(r["feature"], r["n0"], r["n1"]) for r in same.nodes.collect()] == [(None, 4, 4)] * 2  # nothing parts the rows
    pure = TR.fit(spark.createDataFrame([(i, 1, [float(i)]) for i in range(5)], kind), ["x"], "y", "row", TR.TreeConfig(num_trees=1, bagging=False))
    assert pure.nodes.count() == 1
    assert {r["score"] for r in TR.predict(pure, spark.createDataFrame([(0, 0, [99.0])], kind), ["x"]).collect()} == {1.0}


def test_inference_sends_no_nodes_to_the_driver(spark, monkeypatch):
    df, _, _ = table(spark, 300)
    model = TR.fit(df, ["a", "b"], "y", "row", TR.TreeConfig(num_trees=6))
    n, most, frame = model.nodes.count(), [0], type(df)
    collect, broadcast, sent = frame.collect, type(spark.sparkContext).broadcast, []
    monkeypatch.setattr(frame, "collect", lambda self: most.append(len(got := collect(self))) or got)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    scored = TR.predict(model, df, ["a", "b"])
    assert n > 100 and max(most) <= 6 and not sent
    assert scored.columns == [*df.columns, "score"] and scored.count() == 300


def test_a_subtree_is_split_level_by_level(monkeypatch):
    """Before, one histogram per node; the nodes are those that a node at a time gives."""
    rnd = np.random.default_rng(4)
    bins, y, count = rnd.integers(0, 32, (500, 40)).astype(np.uint8), rnd.integers(0, 2, 500), rnd.integers(1, 4, 500)
    bins[:100] = bins[0]  # rows that no feature parts
    cfg, weights, want = TR.TreeConfig(), (1.0, 1.7), []

    def grow(rows, node, depth):
        n0, n1 = (int(count[rows][y[rows] == c].sum()) for c in (0, 1))
        split = None
        if n0 and n1:
            for feature in (TR.node_features(2, node, 40, cfg), np.arange(40)):
                split = split or TR.best_split(TR._histogram(bins[rows], y[rows], count[rows], feature, cfg.bins), feature, weights)
        children = (TR._child(node, 0), TR._child(node, 1)) if split else (None, None)
        want.append((2, node, depth, *(split or (None, None)), *children, n0, n1))
        if split:
            lower = bins[rows, split[0]] <= split[1]
            grow(rows[lower], children[0], depth + 1)
            grow(rows[~lower], children[1], depth + 1)

    grow(np.arange(500), 77, 0)
    passes, real = [], TR._level_splits
    monkeypatch.setattr(TR, "_level_splits", lambda *a: passes.append(1) or real(*a))
    monkeypatch.setattr(TR, "CELLS", 20_000)  # several passes per level
    got = TR.grow_here(bins, y, count, 2, 77, 0, weights, cfg).to_pylist()
    assert sorted((tuple(r.values()) for r in got), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])
    assert len(passes) <= 2 * (1 + max(r[2] for r in want)) < len(want)
