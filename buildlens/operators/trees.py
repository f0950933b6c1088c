"""Decision forests of any depth, grown level by level (M5, M7).

Features are cut into ``bins`` of equal width between their least and largest values.
A node asks for histograms, (feature, bin) -> rows of each class; tasks count their rows, the counts
are summed, and the best split of every node is picked from the sums.  Rows never
move for that: each keeps the node it is in, per tree.  Nodes of at most ``local`` rows are
finished at once: their rows meet in a group, whose whole subtree is grown there.  Both ways give the
same tree.

A tree's rows are drawn by a hash (Poisson bagging), and a node's features by a hash of its path, so a
forest depends on seed and data only, not on partitions.  Counts are integers; class weights enter when a split
is judged.  A node that has a valid split is split until it is pure, as with unlimited depth.

The model is a table of nodes.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .diffs import materialize

U64 = np.uint64
NODES = "tree int, node long, depth int, feature int, bin int, left long, right long, n0 long, n1 long"
HISTOGRAMS = 64 << 20  # bytes of a task's histograms in one pass
CELLS = 2_000_000  # of the histograms that a subtree's level holds at once
MAX_NODES = 1_000_000  # of a model that a task holds; larger ones are applied by groups of trees
ROW = "_scored_row"
PACKED = ["node", "depth", "feature", "bin", "left", "right", "n0", "n1"]


@dataclass
class TreeConfig:
    num_trees: int = 300
    max_depth: int | None = None   # None: no limit
    features: str | None = "sqrt"  # per node; None: all
    bagging: bool = True
    bins: int = 32
    seed: int = 0
    local: int = 20_000            # rows of a node that is finished in one task


@dataclass
class TreeModel:
    nodes: DataFrame
    low: np.ndarray
    high: np.ndarray
    weights: tuple[float, float]
    config: TreeConfig


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two rounds of shift, xor and multiply."""
    x = np.atleast_1d(np.asarray(x, U64))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> U64(shift))) * U64(factor)
    return x ^ (x >> U64(33))


def _hash(*parts) -> np.ndarray:
    out = np.full(1, 0x9E3779B97F4A7C15, U64)
    for p in parts:
        out = _mix(out * U64(31) + np.atleast_1d(np.asarray(p)).astype(np.int64).view(U64) + U64(1))
    return out


def _child(node: int, side: int) -> int:
    return int(_hash(node, side).view(np.int64)[0])


def bag_counts(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1, by the row's hash."""
    u = _hash(rows, tree, seed).astype(np.float64) / 2.0**64
    table = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))
    return np.searchsorted(table, u, side="right").astype(np.int64)


def node_features(tree: int, node: int, d: int, cfg: TreeConfig) -> np.ndarray:
    if cfg.features is None:
        return np.arange(d)
    k = max(1, int(np.sqrt(d)))
    return np.sort(np.argsort(_hash(np.arange(d), tree, node, cfg.seed), kind="stable")[:k])


def _impurity(x: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    a, b = x[..., 0] * weights[0], x[..., 1] * weights[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        return (a * a + b * b) / (a + b)


def best_split(hist: np.ndarray, feature: np.ndarray, weights: tuple[float, float]) -> tuple[int, int] | None:
    """(feature, last bin of the left side) with the least weighted impurity; None if no bin parts the rows.

    ``hist``: features x bins x 2 counts.  Ties go to the lower feature, then the lower bin.
    """
    left = hist.cumsum(axis=1)[:, :-1]
    right = hist.sum(axis=1)[:, None] - left
    ok = (left.sum(axis=2) > 0) & (right.sum(axis=2) > 0)
    if not ok.any():
        return None

    score = np.where(ok, _impurity(left, weights) + _impurity(right, weights), -np.inf)
    at = int(score.argmax())
    return int(feature[at // score.shape[1]]), at % score.shape[1]


def _histogram(bins: np.ndarray, y: np.ndarray, count: np.ndarray, feature: np.ndarray, n_bins: int) -> np.ndarray:
    at = (np.arange(len(feature)) * n_bins + bins[:, feature]) * 2 + y[:, None]
    return np.bincount(at.ravel(), np.repeat(count, len(feature)), len(feature) * n_bins * 2).astype(np.int64).reshape(len(feature), n_bins, 2)


def _level_splits(bins, y, count, rows, own, nodes, tree: int, weights, cfg: TreeConfig, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(feature or -1, bin) of each of ``nodes``, as ``best_split`` judges them; ``rows`` are in order of their node's place ``own``."""
    d, out = bins.shape[1], np.full((2, len(nodes)), -1, np.int64)
    k = d if every or cfg.features is None else max(1, int(np.sqrt(d)))
    step = max(1, CELLS // (k * cfg.bins * 2))
    for first in range(0, len(nodes), step):
        some = nodes[first:first + step]
        m = len(some)
        feature = np.broadcast_to(np.arange(d), (m, d)) if k == d else \
            np.sort(np.argsort(_hash(np.arange(d)[None, :], tree, some[:, None], cfg.seed), axis=1, kind="stable")[:, :k], axis=1)
        lo, hi = np.searchsorted(own, [first, first + m])
        r, place = rows[lo:hi], own[lo:hi] - first
        at = ((place[:, None] * k + np.arange(k)) * cfg.bins + bins[r[:, None], feature[place]]) * 2 + y[r][:, None]
        hist = np.bincount(at.ravel(), np.repeat(count[r], k), m * k * cfg.bins * 2).reshape(m, k, cfg.bins, 2)
        left = hist.cumsum(axis=2)[:, :, :-1]
        right = hist.sum(axis=2)[:, :, None] - left
        ok = (left.sum(axis=3) > 0) & (right.sum(axis=3) > 0)
        score = np.where(ok, _impurity(left, weights) + _impurity(right, weights), -np.inf).reshape(m, -1)
        best, found = score.argmax(axis=1), ok.reshape(m, -1).any(axis=1)
        out[0, first:first + m] = np.where(found, feature[np.arange(m), best // (cfg.bins - 1)], -1)
        out[1, first:first + m] = np.where(found, best % (cfg.bins - 1), -1)
    return out[0], out[1]


def grow_here(bins: np.ndarray, y: np.ndarray, count: np.ndarray, tree: int, node: int, depth: int, weights, cfg: TreeConfig) -> pa.RecordBatch:
    """All nodes of one subtree, from its rows; the nodes of a level are split at once."""
    levels, d = [], bins.shape[1]
    rows, own, nodes = np.arange(len(y)), np.zeros(len(y), np.int64), np.array([node], np.int64)
    while len(nodes):
        n0, n1 = (np.bincount(own, count[rows] * (y[rows] == c), len(nodes)).astype(np.int64) for c in (0, 1))
        feature, last = np.full((2, len(nodes)), -1, np.int64)
        open_ = np.flatnonzero((n0 > 0) & (n1 > 0)) if cfg.max_depth is None or depth < cfg.max_depth else np.zeros(0, np.int64)
        for every in (False, True):  # where none of the drawn features parts the rows, all are looked at
            if not len(open_) or (every and cfg.features is None):
                break
            at = np.full(len(nodes), -1)
            at[open_] = np.arange(len(open_))
            held = at[own] >= 0
            feature[open_], last[open_] = _level_splits(bins, y, count, rows[held], at[own[held]], nodes[open_], tree, weights, cfg, every)
            open_ = open_[feature[open_] < 0]
        split = feature >= 0
        left, right = (np.where(split, _hash(nodes, side).view(np.int64), 0) for side in (0, 1))
        levels.append((np.full(len(nodes), depth), split, nodes, feature, last, left, right, n0, n1))
        # rows go on to the children, in order of their place
        go = split[own]
        rows, own = rows[go], own[go]
        child = 2 * (np.cumsum(split) - 1)[own] + (bins[rows, feature[own]] > last[own])
        by = np.argsort(child, kind="stable")
        rows, own, nodes, depth = rows[by], child[by], np.stack([left[split], right[split]], axis=1).ravel(), depth + 1
    deep, split, nodes, feature, last, left, right, n0, n1 = (np.concatenate(x) for x in zip(*levels, strict=True))
    inner = lambda x, kind: pa.array(x, kind, mask=~split)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(nodes), tree), pa.int32()), pa.array(nodes), pa.array(deep, pa.int32()), inner(feature, pa.int32()), inner(last, pa.int32()),
        inner(left, pa.int64()), inner(right, pa.int64()), pa.array(n0), pa.array(n1)], ["tree", "node", "depth", "feature", "bin", "left", "right", "n0", "n1"])


def bin_rows(df: DataFrame, columns: list[str], low: np.ndarray, high: np.ndarray, bins: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``bins``, a byte per feature."""
    width = np.where(high > low, high - low, 1.0)

    def cut(batches):
        for batch in batches:
            x = _matrix(batch, columns)
            got = np.clip(np.floor((x - low) / width * bins), 0, bins - 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([r.tobytes() for r in got], pa.binary())], [*keep, "bins"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, *columns).mapInArrow(cut, f"{kinds}, bins binary")


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.concatenate([batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1) for c in columns], axis=1) \
        if len(batch) else np.zeros((0, 0))


def _bytes(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, d)


def fit(df: DataFrame, columns: list[str], label: str, row: str, cfg: TreeConfig, weights: tuple[float, float] = (1.0, 1.0)) -> TreeModel:
    """Grow a forest on vectors ``columns`` (joined) and a 0/1 ``label``; ``row``: a number that names a row, for drawing it."""
    spark = df.sparkSession
    vec = array_to_vector(F.concat(*[F.col(c).cast("array<double>") for c in columns]))
    s = df.agg(Summarizer.metrics("min", "max", "count").summary(vec).alias("s")).select("s.min", "s.max").first()
    low, high = s[0].toArray(), s[1].toArray()
    d = len(low)
    rows = df.select(F.col(row).cast("long").alias("row"), F.col(label).cast("int").alias("y"), *columns)
    root = [(t, int(_hash(t, -1).view(np.int64)[0])) for t in range(cfg.num_trees)]

    def draw(batches):
        """Each row's node in every tree; 0 stands for none."""
        start = np.array([n for _, n in root])
        for batch in batches:
            ids = batch.column("row").to_numpy()
            drawn = np.stack([bag_counts(ids, t, cfg.seed) if cfg.bagging else np.ones(len(ids), np.int64) for t in range(cfg.num_trees)], axis=1)
            at = np.where(drawn > 0, start, 0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("y"), batch.column("bins"), _lists(drawn.astype(np.int8), pa.int8()), _lists(at, pa.int64())],
                                             ["row", "y", "bins", "drawn", "at"])

    STATE = "row long, y int, bins binary, drawn array<tinyint>, at array<long>"
    state = materialize(bin_rows(rows, columns, low, high, cfg.bins, ["row", "y"]).mapInArrow(draw, STATE))
    depth, frontier, done, small = 0, dict.fromkeys(root, 0), [], []
    ask_all: set = set()
    while frontier:
        sizes = {(r["tree"], r["node"]): (r["n0"], r["n1"], r["rows"]) for r in _sizes(state, list(frontier), cfg).collect()}  # a row per open node
        large = {}
        for key, depth in frontier.items():
            n0, n1, n_rows = sizes.get(key, (0, 0, 0))
            if n0 and n1 and (cfg.max_depth is None or depth < cfg.max_depth):
                (small.append((*key, depth)) if n_rows <= cfg.local else large.setdefault(key, depth))
            else:
                done.append((*key, depth, None, None, None, None, n0, n1))
        ask = {k: np.arange(d) if k in ask_all else node_features(*k, d, cfg) for k in large}
        splits, part, size = {}, {}, 0
        for key in large:  # a pass holds histograms of a bounded size
            part[key] = ask[key]
            size += len(ask[key]) * cfg.bins * 16
            if size > HISTOGRAMS:
                splits |= _splits(state, part, d, weights, cfg)
                part, size = {}, 0
        if part:
            splits |= _splits(state, part, d, weights, cfg)
        frontier, moves = {}, {}
        for key, depth in large.items():
            n0, n1, _ = sizes[key]
            split = splits.get(key)
            if split is None and len(ask[key]) < d:
                ask_all.add(key)           # none of the drawn features parts the rows: look at all
                frontier[key] = depth
            elif split is None:
                done.append((*key, depth, None, None, None, None, n0, n1))
            else:
                left, right = _child(key[1], 0), _child(key[1], 1)
                moves[key] = (*split, left, right)
                done.append((*key, depth, *split, left, right, n0, n1))
                frontier[key[0], left] = frontier[key[0], right] = depth + 1
        if moves:
            state = materialize(_moved(state, moves, d, STATE))
    nodes = spark.createDataFrame(done, NODES)
    if small:
        nodes = nodes.unionByName(_finished(state, small, d, weights, cfg))
    return TreeModel(materialize(nodes), low, high, weights, cfg)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel(), kind))


def _open(batch: pa.RecordBatch, nodes: np.ndarray):
    """(places in a sorted list of open nodes or -1, draws), rows x trees; a node's path names its tree."""
    at = batch.column("at").flatten().to_numpy().reshape(len(batch), -1)
    drawn = batch.column("drawn").flatten().to_numpy().reshape(len(batch), -1).astype(np.int64)
    place = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
    return np.where((nodes[place] == at) & (drawn > 0), place, -1), drawn


def _sizes(state: DataFrame, keys: list, cfg: TreeConfig) -> DataFrame:
    order = sorted(keys, key=lambda k: k[1])
    nodes, trees = np.array([k[1] for k in order]), [k[0] for k in order]

    def count(batches):
        total = np.zeros((len(nodes), 3), np.int64)
        for batch in batches:
            if len(batch):
                place, drawn = _open(batch, nodes)
                y = np.broadcast_to(batch.column("y").to_numpy()[:, None], place.shape)
                hit = place >= 0
                for j, w in enumerate((drawn * (y == 0), drawn * (y == 1), np.ones(place.shape, np.int64))):
                    total[:, j] += np.bincount(place[hit], w[hit], len(nodes)).astype(np.int64)
        seen = np.flatnonzero(total[:, 2])
        yield pa.RecordBatch.from_pydict({"tree": pa.array([trees[i] for i in seen], pa.int32()), "node": nodes[seen],
                                          **{c: total[seen, j] for j, c in enumerate(("n0", "n1", "rows"))}})

    return state.mapInArrow(count, "tree int, node long, n0 long, n1 long, rows long").groupBy("tree", "node") \
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("rows").alias("rows"))


def _splits(state: DataFrame, ask: dict, d: int, weights, cfg: TreeConfig) -> dict:
    """Best split of every open node: histograms per task, summed per (node, feature), judged per node."""
    order = sorted(ask, key=lambda k: k[1])
    nodes, wanted = np.array([k[1] for k in order]), [ask[k] for k in order]

    def count(batches):
        total = [np.zeros((len(w), cfg.bins, 2), np.int64) for w in wanted]
        for batch in batches:
            if len(batch):
                place, drawn = _open(batch, nodes)
                bins, y = _bytes(batch, d), batch.column("y").to_numpy()
                rows, tree = np.nonzero(place >= 0)
                by = np.argsort(place[rows, tree], kind="stable")
                rows, tree = rows[by], tree[by]
                cut = np.searchsorted(place[rows, tree], np.arange(len(nodes) + 1))
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    r, t = rows[cut[i]:cut[i + 1]], tree[cut[i]]
                    total[i] += _histogram(bins[r], y[r], drawn[r, t], wanted[i], cfg.bins)
        for i, own in enumerate(total):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), nodes[i])), pa.array(wanted[i], pa.int32()),
                                                  pa.array([h.ravel() for h in own], pa.list_(pa.int64()))], ["node", "feature", "h"])

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by("feature")
        split = best_split(np.array(table.column("h").to_pylist()).reshape(len(table), cfg.bins, 2), table.column("feature").to_numpy(), weights)
        return pa.table({"node": table.column("node")[:1], "feature": pa.array([split and split[0]], pa.int32()), "bin": pa.array([split and split[1]], pa.int32())})

    sums = F.array(*[F.sum(F.col("h")[i]) for i in range(2 * cfg.bins)])
    best = state.mapInArrow(count, "node long, feature int, h array<long>").groupBy("node", "feature").agg(sums.alias("h")) \
        .groupBy("node").applyInArrow(judge, "node long, feature int, bin int")
    found = {r["node"]: (r["feature"], r["bin"]) for r in best.where("feature IS NOT NULL").collect()}  # a row per open node
    return {k: found[k[1]] for k in order if k[1] in found}


def _moved(state: DataFrame, moves: dict, d: int, schema: str) -> DataFrame:
    """Rows go on to the children of the nodes that were split."""
    order = sorted(moves, key=lambda k: k[1])
    nodes, (feature, last, left, right) = np.array([k[1] for k in order]), (np.array(x) for x in zip(*[moves[k] for k in order], strict=True))

    def step(batches):
        for batch in batches:
            if len(batch):
                place, _ = _open(batch, nodes)
                at, bins = batch.column("at").flatten().to_numpy().reshape(len(batch), -1).copy(), _bytes(batch, d)
                rows, tree = np.nonzero(place >= 0)
                own = place[rows, tree]
                at[rows, tree] = np.where(bins[rows, feature[own]] <= last[own], left[own], right[own])
                yield batch.set_column(batch.schema.get_field_index("at"), "at", _lists(at, pa.int64()))

    return state.mapInArrow(step, schema)


def _finished(state: DataFrame, small: list, d: int, weights, cfg: TreeConfig) -> DataFrame:
    """The subtrees of small nodes, each grown in one group of at most ``local`` rows."""
    order = sorted(small, key=lambda k: k[1])
    nodes, trees, depths = np.array([k[1] for k in order]), np.array([k[0] for k in order]), np.array([k[2] for k in order])

    def deal(batches):
        for batch in batches:
            if len(batch):
                place, drawn = _open(batch, nodes)
                rows, tree = np.nonzero(place >= 0)
                own = place[rows, tree]
                yield pa.RecordBatch.from_arrays([
                    pa.array(trees[own], pa.int32()), pa.array(nodes[own]), pa.array(depths[own], pa.int32()), batch.column("row").take(pa.array(rows)),
                    batch.column("y").take(pa.array(rows)), pa.array(drawn[rows, tree]), batch.column("bins").take(pa.array(rows))],
                    ["tree", "node", "depth", "row", "y", "n", "bins"])

    def grow(table: pa.Table) -> pa.Table:
        batch = table.sort_by("row").combine_chunks().to_batches()[0]
        first = [batch.column(c)[0].as_py() for c in ("tree", "node", "depth")]
        return pa.Table.from_batches([grow_here(_bytes(batch, d), batch.column("y").to_numpy(), batch.column("n").to_numpy(), *first, weights, cfg)])

    rows = state.mapInArrow(deal, "tree int, node long, depth int, row long, y int, n long, bins binary")
    return rows.groupBy("tree", "node").applyInArrow(grow, NODES)


# ------------------------------------------------------------------ inference
class _Packed:
    """Nodes of some trees as arrays; a node's children are places."""

    def __init__(self, pieces: list[dict], weights: tuple[float, float]):
        col = {c: np.concatenate([p[c] for p in pieces]) for c in PACKED}
        by = np.argsort(col["node"], kind="stable")
        ids = col["node"][by]
        self.feature, self.bin = col["feature"][by], col["bin"][by]
        self.left, self.right = (np.searchsorted(ids, col[side][by]).astype(np.int32) for side in ("left", "right"))
        a, b = (col[c][by] * w for c, w in zip(("n0", "n1"), weights, strict=True))
        self.share = np.where(a + b > 0, b / np.maximum(a + b, 1e-300), 0.0)
        self.roots = np.flatnonzero(col["depth"][by] == 0)

    def total(self, bins: np.ndarray) -> np.ndarray:
        """Sum over trees of the share of class 1 in each row's leaf."""
        out = np.zeros(len(bins))
        for root in self.roots:
            at, rows = np.full(len(bins), root), np.arange(len(bins))
            while len(rows):
                rows = rows[self.feature[at[rows]] >= 0]
                own = at[rows]
                at[rows] = np.where(bins[rows, self.feature[own]] <= self.bin[own], self.left[own], self.right[own])
            out += self.share[at]
        return out


def _group_totals(model: TreeModel, tagged: DataFrame, columns: list[str], of: list[tuple[int, int]]) -> DataFrame:
    """(row, group, total): each row's sum over the trees of each group; ``of``: (tree, group).

    A group's nodes and the binned rows meet in one partition, nodes first, so a task holds the nodes of one group and a batch of rows.
    """
    spark, d, weights = tagged.sparkSession, len(model.low), model.weights
    n_groups = of[-1][1] + 1
    nodes = model.nodes.join(F.broadcast(spark.createDataFrame(of, "tree int, group int")), "tree") \
        .select("group", F.lit(-1).cast("long").alias(ROW), *[F.coalesce(c, F.lit(-1)).alias(c) for c in PACKED], F.lit(None).cast("binary").alias("bins"))
    rows = bin_rows(tagged, columns, model.low, model.high, model.config.bins, [ROW]) \
        .select(F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"), ROW, *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in PACKED], "bins")

    def apply(batches):
        group, held, packed = None, [], None
        for batch in batches:
            at, ids = batch.column("group").to_numpy(), batch.column(ROW).to_numpy()
            cut = [0, *(np.flatnonzero((at[1:] != at[:-1]) | ((ids[1:] < 0) != (ids[:-1] < 0))) + 1).tolist(), len(batch)]
            for first, end in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(first, end - first)
                if not len(part):
                    continue
                if ids[first] < 0:
                    if at[first] != group:
                        group, held, packed = at[first], [], None
                    held.append({c: part.column(c).to_numpy().copy() for c in PACKED})
                    continue
                if packed is None:
                    packed, held = _Packed(held, weights), []
                yield pa.RecordBatch.from_arrays([part.column(ROW), part.column("group"), pa.array(packed.total(_bytes(part, d)))], [ROW, "group", "total"])

    return nodes.unionByName(rows).repartition(4 * n_groups, "group").sortWithinPartitions("group", ROW) \
        .mapInArrow(apply, f"{ROW} long, group int, total double")


def predict(model: TreeModel, df: DataFrame, columns: list[str], score: str = "score") -> DataFrame:
    """``df`` with the mean share of class 1 over all trees.

    Trees are dealt in groups of ``MAX_NODES`` nodes at most (a larger tree is its own group), and every row meets every group;
    no nodes reach the driver.
    """
    sizes = sorted((r["tree"], r["n"]) for r in model.nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per tree
    if not sizes:
        return df.withColumn(score, F.lit(0.0))
    of, held = [], 0
    for tree, n in sizes:
        new = bool(of) and held + n > MAX_NODES
        of.append((tree, (of[-1][1] if of else 0) + new))
        held = n if new else held + n
    kept = [c for c in df.columns if c != score]
    tagged = materialize(df.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias(ROW)))
    share = F.aggregate(F.array_sort(F.collect_list(F.struct("group", "total"))), F.lit(0.0), lambda s, x: s + x["total"] / len(sizes))
    totals = _group_totals(model, tagged, columns, of).groupBy(ROW).agg(share.alias(score))
    return tagged.join(totals, ROW).select(*[F.col(f"`{c}`") for c in kept], score)


# ------------------------------------------------------------------ storage
def save(model: TreeModel, path: str) -> None:
    """The node table, the features' ranges and a one-row configuration."""
    spark = model.nodes.sparkSession
    model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(model.low, model.high, strict=True))],
                          "feature int, low double, high double").write.mode("overwrite").parquet(f"{path}/ranges")
    spark.createDataFrame([(json.dumps(asdict(model.config)), *map(float, model.weights))], "config string, w0 double, w1 double") \
        .write.mode("overwrite").json(f"{path}/trees")


def load(spark: SparkSession, path: str) -> TreeModel:
    r = spark.read.schema("config string, w0 double, w1 double").json(f"{path}/trees").first()
    ranges = sorted(spark.read.parquet(f"{path}/ranges").collect())  # a row per feature
    low, high = (np.array([x[c] for x in ranges]) for c in ("low", "high"))
    return TreeModel(spark.read.schema(NODES).parquet(f"{path}/nodes"), low, high, (r["w0"], r["w1"]), TreeConfig(**json.loads(r["config"])))
