"""Boosted trees over histograms, for many deep trees on rows that no one task holds.

Columns are binned once, by exact places among quantiles from a sketch; rows
that are equal then, label included, are one row with a weight, as no cut parts
them and all have one margin.  They are stored in the shared folder in blocks of
a byte per value, column by column.  A level of a tree is
one job: each task adds up gradients and hessians of its rows per open node,
column and bin, the sums of a node are merged in one task, which picks its best
cut by second-order gain, and the driver sees a few numbers per node; only sums
of at most ``DRIVER_BYTES`` are merged there.  Rows and columns are sampled per tree; a
row keeps its margin, and margins are written to the shared folder every ``CUT``
trees, which cuts lineage.  Of a row of weight n a tree draws a binomial number,
as if each of the n were drawn on its own.  Where the binned rows are no more than one task's
part (``TASK_BYTES``), there is nothing to merge, and the trees are grown where
the rows are, in one job.

A missing value (null or NaN) has a bin of its own and goes, at each cut, to the
side where it gains more.  Rows with a null label are left out of the fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.sources.shared import shared_folder

#: Trees after which margins are written out.
CUT = 50
#: Bytes of binned values that one task works on, at least and at most, about; both change the work, not the result.
TASK_BYTES, MOST_TASK_BYTES = 1 << 20, 64 << 20
#: Bytes of sums that a level sends to the driver at most, and that one task merges, about.
DRIVER_BYTES, MERGE_BYTES = 1 << 18, 16 << 20
#: Rows whose sums are added up together; small blocks would each pay for sums of all open nodes.
SUM_ROWS = 1 << 18
#: Nodes of a tree up to which each cut is compared with all rows, which then takes less than to follow the rows.
FEW_NODES = 32
#: Gains up to this count as none.
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    """``rows`` and ``columns`` are the shares sampled for a tree; ``least`` the least hessian of a child; ``ridge`` the penalty on leaf values."""

    trees: int = 500
    depth: int = 8
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 256
    least: float = 1.0
    ridge: float = 1.0
    gain: float = 0.0
    seed: int = 42


#: Settings of the window and of the row classifier.
WINDOW = Settings()
ROW = Settings(trees=300, depth=10, rows=0.9, columns=0.9)


@dataclass
class Tree:
    """Nodes in flat lists; ``feature`` is -1 at a leaf, a right child follows the left one."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, x in (("feature", -1), ("cut", 0), ("missing_left", False), ("left", 0), ("value", value)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(getattr(self, name)) for name in ("feature", "cut", "missing_left", "left", "value"))


@dataclass
class Boosted:
    """A fitted model: edges of the bins of each column, trees, and the margin that all rows start from."""

    columns: list[str]
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, ...]]
    base: float


def leaf_of(bins: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The node at which each row ends; quickest where ``bins`` is stored column by column."""
    feature, cut, missing_left, left, _ = tree
    inner = feature >= 0
    # A missing value is bin 0: where it goes right, bins less one are compared, so that it is the greatest byte.
    less = (inner & ~missing_left.astype(bool)).astype(np.uint8)
    most = np.where(inner, cut - less, 255).astype(np.uint8)
    if len(feature) <= FEW_NODES:
        ends: list = list(range(len(feature)))
        for i in np.flatnonzero(inner)[::-1]:  # children come after their parent
            low = bins[:, feature[i]] - less[i] <= most[i]
            ends[i] = np.where(low, *(np.asarray(ends[left[i] + k], np.int32) for k in (0, 1)))
        return np.broadcast_to(np.asarray(ends[0], np.int64), len(bins)) if not inner[0] else ends[0].astype(np.int64)
    column, after = np.where(inner, feature, 0), np.where(inner, left, np.arange(len(feature)))
    # Leaves lead to themselves.
    flat, (down, across) = bins.ravel("K"), (x // bins.itemsize for x in bins.strides)
    node, start = np.zeros(len(bins), np.int64), np.arange(len(bins)) * down
    while inner[node].any():
        low = flat.take(start + column.take(node) * across) - less.take(node) <= most.take(node)
        node = after.take(node) + ~low
    return node


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bytes: 0 for a missing value, else 1 + the number of edges below it."""
    out = np.empty(values.shape, np.uint8, order="F")
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(values[:, j]), 0, 1 + np.searchsorted(e, values[:, j], side="left"))
    return out


def best_cuts(sums: np.ndarray, n_edges: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Per node: gain, column, cut, whether missing values go left, and the sums (gradient, hessian) of the left child.

    ``sums`` is nodes x columns x bins x 2; a cut at bin b sends bins 1..b left.
    """
    whole = sums[:, 0].sum(1)[:, None, None, :]
    upto, missing = sums[:, :, 1:].cumsum(2), sums[:, :, :1]
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.ridge)
    real = np.arange(1, upto.shape[2] + 1)[None, None, :] <= n_edges[None, :, None]
    best = None
    for with_missing in (False, True):
        low = upto + missing if with_missing else upto
        high = whole - low
        gain = (score(low) + score(high) - score(whole)) / 2 - s.gain
        gain = np.where(real & (low[..., 1] >= s.least) & (high[..., 1] >= s.least), gain, -np.inf).reshape(len(sums), -1)
        at = gain.argmax(1)
        own = (gain[np.arange(len(sums)), at], at, np.full(len(sums), with_missing), low.reshape(len(sums), -1, 2)[np.arange(len(sums)), at])
        best = own if best is None else tuple(np.where((own[0] > best[0]).reshape(-1, *[1] * (y.ndim - 1)), x, y) for x, y in zip(own, best))
    gain, at, with_missing, low = best
    return gain, at // upto.shape[2], at % upto.shape[2] + 1, with_missing, low


def _drawn(weight: np.ndarray, share: float, key: list) -> np.ndarray:
    """How many of each row's equals a tree takes."""
    if share >= 1:
        return weight
    rng = np.random.default_rng(key)
    out, many = (rng.random(len(weight)) < share).astype(float), np.flatnonzero(weight > 1)
    out[many] = rng.binomial(weight[many].astype(np.int64), share)
    return out


def _level(blocks: Iterator[tuple], tree: tuple, slots: np.ndarray, columns: np.ndarray, share: float, key: tuple) -> Iterator[np.ndarray]:
    """The sums of a task's rows per open node, column and bin."""
    out = np.zeros((int(slots.max()) + 1, len(columns), 256, 2))
    held: list[tuple] = []

    def add() -> None:
        first, g, h = (np.concatenate([x[i] for x in held]) for i in range(3))
        for j in range(len(columns)):
            at = first + np.concatenate([x[3][j] for x in held])
            for k, w in ((0, g), (1, h)):
                out[:, j, :, k] += np.bincount(at, w, len(out) * 256).reshape(-1, 256)
        held.clear()

    for number, bins, y, margin, weight in blocks:
        slot, drawn = slots[leaf_of(bins, tree)], _drawn(weight, share, [*key, number])
        use = np.flatnonzero((slot >= 0) & (drawn > 0))
        p, drawn = 1 / (1 + np.exp(-margin[use])), drawn[use]
        held.append((slot[use] * 256, (p - y[use]) * drawn, np.maximum(p * (1 - p), 1e-16) * drawn, [bins[:, c].take(use) for c in columns]))
        if sum(len(x[0]) for x in held) >= SUM_ROWS:
            add()
    if held:
        add()
    yield out


def _best(sums: np.ndarray, n_edges: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """What ``best_cuts`` says of each node, and its sums (gradient, hessian)."""
    return *best_cuts(sums, n_edges, s), sums[:, 0].sum(1)


def _best_apart(parts: RDD, nodes: int, size: int, n_edges: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """The same from ``parts`` (one array of sums a task, of ``size`` bytes together), merged node by node on the executors."""
    by_node = parts.mapPartitionsWithIndex(lambda i, arrays: ((node, (i, own)) for sums in arrays for node, own in enumerate(sums)))

    def merged(groups: Iterator[tuple]) -> Iterator[tuple]:
        # In one order, so that a fit comes out the same again.
        sums = ((node, sum(x for _, x in sorted(own, key=lambda x: x[0]))) for node, own in groups)
        for some in batched(sums, 32):
            yield from zip((node for node, _ in some), zip(*_best(np.stack([x for _, x in some]), n_edges, s)))

    tasks = min(parts.getNumPartitions(), nodes, math.ceil(size / MERGE_BYTES))
    found = dict(by_node.groupByKey(tasks).mapPartitions(merged).collect())  # a few numbers per node
    return tuple(np.array(x) for x in zip(*(found[node] for node in range(nodes))))


def _moved(blocks: Iterator[tuple], tree: tuple) -> Iterator[tuple]:
    for number, bins, y, margin, weight in blocks:
        yield number, bins, y, margin + tree[4][leaf_of(bins, tree)], weight


def _grow(best: Callable[..., tuple[np.ndarray, ...]], n_edges: np.ndarray, s: Settings, number: int) -> tuple[np.ndarray, ...]:
    """One tree; ``best`` gives what ``_best`` says of a level (with the arguments of ``_level`` but for the blocks)."""
    rng = np.random.default_rng([s.seed, number])
    columns = np.sort(rng.choice(len(n_edges), max(1, round(s.columns * len(n_edges))), replace=False))
    tree = Tree()
    tree.add(0.0)
    open_ = [0]
    leaf = lambda g, h: -s.rate * g / (h + s.ridge)
    for depth in range(s.depth):
        if not open_:
            break
        slots = np.full(len(tree.feature), -1)
        slots[open_] = np.arange(len(open_))
        gain, column, cut, missing_left, low, whole = best(tree.arrays(), slots, columns, s.rows, (s.seed, number))
        after = []
        if depth == 0:
            tree.value[0] = leaf(*whole[0])
        for k, node in enumerate(open_):
            if gain[k] > LEAST_GAIN:
                children = [(tree.add(leaf(*x)), x[1]) for x in (low[k], whole[k] - low[k])]
                tree.feature[node], tree.cut[node], tree.missing_left[node], tree.left[node] = int(columns[column[k]]), int(cut[k]), bool(missing_left[k]), children[0][0]
                after += [at for at, weight in children if weight >= 2 * s.least]
        open_ = after
    return tree.arrays()


def _grow_here(blocks: Iterator[tuple], n_edges: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, ...]]:
    """All trees, by the one task that has all rows."""
    held = list(blocks)
    for number in range(s.trees):
        tree = _grow(lambda *args: _best(next(_level(iter(held), *args)), n_edges[args[2]], s), n_edges, s, number)
        held = list(_moved(iter(held), tree))
        yield tree


def _grow_apart(blocks: RDD, n_edges: np.ndarray, s: Settings, folder: str) -> Iterator[tuple[np.ndarray, ...]]:
    """All trees, a job for each level."""
    tasks, held = blocks.getNumPartitions(), [blocks.persist(StorageLevel.MEMORY_AND_DISK)]

    def best(tree: tuple, slots: np.ndarray, columns: np.ndarray, *args) -> tuple[np.ndarray, ...]:
        parts, nodes = held[-1].mapPartitions(lambda b: _level(b, tree, slots, columns, *args)), int(slots.max()) + 1
        size = tasks * nodes * len(columns) * 256 * 2 * 8
        if size <= DRIVER_BYTES:
            return _best(parts.reduce(np.add), n_edges[columns], s)
        return _best_apart(parts, nodes, size, n_edges[columns], s)

    try:
        for number in range(s.trees):
            tree = _grow(best, n_edges, s, number)
            yield tree
            moved = held[-1].mapPartitions(lambda b, t=tree: _moved(b, t))
            if number % CUT == CUT - 1:
                moved.saveAsPickleFile(f"{folder}/margins-{number}", batchSize=1)
                moved = blocks.context.pickleFile(f"{folder}/margins-{number}").coalesce(tasks)
            held.append(moved.persist(StorageLevel.MEMORY_AND_DISK))
            if len(held) > 2:  # what the one before the last was made from
                held.pop(0).unpersist()
    finally:
        for rdd in held:
            rdd.unpersist()


def edges_of(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 2 edges per column, from one pass of bounded sketches."""
    if bins > 256:
        raise ValueError("at most 256 bins: a value is a byte")
    at = [i / (bins - 1) for i in range(1, bins - 1)]
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns]
    found = df.agg(*(F.percentile_approx(x, at, 20 * bins).alias(f"e{i}") for i, x in enumerate(known)), *(F.max(x).alias(f"m{i}") for i, x in enumerate(known))).first()
    # A cut above the greatest value would part nothing.
    return [np.unique([e for e in found[f"e{i}"] or [] if e < found[f"m{i}"]]) for i in range(len(columns))]


def fit(df: DataFrame, columns: list[str], label: str = "label", settings: Settings = WINDOW, **changed) -> Boosted:
    """Boosted trees for P(label = 1); ``changed`` replaces single settings."""
    s = replace(settings, **changed)
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    folder = shared_folder(spark, "boosting")
    known = df.where(F.col(label).isNotNull())
    edges = edges_of(known, columns, s.bins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(j).to_numpy(zero_copy_only=False) for j in range(len(columns))]).astype(float)
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(columns)
            row = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(binned(x, edges).tobytes())])
            yield pa.RecordBatch.from_arrays([row, b.column(len(columns))], names=["row", "y"])

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            y, weight = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
            values = [len(y)], [weight.sum()], [y @ weight], [rows.tobytes("F")], [y.astype(np.float32).tobytes()], [weight.tobytes()]
            types = pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, types)], names=["n", "rows", "ones", "bins", "y", "weight"])

    ready = known.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)), (F.col(label) != 0).cast("int").alias("y"))
    weighted = ready.mapInArrow(cut, "row binary, y int").groupBy("row", "y").agg(F.count("*").alias("weight")).sortWithinPartitions("row", "y")
    found = weighted.mapInArrow(block_of, "n long, rows double, ones double, bins binary, y binary, weight binary")
    found.withColumn("block", F.monotonically_increasing_id()).write.parquet(f"{folder}/binned")
    stored = spark.read.parquet(f"{folder}/binned")
    n, rows, ones = stored.agg(F.sum("n"), F.sum("rows"), F.sum("ones")).first()
    if not n:
        return Boosted(columns, edges, [], 0.0)
    rate = min(max(ones / rows, 1e-6), 1 - 1e-6)
    base = math.log(rate / (1 - rate))

    def block(r) -> tuple:
        bins = np.frombuffer(r["bins"], np.uint8).reshape(-1, r["n"]).T
        return r["block"], bins, np.frombuffer(r["y"], np.float32), np.full(r["n"], base), np.frombuffer(r["weight"])

    size, n_edges = n * len(columns), np.array([len(e) for e in edges])
    tasks = min(math.ceil(size / TASK_BYTES), max(2 * sc.defaultParallelism, math.ceil(size / MOST_TASK_BYTES)))
    blocks = stored.repartition(max(1, tasks), "block").sortWithinPartitions("block").rdd.map(block)
    if tasks <= 1:
        trees = blocks.coalesce(1).mapPartitions(lambda b: _grow_here(b, n_edges, s)).collect()
    else:
        trees = list(_grow_apart(blocks, n_edges, s, folder))
    return Boosted(list(columns), edges, trees, base)


def margins(model: Boosted, values: np.ndarray) -> np.ndarray:
    bins, out = binned(values, model.edges), np.full(len(values), model.base)
    for tree in model.trees:
        out += tree[4][leaf_of(bins, tree)]
    return out


def predict(model: Boosted, df: DataFrame) -> DataFrame:
    """Add ``score``, the probability of label 1, and ``predicted``; the rows stay where they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # trees x nodes, whatever the number of rows
    kept = [c for c in df.columns if c not in ("score", "predicted")]
    inner = [f"__x{i}" for i in range(len(model.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(len(kept) + j).to_numpy(zero_copy_only=False) for j in range(len(inner))]).astype(float)
            p = 1 / (1 + np.exp(-margins(shared.value, x)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(p), pa.array((p > 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = df.select(*kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return df.select(*kept, *(F.col(c).cast("double").alias(x) for c, x in zip(model.columns, inner))).mapInArrow(run, schema)


_NODE = "tree int, node int, feature int, cut int, missing_left boolean, left int, value double"


def save(spark: SparkSession, model: Boosted, path: str) -> None:
    """Store a model as two tables, of its columns and of its nodes."""
    columns = [(i, c, [float(x) for x in e], model.base) for i, (c, e) in enumerate(zip(model.columns, model.edges))]
    nodes = [(t, i, *(x.item() for x in node)) for t, tree in enumerate(model.trees) for i, node in enumerate(zip(*tree))]
    spark.createDataFrame(columns, "at int, name string, edges array<double>, base double").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    spark.createDataFrame(nodes, _NODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")


def load(spark: SparkSession, path: str) -> Boosted:
    """A model that ``save`` stored."""
    columns = spark.read.parquet(f"{path}/columns").orderBy("at").collect()
    trees: dict[int, Tree] = {}
    for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():  # nodes of one model
        tree = trees.setdefault(r["tree"], Tree())
        at = tree.add(r["value"])
        tree.feature[at], tree.cut[at], tree.missing_left[at], tree.left[at] = r["feature"], r["cut"], r["missing_left"], r["left"]
    return Boosted([r["name"] for r in columns], [np.array(r["edges"]) for r in columns], [t.arrays() for _, t in sorted(trees.items())], columns[0]["base"])
