"""Boosted trees against a plain version that looks at every row for every cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.operators import boosting

NAMES = ["a", "b", "c"]
SCHEMA = "i long, a double, b double, c double, label int"


def rows(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n).astype(float), rng.normal(size=n) * 100])
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) * 0.4 > 1.5).astype(int)
    x[rng.random((n, 3)) < 0.1] = np.nan
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, *(None if np.isnan(v) and i % 2 else float(v) for v in r), None if t is None else int(t)) for i, (r, t) in enumerate(zip(x, y))], SCHEMA)


def plain_value(x, g, h, row, edges, s, depth=0):
    """The value that a tree grown greedily on all rows gives to one row of it, and the cuts on its way."""
    G, H = g.sum(), h.sum()
    score = lambda a, b: a * a / (b + s.ridge)
    best = None
    if depth < s.depth and (depth == 0 or H >= 2 * s.least):
        for missing_left in (False, True):
            for c in range(x.shape[1]):
                for e in edges[c]:
                    left = np.where(np.isnan(x[:, c]), missing_left, x[:, c] <= e)
                    gl, hl = g[left].sum(), h[left].sum()
                    if hl < s.least or H - hl < s.least:
                        continue
                    gain = (score(gl, hl) + score(G - gl, H - hl) - score(G, H)) / 2
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, c, e, missing_left, left)
    if best is None or best[0] <= boosting.LEAST_GAIN:
        return -s.rate * G / (H + s.ridge)
    _, c, e, missing_left, left = best
    go = missing_left if np.isnan(row[c]) else row[c] <= e
    side = left if go else ~left
    return plain_value(x[side], g[side], h[side], row, edges, s, depth + 1)


def test_one_tree_is_the_greedy_one(spark):
    x, y = rows()
    s = boosting.Settings(trees=1, depth=3, rows=1.0, columns=1.0, bins=12)
    model = boosting.fit(frame(spark, x, y).repartition(5), NAMES, settings=s)
    assert all(0 < len(e) <= 10 for e in model.edges)
    p = 1 / (1 + np.exp(-model.base))
    g, h = p - y, np.full(len(y), p * (1 - p))
    got = boosting.margins(model, x) - model.base
    for i in range(0, len(x), 7):
        assert got[i] == pytest.approx(plain_value(x, g, h, x[i], model.edges, s), abs=1e-9)


def test_trees_in_sequence_equal_a_plain_boosting(spark):
    """Rows and columns all taken: margins after each tree follow from the gradients of the one before."""
    x, y = rows(200, 5)
    s = boosting.Settings(trees=4, depth=2, rows=1.0, columns=1.0, bins=8, rate=0.5)
    model = boosting.fit(frame(spark, x, y).repartition(3), NAMES, settings=s)
    margin = np.full(len(y), model.base)
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + [plain_value(x, p - y, p * (1 - p), r, model.edges, s) for r in x]
    assert np.allclose(boosting.margins(model, x), margin, atol=1e-9)


def test_many_tasks_and_cut_lineage(spark, monkeypatch):
    x, y = rows(900, 6)
    df = frame(spark, x, y)
    s = boosting.Settings(trees=7, depth=3, rows=0.7, columns=0.7, bins=32)
    one = boosting.margins(boosting.fit(df.repartition(24), NAMES, settings=s), x)
    monkeypatch.setattr(boosting, "TASK_BYTES", 100)
    monkeypatch.setattr(boosting, "CUT", 2)
    many = boosting.margins(boosting.fit(df.repartition(24), NAMES, settings=s), x)
    assert np.allclose(one, many, atol=1e-9)


def test_sums_stay_on_the_executors(spark, monkeypatch):
    """What the driver collects of a level is a few numbers per node, and the trees are those of one task."""
    import pickle

    from pyspark import RDD

    x, y = rows(900, 8)
    df, s = frame(spark, x, y).repartition(24), boosting.Settings(trees=3, depth=4, rows=1.0, columns=1.0, bins=32)
    one = boosting.fit(df, NAMES, settings=s)
    monkeypatch.setattr(boosting, "TASK_BYTES", 300)
    monkeypatch.setattr(boosting, "DRIVER_BYTES", 0, raising=False)
    sizes, collect = [], RDD.collect

    def counted(rdd):
        found = collect(rdd)
        sizes.append(len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(RDD, "collect", counted)
    many = boosting.fit(df, NAMES, settings=s)
    assert 3 * 4 <= len(sizes) and max(sizes) < 20_000  # sums of one node and task: 12,288 bytes
    assert np.allclose(boosting.margins(one, x), boosting.margins(many, x), atol=1e-9)
    again = boosting.fit(df, NAMES, settings=s)
    assert np.allclose(boosting.margins(again, x), boosting.margins(many, x), atol=1e-9)


def test_model_is_saved_and_scores_rows_where_they_are(spark, tmp_path):
    x, y = rows()
    df = frame(spark, x, y).withColumn("score", F.lit("old"))
    model = boosting.fit(df, NAMES, trees=20, depth=4)
    boosting.save(spark, model, str(tmp_path / "m"))
    again = boosting.load(spark, str(tmp_path / "m"))
    assert np.array_equal(boosting.margins(model, x), boosting.margins(again, x))
    found = boosting.predict(again, df).orderBy("i").collect()
    want = 1 / (1 + np.exp(-boosting.margins(model, x)))
    assert np.allclose([r.score for r in found], want) and np.mean([r.predicted == t for r, t in zip(found, y)]) > 0.85


def test_awkward_tables(spark):
    empty = boosting.fit(frame(spark, np.zeros((0, 3)), []), NAMES, trees=3)
    assert empty.trees == [] and [r.score for r in boosting.predict(empty, frame(spark, np.zeros((2, 3)), [0, 1])).collect()] == [0.5, 0.5]
    flat = boosting.fit(frame(spark, np.zeros((20, 3)), [0, 1] * 10), NAMES, trees=3)
    assert len({r.score for r in boosting.predict(flat, frame(spark, np.zeros((2, 3)), [0, 1])).collect()}) == 1 and all(len(t[0]) == 1 for t in flat.trees)
    nothing = np.full((30, 3), np.nan)
    assert boosting.predict(boosting.fit(frame(spark, nothing, [0, 1, None] * 10), NAMES, trees=2), frame(spark, nothing, [0] * 30)).count() == 30
    with pytest.raises(ValueError, match="256"):
        boosting.fit(frame(spark, nothing, [0, 1] * 15), NAMES, bins=300)


def test_equal_rows_are_one_row_with_a_weight(spark, monkeypatch):
    """600 rows 40 times each are no more work than 600, and give the trees of the plain version."""
    x, y = rows(600, 9)
    s = boosting.Settings(trees=1, depth=3, rows=1.0, columns=1.0, bins=12)
    df = frame(spark, x, y).crossJoin(spark.range(40).select(F.lit(1).alias("copy"))).repartition(5)
    monkeypatch.setattr(boosting, "TASK_BYTES", x.size)
    with monkeypatch.context() as m:
        m.setattr(boosting, "_grow_apart", lambda *_: pytest.fail("rows were not put together"))
        model = boosting.fit(df, NAMES, settings=s)
        drawn = boosting.fit(df, NAMES, settings=s, rows=0.5, depth=1)
    many, ys = np.repeat(x, 40, axis=0), np.repeat(y, 40)
    p = 1 / (1 + np.exp(-model.base))
    assert p == pytest.approx(y.mean())
    got, g, h = boosting.margins(model, x) - model.base, p - ys, np.full(len(ys), p * (1 - p))
    for i in range(0, len(x), 97):
        assert got[i] == pytest.approx(plain_value(many, g, h, x[i], model.edges, s), abs=1e-9)
    # Half of 24,000 rows: the hessian of the root is that of the rows drawn, not of half of the 600.
    assert len(drawn.trees[0][0]) == 3
    taken = boosting._drawn(np.full(600, 40.0), 0.5, [1, 2])
    assert abs(taken.sum() - 12_000) < 400 and 10 < len(np.unique(taken)) < 41
    monkeypatch.setattr(boosting, "TASK_BYTES", 100)
    assert np.allclose(boosting.margins(boosting.fit(df, NAMES, settings=s), x), boosting.margins(model, x), atol=1e-9)


@pytest.mark.parametrize("size", [1, 3, 31, 33, 301])
def test_rows_end_at_the_leaf_that_the_cuts_lead_to(size):
    rng, tree, open_ = np.random.default_rng(size), boosting.Tree(), [0]
    tree.add(0.0)
    while len(tree.feature) < size:
        node, left = open_.pop(0), tree.add(0.0)
        open_ += [left, tree.add(0.0)]
        tree.feature[node], tree.cut[node], tree.missing_left[node], tree.left[node] = int(rng.integers(4)), int(rng.integers(1, 255)), bool(rng.integers(2)), left
    bins = rng.integers(0, 256, (500, 4)).astype(np.uint8)
    bins[rng.random(bins.shape) < 0.2] = 0
    want = []
    for row in bins:
        at = 0
        while tree.feature[at] >= 0:
            b = row[tree.feature[at]]
            at = tree.left[at] + (not (tree.missing_left[at] if b == 0 else b <= tree.cut[at]))
        want.append(at)
    for stored in (bins, np.asfortranarray(bins)):
        assert boosting.leaf_of(stored, tree.arrays()).tolist() == want
    assert len(boosting.leaf_of(bins[:0], tree.arrays())) == 0
