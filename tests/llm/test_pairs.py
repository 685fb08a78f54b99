"""Exact dedup, n-gram join and line dedup against plain versions."""

import hashlib

import pytest

from netweave.llm import common, exact_dedup, line_dedup, ngram_join
from tests.llm import brute
from tests.llm.tables import corpus, documents


def test_cut_points_follow_content():
    data = hashlib.sha256(b"x").digest() * 4000
    ends = exact_dedup.cut_points(data)
    assert ends[-1] == len(data) and all(b - a <= exact_dedup.MAX_CHUNK for a, b in zip([0, *ends], ends))
    assert exact_dedup.cut_points(b"") == [] and exact_dedup.cut_points(b"abc") == [3]


def test_exact_groups(spark):
    rows = corpus()
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    found = {r.doc_id: r for r in exact_dedup.exact_groups(documents(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        group = by[t or ""]
        r = found[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), i == max(group))
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_groups_null_and_repeated_ids(spark):
    docs = documents(spark, [(None, "a b"), (7, "a b"), (7, "a b"), (9, "c"), (None, None)])
    found = exact_dedup.exact_groups(docs).collect()
    assert len(found) == 5 and sum(r.kept for r in found) == 3
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(7, "a b"), (9, "c")]


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_link_components(spark, k, percent):
    rows = corpus()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(documents(spark, rows), k=k, percent=percent).collect()}
    assert found == brute.components(rows, k, percent)


def test_lower_similarity_and_frequent_shingles(spark, monkeypatch):
    """At 70 percent, with pairs of frequent shingles for all: no link is lost; below 50 is refused."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    monkeypatch.setattr(ngram_join, "LOADS", 0)
    rows = corpus(seed=6, size=90)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(documents(spark, rows), k=4, percent=70).collect()}
    assert found == brute.components(rows, 4, 70)
    with pytest.raises(ValueError):
        ngram_join.link_components(documents(spark, rows), percent=40)


def test_signatures_of_linked_sets_meet():
    """Any two sets at the threshold share a signature, at every percent and size."""
    import random

    import numpy as np

    rng = np.random.default_rng(2)
    levels = np.full(1 << ngram_join.SKETCH_BITS, 9, np.uint8)
    for percent in (50, 60, 70, 80, 85, 95):
        for n in (20, 60, 200, 900, 1500):
            shared = int(np.ceil(n * percent / 100))  # the smaller set lies inside the larger one
            for _ in range(10):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
                b = np.sort(np.array(random.Random(int(a[0])).sample(a.tolist(), shared), np.uint64))
                for cut in (0, 200):  # all frequent; all rare
                    got = [np.concatenate(ngram_join.signatures(x, levels, cut, percent)) for x in (a, b)]
                    assert len(np.intersect1d(*got)), (percent, n, cut)


def test_sketches_never_tell_more_than_the_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 5, 43, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n // 3 + 1, dtype=np.int64).astype(np.uint64)]))
        x, y = ngram_join.parity(a), ngram_join.parity(b)
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_sweep_of_one_signature_over_many_partitions(spark):
    """All rows of a hot signature keep one leader wherever partitions are cut."""
    from netweave.llm.common import Scratch

    rows = [(7, n, 10) for n in range(50)] * 2 + [(3, 1, 10), (9, 4, 10), (9, 5, 10), (11, 6, 10)]
    sigs = spark.createDataFrame(rows, "sig long, node long, n int").repartition(4)
    got = sorted((r.sig, r.lead, r.node) for r in ngram_join._members(sigs, Scratch(spark, "sweep")).collect())
    assert got == sorted([(7, 0, n) for n in range(50)] + [(9, 4, 4), (9, 4, 5)])


def test_a_repeated_id_links_its_texts(spark):
    import random

    rng = random.Random(1)
    one, two, three = (" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(80)) for _ in range(3))
    rows = [(5, one), (5, two), (7, two + " x"), (4, one + " y"), (9, three), (None, one), (8, None), (5, None)]
    found = {(r.doc_id, r.component_id) for r in ngram_join.link_components(documents(spark, rows), k=4, percent=85).collect()}
    assert {(5, 4), (7, 4), (4, 4), (9, 9), (None, None), (8, 8)} <= found


@pytest.mark.parametrize("first", [64, 1])
def test_near_copies_of_one_base(spark, monkeypatch, first):
    """Many copies whose similarity to each other lies around the threshold; with one signature carried, pairs are made more than once."""
    monkeypatch.setattr(ngram_join, "FIRST", first)
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in rng.sample(range(150), rng.choice([0, 1, 2, 3, 3, 4])):
            words[j] = f"x{i}_{j}"
        rows.append((i + 1, " ".join(words)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(documents(spark, rows), k=4, percent=85).collect()}
    assert found == brute.components(rows, 4, 85)


def test_drop_near_copies_keeps_columns(spark):
    rows = corpus(size=40)
    docs = documents(spark, rows)
    kept = ngram_join.drop_near_copies(docs, k=5, percent=80)
    want = {i for i, (_, c) in brute.components(rows, 5, 80).items() if i == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("run", [exact_dedup.exact_groups, ngram_join.link_components, line_dedup.dedup_lines, exact_dedup.drop_copies, ngram_join.drop_near_copies])
def test_empty_tables(spark, run):
    assert run(documents(spark, [])).count() == 0


def test_dedup_lines(spark):
    rows = corpus()
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert found == brute.kept_lines(rows)


def test_dedup_lines_min_docs(spark):
    rows = [(i, f"a line that is shared\nown line number {i}") for i in range(4)]
    docs = documents(spark, rows)
    three = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=3).collect()}
    five = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=5).collect()}
    assert three == {0: 0, 1: 1, 2: 1, 3: 1} and set(five.values()) == {0}


def test_native_plans_run_no_python(spark, sf_dir):
    from netweave.llm.queries import QUERIES

    for name in ("op1_url_filters", "op6_line_dedup"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("heavy", [3])
def test_frequent_shingles_found_on_the_way(spark, monkeypatch, heavy):
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    rows = corpus(seed=9, size=160)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(documents(spark, rows), k=4, percent=85).collect()}
    assert found == brute.components(rows, 4, 85)


def test_columns_with_dots_in_their_names(spark):
    rows = [(1, "same text"), (1, "same text"), (2, "same text"), (3, None), (3, None), (4, "other words here that are many enough")]
    docs = documents(spark, rows).selectExpr("*", "doc_id AS `a.b`", "named_struct('c', 1) AS `a`")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    near = ngram_join.drop_near_copies(docs, k=2, percent=80)
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == {1, 3, 4}


@pytest.mark.parametrize("rows, size", [(1_000_000, 64 << 20), (3, 1 << 30), (1_000_000, 10)])
def test_ids_are_broadcast_only_while_rows_and_bytes_are_few(spark, monkeypatch, rows, size):
    monkeypatch.setattr(common, "SMALL_ROWS", rows)
    monkeypatch.setattr(common, "SMALL_BYTES", size)
    docs, ids = documents(spark, [(i, f"t{i}") for i in range(30)]), spark.createDataFrame([(i, "x" * i) for i in range(0, 30, 3)], "i long, s string")
    assert common._is_small(ids) == (rows > 3 and size > 10)
    for without in (False, True):
        found = common.having_ids(docs, ids.select("i"), "doc_id", without=without)
        assert sorted(r.doc_id for r in found.collect()) == [i for i in range(30) if (i % 3 == 0) != without]
