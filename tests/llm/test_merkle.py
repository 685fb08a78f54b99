"""The Merkle manifest against a plain version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from netweave.llm import merkle
from tests.llm.brute import lower
from tests.llm.tables import SCHEMA


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(top, for each node its path of (siblings before, siblings after))."""
    paths, group = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for j in range(len(run)):
                for i in group[at + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
            up.append(h("".join(run)))
            above.append([i for g in group[at : at + 16] for i in g])
        nodes, group = up, above
    return nodes[0], paths


def plain(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for r, path in zip(by[s], trees[s][1]):
            own = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                own = leaf((*r[:4], lower(r[4])))
            proof = ""
            for before, after in path + top:
                proof += "".join(before + after)
                own = h("".join([*before, own, *after]))
            out.append((r[0], leaf(r), trees[s][0], root, h(proof), own, own == root))
    return out


@pytest.mark.parametrize("seed, sources, most", [(1, ["hot", "a", "É", None, "z", "B"], 700), (2, ["one"], 17), (3, [f"s{i}" for i in range(40)], 90), (4, ["x"], 1)])
def test_manifest_is_that_of_a_plain_pass(spark, seed, sources, most):
    rng = random.Random(seed)
    n = rng.randint(most // 2 + 1, most)
    rows = [(rng.choice([i, i, i, None]), rng.choice([sources[0], rng.choice(sources)]), rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["Ab c", "lower", "", None, "É" * 9])) for i in range(n)]
    rows += rows[: n // 9]  # repeated rows
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], SCHEMA).selectExpr("*", "'x' AS leaf", "1 AS row", "'y' AS shown", "2 AS id")
    found = [tuple(r) for r in merkle.manifest(df, shown=merkle.tampered(df)).collect()]
    assert sorted(found, key=repr) == sorted(plain(rows), key=repr)


def test_one_key_and_one_row_in_all_partitions(spark):
    """Repeated rows of one source and id are spread, and their places follow one another."""
    base = spark.range(0, 3000, 1, 6).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    found = [tuple(r) for r in merkle.manifest(base, shown=merkle.tampered(base)).collect()]
    assert sorted(found) == sorted(plain([(7, "hot", "en", 4, "same")] * 3000))


def test_tampering_is_found_and_nothing_else(spark):
    rows = [(i, "src", "en", 5, "Upper" if i % 2 else "lower") for i in range(200)]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], SCHEMA)
    for r in merkle.manifest(df, shown=merkle.tampered(df)).collect():
        assert r.verified == (not (zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id % 2))
    assert all(r.verified for r in merkle.manifest(df).collect())


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
