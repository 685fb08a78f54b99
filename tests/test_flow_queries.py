"""Every registered flow query against DuckDB at the smallest size."""

import duckdb
import pandas as pd
import pytest

from netweave.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    show = lambda x: "~" if pd.isna(x) else f"{x:.5g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_model_queries_score_every_row(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert len(found)
    if "score" in found:
        assert found.score.between(0, 1).all()
    if "distance" in found:
        assert (found.distance >= 0).all()
