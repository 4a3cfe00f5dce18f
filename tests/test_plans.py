"""Each registered query with SQL gives the rows that DuckDB gives for the SQL, over the smallest tables."""

import duckdb
import pytest

from pixelweave.plans import queries, sql

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("lineitem", "events", "documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted(map(repr, (tuple(round(float(v), 7) if isinstance(v, float) or hasattr(v, "dtype") else v for v in map(lambda v: v.item() if hasattr(v, "item") else v, r)) for r in df.itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_against_duckdb(spark, db, name):
    ours, theirs = queries.QUERIES[name](spark, DATA).toPandas(), db.execute(sql.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b) and len(a) > 0
    import re

    loose = lambda xs: [re.sub(r"(\d)\.0\b", r"\1", x) for x in xs]
    assert loose(a) == loose(b)


#: Tested in test_order_dependent and test_filters_in_order.
NO_SQL = {"grow_blobs", "forest_score", "connect_lines", "filter_pipeline", "tree_report", "disconnected_filter", "size_clouds", "isolated_in_order", "dim_isolated_in_order"}


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(queries.QUERIES) - set(sql.ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted({*NO_SQL, "clouds", "alpha_plane", "best_line", "feature_vector"}))
def test_a_fresh_plan_counts_and_gives_few_columns(spark, name):
    """Pruned to no column or one, a query gives as many rows as when all are read; each action has a plan of its own."""
    fresh = lambda: queries.QUERIES[name](spark, DATA)
    n = len(fresh().collect())
    assert fresh().count() == n == len(fresh().select(fresh().columns[0]).collect())


def test_the_entry_counts(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == len(__spark_entry__.entry(spark).collect()) > 0
