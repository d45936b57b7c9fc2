"""Every query against its SQL on the smallest tables, as the driver compares them: same columns, same rows."""

import math
import os

import duckdb
import pytest

from terracell.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, db, name):
    d = QUERIES[name](spark, DATA)
    cursor = db.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(d.columns) == sorted(columns)
    assert normal(d.collect(), d.columns) == normal(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_scores_halfway_between_thousandths_are_rounded_as_in_the_sql(spark, tmp_path):
    """Lengths of which some lie halfway: 10,110 / 20,000 * 1,000 is a little under 505.5 in doubles."""
    spark.range(0, 20200, 10).selectExpr("id AS doc_id", "CAST(id AS INT) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, 20200, 10).selectExpr("id AS doc_id", "CAST(id DIV 10 % 2 AS INT) AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    d, cursor = QUERIES["roc_points"](spark, str(tmp_path)), con.execute(SQL["roc_points"])
    assert normal(d.collect(), d.columns) == normal(cursor.fetchall(), [c[0] for c in cursor.description])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
