"""Each registered feature query against its SQL."""

import decimal
import os

import duckdb
import pytest

from chronofeat.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: float(f"{float(v):.9g}") if isinstance(v, float | decimal.Decimal) else v
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    expected = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert plain(df.collect(), df.columns) == plain(expected.fetchall(), expected.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_road_matches(spark):
    found = registry.queries()["d14_match_roads"](spark, SF).collect()
    assert {r.change for r in found} <= {"same", "widened", "rerouted", "replaced", "removed", "new"}
    assert sum(r.side == "old" for r in found) == spark.read.parquet(f"{SF}/part.parquet").where("p_partkey % 4 = 3").count()
