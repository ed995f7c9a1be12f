"""Every query with SQL against DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import model_queries, queries  # noqa: F401  (both fill one registry)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    if name not in queries.ORACLE_SQL:
        assert got.count() > 0
        return
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.columns, got.collect()), rows_of(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert a == b


def test_whole_tables_take_part(spark, sf):
    """Every part with a child is a root; every customer's own code can match."""
    part, customer = queries.table(spark, sf, "part"), queries.table(spark, sf, "customer")
    roots = {r[0] for r in queries.QUERIES["bot_closure_all_parts"](spark, sf).select("root").distinct().collect()}
    assert roots == {r[0] // 2 for r in part.select("p_partkey").collect() if r[0] > 1}
    codes = {r[0] for r in queries.QUERIES["match_fuzzy_all_customers"](spark, sf).select("code").distinct().collect()}
    assert codes >= {str(r[0]) for r in customer.where("c_custkey % 3 = 0").select("c_custkey").collect()}


def test_lineitem_mapping_builds_objects_and_counts_subjects(spark, sf, tmp_path):
    lines = queries.table(spark, sf, "lineitem").limit(50)
    lines.union(lines.limit(1)).coalesce(1).write.parquet(f"{tmp_path}/a/lineitem.parquet")
    a = spark.read.parquet(f"{tmp_path}/a/lineitem.parquet")
    a.withColumn("l_quantity", (a.l_quantity + 1).cast(a.schema["l_quantity"].dataType)).write.parquet(f"{tmp_path}/b/lineitem.parquet")
    x, y = ({r["p"]: r for r in queries.rml_map_lineitem_whole(spark, f"{tmp_path}/{k}").collect()} for k in "ab")
    assert len(x) == 5 and all((r["n"], r["subjects"]) == (51, 50) for r in x.values())
    assert {p for p in x if x[p]["content"] != y[p]["content"]} == {queries.B + "quantity"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
