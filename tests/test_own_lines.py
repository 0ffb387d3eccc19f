"""Review queries judge lines in one pass; scans for which that can't be done go through the joins, with the same results as the SQL."""

import shutil
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"
NAMES = ("report_rows", "row_decisions", "row_filters", "headline_findings", "field_marks", "finding_groups", "noise_hidden", "rebucketed_totals")
TABLES = ("lineitem", "part", "orders", "customer", "supplier", "events")


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """A scan of 120 lines, one without lines, lines and orders without a key, a part listed twice and an order listed twice."""
    folder = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        shutil.copy(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    lines, part, orders = read("lineitem"), read("part"), read("orders")
    a, b, c = (r[0] for r in orders.orderBy("o_orderkey").select("o_orderkey").limit(3).collect())
    many = lines.orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(120).withColumn("l_orderkey", F.lit(a).cast("bigint"))
    bare = lines.orderBy("l_partkey", "l_orderkey").limit(5).withColumn("l_orderkey", F.lit(None).cast("bigint"))
    out = {
        "lineitem": lines.where(~F.col("l_orderkey").isin(a, b)).union(many).union(bare),
        "part": part.union(part.orderBy("p_partkey").limit(1).withColumn("p_name", F.lit("other"))),
        "orders": orders.union(orders.where(F.col("o_orderkey") == c)).union(orders.limit(1).withColumn("o_orderkey", F.lit(None).cast("bigint"))),
    }
    for t, rows in out.items():
        rows.toPandas().to_parquet(folder / f"{t}.parquet", coerce_timestamps="us")
    return str(folder)


@pytest.mark.parametrize("name", ["report_rows", "finding_groups", "field_marks", "row_filters"])
def test_lines_are_read_once(spark, name):
    """Beside the count of each scan's lines, which is worked out before, the plan reads them once and joins no line with another."""
    plan = registered.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and plan.count("row_number() windowspecdefinition(l_orderkey") == 1


@pytest.mark.parametrize("name", NAMES)
def test_odd_scans(spark, odd_tables, name):
    rows = registered.queries()[name](spark, odd_tables)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd_tables}/{t}.parquet'")
    columns = ", ".join(f'"{c}"' for c in rows.columns)
    want = Counter(db.execute(f"SELECT {columns} FROM ({registered.oracle_sql()[name]})").fetchall())
    assert Counter(map(tuple, rows.collect())) == want
