"""Operators that SQL expresses, against DuckDB over the same tables and over odd rows."""

import duckdb
import pandas as pd
import pytest

from claimloom.llm import licences, mixing, quality, registry, sharding, substring
from tests.llm.helpers import SCHEMA, odd_documents

SF = "/root/testdata/sf0.001"
OVER = {"op3_quality": quality.report, "op4_substring": lambda d: substring.remove_repeats(d).drop("kept"), "op6_mixing": lambda d: mixing.mix(d).select("row.doc_id", "row.source", "row.text", "copies", "copy", "mix_key"), "op7_jump_sharding": sharding.shard_documents, "op12_licences": licences.report}


def told(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted((tuple(None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in row) for row in frame.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert told(registry.queries()[name](spark, SF).toPandas()) == told(con.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(OVER))
def test_odd_rows_against_sql(spark, name, tmp_path):
    lines = "\n".join(["Shared LINE 7", "own words that nobody else has in a line of this length", "Shared LINE 7", "c < d | e\t# 10%"])
    rows = [(100 + k, f"shared\xa0line {k % 10}\nnext {'abcdefghijklmnopqrstuvwxyz'[k % 26] * (k + 1)} one two three four five six seven eight\r", "en", None if k % 2 else "h", 0) for k in range(60)]
    docs = odd_documents(spark, [*rows, (300, lines, "en", "h", 0), (301, "one two three four five " * 9, "en", "h", 0)]).select(*(c.split()[0] for c in SCHEMA.split(", ")))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    got = told(OVER[name](docs).toPandas())
    assert got == told(con.sql(registry.oracle_sql()[name]).df()) and (name != "op3_quality" or any(r[got[0].index("n_left")] < r[got[0].index("n_words")] for r in got[1]))
