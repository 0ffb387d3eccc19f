"""Queries that read a view many times work it out once."""

import pytest

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"


def tables_read(rows):
    return {path.rsplit("/", 1)[-1] for path in rows.inputFiles()} & {"lineitem.parquet", "orders.parquet"}


@pytest.mark.parametrize("name", ["lab_rows", "lab_row_counts", "lab_rules", "lab_pairs", "row_status", "category_totals"])
def test_views_are_laid_out_once(spark, name):
    assert not tables_read(registered.queries()[name](spark, SF))
