"""A date's text is read once, whatever the number of orders it is resolved by."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from claimloom.functions import dates
from claimloom.plans.words import date_resolve


def test_text_is_read_once(spark):
    plan = date_resolve(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    assert "gettimestamp" not in plan.lower() and "to_date" not in plan.lower()  # a failed parse costs an exception a row


def test_calendar(spark):
    days = [date(1999, 12, 25) + timedelta(k) for k in range(800)] + [date(2100, 2, 28)]
    rows = [(f"{d.year}-{d.month}-{d.day}", d) for d in days] + [(x, None) for x in ("2001-2-29", "2100-2-29", "2000-4-31", "2000-13-1", "2000-0-1", "2000-1-0", "2000-1-32")]
    read = spark.createDataFrame(rows, "raw string, want date").select("want", dates.resolve_date(F.col("raw")).alias("r")).select("want", "r.*").collect()
    assert len(read) == len(rows) and all(r.value == r.want for r in read)
