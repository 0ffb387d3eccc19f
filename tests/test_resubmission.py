"""Repeated bills where one number is used very often, and by shops of alike names."""

from datetime import date

from pyspark.sql import functions as F

from claimloom.operators import history


def test_a_number_used_often_is_not_met_in_pairs(spark):
    n = 30_000
    day = F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") / 100).cast("int"))
    scans = spark.range(n).select(F.col("id").alias("scan_id"), day.alias("created_on"), day.alias("bill_date"), F.lit(1).cast("decimal(18,2)").alias("claimed_amount"), F.lit("Shop").alias("pharmacy_name"), F.lit("B-1").alias("bill_no"))
    lines = scans.select("scan_id", F.lit("x").alias("drug_name"), F.lit(1).cast("decimal(18,2)").alias("line_total"))
    got = history.resubmissions(scans, lines)
    told = got.agg(F.count("*").alias("n"), F.sum((F.col("prior_scan_id") == 0).cast("int")).alias("first"), F.sum((F.col("others") == F.col("scan_id") - 1).cast("int")).alias("others"), F.sum("changed").alias("changed")).first()
    assert (told.n, told.first, told.others, told.changed) == (n - 1, n - 1, n - 1, 0)


def test_alike_shops_against_all_pairs(spark):
    shops, alike = ("a", "b", "c"), {("a", "a"), ("b", "b"), ("c", "c"), ("a", "b"), ("b", "a"), ("b", "c")}
    rows = [(k, date(2024, 1, 1 + k * 7 % 5) if k % 9 else None, None, 1, shops[k * 5 % 3] if k % 11 else None, f"B-{k % 4}" if k % 7 else " ") for k in range(60)]
    scans = spark.createDataFrame(rows, "scan_id long, created_on date, bill_date date, claimed_amount int, pharmacy_name string, bill_no string")
    lines = spark.createDataFrame([], "scan_id long, drug_name string, line_total int")
    order = lambda r: (r[1] is not None, r[1] or date.min, r[0])
    want = {}
    for a in rows:
        prior = sorted((b for b in rows if a[5].strip() and a[5] == b[5] and (a[4], b[4]) in alike and order(b) < order(a)), key=order)
        if prior:
            want[a[0]] = (prior[0][0], len(prior) - 1)
    got = history.resubmissions(scans, lines, pharmacies=spark.createDataFrame(sorted(alike), "name string, other string"))
    assert {r.scan_id: (r.prior_scan_id, r.others) for r in got.collect()} == want and want


def test_scans_are_not_dealt_out_for_every_alike_shop(spark):
    n, names = 20_000, [f"shop {k}" for k in range(40)]
    scans = spark.range(n).select(F.col("id").alias("scan_id"), F.lit(date(2024, 1, 1)).alias("created_on"), F.concat(F.lit("shop "), (F.col("id") % 40).cast("string")).alias("pharmacy"), (F.col("id") % 50).cast("string").alias("no"))
    alike = spark.createDataFrame([(a, b) for a in names for b in names], "name string, other string")
    found = history._earlier_of_alike(scans, alike)
    told = found.agg(F.count("*").alias("rows"), F.sum("n").alias("met"), F.sum((F.col("prior") != F.col("scan_id") % 50).cast("int")).alias("wrong")).first()
    assert (told.rows, told.met, told.wrong) == (n - 50, 50 * 400 * 399 // 2, 0)
    assert "Repartition" in found._jdf.queryExecution().optimizedPlan().toString() and "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
