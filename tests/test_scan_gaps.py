import random

from claimloom.operators import lab, review


def test_gaps_by_counts_equal_those_of_the_findings(spark):
    rng = random.Random(6)
    tests = "scan_id long, ordinal int, item_id string, test_name string, raw_text string, quantity double"
    side = lambda keep, names: spark.createDataFrame([(s, k, f"t-{k}" if rng.random() < 0.9 else "t-0", rng.choice(names), rng.choice(["CBC", "", None, "zz"]), rng.choice([None, 1.0, 2.0])) for s in range(120) if rng.random() < keep for k in range(rng.randrange(1, 4))], tests)
    ordered, billed = (lab.resolve_names(side(keep, names), fuzzy=False) for keep, names in ((0.7, ["LFT", "TSH", "xq", None, "Lipid Profile"]), (0.5, ["TSH", "", "SGPT (ALT)", "qq", None])))
    scans = [(s, rng.choice([True, False, None]), rng.choice([True, False, None]), rng.random() < 0.8) for s in range(125)]
    scans = spark.createDataFrame([*scans, *scans[:20], (None, True, True, True)], "scan_id long, investigations boolean, lab_bill boolean, has_items boolean")  # some are listed twice
    want = review.document_gaps(lab.lab_findings(ordered, billed, scans, lab.panel_table(spark)))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(lab.scan_gaps(ordered, billed, scans)) == rows(want) and want.select("gap").distinct().count() == 3


def test_few_names_go_to_the_tests(spark):
    tests = spark.range(1000).selectExpr("id AS scan_id", "1 AS ordinal", "'t' AS item_id", "CASE WHEN id % 2 = 0 THEN 'LFT' ELSE 'TSH' END AS test_name", "'' AS raw_text", "1.0D AS quantity")
    resolved = lab.resolve_names(tests, fuzzy=False)
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and resolved.where("name IS NOT NULL").count() == 1000
