"""What a reviewer sees of a scan: rows with their findings, remarks, headlines, decisions, summaries and what could not be assessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text
from claimloom.operators.money import NOT_ELIGIBLE, UNCHECKED  # noqa: F401
from claimloom.operators.rules import UNAVAILABLE

# Codes by precedence of their remark, by how specific they are, by the field they concern, and by group.
REMARKS = (
    "NON_MEDICINE_ITEM", "DUPLICATE_BILL", "POSSIBLE_RESUBMISSION", "EARLY_REPEAT", "EXPIRED_ITEM", "TEST_BILLED_NOT_REPORTED", "REPORT_PATIENT_MISMATCH", "REPORT_DATE_ANOMALY",
    "TEST_REPORTED_NOT_ORDERED", "TEST_REPORTED_NOT_BILLED", "SALT_DIFFERENT_CLASS", "EXPIRY_NEAR", "SCHEDULE_H_UNBACKED", "STRENGTH_MISMATCH", "BILL_NOT_PRESCRIBED", "RX_NOT_BILLED",
    "TEST_NOT_PRESCRIBED", "TEST_NOT_BILLED", "FORM_MISMATCH", "QUANTITY_SHORT", "QUANTITY_EXCESS", "DUPLICATE_THERAPY", "TEST_DUPLICATE", "PANEL_PARTIAL", "BRAND_SUBSTITUTION",
    "LINE_TOTAL_MISMATCH", "QUANTITY_AMBIGUOUS", "STRENGTH_UNIT_UNSTATED", "TEST_UNRESOLVED",
)
PINNED = "SCHEDULE_H_UNBACKED"
SPECIFIC = (
    PINNED, "DUPLICATE_BILL", "EXPIRED_ITEM", "TEST_BILLED_NOT_REPORTED", "SALT_DIFFERENT_CLASS", "STRENGTH_MISMATCH", "DUPLICATE_THERAPY", "PANEL_PARTIAL", "TEST_DUPLICATE", "FORM_MISMATCH",
    "QUANTITY_SHORT", "QUANTITY_EXCESS", "BRAND_SUBSTITUTION", "TEST_REPORTED_NOT_ORDERED", "TEST_NOT_PRESCRIBED", "TEST_NOT_BILLED", "BILL_NOT_PRESCRIBED", "RX_NOT_BILLED",
    "LINE_TOTAL_MISMATCH", "GSTIN_INVALID", "LICENCE_ABSENT", "NON_MEDICINE_ITEM",
)
SEVERITIES = ("critical", "warning", "info")
FIELDS = {
    "STRENGTH_MISMATCH": "strength", "STRENGTH_UNIT_UNSTATED": "strength", "FORM_MISMATCH": "form", "QUANTITY_SHORT": "qty", "QUANTITY_EXCESS": "qty", "QUANTITY_AMBIGUOUS": "qty",
    "BRAND_SUBSTITUTION": "drug", "SALT_DIFFERENT_CLASS": "drug", "DUPLICATE_THERAPY": "drug", "SCHEDULE_H_UNBACKED": "drug",
}
UNVERIFIED = ("QUANTITY_AMBIGUOUS", "STRENGTH_UNIT_UNSTATED", "TEST_UNRESOLVED")
NOTED = ("BRAND_SUBSTITUTION", "DATE_ORDER_ASSUMED", "NON_MEDICINE_ITEM", "GSTIN_STATE_MISMATCH", "TAX_INCLUSIVE_PRICING", "TEST_REPORTED_NOT_BILLED")
QUALITY = ("LOW_CONFIDENCE_FIELD", "ILLEGIBLE_RX")
DECISIONS = {"accept": "Accepted", "reject": "Rejected", "unset": "Not decided"}


def rank(code: Column, order: tuple[str, ...]) -> Column:
    """The place of a code in an order; those that aren't in it come last."""
    place = F.array_position(F.array(*map(F.lit, order)), code)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def rows_of(pairs: DataFrame, rx: DataFrame, bill: DataFrame) -> DataFrame:
    """(scan_id, row_key, rx_item, bill_item): pairs, then lines without a counterpart of either side."""
    both = pairs.select("scan_id", "rx_item", "bill_item")
    left = rx.select("scan_id", F.col("item_id").alias("rx_item")).join(both, ["scan_id", "rx_item"], "left")
    alone = bill.select("scan_id", F.col("item_id").alias("bill_item")).join(both.select("scan_id", "bill_item"), ["scan_id", "bill_item"], "left_anti")
    rows = left.select("scan_id", "rx_item", "bill_item").union(alone.select("scan_id", F.lit(None).cast("string"), "bill_item"))
    return rows.withColumn("row_key", text.row_key(F.col("rx_item"), F.col("bill_item")))


def findings_of(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Each row's findings: every reference that a finding has must be the row's, and it must have one. Joined on the one it has first."""
    f = findings.where(F.col("prescribed_ref").isNotNull() | F.col("billed_ref").isNotNull())
    by_rx = rows.where("rx_item IS NOT NULL").join(f.withColumnRenamed("prescribed_ref", "rx_item"), ["scan_id", "rx_item"]).where("billed_ref IS NULL OR bill_item IS NULL OR billed_ref = bill_item")
    by_bill = rows.where("bill_item IS NOT NULL").join(f.withColumnRenamed("billed_ref", "bill_item"), ["scan_id", "bill_item"]).where("prescribed_ref IS NULL OR rx_item IS NULL")
    return by_rx.select("scan_id", "row_key", "rule_code", "severity").union(by_bill.select("scan_id", "row_key", "rule_code", "severity"))


def row_states(rows: DataFrame, findings: DataFrame, bill: DataFrame) -> DataFrame:
    """Rows with state, partial, remark, further remarks, amount, what can be claimed of it and the decision it starts with."""
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    code = F.col("rule_code")
    remark = F.when(code.isin(*REMARKS), rank(code, REMARKS))
    folded = findings_of(rows, findings).groupBy("scan_id", "row_key").agg(
        has(F.col("severity") == "critical").alias("critical"), has(F.col("severity") == "warning").alias("warning"), has(code == "NON_MEDICINE_ITEM").alias("other"), has(code == "BRAND_SUBSTITUTION").alias("substitution"),
        has(code.isin(*UNCHECKED)).alias("open"), F.count("*").alias("n_findings"), F.min_by("rule_code", remark).alias("remark"), F.count_distinct(F.when(remark.isNotNull(), code)).alias("remarks"),
    )
    flags = ("critical", "warning", "other", "substitution", "open")
    held = rows.join(folded, ["scan_id", "row_key"], "left").fillna(False, flags).fillna(0, ["n_findings", "remarks"])
    return states_of(held.join(bill.select("scan_id", F.col("item_id").alias("bill_item"), "line_total"), ["scan_id", "bill_item"], "left"))


def states_of(held: DataFrame, *keep: str) -> DataFrame:
    """`row_states` of rows that have their findings folded and their line's amount, with the columns to `keep`."""
    paired = F.col("rx_item").isNotNull() & F.col("bill_item").isNotNull()
    state = F.when(F.col("critical"), "problem").when(F.col("warning"), "warning").when(F.col("other"), "out-of-scope").when(paired & F.col("substitution"), "substitution").when(paired, "clean").otherwise("unchecked")
    told = held.withColumn("state", state).withColumn("partial", F.col("open") & F.col("state").isin("problem", "warning", "substitution", "clean"))
    claimable = (F.col("state") != "out-of-scope") & F.col("line_total").isNotNull() & paired
    amount = F.when(claimable, F.col("line_total")).otherwise(F.lit(0)).cast("decimal(18,2)")
    start = F.when(claimable & F.col("state").isin("clean", "substitution"), "accept").otherwise("unset")
    return told.select("scan_id", "row_key", "rx_item", "bill_item", "state", "partial", "n_findings", "remark", F.greatest(F.col("remarks") - 1, F.lit(0)).alias("more"), claimable.alias("claimable"), amount.alias("amount"), start.alias("start"), *keep)


def decided(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows with the decision on them, and in words; one that nobody ruled on is never accepted."""
    return ruled_on(rows.join(decisions.select("scan_id", "row_key", F.col("decision").alias("ruled")), ["scan_id", "row_key"], "left"))


def ruled_on(held: DataFrame) -> DataFrame:
    """`decided` of rows that have what was ruled on them."""
    words = F.create_map(*(F.lit(x) for pair in DECISIONS.items() for x in pair))
    return held.withColumn("word", F.coalesce(F.try_element_at(words, F.col("ruled")), F.lit(DECISIONS["unset"]))).withColumn("decision", F.coalesce("ruled", "start")).drop("ruled")


def row_counts(rows: DataFrame) -> DataFrame:
    """Matched and problem rows, decisions on what can be claimed, and the claim, by scan."""
    ruled = lambda d: F.count_if(F.col("claimable") & d)
    d = F.col("decision")
    return rows.groupBy("scan_id").agg(
        F.count_if(F.col("state").isin("clean", "substitution")).alias("matched"), F.count_if(F.col("state").isin("problem", "warning")).alias("problems"),
        ruled(d == "accept").alias("accepted"), ruled(d == "reject").alias("rejected"), ruled(~d.isin("accept", "reject")).alias("undecided"),
        F.coalesce(F.sum(F.when(d == "accept", F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias("claim"),
    )


def filtered(rows: DataFrame, kind: str) -> DataFrame:
    """Rows by what the list shows: all, matched, problems, or the rest."""
    kinds = {"matched": ("clean", "substitution"), "problems": ("problem", "warning"), "out-of-scope": ("out-of-scope", "unchecked")}
    return rows if kind == "all" else rows.where(F.col("state").isin(*kinds[kind]))


def filter_counts(rows: DataFrame) -> DataFrame:
    """(scan_id, n, kind): how many rows each list of `filtered` shows, counted in one reading of them."""
    state = F.col("state")
    group = F.when(state.isin("clean", "substitution"), "matched").when(state.isin("problem", "warning"), "problems").when(state.isin("out-of-scope", "unchecked"), "out-of-scope")
    each = rows.select("scan_id", F.explode(F.array(F.lit("all"), group)).alias("kind")).where("kind IS NOT NULL")
    return each.groupBy("scan_id", "kind").agg(F.count("*").alias("n")).select("scan_id", "n", "kind")


def headlines(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(scan_id, item, severity, headline, more): one row for each line and for each finding that is about none.

    Both lines of a pair are one item. A line's headline is the pinned code, or else the loudest and then most specific.
    """
    refs = pairs.select("scan_id", F.explode(F.array(F.struct(F.col("rx_item").alias("ref"), F.col("rx_item").alias("item")), F.struct(F.col("bill_item").alias("ref"), F.col("rx_item").alias("item")))).alias("r")).select("scan_id", "r.ref", "r.item")
    named = findings.withColumn("ref", F.coalesce("prescribed_ref", "billed_ref"))
    lines = named.where("ref IS NOT NULL").join(refs, ["scan_id", "ref"], "left").withColumn("item", F.coalesce("item", "ref"))
    loud, special = rank(F.col("severity"), SEVERITIES), rank(F.col("rule_code"), SPECIFIC)
    grouped = lines.groupBy("scan_id", "item").agg(F.min(loud).alias("loudest"), F.min_by("rule_code", F.struct(F.col("rule_code") != PINNED, loud, special, "rule_code")).alias("headline"), (F.count("*") - 1).alias("more"))
    lines = grouped.select("scan_id", "item", F.get(F.array(*map(F.lit, SEVERITIES)), F.col("loudest") - 1).alias("severity"), "headline", "more")
    return lines.union(whole_headlines(findings))


def whole_headlines(findings: DataFrame) -> DataFrame:
    """`headlines` of the findings that are about no line."""
    none = findings.where("prescribed_ref IS NULL AND billed_ref IS NULL")
    return none.select("scan_id", F.lit(None).cast("string").alias("item"), F.col("severity"), F.col("rule_code").alias("headline"), F.lit(0).cast("bigint").alias("more"))


def field_marks(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """(scan_id, row_key, field, severity): the loudest marking of each field of a row."""
    field = F.try_element_at(F.create_map(*(F.lit(x) for pair in FIELDS.items() for x in pair)), F.col("rule_code"))
    marked = findings_of(rows, findings).withColumn("field", field).where("field IS NOT NULL")
    return marked.groupBy("scan_id", "row_key", "field").agg(F.min_by("severity", rank(F.col("severity"), SEVERITIES)).alias("severity"))


def group_of(code: Column) -> Column:
    """discrepancy, unverified, not_run, noted or quality."""
    return F.when(code.isin(*UNVERIFIED), "unverified").when(code == UNAVAILABLE, "not_run").when(code.isin(*NOTED), "noted").when(code.isin(*QUALITY), "quality").otherwise("discrepancy")


def without_noise(findings: DataFrame) -> DataFrame:
    """Findings without those that repeat of a confirmed non-medicine line that it is none."""
    confirmed = findings.where("rule_code = 'NON_MEDICINE_ITEM' AND billed_ref IS NOT NULL").select("scan_id", "billed_ref").distinct().withColumn("confirmed", F.lit(True))
    held = findings.join(confirmed, ["scan_id", "billed_ref"], "left")
    return held.where(F.col("confirmed").isNull() | ~F.col("rule_code").isin("BILL_NOT_PRESCRIBED", "NON_MEDICINE_ITEM")).select(*findings.columns)


def document_gaps(findings: DataFrame) -> DataFrame:
    """(scan_id, gap, findings): what of a scan could not be assessed; findings carry detail as JSON."""
    soft = F.get_json_object("detail", "$.softened_code")
    gap = F.when((F.col("rule_code") == "RX_NOT_BILLED") & (F.get_json_object("detail", "$.lab_only_bill") == "true"), "pharmacy_bill_missing")
    gap = gap.when((F.col("rule_code") == "TEST_NOT_BILLED") & (soft == "no_lab_bill"), "lab_bill_missing").when((F.col("rule_code") == "TEST_NOT_BILLED") & (soft == "lab_bill_unreadable"), "lab_bill_unreadable")
    gap = gap.when((F.col("rule_code") == UNAVAILABLE) & (F.col("check_name") == "test authorisation") & F.col("billed_ref").isNull(), "orders_unreadable")
    return findings.withColumn("gap", gap).where("gap IS NOT NULL").groupBy("scan_id", "gap").agg(F.count("*").alias("findings"))


def review_summary(lines: DataFrame, findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Lines to review and fields that disagreement nulled, null where nothing was measured, with the checks not made.

    `lines` has scan_id, agreement (map of fields to shares, null for a single run) and nulled (the fields of it that are null).
    """
    shaky = F.map_filter("agreement", lambda _, x: x < 1.0)
    each = lines.groupBy("scan_id").agg(
        F.bool_or(F.coalesce(F.size("agreement") > 0, F.lit(False))).alias("measured"), F.count_if(F.size(shaky) > 0).alias("needing"),
        F.sum(F.size(F.array_intersect(F.map_keys(shaky), "nulled"))).alias("nulled"),
    )
    unmade = findings.where(F.col("rule_code") == UNAVAILABLE).groupBy("scan_id").agg(F.count("*").alias("checks_unavailable"))
    runs = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")) > 1
    held = scans.select("scan_id", "rx_runs", "bill_runs").join(each, "scan_id", "left").join(unmade, "scan_id", "left")
    measured = F.coalesce("measured", F.lit(False)) | runs("rx_runs") | runs("bill_runs")
    known = lambda c: F.when(measured, F.coalesce(c, F.lit(0)).cast("bigint"))
    return held.select("scan_id", measured.alias("measured"), known("needing").alias("items_needing_review"), known("nulled").alias("fields_nulled"), F.coalesce("checks_unavailable", F.lit(0)).alias("checks_unavailable"))


def rebucketed(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """Amounts and lines by what they are: what waits for review counts by whether the line is paired."""
    paired = pairs.select("scan_id", F.col("bill_item").alias("item_id"), F.lit(True).alias("paired"))
    return bucket_totals(states.join(paired, ["scan_id", "item_id"], "left"))


def bucket_totals(held: DataFrame) -> DataFrame:
    """`rebucketed` of lines that say whether they are paired."""
    bucket = F.when(F.col("bucket") != "needs_review", F.col("bucket")).when(F.coalesce("paired", F.lit(False)), "eligible").otherwise("not_eligible")
    return held.where(F.col("line_total").isNotNull()).withColumn("bucket", bucket).groupBy("scan_id", "bucket").agg(F.sum("line_total").cast("decimal(18,2)").alias("total"), F.count("*").alias("lines"))


def readability(scans: DataFrame) -> DataFrame:
    """(scan_id, slot, state) of the four documents: read, partly_unreadable, unreadable, not_assessed or not_supplied.

    `scans` has verdict, unstable_rx, unstable_bill, n_rx, n_rx_tests, n_bill, investigations, the four `..._supplied`, lab_tests_read,
    lab_unstable, report_stored, n_report_tests and unreadable_pages.
    """
    state = lambda supplied, told: F.when(~F.col(supplied), "not_supplied").otherwise(told)
    rx = F.when(((F.col("n_rx") == 0) & (F.col("n_rx_tests") == 0)) | (F.col("verdict") == "inconclusive"), "unreadable").when(F.col("unstable_rx") | (F.coalesce(F.col("investigations"), F.lit(False)) & (F.col("n_rx_tests") == 0)), "partly_unreadable").otherwise("read")
    bill = F.when(F.col("n_bill") == 0, "unreadable").when(F.col("unstable_bill"), "partly_unreadable").otherwise("read")
    lab = F.when(F.col("lab_tests_read").isNull(), "not_assessed").when(F.col("lab_tests_read") == 0, "unreadable").when(F.col("lab_unstable"), "partly_unreadable").otherwise("read")
    report = F.when(~F.col("report_stored"), "not_assessed").when((F.col("n_report_tests") == 0) & (F.col("unreadable_pages") == 0), "unreadable").when(F.col("unreadable_pages") > 0, "partly_unreadable").otherwise("read")
    slots = (("prescription", "rx_supplied", rx), ("pharmacy_bill", "bill_supplied", bill), ("lab_bill", "lab_supplied", lab), ("lab_report", "report_supplied", report))
    return scans.select("scan_id", F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), state(c, x).alias("state")) for s, c, x in slots))).alias("d")).select("scan_id", "d.*")
