"""The store of scans: events that are appended, the state that follows from them, views by role, migration and export.

Plain Parquet has no update, so every change is an event; the last one of each kind decides. Tables are partitioned by allowance year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import split_name
from claimloom.operators.history import DEFAULT_ALLOWANCE, allowance_year

# What a submitter may see, and the columns that were added to older records with what they start as.
SUBMITTER = ("scan_id", "created_on", "employee_name", "first_name", "middle_name", "last_name", "employee_number", "condition", "description", "prescription_filename", "bill_filename", "lab_report_filename", "lab_bill_filename", "review_status", "certified_by_employee", "certified_at")
ADDED = {"first_name": "", "middle_name": "", "last_name": "", "review_status": "", "decisions_json": "{}", "certified_by_employee": False, "claimed_amount": "0"}
SUBMITTED, UNDER_REVIEW, REVIEWED = "submitted", "under_review", "reviewed"
ENVELOPE = "1.0"


def save_batch(rows: DataFrame, path: str, batch: str, by: str) -> None:
    """Write a batch under its own name below each value of `by`, in place of what an earlier try of the same batch left there."""
    named = rows.withColumn("batch", F.lit(batch))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch").parquet(path)


def save_scans(scans: DataFrame, verdicts: DataFrame, path: str, batch: str) -> None:
    """Store scans with the counts that follow from their verdicts, never with counts of the caller's; a repeated batch is stored once."""
    told = scans.drop("critical_count", "warning_count", "unavailable_count", "verdict").join(verdicts.select("scan_id", "verdict", "critical_count", "warning_count", "unavailable_count"), "scan_id")
    save_batch(told.withColumn("allowance_year", allowance_year(F.col("created_on"))), path, batch, "allowance_year")


def save_pages(pages: DataFrame, path: str, batch: str) -> None:
    """Store all pages of all documents; a repeated batch is stored once."""
    save_batch(pages.select("scan_id", "slot", "page_no", "content"), path, batch, "slot")


def review_states(scans: DataFrame, events: DataFrame) -> DataFrame:
    """(scan_id, review_status, decisions, claimed_amount, allowance_year, certified_at) from events (scan_id, seq, kind, payload, amount).

    A review goes from submitted to under_review to reviewed and never back; the last decisions count, the first certification stays;
    deleted scans are gone.
    """
    kind = F.col("kind")
    last = lambda k, c: F.max_by(c, F.when(kind == k, F.col("seq")))
    folded = events.groupBy("scan_id").agg(
        F.bool_or(kind == "delete").alias("deleted"), F.bool_or(kind == "open").alias("opened"), F.bool_or(kind == "complete").alias("done"),
        last("decide", "payload").alias("decisions"), last("decide", "amount").alias("amount"), F.min(F.when(kind == "certify", F.col("seq"))).alias("certified_at"),
    )
    held = scans.join(folded, "scan_id", "left").where(~F.coalesce("deleted", F.lit(False)))
    status = F.when(F.coalesce("done", F.lit(False)), REVIEWED).when(F.coalesce("opened", F.lit(False)), UNDER_REVIEW).otherwise(SUBMITTED)
    year = allowance_year(F.col("created_on"))
    return held.select("scan_id", status.alias("review_status"), "decisions", F.coalesce("amount", F.lit(0)).cast("decimal(18,2)").alias("claimed_amount"), year.alias("allowance_year"), "certified_at")


def allowances(events: DataFrame) -> DataFrame:
    """(employee_number, annual_amount, employee_name): the last amount set for each employee."""
    return events.groupBy("employee_number").agg(F.max_by("annual_amount", "seq").alias("annual_amount"), F.max_by("employee_name", "seq").alias("employee_name"))


def allowance_views(scans: DataFrame, stored: DataFrame, year: str, exclude: int | None = None) -> DataFrame:
    """Each employee's allowance in a year: what is set or the default, what reviewed scans used but for one excluded, what waits, what is left."""
    own = scans.where(allowance_year(F.col("created_on")) == year)
    reviewed = F.col("review_status") == REVIEWED
    counted = reviewed if exclude is None else reviewed & (F.col("scan_id") != exclude)
    used = own.groupBy("employee_number").agg(F.coalesce(F.sum(F.when(counted, F.col("claimed_amount"))), F.lit(0)).cast("decimal(18,2)").alias("used"), F.count_if(counted).alias("scans_counted"), F.count_if(~reviewed).alias("awaiting"))
    everyone = scans.groupBy("employee_number").agg(F.max_by("employee_name", F.struct("created_on", "scan_id")).alias("last_name_seen"))
    held = everyone.join(used, "employee_number", "left").join(stored, "employee_number", "left").fillna(0, ["scans_counted", "awaiting"])
    annual = F.coalesce("annual_amount", F.lit(DEFAULT_ALLOWANCE)).cast("decimal(18,2)")
    spent = F.coalesce("used", F.lit(0)).cast("decimal(18,2)")
    return held.select("employee_number", F.coalesce("employee_name", "last_name_seen").alias("employee_name"), annual.alias("annual"), spent.alias("used"), F.greatest(F.lit(0).cast("decimal(18,2)"), (annual - spent).cast("decimal(18,2)")).alias("balance"), "scans_counted", "awaiting")


def submitter_view(scans: DataFrame) -> DataFrame:
    """What an employee sees of their own scans: a list of allowed columns, so that none added later is shown by accident."""
    return scans.select(*SUBMITTER)


def reviewer_view(scans: DataFrame, result: str = "result_json") -> DataFrame:
    """A row of the history: all but the result itself, with the covered amount and the currency read from it; a broken one reads as none."""
    money = F.from_json(result, "reimbursement struct<eligible_total: string, currency: string>", {"mode": "PERMISSIVE"})["reimbursement"]
    return scans.withColumns({"eligible_total": F.coalesce(money["eligible_total"], F.lit("0")), "currency": F.coalesce(money["currency"], F.lit("INR"))}).drop(result)


def transcription(rx: DataFrame, bill: DataFrame) -> DataFrame:
    """(scan_id, medicines, lines): both documents as read, nulls kept, amounts and numbers as text, in the order of the page."""
    number = lambda c: F.col(c).cast("string")
    strength = F.when(F.col("strength_value").isNotNull(), F.concat(number("strength_value"), F.coalesce("strength_unit", F.lit(""))))
    in_order = lambda fields: F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*fields).alias("line")))), lambda x: x["line"])
    left = rx.groupBy("scan_id").agg(in_order((F.col("drug_name").alias("name"), strength.alias("strength"), F.col("form"))).alias("medicines"))
    right = bill.groupBy("scan_id").agg(in_order((F.col("drug_name").alias("item"), number("expiry").alias("expiry"), number("quantity").alias("quantity"), number("unit_price").alias("rate"), number("line_total").alias("amount"), F.col("raw_text"))).alias("lines"))
    return left.join(right, "scan_id", "full")


def migrated(old: DataFrame) -> DataFrame:
    """Older records with the columns added since, filled from the row itself where nothing is set; a second time changes nothing."""
    for column, start in ADDED.items():
        if column not in old.columns:
            old = old.withColumn(column, F.lit(start))
    parts = split_name(F.col("employee_name"))
    unsplit = (F.coalesce("first_name", F.lit("")) == "") & (F.coalesce("middle_name", F.lit("")) == "") & (F.coalesce("last_name", F.lit("")) == "")
    decided = ~F.trim(F.coalesce("decisions_json", F.lit("{}"))).isin("", "{}")
    status = F.when(F.coalesce("review_status", F.lit("")) != "", F.col("review_status")).when(decided, REVIEWED).otherwise(SUBMITTED)
    named = {f"{p}_name": F.when(unsplit, F.coalesce(parts[p], F.lit(""))).otherwise(F.col(f"{p}_name")) for p in ("first", "middle", "last")}
    return old.withColumns({**named, "review_status": status})


def export_json(scans: DataFrame, counts: DataFrame, totals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(scan_id, document): the envelope of each scan as JSON text; `counts` as of review.row_counts, `totals` as of review.rebucketed."""
    buckets = totals.groupBy("scan_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", F.struct(F.col("total").cast("string").alias("total"), "lines"))))).alias("reimbursement"))
    held = scans.join(verdicts.select("scan_id", "verdict"), "scan_id").join(counts, "scan_id", "left").join(buckets, "scan_id", "left")
    document = F.struct(
        F.lit(ENVELOPE).alias("envelope_version"), F.struct("scan_id", F.col("created_on").cast("string").alias("created_at"), "employee_name", "employee_number").alias("scan"),
        F.struct(F.col("claimed_amount").cast("string").alias("claimed_amount"), "accepted", "rejected", "undecided").alias("review"), F.struct("verdict", "matched", "problems", "reimbursement").alias("summary"),
    )
    return held.select("scan_id", F.to_json(document).alias("document"))


def accounts(scans: DataFrame) -> DataFrame:
    """(employee_number, display_name, scans): each account with the name it was last seen with."""
    last = Window.partitionBy("employee_number").orderBy(F.desc("created_on"), F.desc("scan_id"))
    named = scans.withColumn("k", F.row_number().over(last))
    return named.groupBy("employee_number").agg(F.max(F.when(F.col("k") == 1, F.col("employee_name"))).alias("display_name"), F.count("*").alias("scans"))
