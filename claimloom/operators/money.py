"""Bill totals, reimbursement buckets and the state of each billed line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.pairing import same_line
from claimloom.operators.rules import TOTAL_TOLERANCE, UNAVAILABLE

#: Codes by what they mean for a billed line's money.
NOT_ELIGIBLE = ("BILL_NOT_PRESCRIBED", "SCHEDULE_H_UNBACKED", "TEST_NOT_PRESCRIBED")
OVER_NON_MEDICINE = ("SCHEDULE_H_UNBACKED", "TEST_NOT_PRESCRIBED")
UNCHECKED = (UNAVAILABLE, "QUANTITY_AMBIGUOUS", "STRENGTH_UNIT_UNSTATED", "TEST_UNRESOLVED")
BUCKETS = ("eligible", "needs_review", "not_eligible", "non_medicine")


def document_totals(lines: DataFrame) -> DataFrame:
    """(scan_id, lines, line_sum) where the sum is null unless every line has an amount."""
    whole = F.when(F.count_if(F.col("line_total").isNull()) == 0, F.sum("line_total")).cast("decimal(18,2)")
    return lines.groupBy("scan_id").agg(F.count("*").alias("lines"), whole.alias("line_sum"))


def total_checks(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Subtotal against the lines' sum, net or gross of the discount, and grand total against subtotal, discount and tax.

    `headers` has subtotal, discount_total, tax_total, grand_total. A total that the tax is already part of is told apart.
    """
    less, most = F.coalesce("discount_total", F.lit(0).cast("decimal(18,2)")), F.lit(TOTAL_TOLERANCE).cast("decimal(5,2)")
    both = headers.join(document_totals(lines), "scan_id")
    off = lambda a, b: F.abs(a - b) > most
    gross_fits = F.col("discount_total").isNotNull() & ~off(F.col("line_sum"), F.col("subtotal"))
    subtotal = F.when(F.col("subtotal").isNull() | F.col("line_sum").isNull(), UNAVAILABLE).when(off(F.col("line_sum") - less, F.col("subtotal")) & ~gross_fits, "SUBTOTAL_MISMATCH")
    known = F.col("subtotal").isNotNull() & F.col("tax_total").isNotNull() & F.col("grand_total").isNotNull()
    net = F.col("subtotal") - less
    grand = F.when(~known, UNAVAILABLE).when((F.col("tax_total") > 0) & ~off(net, F.col("grand_total")), "TAX_INCLUSIVE_PRICING").when(off(net + F.col("tax_total"), F.col("grand_total")), "GRAND_TOTAL_MISMATCH")
    return both.select("scan_id", "line_sum", subtotal.alias("subtotal_code"), grand.alias("grand_code"))


def line_states(lines: DataFrame, findings: DataFrame, matched: DataFrame) -> DataFrame:
    """Each billed line's row state, whether a check on it stayed open, and its reimbursement bucket.

    Findings are folded to one row a line before they are joined; `matched` has (scan_id, item_id) of paired or covered lines.
    """
    has = lambda *codes: F.bool_or(F.col("rule_code").isin(*codes))
    told = findings.where(F.col("billed_ref").isNotNull()).groupBy("scan_id", F.col("billed_ref").alias("item_id")).agg(
        F.bool_or(F.col("severity") == "critical").alias("critical"),
        F.bool_or(F.col("severity") == "warning").alias("warning"),
        has("NON_MEDICINE_ITEM").alias("non_medicine"),
        has("BRAND_SUBSTITUTION").alias("substitution"),
        has(*NOT_ELIGIBLE).alias("not_eligible"),
        has(*OVER_NON_MEDICINE).alias("overriding"),
        has(*UNCHECKED).alias("unchecked"),
    )
    flags = ("critical", "warning", "non_medicine", "substitution", "not_eligible", "overriding", "unchecked")
    paired = matched.select("scan_id", "item_id", F.lit(True).alias("paired"))
    on = lambda side: (F.col("l.scan_id") == F.col(f"{side}.scan_id")) & same_line("l.item_id", f"{side}.item_id")
    rows = lines.alias("l").join(told.alias("t"), on("t"), "left").join(paired.alias("m"), on("m"), "left")
    return states_of(rows.select("l.*", *flags, "paired").fillna(False, [*flags, "paired"]))


def states_of(rows: DataFrame, *keep: str) -> DataFrame:
    """`line_states` of lines that have what was told of them, with the columns to `keep`."""
    state = F.when(F.col("critical"), "problem").when(F.col("warning"), "warning").when(F.col("non_medicine"), "out-of-scope").when(F.col("paired") & F.col("substitution"), "substitution").when(F.col("paired"), "clean").otherwise("unchecked")
    partial = F.col("unchecked") & (F.col("critical") | F.col("warning") | (~F.col("non_medicine") & F.col("paired")))
    bucket = F.when(F.col("non_medicine") & ~F.col("overriding"), "non_medicine").when(F.col("not_eligible"), "not_eligible").when(F.col("unchecked") | F.col("critical") | F.col("warning"), "needs_review").when(F.col("paired"), "eligible").otherwise("needs_review")
    return rows.select("scan_id", "item_id", "line_total", state.alias("state"), partial.alias("partial"), bucket.alias("bucket"), *keep)


def category_totals(states: DataFrame) -> DataFrame:
    """Amounts by bucket for each scan; lines without an amount are counted, not taken as zero."""
    amount = lambda b: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("line_total"))), F.lit(0)).cast("decimal(18,2)").alias(b)
    return states.groupBy("scan_id").agg(*map(amount, BUCKETS), F.count_if(F.col("line_total").isNull()).alias("lines_without_amount"))


def excluded(states: DataFrame) -> DataFrame:
    """(scan_id, not_prescribed, non_medicine, excluded): what a claim leaves out, lines with an amount and their sum; only scans with such a line."""
    out = states.where(F.col("bucket").isin("not_eligible", "non_medicine") & F.col("line_total").isNotNull())
    lines = lambda bucket: F.count_if(F.col("bucket") == bucket)
    return out.groupBy("scan_id").agg(lines("not_eligible").alias("not_prescribed"), lines("non_medicine").alias("non_medicine"), F.sum("line_total").cast("decimal(18,2)").alias("excluded"))
