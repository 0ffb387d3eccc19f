"""Deterministic rules; each returns findings (scan_id, rule_code, severity, prescribed_ref, billed_ref) for all scans at once.

A check whose inputs are missing says so with CHECK_UNAVAILABLE; absence alone is never a discrepancy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.pairing import normalised, same_line

#: Tolerances of amounts, the largest shortfall that an unprinted discount explains, and days.
LINE_TOLERANCE, TOTAL_TOLERANCE, IMPLIED_DISCOUNT = "0.05", "1.00", 0.30
NEAR_EXPIRY_DAYS, MOST_BILL_LAG = 30, 30
UNAVAILABLE = "CHECK_UNAVAILABLE"


#: What every rule returns; check_name tells apart the checks that could not be made, detail is JSON.
FINDING = ("scan_id", "rule_code", "severity", "prescribed_ref", "billed_ref", "check_name", "detail")


def told(rows: DataFrame, code: Column | str, severity: Column | str, rx: Column | None = None, bill: Column | None = None, check: Column | str | None = None, detail: Column | None = None) -> DataFrame:
    """Findings from rows; those without a code are none. A check's name is kept only where it could not be made."""
    column = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    values = dict(zip(FINDING[1:], map(column, (code, severity, rx, bill, check, detail))))
    named = rows.select("scan_id", *(v.cast("string").alias(k) for k, v in values.items())).where("rule_code IS NOT NULL")
    return named.withColumn("check_name", F.when(F.col("rule_code") == UNAVAILABLE, F.col("check_name")))


def unavailable(rows: DataFrame, check: Column | str, rx: Column | None = None, bill: Column | None = None, detail: Column | None = None) -> DataFrame:
    return told(rows, UNAVAILABLE, "info", rx, bill, check, detail)


def pair_codes(r: str, b: str) -> tuple[Column, Column, Column]:
    """Codes for strength, form and brand of normalised lines, whose columns begin with `r` and `b`."""
    rv, bv, ru, bu = (F.col(x) for x in (f"{r}strength_value", f"{b}strength_value", f"{r}strength_unit", f"{b}strength_unit"))
    equal, units = F.abs(rv - bv) < 1e-6, ru.isNotNull() & bu.isNotNull()
    strength = F.when(rv.isNull() | bv.isNull(), UNAVAILABLE).when(~equal | (units & (ru != bu)), "STRENGTH_MISMATCH").when(~units, "STRENGTH_UNIT_UNSTATED")
    form = F.when(F.col(f"{r}form").isNull() | F.col(f"{b}form").isNull(), UNAVAILABLE).when(F.col(f"{r}form") != F.col(f"{b}form"), "FORM_MISMATCH")
    brand = F.when((F.col(f"{r}salt") == F.col(f"{b}salt")) & (F.col(f"{r}drug_name") != F.col(f"{b}drug_name")) & ~F.coalesce(strength == "STRENGTH_MISMATCH", F.lit(False)), "BRAND_SUBSTITUTION")
    return strength, form, brand


def strength_and_form(pairs: DataFrame, rx: DataFrame, bill: DataFrame) -> DataFrame:
    """Strength, form and brand of each pair."""
    r, b = normalised(rx).alias("r"), normalised(bill).alias("b")
    both = pairs.alias("p").join(r, (F.col("p.scan_id") == F.col("r.scan_id")) & same_line("p.rx_item", "r.item_id")).join(b, (F.col("p.scan_id") == F.col("b.scan_id")) & same_line("p.bill_item", "b.item_id"))
    strength, form, brand = pair_codes("r.", "b.")
    each = both.select("p.scan_id", "rx_item", "bill_item", F.explode(F.array(*(F.struct(c.alias("code"), F.lit(k).alias("check")) for c, k in ((strength, "strength"), (form, "dosage form"), (brand, None))))).alias("t")).select("scan_id", "rx_item", "bill_item", "t.code", "t.check")
    severity = F.when(F.col("code").isin("STRENGTH_MISMATCH", "FORM_MISMATCH"), "critical").otherwise("info")
    return told(each, F.col("code"), severity, F.col("rx_item"), F.col("bill_item"), F.col("check"))


def total_code() -> tuple[Column, Column]:
    """The code for a billed line's total, and whether it can be checked."""
    gross = F.bround(F.col("quantity") * F.col("unit_price"), 2)
    expected = gross - F.coalesce(F.col("discount"), F.lit(0).cast("decimal(5,2)"))
    short = expected - F.col("line_total")
    implied = (short > 0) & F.col("discount").isNull() & (gross > 0) & (short.cast("double") <= IMPLIED_DISCOUNT * gross.cast("double"))
    priced = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & F.col("line_total").isNotNull()
    packed = F.bround((F.col("quantity") * F.col("unit_price")).cast("double") / F.col("per_pack"), 2) - F.coalesce(F.col("discount").cast("double"), F.lit(0.0)) - F.col("line_total").cast("double")
    by_pack = F.coalesce(~F.col("units_basis").eqNullSafe("unit") & (F.abs(packed) <= float(LINE_TOLERANCE) + 1e-6), F.lit(False))
    wrong = F.when(priced & (F.abs(short) > F.lit(LINE_TOLERANCE).cast("decimal(5,2)")) & ~by_pack & ~implied, "LINE_TOTAL_MISMATCH")
    return wrong, priced


def line_arithmetic(bill: DataFrame) -> DataFrame:
    """Quantity times rate less discount against the line's total, the quantity counting packs or what is in them."""
    wrong, priced = total_code()
    lines = told(bill, wrong, "warning", bill=F.col("item_id"))
    unpriced = bill.where(~priced).select("scan_id").distinct()
    return lines.union(unavailable(unpriced, "line arithmetic"))


def document_dates(scans: DataFrame) -> DataFrame:
    """A bill dated before its prescription or long after it."""
    lag = F.datediff("bill_date", "rx_date")
    code = F.when(lag.isNull(), UNAVAILABLE).when((lag < 0) | (lag > MOST_BILL_LAG), "DATE_ANOMALY")
    return told(scans, code, F.when(lag.isNull(), "info").otherwise("warning"), check="document date")


def expiry_code(days: Column) -> Column:
    return F.when(days < 0, "EXPIRED_ITEM").when(days <= NEAR_EXPIRY_DAYS, "EXPIRY_NEAR")


def expiry(bill: DataFrame, scans: DataFrame) -> DataFrame:
    """Lines past their last valid day on the bill's date, or near it; one finding a scan where dates are missing."""
    dated = bill.join(scans.select("scan_id", "bill_date"), "scan_id")
    days = F.datediff("expiry", "bill_date")
    code = expiry_code(days)
    lines = told(dated, code, F.when(days < 0, "critical").otherwise("warning"), bill=F.col("item_id"))
    return lines.union(unavailable(dated.where(days.isNull()).select("scan_id").distinct(), "expiry"))


def duplicate_therapy(bill: DataFrame) -> DataFrame:
    """Salts billed on more than one line of a scan, told at the first of them."""
    groups = bill.where(F.col("salt").isNotNull()).groupBy("scan_id", "salt").agg(F.count("*").alias("n"), F.min_by("item_id", "ordinal").alias("first")).where("n > 1")
    unresolved = bill.where(F.col("salt").isNull()).select("scan_id").distinct()
    return told(groups, "DUPLICATE_THERAPY", "warning", bill=F.col("first")).union(unavailable(unresolved, "duplicate-therapy"))


def low_confidence(lines: DataFrame, *, billed: bool) -> DataFrame:
    """Lines on whose name the runs disagreed."""
    code = F.when(F.col("name_agreement") < 1, "LOW_CONFIDENCE_FIELD")
    return told(lines, code, "info", **{"bill" if billed else "rx": F.col("item_id")})


def all_findings(pairs: DataFrame, rx: DataFrame, bill: DataFrame, scans: DataFrame) -> DataFrame:
    parts = (strength_and_form(pairs, rx, bill), line_arithmetic(bill), document_dates(scans), expiry(bill, scans), duplicate_therapy(bill), low_confidence(rx, billed=False), low_confidence(bill, billed=True))
    return reduce(DataFrame.union, parts)


def unstable(runs: Column) -> Column:
    """Whether runs, joined by commas, counted different numbers of lines."""
    return F.coalesce(F.size(F.array_distinct(F.split(runs, ","))) > 1, F.lit(False))


def verdicts(findings: DataFrame, rx: DataFrame, scans: DataFrame) -> DataFrame:
    """Counts, verdict and score of every scan, those without prescribed lines included; inconclusive, with no score, if names are
    mostly unread, the runs mostly disagree on them, or they counted different numbers of lines.
    """
    names = rx.groupBy("scan_id").agg(F.avg(F.col("drug_name").isNull().cast("double")).alias("unread"), F.avg("name_agreement").alias("agreement"))
    counts = findings.groupBy("scan_id").agg(
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.count_if(F.col("rule_code") == UNAVAILABLE).alias("unavailable_count"),
    )
    held = scans.select("scan_id", "rx_runs", "bill_runs").join(names, "scan_id", "left").join(counts, "scan_id", "left").fillna(0, ["critical_count", "warning_count", "unavailable_count"])
    unclear = F.coalesce((F.col("unread") > 0.5) | (F.col("agreement") < 0.67), F.lit(False)) | unstable(F.col("rx_runs")) | unstable(F.col("bill_runs"))
    verdict = F.when(unclear, "inconclusive").when(F.col("critical_count") > 0, "mismatch").when(F.col("warning_count") > 0, "match_with_warnings").otherwise("match")
    score = F.when(~unclear, F.greatest(F.lit(0), 100 - 25 * F.col("critical_count") - 8 * F.col("warning_count")))
    return held.select("scan_id", "critical_count", "warning_count", "unavailable_count", verdict.alias("verdict"), score.cast("bigint").alias("score"))
