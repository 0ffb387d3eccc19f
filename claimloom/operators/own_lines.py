"""All rules on lines that come with what is prescribed for them, in one pass over the lines of each scan.

`rules.all_findings` joins pairs with both sides, and reads the bill for each rule. Where a pair is one row already and a line's name is
its own in its scan, each rule is a column of that row. What concerns several lines of a scan is told by windows over the scan, on its
first row. A finding that has a line has no other than this row's, so rows, marks and headlines need no join either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text
from claimloom.functions.forms import normalise_form
from claimloom.functions.units import normalise_strength
from claimloom.operators import documents, money, review, rules

#: Columns of codes: whether they name the prescribed line and the billed one, and their check where it could not be made.
CODES: dict[str, tuple[bool, bool, str | None]] = {
    "strength": (True, True, "strength"), "dosage": (True, True, "dosage form"), "brand": (True, True, None), "total": (False, True, None), "expired": (False, True, None),
    "therapy": (False, True, None), "rx_name": (True, False, None), "bill_name": (False, True, None), "outside": (False, True, None),
}
#: Checks that could not be made somewhere in a scan.
CHECKS = {"unpriced": "line arithmetic", "undated": "expiry", "unsalted": "duplicate-therapy"}
CRITICAL = ("STRENGTH_MISMATCH", "FORM_MISMATCH", "EXPIRED_ITEM")
WARNING = ("LINE_TOTAL_MISMATCH", "EXPIRY_NEAR", "DUPLICATE_THERAPY")


def severity(code: Column) -> Column:
    return F.when(code.isin(*CRITICAL), "critical").when(code.isin(*WARNING), "warning").otherwise("info")


def judged(lines: DataFrame) -> DataFrame:
    """Lines with a column for each of `CODES`, and on a scan's first line those of `CHECKS`.

    `lines` are billed lines with `rx`, a struct of the prescribed line or null, `bill_date`, and `known`, true if their scan is.
    """
    def normal(side: str, of: str) -> dict[str, Column]:
        c = lambda k: F.col(side + k)
        strength = normalise_strength(c("strength_value"), c("strength_unit"))
        unit = F.when(c("strength_value").isNotNull() | c("strength_unit").isNotNull(), strength["unit"])
        return {f"{of}_strength_value": strength["value"], f"{of}_strength_unit": unit, f"{of}_form": normalise_form(c("form")), f"{of}_salt": c("salt"), f"{of}_drug_name": c("drug_name")}

    paired = F.col("rx").isNotNull()
    wrong, priced = rules.total_code()
    days = F.when(F.col("known"), F.datediff("expiry", "bill_date"))
    sides = lines.withColumns(normal("rx.", "ordered") | normal("", "billed"))  # flat, as structs would be worked out anew for each use
    of_pair = dict(zip(("strength", "dosage", "brand"), rules.pair_codes("ordered_", "billed_")))
    each = sides.select(
        "scan_id", "ordinal", "item_id", "salt", "line_total", F.col("rx.item_id").alias("rx_item"), *(F.when(paired, c).alias(k) for k, c in of_pair.items()), wrong.alias("total"), rules.expiry_code(days).alias("expired"),
        *(F.when(x < 1, "LOW_CONFIDENCE_FIELD").alias(k) for k, x in (("rx_name", F.col("rx.name_agreement")), ("bill_name", F.col("name_agreement")))), F.when(documents.outside_medicine(), "NON_MEDICINE_ITEM").alias("outside"),
        (~priced).alias("unpriced"), F.coalesce(F.col("known") & days.isNull(), F.lit(False)).alias("undated"), F.col("salt").isNull().alias("unsalted"),
    )
    scan = Window.partitionBy("scan_id")
    by = scan.orderBy("salt", "ordinal")
    before, after = F.lag("salt").over(by), F.lead("salt").over(by)
    placed = each.withColumns({"place": F.row_number().over(by), "before": before, "after": after, **{f"{k}_any": F.bool_or(k).over(scan) for k in CHECKS}})
    therapy = F.when((F.col("salt") == F.col("after")) & ~F.col("before").eqNullSafe(F.col("salt")), "DUPLICATE_THERAPY")
    first = F.col("place") == 1
    return placed.select("scan_id", "ordinal", "line_total", "rx_item", F.col("item_id").alias("bill_item"), therapy.alias("therapy"), *(k for k in CODES if k != "therapy"), *((first & F.col(f"{k}_any")).alias(k) for k in CHECKS))


def findings(held: DataFrame) -> DataFrame:
    """The findings of judged lines, as `rules` tell them."""
    null = F.lit(None).cast("string")
    item = lambda has, c: F.col(c) if has else null
    each = [F.struct(F.col(k).alias("rule_code"), item(rx, "rx_item").alias("prescribed_ref"), item(bill, "bill_item").alias("billed_ref"), F.lit(check).cast("string").alias("check_name")) for k, (rx, bill, check) in CODES.items()]
    each += [F.struct(F.when(F.col(k), rules.UNAVAILABLE).alias("rule_code"), null.alias("prescribed_ref"), null.alias("billed_ref"), F.lit(check).alias("check_name")) for k, check in CHECKS.items()]
    told = held.select("scan_id", F.explode(F.array(*each)).alias("t")).select("scan_id", "t.*").where("rule_code IS NOT NULL")
    check = F.when(F.col("rule_code") == rules.UNAVAILABLE, F.col("check_name"))
    return told.select("scan_id", "rule_code", severity(F.col("rule_code")).alias("severity"), "prescribed_ref", "billed_ref", check.alias("check_name"), null.alias("detail"))


def _any(of: list[str], cond) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(cond(F.col(k)), F.lit(False)) for k in of))


def _count(of: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(k).isNotNull().cast("bigint") for k in of))


def row_states(held: DataFrame, *keep: Column) -> DataFrame:
    """`review.row_states` of judged lines, with the columns to `keep`."""
    codes = list(CODES)
    remarks = F.array_distinct(F.array_compact(F.array(*(F.when(F.col(k).isin(*review.REMARKS), F.struct(review.rank(F.col(k), review.REMARKS).alias("k"), F.col(k).alias("code"))) for k in codes))))
    rows = held.select(
        *keep, "scan_id", "rx_item", "bill_item", "line_total", text.row_key(F.col("rx_item"), F.col("bill_item")).alias("row_key"),
        _any(codes, lambda c: c.isin(*CRITICAL)).alias("critical"), _any(codes, lambda c: c.isin(*WARNING)).alias("warning"), F.col("outside").isNotNull().alias("other"), F.col("brand").isNotNull().alias("substitution"),
        _any(codes, lambda c: c.isin(*money.UNCHECKED)).alias("open"), _count(codes).alias("n_findings"), remarks.alias("told"),
    )
    return review.states_of(rows.withColumns({"remark": F.array_min("told")["code"], "remarks": F.size("told").cast("bigint")}), *rows.columns[: len(keep)])


def field_marks(held: DataFrame) -> DataFrame:
    """`review.field_marks` of judged lines."""
    field = F.try_element_at(F.create_map(*(F.lit(x) for pair in review.FIELDS.items() for x in pair)), F.col("code"))
    each = held.select("scan_id", text.row_key(F.col("rx_item"), F.col("bill_item")).alias("row_key"), F.explode(F.array(*CODES)).alias("code")).where("code IS NOT NULL").withColumn("field", field).where("field IS NOT NULL")
    return each.groupBy("scan_id", "row_key", "field").agg(F.min_by(severity(F.col("code")), review.rank(severity(F.col("code")), review.SEVERITIES)).alias("severity"))


def headlines(held: DataFrame) -> DataFrame:
    """`review.headlines` of judged lines, with those of their scans' checks."""
    code = lambda c: F.struct((c != review.PINNED).alias("other"), review.rank(severity(c), review.SEVERITIES).alias("loud"), review.rank(c, review.SPECIFIC).alias("special"), c.alias("code"))
    told = held.where(_any(list(CODES), lambda c: c.isNotNull())).select("scan_id", F.coalesce("rx_item", "bill_item").alias("item"), F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), code(F.col(k))) for k in CODES))).alias("told"))
    loudest = F.array_min(F.transform("told", lambda t: t["loud"]))
    lines = told.select("scan_id", "item", F.get(F.array(*map(F.lit, review.SEVERITIES)), loudest - 1).alias("severity"), F.array_min("told")["code"].alias("headline"), (F.size("told") - 1).cast("bigint").alias("more"))
    whole = held.where(_any(list(CHECKS), lambda c: c)).select("scan_id", F.explode(F.array(*CHECKS)).alias("x")).where("x")
    return lines.union(whole.select("scan_id", F.lit(None).cast("string").alias("item"), F.lit("info").alias("severity"), F.lit(rules.UNAVAILABLE).alias("headline"), F.lit(0).cast("bigint").alias("more")))


def line_states(held: DataFrame) -> DataFrame:
    """`money.line_states` of judged lines by the rules alone, with `paired`."""
    codes = [k for k, (_, bill, _) in CODES.items() if bill and k != "outside"]
    no = F.lit(False)
    rows = held.select(
        "scan_id", F.col("bill_item").alias("item_id"), "line_total", F.col("rx_item").isNotNull().alias("paired"), _any(codes, lambda c: c.isin(*CRITICAL)).alias("critical"), _any(codes, lambda c: c.isin(*WARNING)).alias("warning"),
        no.alias("non_medicine"), F.col("brand").isNotNull().alias("substitution"), no.alias("not_eligible"), no.alias("overriding"), _any(codes, lambda c: c.isin(*money.UNCHECKED)).alias("unchecked"),
    )
    return money.states_of(rows, "paired")
