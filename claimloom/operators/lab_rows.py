"""Rows of laboratory tests as a report shows them: every ordered and every billed test is accounted for.

An ordered test that is met makes a row with the billed line that is first among those covering it. A panel consumes further lines; each
of these that leads no pair has a clean row of its own, which names what covers it. What is left on either side has a row without a
counterpart. A line that several orders are met by leads a row for each of them, as each is a claim on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.lab import pair_tests
from claimloom.operators.money import UNCHECKED
from claimloom.operators.review import findings_of


def label() -> Column:
    """What to call a test: its name, or what was written where no name was read."""
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(filled("test_name"), filled("raw_text"))


def rows_of_tests(ordered: DataFrame, billed: DataFrame, panels: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(scan_id, row_key, rx_item, bill_item, covers_count, covered_by, covered) of resolved tests; `pairs` as in `lab.lab_findings`."""
    met = (pair_tests(ordered, billed, panels) if pairs is None else pairs).where("found > 0").select("scan_id", "rx_item", "bill_item", "covers")
    none, zero = F.lit(None).cast("string"), F.lit(0)
    orders = ordered.select("scan_id", F.col("item_id").alias("rx_item"), "ordinal", label().alias("label"))
    both = orders.join(met, ["scan_id", "rx_item"], "left")
    key = F.when(F.col("bill_item").isNull(), F.concat(F.lit("rxt-"), "rx_item")).otherwise(F.concat_ws("-", "rx_item", "bill_item"))
    asked = both.select("scan_id", key.alias("row_key"), "rx_item", "bill_item", F.coalesce(F.size("covers"), zero).alias("covers_count"), none.alias("covered_by"), F.lit(False).alias("covered"))

    used = both.where("bill_item IS NOT NULL").select("scan_id", "bill_item", "ordinal", "label", F.explode("covers").alias("item_id"))
    leads = F.bool_or(F.col("item_id") == F.col("bill_item"))
    last = F.max_by("label", F.when(F.col("label").isNotNull(), F.col("ordinal")))
    lines = billed.select("scan_id", "item_id").join(used.groupBy("scan_id", "item_id").agg(leads.alias("leads"), last.alias("covered_by")), ["scan_id", "item_id"], "left")
    covered = F.col("leads").isNotNull()
    rest = lines.where("leads IS NULL OR NOT leads")
    bill_key = F.concat(F.when(covered, "covered-").otherwise("bt-"), "item_id")
    return asked.union(rest.select("scan_id", bill_key, none, "item_id", zero, F.when(covered, F.col("covered_by")), covered))


def states_of_tests(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows with state, partial, number of findings and whether an amount can be claimed: for pairs, and for lines a panel covers."""
    code, has = F.col("rule_code"), lambda c: F.bool_or(c)
    folded = findings_of(rows.where("NOT covered"), findings).groupBy("scan_id", "row_key").agg(
        has(F.col("severity") == "critical").alias("critical"),
        has(F.col("severity") == "warning").alias("warning"),
        has(code.isin(*UNCHECKED)).alias("open"),
        F.count("*").alias("n_findings"),
    )
    told = rows.join(folded, ["scan_id", "row_key"], "left").fillna(False, ["critical", "warning", "open"]).fillna(0, ["n_findings"])
    paired = F.col("rx_item").isNotNull() & F.col("bill_item").isNotNull()
    state = F.when(F.col("critical"), "problem").when(F.col("warning"), "warning").when(paired | F.col("covered"), "clean").otherwise("unchecked")
    told = told.withColumn("state", state)
    claimable = paired | (F.col("bill_item").isNotNull() & (F.col("state") == "clean") & (F.col("n_findings") == 0))
    partial = F.col("open") & (F.col("state") != "unchecked")
    return told.select("scan_id", "row_key", "rx_item", "bill_item", "state", partial.alias("partial"), "n_findings", "covers_count", "covered_by", claimable.alias("claimable"))


def counts(rows: DataFrame) -> DataFrame:
    """(scan_id, matched, problems, lines_billed): the figures of a summary, and the billed lines that the rows account for, each once."""
    return rows.groupBy("scan_id").agg(
        F.count_if(F.col("state").isin("clean", "substitution")).alias("matched"),
        F.count_if(F.col("state").isin("problem", "warning")).alias("problems"),
        F.count_distinct("bill_item").alias("lines_billed"),
    )
