"""Queries over rows of laboratory tests and over totals of what a claim leaves out, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import lab, listing, money
from claimloom.operators import lab_rows as rows
from claimloom.plans import documents, review, store
from claimloom.plans.claims import SCANS, bill_items, plain, scans
from claimloom.plans.documents import BILLED, ORDERED, facts, paired_tests
from claimloom.plans.registry import same_place
from claimloom.session import laid_out


def lab_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    panels = lab.panel_table(spark)
    ordered, billed, pairs = paired_tests(spark, sf_dir, panels)
    found = laid_out(lab.lab_findings(ordered, billed, facts(spark, sf_dir), panels, pairs))
    return rows.states_of_tests(laid_out(rows.rows_of_tests(ordered, billed, panels, pairs)), found)


def lab_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.counts(lab_rows(spark, sf_dir))


def excluded_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, bill = same_place(spark, sf_dir), bill_items(spark, sf_dir)
    matched = pairs.select("scan_id", F.col("bill_item").alias("item_id"))
    return money.excluded(money.line_states(bill.select("scan_id", "item_id", "line_total"), review._findings(spark, sf_dir), matched))


def uncertified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.uncertified(store.scan_states(spark, sf_dir).join(scans(spark, sf_dir).select("scan_id", "employee_number"), "scan_id"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (lab_rows, lab_row_counts, excluded_totals, uncertified)

_LABEL = "coalesce(nullif(trim(test_name), ''), nullif(trim(raw_text), ''))"
_UNCHECKED = ", ".join(f"'{x}'" for x in money.UNCHECKED)
_ROWS = f"""
WITH p AS ({documents.ORACLE["lab_pairs"]}),
  f AS ({documents.ORACLE["lab_rules"]}),
  o AS (SELECT scan_id, item_id, ordinal, {_LABEL} AS label FROM ({plain(ORDERED)}) x),
  b AS (SELECT scan_id, item_id FROM ({plain(BILLED)}) x),
  c AS (SELECT p.scan_id, rx_item, bill_item, unnest(string_split(covers, ',')) AS item_id FROM p),
  used AS (
    SELECT c.scan_id, c.item_id, bool_or(c.item_id = c.bill_item) AS leads, arg_max(label, ordinal) FILTER (label IS NOT NULL) AS covered_by
    FROM c JOIN o ON o.scan_id = c.scan_id AND o.item_id = c.rx_item GROUP BY ALL),
  k AS (
    SELECT scan_id, rx_item || '-' || bill_item AS row_key, rx_item, bill_item, len(string_split(covers, ',')) AS covers_count, NULL AS covered_by, false AS covered FROM p
    UNION ALL
    SELECT scan_id, 'rxt-' || item_id, item_id, NULL, 0, NULL, false FROM o WHERE NOT EXISTS (FROM p WHERE p.scan_id = o.scan_id AND p.rx_item = o.item_id)
    UNION ALL
    SELECT scan_id, 'covered-' || item_id, NULL, item_id, 0, covered_by, true FROM b JOIN used USING (scan_id, item_id) WHERE NOT leads
    UNION ALL
    SELECT scan_id, 'bt-' || item_id, NULL, item_id, 0, NULL, false FROM b WHERE NOT EXISTS (FROM used u WHERE u.scan_id = b.scan_id AND u.item_id = b.item_id)),
  own AS (
    SELECT k.scan_id, row_key, rule_code, severity FROM k JOIN f ON f.scan_id = k.scan_id AND f.prescribed_ref = k.rx_item
    WHERE f.billed_ref IS NULL OR k.bill_item IS NULL OR f.billed_ref = k.bill_item
    UNION ALL
    SELECT k.scan_id, row_key, rule_code, severity FROM k JOIN f ON f.scan_id = k.scan_id AND f.billed_ref = k.bill_item
    WHERE NOT covered AND (f.prescribed_ref IS NULL OR k.rx_item IS NULL)),
  g AS (
    SELECT scan_id, row_key, bool_or(severity = 'critical') AS bad, bool_or(severity = 'warning') AS warn, bool_or(rule_code IN ({_UNCHECKED})) AS open, count(*) AS n
    FROM own GROUP BY ALL),
  s AS (
    SELECT k.*, coalesce(open, false) AS open, coalesce(n, 0) AS n_findings,
      CASE WHEN bad THEN 'problem' WHEN warn THEN 'warning' WHEN covered OR rx_item IS NOT NULL AND bill_item IS NOT NULL THEN 'clean' ELSE 'unchecked' END AS state
    FROM k LEFT JOIN g USING (scan_id, row_key)),
  shown AS (
    SELECT scan_id, row_key, rx_item, bill_item, state, open AND state <> 'unchecked' AS partial, n_findings, covers_count, covered_by,
      bill_item IS NOT NULL AND (rx_item IS NOT NULL OR state = 'clean' AND n_findings = 0) AS claimable
    FROM s)"""

ORACLE: dict[str, str] = {
    "lab_rows": f"{_ROWS} SELECT * FROM shown",
    "lab_row_counts": f"""{_ROWS}
      SELECT scan_id, count(*) FILTER (state = 'clean') AS matched, count(*) FILTER (state IN ('problem', 'warning')) AS problems, count(DISTINCT bill_item) AS lines_billed
      FROM shown GROUP BY scan_id""",
    "excluded_totals": f"""{review._FOUND},
      t AS (
        SELECT scan_id, billed_ref AS item_id, bool_or(rule_code = 'NON_MEDICINE_ITEM') AS other,
          bool_or(rule_code IN {review._quoted(money.NOT_ELIGIBLE)}) AS barred, bool_or(rule_code IN {review._quoted(money.OVER_NON_MEDICINE)}) AS over
        FROM every WHERE billed_ref IS NOT NULL GROUP BY ALL),
      x AS (
        SELECT scan_id, line_total, CASE WHEN other AND NOT over THEN 'non_medicine' WHEN barred THEN 'not_eligible' END AS bucket
        FROM bill JOIN t USING (scan_id, item_id) WHERE line_total IS NOT NULL)
      SELECT scan_id, count(*) FILTER (bucket = 'not_eligible') AS not_prescribed, count(*) FILTER (bucket = 'non_medicine') AS non_medicine,
        CAST(sum(line_total) AS DECIMAL(18,2)) AS excluded
      FROM x WHERE bucket IS NOT NULL GROUP BY scan_id""",
    "uncertified": f"""
      SELECT employee_number, count(*) FILTER (certified_at IS NULL) AS uncertified, count(*) AS scans
      FROM ({store.ORACLE["scan_states"]}) s JOIN ({plain(SCANS)}) a ON a.scan_id = s.scan_id GROUP BY 1""",
}
