"""Queries over dosing, packs, totals, counterparts, tests, readings and listings, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import forms, sig, units
from claimloom.operators import amounts, consensus, counterparts, engine, history, lab, listing, money, pairing, resolution, rules
from claimloom.plans.claims import BILL_ITEMS, RX_ITEMS, bill_items, plain, rx_items, scans, view
from claimloom.plans.registry import ALL, SAME_PLACE, WITH, assignment_pairs, findings, same_place

SIGS = """
SELECT p_partkey AS item, CASE p_partkey % 14 WHEN 0 THEN 'OD' WHEN 1 THEN '1-0-1' WHEN 2 THEN 'bd' WHEN 3 THEN '1–1–1' WHEN 4 THEN 'SOS' WHEN 5 THEN '½-0-1½' WHEN 6 THEN 'TDS after food'
    WHEN 7 THEN '1/2-0-1' WHEN 8 THEN 'twice  daily' WHEN 9 THEN NULL WHEN 10 THEN '1 + 1' WHEN 11 THEN '1-x-1' WHEN 12 THEN '1 tab prn' ELSE 'weekly' END AS frequency,
  CASE p_partkey % 9 WHEN 0 THEN '5/7' WHEN 1 THEN '2/52' WHEN 2 THEN '1/12' WHEN 3 THEN 'x 7 days' WHEN 4 THEN '2 Weeks' WHEN 5 THEN '1 month' WHEN 6 THEN '10' WHEN 7 THEN NULL ELSE '৫ days' END AS duration,
  CASE p_partkey % 11 WHEN 0 THEN '10''S' WHEN 1 THEN '15ML' WHEN 2 THEN '1.5 l' WHEN 3 THEN 'Strip of  10' WHEN 4 THEN '2x15' WHEN 5 THEN '10 TAB' WHEN 6 THEN '1 Vial' WHEN 7 THEN 'loose' WHEN 8 THEN NULL WHEN 9 THEN ' ' ELSE '10T' END AS pack,
  CAST(p_size AS DOUBLE) AS strength, CASE p_partkey % 8 WHEN 0 THEN 'g' WHEN 1 THEN 'MG' WHEN 2 THEN 'mcg' WHEN 3 THEN 'L' WHEN 4 THEN 'iu' WHEN 5 THEN 'puffs' WHEN 6 THEN NULL ELSE ' ml ' END AS unit
FROM {part}"""
HEADERS = f"""
SELECT scan_id, CASE WHEN scan_id % 11 = 0 THEN NULL ELSE CAST(sum(coalesce(line_total, 0)) + max(CASE WHEN scan_id % 7 = 0 THEN 5 WHEN scan_id % 4 = 1 THEN -3 ELSE 0 END) AS DECIMAL(18,2)) END AS subtotal,
  CASE WHEN scan_id % 4 = 1 THEN CAST(3 AS DECIMAL(18,2)) END AS discount_total, CASE WHEN scan_id % 13 = 0 THEN NULL ELSE CAST(12 AS DECIMAL(18,2)) END AS tax_total,
  CAST(sum(coalesce(line_total, 0)) + max(CASE WHEN scan_id % 5 = 0 THEN 0 WHEN scan_id % 5 = 1 THEN 40 ELSE 12 END) AS DECIMAL(18,2)) AS grand_total FROM ({BILL_ITEMS}) b GROUP BY scan_id"""
ORDERED = f"SELECT scan_id, ordinal, item_id, CASE (scan_id + ordinal) % 5 WHEN 0 THEN 'Thyroid Profile' WHEN 1 THEN 'T3' WHEN 2 THEN 'Lipid Profile' WHEN 3 THEN 'Glucose Fasting' END AS test_name FROM ({BILL_ITEMS}) b WHERE ordinal <= 2"
BILLED = f"SELECT scan_id, ordinal, item_id, CASE (scan_id * 3 + ordinal) % 8 WHEN 0 THEN 'T3' WHEN 1 THEN 'T4' WHEN 2 THEN 'TSH' WHEN 3 THEN 'LDL' WHEN 4 THEN 'HDL' WHEN 5 THEN 'Total Cholesterol' WHEN 6 THEN 'Thyroid Profile' END AS test_name FROM ({BILL_ITEMS}) b"
REPORTED = f"SELECT scan_id, ordinal, item_id, CASE (scan_id + 2 * ordinal) % 6 WHEN 0 THEN 'T3' WHEN 1 THEN 'TSH' WHEN 2 THEN 'VLDL' WHEN 3 THEN 'LDL' WHEN 4 THEN 'Glucose Fasting' ELSE 'T4' END AS test_name FROM ({BILL_ITEMS}) b WHERE scan_id % 3 = 0"
PANELS = "SELECT * FROM (VALUES ('Thyroid Profile', 'T3', true), ('Thyroid Profile', 'T4', true), ('Thyroid Profile', 'TSH', true), ('Lipid Profile', 'Total Cholesterol', true), ('Lipid Profile', 'Triglycerides', true), ('Lipid Profile', 'HDL', true), ('Lipid Profile', 'LDL', true), ('Lipid Profile', 'VLDL', false)) AS t(panel, component, billable)"
VOTES = f"SELECT scan_id, ordinal AS run, CASE WHEN ordinal % 5 = 0 THEN NULL ELSE form END AS value FROM ({BILL_ITEMS}) b"
BOXES = "SELECT p_partkey AS item, CAST(p_partkey % 7 AS DOUBLE) AS l1, CAST(p_partkey % 5 AS DOUBLE) AS t1, CAST(p_partkey % 7 + 4 AS DOUBLE) AS r1, CAST(p_partkey % 5 + 3 AS DOUBLE) AS b1, CAST(p_size % 8 AS DOUBLE) AS l2, CAST(p_size % 6 AS DOUBLE) AS t2, CAST(p_size % 8 + 3 AS DOUBLE) AS r2, CAST(p_size % 6 + 4 AS DOUBLE) AS b2 FROM {part}"
DICTIONARY = "SELECT upper(p_name) AS brand, upper(p_type) AS salt, p_partkey AS ordinal, CASE WHEN p_partkey % 40 = 0 THEN 'X' WHEN p_size > 45 THEN 'H1' WHEN p_size > 30 THEN 'H' ELSE 'OTC' END AS schedule FROM {part}"
NAMES = "SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN upper(p_type) WHEN 1 THEN concat(upper(p_name), ' XR') WHEN 2 THEN replace(upper(p_name), 'D', 'T') ELSE upper(p_name) END AS name FROM {part}"


def sig_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, SIGS).select("item", sig.doses_per_day(F.col("frequency")).alias("per_day"), sig.duration_days(F.col("duration")).alias("days"))
    return rows.withColumn("expected", sig.expected_units(F.col("per_day"), F.col("days"), F.lit(1.0)))


def pack_size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SIGS).select("item", units.pack_size(F.col("pack")).alias("p")).select("item", "p.method", "p.units", "p.volume")


def strength_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SIGS).select("item", units.normalise_strength(F.col("strength"), F.col("unit")).alias("s")).select("item", "s.value", "s.unit")


def total_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money.total_checks(view(spark, sf_dir, HEADERS), bill_items(spark, sf_dir))


def row_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = same_place(spark, sf_dir).select("scan_id", F.col("bill_item").alias("item_id"))
    return money.line_states(bill_items(spark, sf_dir).select("scan_id", "item_id", "line_total"), findings(spark, sf_dir), matched).drop("line_total")


def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = same_place(spark, sf_dir).select("scan_id", F.col("bill_item").alias("item_id"))
    return money.category_totals(money.line_states(bill_items(spark, sf_dir).select("scan_id", "item_id", "line_total"), findings(spark, sf_dir), matched))


def counterpart_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx, bill = rx_items(spark, sf_dir), bill_items(spark, sf_dir)
    pairs = rx.where("ordinal % 3 <> 0").select("scan_id", "ordinal", F.col("item_id").alias("rx_item")).join(bill.select("scan_id", "ordinal", F.col("item_id").alias("bill_item")), ["scan_id", "ordinal"])
    return counterparts.unmatched_findings(pairing.unmatched(rx, pairs, "rx_item"), pairing.unmatched(bill, pairs, "bill_item")).drop("check_name", "detail")


def quantity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = sig.expected_units(F.col("scan_id") % 3 + 1, F.when(F.col("ordinal") % 5 != 0, 10), F.lit(1))
    per_pack, basis = F.when(F.col("ordinal") % 4 != 0, 10), F.when(F.col("ordinal") % 3 == 0, "unit").when(F.col("ordinal") % 3 == 1, "pack")
    return bill_items(spark, sf_dir).select("scan_id", "item_id", counterparts.quantity_code(due, F.col("quantity"), per_pack, basis).alias("rule_code"))


def _tests(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return lab.components(view(spark, sf_dir, sql), spark.sql(PANELS))


def lab_component_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.coverage(_tests(spark, sf_dir, ORDERED), _tests(spark, sf_dir, BILLED))


def report_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.report_axis(*(_tests(spark, sf_dir, x) for x in (ORDERED, BILLED, REPORTED)))


def consensus_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.field_mode(view(spark, sf_dir, VOTES), ["scan_id"])


def consensus_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = view(spark, sf_dir, BILL_ITEMS).select("drug_name", F.pmod("scan_id", F.lit(3)).alias("run"), F.pmod("ordinal", F.lit(50)).alias("line"), F.floor(F.col("scan_id") / 30).alias("doc"))
    return consensus.majority(seen, ["doc", "line", "drug_name"], 3)


def bbox_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda k: F.array(*(F.col(f"{side}{k}") for side in "ltrb"))
    return view(spark, sf_dir, BOXES).select("item", F.round(consensus.iou(box(1), box(2)), 6).alias("iou"))


def line_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.line_overlap(scans(spark, sf_dir), bill_items(spark, sf_dir), 0.2)


def scan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.filtered(scans(spark, sf_dir), review="reviewed", name="1", bill_no="b-4", since=date(1993, 1, 1), until=date(1997, 12, 31)).select("scan_id", "bill_no", "created_on")


def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.visible(scans(spark, sf_dir), 7).select("scan_id", "employee_number")


def count_by_employee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.count_by(scans(spark, sf_dir), "employee_number")


def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.review_progress(scans(spark, sf_dir), history.allowance_year(F.col("created_on")), "1995-96")


def exact_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.exact(view(spark, sf_dir, NAMES), view(spark, sf_dir, DICTIONARY))


def schedule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, DICTIONARY)
    return resolution.schedule_of(rows.select("salt").distinct(), rows)


def fuzzy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.alike(view(spark, sf_dir, NAMES), view(spark, sf_dir, DICTIONARY))


# The same over the optimal assignment and with every rule; SQL can't follow the assignment, so these have none.


def whole_unmatched_billed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.unmatched(bill_items(spark, sf_dir), assignment_pairs(spark, sf_dir), "bill_item").select("scan_id", "item_id", "drug_name")


def whole_strength_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.strength_and_form(assignment_pairs(spark, sf_dir), rx_items(spark, sf_dir), bill_items(spark, sf_dir))


def whole_counterpart_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx, bill, pairs = rx_items(spark, sf_dir), bill_items(spark, sf_dir), assignment_pairs(spark, sf_dir)
    return counterparts.unmatched_findings(pairing.unmatched(rx, pairs, "rx_item"), pairing.unmatched(bill, pairs, "bill_item"))


#: Lines as written: names with slips of the pen, dosing, courses and packs; and what names stand for.
RX_WRITTEN = f"""
SELECT r.*, CASE WHEN drug_name IS NULL THEN NULL WHEN (scan_id + ordinal) % 11 = 0 THEN concat('Tab. ', replace(salt, 'd', 't'), ' 500mg BD') ELSE concat('TAB ', salt, ' OD x 5/7') END AS raw,
  CASE (scan_id + ordinal) % 6 WHEN 0 THEN 'BD' WHEN 1 THEN NULL WHEN 2 THEN 'TDS' WHEN 3 THEN 'SOS' ELSE concat(CAST(scan_id % 3 AS STRING), '-', CAST(ordinal % 2 AS STRING), '-1') END AS frequency_raw,
  CASE (scan_id + 2 * ordinal) % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(CAST(ordinal + 2 AS STRING), '/7') ELSE concat(CAST(scan_id % 20 + 1 AS STRING), ' days') END AS duration_raw,
  CAST(CASE WHEN scan_id % 13 = 0 THEN 6 END AS INT) AS duration_days, CAST(CASE WHEN ordinal % 3 = 0 THEN NULL ELSE ordinal % 3 END AS DOUBLE) AS dose_per_administration
FROM ({RX_ITEMS}) r"""
BILL_WRITTEN = f"""
SELECT b.*, CASE WHEN salt IS NULL THEN NULL ELSE raw_text END AS raw,
  CASE (scan_id + ordinal) % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(CAST(ordinal * 5 AS STRING), '''s') WHEN 2 THEN 'Strip of 10' WHEN 3 THEN '15ml' ELSE concat('2x', CAST(ordinal + 3 AS STRING)) END AS pack_size
FROM ({BILL_ITEMS}) b"""
NAMED = "SELECT upper(p_name) AS brand, upper(split_part(p_name, ' ', 2)) AS salt, split_part(p_name, ' ', 1) AS therapeutic_class, p_partkey AS ordinal, CASE WHEN p_partkey % 40 = 0 THEN 'X' WHEN p_size > 45 THEN 'H1' WHEN p_size > 30 THEN 'H' ELSE 'OTC' END AS schedule FROM {part}"


def amounts_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of lines paired by their place, as SQL can pair them."""
    rows = amounts.compared(same_place(spark, sf_dir), view(spark, sf_dir, RX_WRITTEN), view(spark, sf_dir, BILL_WRITTEN))
    return rows.select("scan_id", "rx_item", "bill_item", "expected_units", "billed_units", "units_per_pack", "units_basis", "basis_method", F.array_join("missing", ",").alias("missing"), "rule_code")


def _whole(spark: SparkSession, sf_dir: str) -> engine.Outcome:
    from claimloom.operators import lab
    from claimloom.plans import documents as d

    tests = (lab.resolve_names(view(spark, sf_dir, x)) for x in (d.ORDERED, d.BILLED, d.REPORTED))
    rx, bill = (view(spark, sf_dir, x) for x in (RX_WRITTEN, BILL_WRITTEN))
    return engine.reconcile(engine.Claims(rx, bill, d.facts(spark, sf_dir), *tests, view(spark, sf_dir, NAMED), total_checks(spark, sf_dir)))


def whole_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).findings


def whole_verdict_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).verdicts


def whole_rule_histogram_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.frequent_codes(whole_findings(spark, sf_dir), scans(spark, sf_dir))


def _whole_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _whole(spark, sf_dir)
    return money.line_states(bill_items(spark, sf_dir).select("scan_id", "item_id", "line_total"), whole.findings, whole.pairs.select("scan_id", F.col("bill_item").alias("item_id")))


def whole_row_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_states(spark, sf_dir).drop("line_total")


def whole_category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money.category_totals(_whole_states(spark, sf_dir))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (sig_parse, pack_size_parse, strength_normalise, total_checks, row_status, category_totals, counterpart_rules, quantity_rules, lab_component_join, report_axis, consensus_mode, consensus_majority, bbox_iou, line_overlap, scan_filters, visibility, count_by_employee, review_progress, exact_resolution, schedule_lookup, fuzzy_resolution, amounts_due,
    whole_unmatched_billed, whole_strength_rules, whole_counterpart_rules, whole_findings, whole_verdict_score, whole_rule_histogram_top20, whole_row_status, whole_category_totals)

_SIGS = f"WITH s AS ({plain(SIGS)})"
_STATES = f"""{ALL}, told AS (SELECT scan_id, billed_ref AS item_id, bool_or(severity = 'critical') AS c, bool_or(severity = 'warning') AS w, bool_or(rule_code = 'BRAND_SUBSTITUTION') AS sub, bool_or(rule_code IN ('CHECK_UNAVAILABLE', 'STRENGTH_UNIT_UNSTATED')) AS un FROM found WHERE billed_ref IS NOT NULL GROUP BY ALL),
  states AS (SELECT b.scan_id, b.item_id, line_total, CASE WHEN c THEN 'problem' WHEN w THEN 'warning' WHEN p.scan_id IS NULL THEN 'unchecked' WHEN sub THEN 'substitution' ELSE 'clean' END AS state,
    coalesce(un AND (c OR w OR p.scan_id IS NOT NULL), false) AS partial, CASE WHEN un OR c OR w OR p.scan_id IS NULL THEN 'needs_review' ELSE 'eligible' END AS bucket
    FROM bill b LEFT JOIN told t ON b.scan_id = t.scan_id AND b.item_id = t.item_id LEFT JOIN pairs p ON b.scan_id = p.scan_id AND b.item_id = p.bill_item)"""
_TESTS = f"""WITH panels AS ({PANELS}), """ + ", ".join(f"{n} AS (SELECT scan_id, item_id, test_name, coalesce(component, test_name) AS component, coalesce(billable, true) AS billable FROM ({plain(x)}) q LEFT JOIN panels ON panel = test_name WHERE test_name IS NOT NULL)" for n, x in (("asked", ORDERED), ("charged", BILLED), ("told", REPORTED)))
_OTHER_FORMS = "(" + ", ".join(f"'{x}'" for x in forms.NON_MEDICINE_FORMS) + ")"
_NO_MEDICINE = f"regexp_matches(lower(coalesce(o.drug_name, '') || ' ' || coalesce(o.raw_text, '')), '{'|'.join(forms.NON_MEDICINE_WORDS)}') OR coalesce(o.form IN {_OTHER_FORMS}, false)"
_SURE = "salt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {other} o WHERE o.scan_id = a.scan_id AND o.salt IS NULL{more})"

ORACLE: dict[str, str] = {
    "sig_parse": _SIGS + r""", n AS (SELECT item, upper(replace(regexp_replace(frequency, '\s+', ' ', 'g'), '–', '-')) AS f, lower(replace(duration, '৫', '5')) AS d FROM s),
      p AS (SELECT item, CASE f WHEN 'OD' THEN 1.0 WHEN '1-0-1' THEN 2.0 WHEN 'BD' THEN 2.0 WHEN '1-1-1' THEN 3.0 WHEN '½-0-1½' THEN 2.0 WHEN 'TDS AFTER FOOD' THEN 3.0 WHEN '1/2-0-1' THEN 1.5 WHEN 'TWICE DAILY' THEN 2.0 WHEN '1 + 1' THEN 2.0 END::DOUBLE AS per_day,
        CASE d WHEN '5/7' THEN 5 WHEN '2/52' THEN 14 WHEN '1/12' THEN 30 WHEN 'x 7 days' THEN 7 WHEN '2 weeks' THEN 14 WHEN '1 month' THEN 30 WHEN '5 days' THEN 5 END AS days FROM n) SELECT item, per_day, days, per_day * days AS expected FROM p""",
    "pack_size_parse": _SIGS + """ SELECT item, CASE p WHEN 0 THEN 'apostrophe_s' WHEN 1 THEN 'volume' WHEN 2 THEN 'volume' WHEN 3 THEN 'strip_of' WHEN 4 THEN 'multiplier' WHEN 5 THEN 'count_unit' WHEN 6 THEN 'singular' WHEN 7 THEN 'unrecognised' WHEN 10 THEN 'count_unit' END AS method,
      CASE p WHEN 0 THEN 10 WHEN 3 THEN 10 WHEN 4 THEN 30 WHEN 5 THEN 10 WHEN 6 THEN 1 WHEN 10 THEN 10 END AS units, CASE p WHEN 1 THEN 15.0 WHEN 2 THEN 1500.0 END::DOUBLE AS volume FROM (SELECT item, item % 11 AS p FROM s)""",
    "strength_normalise": _SIGS + """ SELECT item, strength * CASE WHEN lower(trim(unit)) IN ('g', 'l') THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS value, CASE lower(trim(unit)) WHEN 'g' THEN 'mg' WHEN 'mg' THEN 'mg' WHEN 'mcg' THEN 'mcg' WHEN 'l' THEN 'ml' WHEN 'ml' THEN 'ml' WHEN 'iu' THEN 'IU' END AS unit FROM s""",
    "total_checks": f"""WITH bill AS ({plain(BILL_ITEMS)}), h AS ({plain(HEADERS)}), t AS (SELECT scan_id, CASE WHEN count(*) = count(line_total) THEN CAST(sum(line_total) AS DECIMAL(18,2)) END AS line_sum FROM bill GROUP BY scan_id)
      SELECT scan_id, line_sum, CASE WHEN subtotal IS NULL OR line_sum IS NULL THEN 'CHECK_UNAVAILABLE' WHEN abs(line_sum - coalesce(discount_total, 0) - subtotal) > 1 AND (discount_total IS NULL OR abs(line_sum - subtotal) > 1) THEN 'SUBTOTAL_MISMATCH' END AS subtotal_code,
        CASE WHEN subtotal IS NULL OR tax_total IS NULL OR grand_total IS NULL THEN 'CHECK_UNAVAILABLE' WHEN tax_total > 0 AND abs(subtotal - coalesce(discount_total, 0) - grand_total) <= 1 THEN 'TAX_INCLUSIVE_PRICING' WHEN abs(subtotal - coalesce(discount_total, 0) + tax_total - grand_total) > 1 THEN 'GRAND_TOTAL_MISMATCH' END AS grand_code FROM h JOIN t USING (scan_id)""",
    "row_status": f"{_STATES} SELECT scan_id, item_id, state, partial, bucket FROM states",
    "category_totals": f"""{_STATES} SELECT scan_id, CAST(coalesce(sum(line_total) FILTER (bucket = 'eligible'), 0) AS DECIMAL(18,2)) AS eligible, CAST(coalesce(sum(line_total) FILTER (bucket = 'needs_review'), 0) AS DECIMAL(18,2)) AS needs_review,
      CAST(0 AS DECIMAL(18,2)) AS not_eligible, CAST(0 AS DECIMAL(18,2)) AS non_medicine, count(*) - count(line_total) AS lines_without_amount FROM states GROUP BY scan_id""",
    "counterpart_rules": f"""{WITH}, ra AS (SELECT * FROM rx WHERE ordinal % 3 = 0), ba AS (SELECT * FROM bill WHERE ordinal % 3 = 0 OR (scan_id + ordinal) % 7 = 0),
      j AS (SELECT scan_id, 'RX_NOT_BILLED' AS rule_code, CASE WHEN {_SURE.format(other="ba", more=f" AND NOT ({_NO_MEDICINE})")} THEN 'critical' ELSE 'warning' END AS severity, item_id AS prescribed_ref, NULL AS billed_ref FROM ra a
        UNION ALL SELECT scan_id, 'BILL_NOT_PRESCRIBED', CASE WHEN coalesce(form IN {_OTHER_FORMS}, false) OR (salt IS NULL AND form IS NULL) THEN 'info' WHEN {_SURE.format(other="ra", more="")} THEN 'critical' ELSE 'warning' END, NULL, item_id FROM ba a)
      SELECT * FROM j UNION ALL SELECT scan_id, 'CHECK_UNAVAILABLE', 'info', prescribed_ref, billed_ref FROM j WHERE severity = 'warning'""",
    "quantity_rules": f"""WITH q AS (SELECT scan_id, item_id, ordinal % 3 AS basis, quantity, CASE WHEN ordinal % 5 <> 0 THEN (scan_id % 3 + 1) * 10 END AS due, CASE WHEN ordinal % 4 <> 0 THEN 10 END AS per_pack FROM ({plain(BILL_ITEMS)}) b),
      r AS (SELECT *, CASE WHEN quantity < due THEN 'QUANTITY_SHORT' WHEN quantity * 5 > 6 * due THEN 'QUANTITY_EXCESS' ELSE '' END AS u, CASE WHEN quantity * per_pack < due THEN 'QUANTITY_SHORT' WHEN quantity * per_pack * 5 > 6 * due THEN 'QUANTITY_EXCESS' ELSE '' END AS p FROM q)
      SELECT scan_id, item_id, nullif(CASE WHEN due IS NULL OR quantity IS NULL OR (per_pack IS NULL AND basis <> 0) THEN 'CHECK_UNAVAILABLE' WHEN basis = 0 THEN u WHEN basis = 1 THEN p WHEN u = p THEN p ELSE 'QUANTITY_AMBIGUOUS' END, '') AS rule_code FROM r""",
    "amounts_due": f"""{WITH}, {SAME_PLACE}, rw AS ({plain(RX_WRITTEN)}), bw AS ({plain(BILL_WRITTEN)}),
      w AS (
        SELECT p.*, quantity, units_basis AS declared, CAST(unit_price AS DOUBLE) * quantity AS stated, CAST(line_total AS DOUBLE) AS total,
          CASE WHEN frequency_raw = 'BD' THEN 2.0 WHEN frequency_raw = 'TDS' THEN 3.0 WHEN contains(frequency_raw, '-') THEN list_sum(list_transform(string_split(frequency_raw, '-'), lambda x: TRY_CAST(x AS DOUBLE))) END::DOUBLE AS per_day,
          coalesce(duration_days, TRY_CAST(regexp_extract(duration_raw, '^[0-9]+') AS INTEGER)) AS days,
          coalesce(dose_per_administration, CASE WHEN contains(frequency_raw, '-') THEN 1.0 END)::DOUBLE AS dose,
          CASE WHEN pack_size LIKE '%''s' OR pack_size LIKE 'Strip%' THEN TRY_CAST(regexp_extract(pack_size, '[0-9]+') AS INTEGER) WHEN pack_size LIKE '2x%' THEN 2 * TRY_CAST(substr(pack_size, 3) AS INTEGER) END AS per_pack
        FROM pairs p JOIN rw r ON p.scan_id = r.scan_id AND p.rx_item = r.item_id JOIN bw b ON p.scan_id = b.scan_id AND p.bill_item = b.item_id),
      near AS (
        SELECT *, abs(stated * per_pack - total) <= 0.02 * greatest(abs(stated * per_pack), abs(total), 1) AND NOT abs(stated - total) <= 0.02 * greatest(abs(stated), abs(total), 1) AS proved,
          quantity IS NULL OR stated IS NULL OR total IS NULL OR per_pack IS NULL AS unpriced, CASE WHEN per_day > 0 AND days > 0 AND dose > 0 THEN per_day * days * dose END AS due FROM w),
      based AS (
        SELECT *, CASE WHEN declared IS NOT NULL THEN declared WHEN NOT unpriced AND proved THEN 'pack' END AS basis,
          CASE WHEN declared IS NOT NULL THEN 'declared' WHEN unpriced THEN 'no_price_data' WHEN proved THEN 'price_reconciled' ELSE 'price_inconclusive' END AS how FROM near),
      out AS (
        SELECT *, CASE WHEN quantity < due THEN 'QUANTITY_SHORT' WHEN quantity > 1.2::DOUBLE * due THEN 'QUANTITY_EXCESS' ELSE '' END AS u,
          CASE WHEN quantity * per_pack < due THEN 'QUANTITY_SHORT' WHEN quantity * per_pack > 1.2::DOUBLE * due THEN 'QUANTITY_EXCESS' ELSE '' END AS k FROM based),
      coded AS (
        SELECT *, nullif(CASE WHEN due IS NULL OR quantity IS NULL OR (per_pack IS NULL AND basis IS DISTINCT FROM 'unit') THEN 'CHECK_UNAVAILABLE'
          WHEN basis = 'unit' THEN u WHEN basis = 'pack' THEN k WHEN u = k THEN k ELSE 'QUANTITY_AMBIGUOUS' END, '') AS rule_code FROM out)
      SELECT scan_id, rx_item, bill_item, due AS expected_units,
        CAST(CASE WHEN rule_code IN ('CHECK_UNAVAILABLE', 'QUANTITY_AMBIGUOUS') THEN NULL WHEN basis = 'unit' THEN quantity ELSE quantity * per_pack END AS DOUBLE) AS billed_units,
        per_pack AS units_per_pack, basis AS units_basis, how AS basis_method,
        concat_ws(',', CASE WHEN per_day IS NULL THEN 'frequency' END, CASE WHEN days IS NULL THEN 'duration' END, CASE WHEN dose IS NULL THEN 'dose' END, CASE WHEN quantity IS NULL THEN 'quantity' END,
          CASE WHEN per_pack IS NULL AND basis IS DISTINCT FROM 'unit' THEN 'pack' END) AS missing, rule_code FROM coded""",
    "lab_component_join": f"""{_TESTS}, c AS (SELECT a.scan_id, a.item_id, a.test_name, count(*) AS required, count(*) FILTER (EXISTS (SELECT 1 FROM charged b WHERE b.scan_id = a.scan_id AND b.component = a.component)) AS covered FROM asked a WHERE billable GROUP BY ALL)
      SELECT *, CASE WHEN covered = 0 THEN 'TEST_NOT_BILLED' WHEN covered < required THEN 'PANEL_PARTIAL' END AS rule_code FROM c""",
    "report_axis": f"""{_TESTS}, d AS (SELECT scan_id, component, 'TEST_BILLED_NOT_REPORTED' AS rule_code FROM (SELECT scan_id, component FROM charged WHERE scan_id IN (SELECT scan_id FROM told) EXCEPT SELECT scan_id, component FROM told)
      UNION ALL SELECT scan_id, component, 'TEST_REPORTED_NOT_BILLED' FROM (SELECT scan_id, component FROM told EXCEPT SELECT scan_id, component FROM charged)
      UNION ALL SELECT scan_id, component, 'TEST_REPORTED_NOT_ORDERED' FROM (SELECT scan_id, component FROM told EXCEPT SELECT scan_id, component FROM asked)) SELECT * FROM d""",
    "consensus_mode": f"""WITH v AS (SELECT scan_id, value, count(*) AS n, min(run) AS first FROM ({plain(VOTES)}) q GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY scan_id) AS runs FROM v QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, first) = 1)
      SELECT scan_id, CASE WHEN n > 1 OR runs = 1 THEN value END AS value, CASE WHEN runs > 1 THEN round(n / runs, 2) END::DOUBLE AS agreement, CAST(runs AS BIGINT) AS runs FROM r""",
    "consensus_majority": f"""SELECT scan_id // 30 AS doc, CAST(ordinal % 50 AS INT) AS line, drug_name, count(DISTINCT scan_id % 3) AS seen, count(DISTINCT scan_id % 3) < 3 AS unstable FROM ({plain(BILL_ITEMS)}) b GROUP BY 1, 2, 3 HAVING count(DISTINCT scan_id % 3) >= 2""",
    "bbox_iou": f"""WITH b AS ({plain(BOXES)}), s AS (SELECT item, greatest(0, least(r1, r2) - greatest(l1, l2)) * greatest(0, least(b1, b2) - greatest(t1, t2)) AS x FROM b) SELECT item, round(x / (24 - x), 6)::DOUBLE AS iou FROM s""",
    "line_overlap": f"""{WITH}, n AS (SELECT DISTINCT scan_id, drug_name FROM bill), k AS (SELECT scan_id, count(*) AS k FROM n GROUP BY 1),
      p AS (SELECT a.scan_id AS first_scan_id, b.scan_id, count(*) AS shared FROM scans a JOIN scans b ON a.pharmacy_name = b.pharmacy_name AND a.bill_date = b.bill_date AND a.scan_id < b.scan_id JOIN n x ON x.scan_id = a.scan_id JOIN n y ON y.scan_id = b.scan_id AND x.drug_name = y.drug_name GROUP BY 1, 2)
      SELECT first_scan_id, p.scan_id, round(shared / greatest(a.k, b.k), 4)::DOUBLE AS overlap FROM p JOIN k a ON a.scan_id = first_scan_id JOIN k b ON b.scan_id = p.scan_id WHERE round(shared / greatest(a.k, b.k), 4) >= 0.2""",
    "scan_filters": f"{WITH} SELECT scan_id, bill_no, created_on FROM scans WHERE review_status = 'reviewed' AND employee_name LIKE '%1%' AND lower(bill_no) LIKE '%b-4%' AND created_on BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'",
    "visibility": f"{WITH} SELECT scan_id, employee_number FROM scans WHERE employee_number = 7",
    "count_by_employee": f"{WITH} SELECT employee_number, count(*) AS n FROM scans GROUP BY 1",
    "review_progress": f"""{WITH} SELECT count(*) FILTER (review_status = 'submitted') AS pending, count(*) FILTER (review_status = 'under_review') AS in_progress, count(*) FILTER (review_status = 'reviewed' AND created_on BETWEEN DATE '1995-04-01' AND DATE '1996-03-31') AS reviewed,
      CAST(coalesce(sum(claimed_amount) FILTER (review_status = 'reviewed' AND created_on BETWEEN DATE '1995-04-01' AND DATE '1996-03-31'), 0) AS DECIMAL(18,2)) AS claimed FROM scans""",
    "exact_resolution": f"""WITH d AS ({plain(DICTIONARY)}), n AS ({plain(NAMES)}), f AS (SELECT brand, arg_min(salt, ordinal) AS salt FROM d GROUP BY 1)
      SELECT name, coalesce(f.salt, s.salt) AS salt, CASE WHEN f.salt IS NOT NULL THEN 'exact' WHEN s.salt IS NOT NULL THEN 'ingredient' ELSE 'unresolved' END AS method FROM n LEFT JOIN f ON brand = name LEFT JOIN (SELECT DISTINCT salt FROM d WHERE salt NOT LIKE '%+%') s ON s.salt = name""",
    "schedule_lookup": f"SELECT salt, arg_min(schedule, list_position(['X', 'H1', 'H', 'OTC'], schedule)) AS schedule FROM ({plain(DICTIONARY)}) d GROUP BY salt",
}
