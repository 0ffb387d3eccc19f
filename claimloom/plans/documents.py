"""Queries over a scan's documents: their own rules, laboratory tests, reports and repeated bills, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import lab_names as names
from claimloom.functions import text
from claimloom.operators import documents, history, lab, pairing
from claimloom.plans.claims import BILL_ITEMS, SCANS, bill_items, plain, rx_items, scans, view
from claimloom.plans.extended import DICTIONARY
from claimloom.plans.registry import SAME_PLACE, WITH, same_place
from claimloom.plans.words import _DIGITS, _cases
from claimloom.session import laid_out

#: Facts of a scan's documents beside those of the claims view.
FACTS = f"""
SELECT s.*, scan_id % 9 = 0 AS rx_assumed, scan_id % 14 = 0 AS bill_assumed, CASE WHEN scan_id % 6 = 0 THEN NULL WHEN scan_id % 17 = 0 THEN ' ' ELSE concat('27AAPFU', lpad(CAST(scan_id * 7 % 10000 AS STRING), 4, '0'), 'F1Z', substr('V0A9K', CAST(scan_id % 5 + 1 AS INT), 1)) END AS gstin,
  CASE scan_id % 4 WHEN 0 THEN 'Pune, Maharashtra' WHEN 1 THEN 'Goa' WHEN 2 THEN 'Delhi or Haryana' END AS address, CASE WHEN scan_id % 5 = 0 THEN NULL WHEN scan_id % 5 = 1 THEN 'Mr. Asha Rao' ELSE employee_name END AS rx_patient,
  CASE WHEN scan_id % 7 = 0 THEN ' ' WHEN scan_id % 7 = 1 THEN 'Ishan Roy' ELSE employee_name END AS bill_patient, CASE scan_id % 4 WHEN 0 THEN 'Rao Asha' WHEN 1 THEN 'Miss Nobody' WHEN 2 THEN NULL ELSE employee_name END AS report_patient,
  CASE WHEN scan_id % 10 = 0 THEN NULL ELSE created_on - CAST(scan_id % 50 AS INT) END AS collected, scan_id % 3 = 0 AS has_report, CASE scan_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS investigations, CASE scan_id % 8 WHEN 0 THEN true WHEN 1 THEN false END AS lab_bill, scan_id % 11 <> 0 AS has_items
FROM ({SCANS}) s"""



def _lines(name: str, raw: str, where: str) -> str:
    return f"SELECT scan_id, ordinal, concat('test-', item_id) AS item_id, {name} AS test_name, {raw} AS raw_text, CASE WHEN ordinal % 5 = 0 THEN NULL WHEN ordinal % 7 = 6 THEN 2.0 ELSE 1.0 END AS quantity FROM ({BILL_ITEMS}) b WHERE {where}"


#: What the views of tests read of a line.
OF_LINES = ("scan_id", "ordinal", "item_id")
ORDERED = _lines(name="CASE (scan_id + ordinal * 3) % 9 WHEN 0 THEN 'LFT' WHEN 1 THEN 'Thyroid Profile (T3, T4, TSH)' WHEN 2 THEN 'Plasma Glucose F / PP after a month' WHEN 3 THEN 'Lipid Profile' WHEN 4 THEN NULL WHEN 5 THEN 'Test for TSH repeat urgent' WHEN 6 THEN 'xq' END", raw="CASE (scan_id + ordinal) % 4 WHEN 0 THEN 'CBC' WHEN 1 THEN '' ELSE 'zz' END", where="ordinal <= 2 AND scan_id % 6 <> 5")
BILLED = _lines(name="CASE (scan_id + ordinal) % 11 WHEN 0 THEN 'SGPT (ALT)' WHEN 1 THEN 'S.G.O.T' WHEN 2 THEN 'Lipid Profile — HDL' WHEN 3 THEN 'Lipid Profile - Mystery' WHEN 4 THEN 'Vit D' WHEN 5 THEN '' WHEN 6 THEN 'T3' WHEN 7 THEN 'TSH' WHEN 8 THEN 'Odd thing: T4' WHEN 9 THEN 'Glucose PP' ELSE 'LDL' END", raw="CASE (scan_id + ordinal) % 3 WHEN 0 THEN 'Urine R/M' ELSE 'smudge' END", where="ordinal <= 5 AND scan_id % 4 <> 3")
REPORTED = _lines(name="CASE (scan_id + ordinal) % 7 WHEN 0 THEN 'SGPT' WHEN 1 THEN 'VLDL' WHEN 2 THEN 'Cortisol, Morning, Serum' WHEN 3 THEN NULL WHEN 4 THEN 'T3' WHEN 5 THEN 'Glucose [pp]' ELSE 'qq' END", raw="CAST(NULL AS STRING)", where="scan_id % 3 = 0 AND ordinal <= 4")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FACTS)


def _tests(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return lab.resolve_names(view(spark, sf_dir, sql, OF_LINES), fuzzy=False)


def paired_tests(spark: SparkSession, sf_dir: str, panels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ordered tests, billed tests and their pairs, laid out by scan, as many rules read each of them."""
    ordered, billed = (laid_out(_tests(spark, sf_dir, x)) for x in (ORDERED, BILLED))
    return ordered, billed, laid_out(lab.pair_tests(ordered, billed, panels))


def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    return documents.date_order(rows).union(documents.item_counts(rows)).union(documents.identifiers(rows)).drop("detail")


def patient_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.patient_names(facts(spark, sf_dir))


def non_medicine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.non_medicine(bill_items(spark, sf_dir)).drop("detail", "check_name")


def schedule_unbacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone = pairing.unmatched(bill_items(spark, sf_dir), same_place(spark, sf_dir), "bill_item").withColumn("salt", F.upper("therapeutic_class"))
    return documents.schedule_unbacked(alone, view(spark, sf_dir, DICTIONARY)).select("scan_id", "rule_code", "severity", "billed_ref", F.get_json_object("detail", "$.schedule").alias("schedule"))


def class_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("ordinal") % 3 == 0, "fuzzy").otherwise("exact")
    rx = rx_items(spark, sf_dir).withColumns({"method": method, "therapeutic_class": F.when(F.col("ordinal") % 6 == 0, "OTHER").otherwise(F.col("therapeutic_class"))})
    return documents.class_conflicts(same_place(spark, sf_dir), rx, bill_items(spark, sf_dir).withColumn("method", F.lit("exact"))).drop("detail", "check_name")


def lab_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [_tests(spark, sf_dir, sql).withColumn("side", F.lit(side)) for side, sql in (("rx", ORDERED), ("bill", BILLED), ("report", REPORTED))]
    return rows[0].union(rows[1]).union(rows[2]).select("side", "scan_id", "item_id", "written", "kind", "name", "method")


def lab_resolution_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with likeness, over misspelt names."""
    spelt = view(spark, sf_dir, BILLED, OF_LINES).withColumn("test_name", F.translate("test_name", "iy", "yi"))
    return lab.resolve_names(spelt).select("scan_id", "item_id", "written", "kind", "name", "method")


def lab_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lab.pair_tests(_tests(spark, sf_dir, ORDERED), _tests(spark, sf_dir, BILLED), lab.panel_table(spark)).where("found > 0")
    return pairs.select("scan_id", "rx_item", "bill_item", F.array_join("covers", ",").alias("covers"), "similarity", F.array_join("missing", ",").alias("missing"))


def lab_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    panels = lab.panel_table(spark)
    ordered, billed, pairs = paired_tests(spark, sf_dir, panels)
    found = lab.lab_findings(ordered, billed, facts(spark, sf_dir), panels, pairs)
    return found.withColumn("softened_code", F.get_json_object("detail", "$.softened_code")).drop("detail")


def report_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lab.report_findings(*(_tests(spark, sf_dir, x) for x in (ORDERED, BILLED, REPORTED)), facts(spark, sf_dir), lab.panel_table(spark))
    return found.select("scan_id", "rule_code", "severity", "check_name", F.get_json_object("detail", "$.component").alias("component"))


def resubmission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.resubmissions(scans(spark, sf_dir), bill_items(spark, sf_dir))


def resubmission_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a third of the pharmacies' names are written another way."""
    spelt = scans(spark, sf_dir).withColumn("pharmacy_name", F.when(F.col("scan_id") % 3 == 0, F.regexp_replace("pharmacy_name", "Pharmacy", "PHARMACI")).otherwise(F.col("pharmacy_name")))
    return history.resubmissions(spelt, bill_items(spark, sf_dir), pharmacies=history.like_names(spelt, "pharmacy_name"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (document_rules, patient_names, non_medicine_lines, schedule_unbacked, class_conflicts, lab_resolution, lab_resolution_fuzzy, lab_pairs, lab_rules, report_rules, resubmission, resubmission_alike)

_FACTS = f"facts AS ({plain(FACTS)})"
_ALIASES = "aliases AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{k}', '{n}')" for k, d in (("panel", names.PANEL_OF), ("test", names.TEST_OF)) for w, n in d.items() if k == "panel" or w not in names.PANEL_OF) + ") t(key, kind, name))"
_PANELS = "panels AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {k}, '{c}', {'false' if c in names.DERIVED else 'true'})" for p, parts in names.PANELS.items() for k, c in enumerate(parts)) + ") t(panel, place, component, billable))"
_TIMED = "regexp_replace({x}, '" + names.TIMING.replace("'", "''") + "', '')"


def _key(x: str) -> str:
    out = f"lower(trim({x}))"
    for lead in names.LEADS:
        out = f"replace({out}, '{lead}', ' ')"
    return f"trim(regexp_replace(replace(regexp_replace({out}, '[()\\[\\]{{}}.,;:*#<>]', ' ', 'g'), '&', ' and '), '\\s+', ' ', 'g'))"


_UNTIMED = "written"
for _ in range(3):
    _UNTIMED = f"trim({_TIMED.format(x=_UNTIMED)})"
_BARE = "regexp_replace(written, '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g')"
#: Names: every key that a text may be looked up by, in turn; the first step with an entry decides.
_NAMES = f"""sides AS ({" UNION ALL ".join(f"SELECT '{s}' AS side, *, coalesce(nullif(trim(test_name), ''), nullif(trim(raw_text), '')) AS written FROM ({plain(x)}) q" for s, x in (("rx", ORDERED), ("bill", BILLED), ("report", REPORTED)))}), {_ALIASES}, {_PANELS},
  texts AS (SELECT DISTINCT written FROM sides WHERE written IS NOT NULL), cut AS (SELECT written, list_filter(regexp_split_to_array({_BARE}, '\\s*[—–‒−:|]\\s*|\\s+-\\s+'), lambda p: trim(p) <> '') AS parts FROM texts),
  keys AS (SELECT written, 0 AS step, 0 AS part, {_key("written")} AS key FROM texts UNION ALL SELECT written, 1, 0, {_key(_UNTIMED)} FROM texts UNION ALL SELECT written, 2, 0, {_key(_BARE)} FROM texts
    UNION ALL SELECT written, 3, part, {_key("p")} FROM (SELECT written, unnest(parts) AS p, generate_subscripts(parts, 1) AS part FROM cut WHERE len(parts) >= 2)),
  hits AS (SELECT * FROM keys JOIN aliases USING (key)), whole AS (SELECT written, kind, name, 'exact' || ['', '_untimed', '_parenthetical'][step + 1] AS method FROM hits WHERE step < 3 QUALIFY row_number() OVER (PARTITION BY written ORDER BY step) = 1),
  split AS (SELECT written, 'test' AS kind, arg_min(name, part) FILTER (kind = 'test') AS name, CASE WHEN bool_or(kind = 'panel') THEN 'panel_component' ELSE 'component_only' END AS method FROM hits WHERE step = 3 GROUP BY written HAVING count(*) FILTER (kind = 'test') > 0),
  known AS (SELECT * FROM whole UNION ALL SELECT * FROM split WHERE written NOT IN (SELECT written FROM whole)),
  named AS (SELECT s.*, k.kind, k.name, k.method FROM sides s LEFT JOIN known k USING (written)),
  parts AS (SELECT side, scan_id, item_id, ordinal, name, coalesce(place, 0) AS place, coalesce(component, name) AS component, coalesce(billable, true) AS billable FROM named n LEFT JOIN panels p ON n.kind = 'panel' AND n.name = p.panel WHERE name IS NOT NULL),
  met AS (SELECT r.scan_id, r.item_id AS rx_item, r.place, r.component, r.billable, b.item_id AS bill_item, b.ordinal AS bo FROM parts r LEFT JOIN parts b ON b.side = 'bill' AND r.scan_id = b.scan_id AND r.component = b.component WHERE r.side = 'rx'),
  tests AS (SELECT scan_id, rx_item, list(bill_item ORDER BY place, bo, bill_item) FILTER (bill_item IS NOT NULL) AS covers, count(DISTINCT component) FILTER (bill_item IS NOT NULL) AS found, count(DISTINCT component) FILTER (billable) AS required,
    list(component ORDER BY place) FILTER (billable AND bill_item IS NULL) AS missing FROM met GROUP BY ALL)"""
_LABFACTS = """lf AS (SELECT f.scan_id, coalesce(nb, 0) AS nb, CASE WHEN coalesce(nb, 0) = 0 AND coalesce(NOT lab_bill, has_items) THEN 'no_lab_bill' WHEN coalesce(nb, 0) = 0 AND coalesce(lab_bill, false) THEN 'lab_bill_unreadable' WHEN unnamed > 0 THEN 'unidentified_billed_lines' END AS soft,
    CASE WHEN unknown > 0 THEN 'unidentified_orders' WHEN coalesce(no, 0) = 0 AND investigations THEN 'orders_unreadable' WHEN coalesce(no, 0) = 0 AND investigations IS NULL THEN 'orders_unconfirmed' END AS doubt
  FROM facts f LEFT JOIN (SELECT scan_id, count(*) AS nb, count(*) FILTER (coalesce(trim(test_name), '') = '') AS unnamed FROM named WHERE side = 'bill' GROUP BY 1) USING (scan_id) LEFT JOIN (SELECT scan_id, count(*) AS no, count(*) FILTER (name IS NULL) AS unknown FROM named WHERE side = 'rx' GROUP BY 1) USING (scan_id)),
  used AS (SELECT DISTINCT scan_id, unnest(covers) AS item_id FROM tests WHERE found > 0), loose AS (SELECT n.*, lf.doubt FROM named n JOIN lf USING (scan_id) WHERE side = 'bill' AND NOT EXISTS (SELECT 1 FROM used u WHERE u.scan_id = n.scan_id AND u.item_id = n.item_id))"""
_GST = f"""g AS (SELECT *, nullif(upper(regexp_replace(gstin, '[\\s-]', '', 'g')), '') AS number FROM facts), gs AS (SELECT *, {_cases(text.STATES.items(), "substr(number, 1, 2)")} AS home,
    list_sum(list_transform(range(1, 15), lambda i: (instr({_DIGITS}, substr(number, i, 1)) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) // 36 + (instr({_DIGITS}, substr(number, i, 1)) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) % 36)) AS total FROM g),
  gp AS (SELECT *, substr(number, 15, 1) = substr({_DIGITS}, CAST((36 - total % 36) % 36 + 1 AS BIGINT), 1) AS fits, CASE address WHEN 'Pune, Maharashtra' THEN 'Maharashtra' WHEN 'Goa' THEN 'Goa' END AS named FROM gs)"""
_NONE = "CAST(NULL AS VARCHAR)"

ORACLE: dict[str, str] = {
    "document_rules": f"""WITH {_FACTS}, {_GST}, d AS (SELECT scan_id, 'prescription' AS document, rx_runs AS runs FROM facts UNION ALL SELECT scan_id, 'bill', bill_runs FROM facts), c AS (SELECT *, list_filter(string_split(runs, ','), lambda x: x <> '') AS n FROM d),
      f AS (SELECT scan_id, 'DATE_ORDER_ASSUMED' AS rule_code, 'info' AS severity, {_NONE} AS check_name FROM facts WHERE rx_assumed OR bill_assumed UNION ALL SELECT scan_id, 'ITEM_COUNT_UNSTABLE', 'critical', NULL FROM c WHERE len(list_distinct(n)) > 1
        UNION ALL SELECT scan_id, 'CHECK_UNAVAILABLE', 'info', document || ' item-count stability' FROM c WHERE len(n) < 2 UNION ALL SELECT scan_id, 'CHECK_UNAVAILABLE', 'info', 'GSTIN format' FROM gp WHERE number IS NULL
        UNION ALL SELECT scan_id, 'GSTIN_INVALID', 'warning', NULL FROM gp WHERE NOT fits UNION ALL SELECT scan_id, 'GSTIN_STATE_MISMATCH', 'info', NULL FROM gp WHERE fits AND home <> named UNION ALL SELECT scan_id, 'LICENCE_ABSENT', 'warning', NULL FROM facts WHERE coalesce(trim(licence_no), '') = '')
      SELECT *, {_NONE} AS prescribed_ref, {_NONE} AS billed_ref FROM f""",
    "non_medicine_lines": f"""{WITH} SELECT scan_id, 'NON_MEDICINE_ITEM' AS rule_code, 'info' AS severity, {_NONE} AS prescribed_ref, item_id AS billed_ref FROM bill WHERE salt IS NULL AND (contains(lower(raw_text), 'soap') OR contains(lower(raw_text), 'strip'))""",
    "schedule_unbacked": f"""{WITH}, {SAME_PLACE}, d AS (SELECT salt, arg_min(schedule, list_position(['X', 'H1', 'H', 'OTC'], schedule)) AS schedule FROM ({plain(DICTIONARY)}) x GROUP BY salt)
      SELECT b.scan_id, 'SCHEDULE_H_UNBACKED' AS rule_code, 'critical' AS severity, b.item_id AS billed_ref, schedule FROM bill b JOIN d ON d.salt = upper(b.therapeutic_class) WHERE schedule <> 'OTC' AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.scan_id = b.scan_id AND p.bill_item = b.item_id)""",
    "class_conflicts": f"""{WITH} SELECT r.scan_id, 'SALT_DIFFERENT_CLASS' AS rule_code, 'critical' AS severity, r.item_id AS prescribed_ref, b.item_id AS billed_ref FROM rx r JOIN bill b ON r.scan_id = b.scan_id AND r.ordinal = b.ordinal WHERE r.ordinal % 6 = 0 AND r.salt IS NOT NULL AND b.therapeutic_class <> 'OTHER'""",
    "lab_resolution": f"WITH {_NAMES} SELECT side, scan_id, item_id, written, kind, name, method FROM named",
    "lab_pairs": f"""WITH {_NAMES} SELECT scan_id, rx_item, covers[1] AS bill_item, array_to_string(covers, ',') AS covers, CASE WHEN coalesce(len(missing), 0) = 0 THEN 1.0 ELSE round(found / required, 4) END::DOUBLE AS similarity, coalesce(array_to_string(missing, ','), '') AS missing FROM tests WHERE found > 0""",
    "lab_rules": f"""WITH {_FACTS}, {_NAMES}, {_LABFACTS}, f AS (
      SELECT scan_id, 'TEST_UNRESOLVED' AS rule_code, 'info' AS severity, item_id AS prescribed_ref, {_NONE} AS billed_ref, {_NONE} AS check_name, {_NONE} AS softened_code FROM named WHERE side = 'rx' AND name IS NULL
      UNION ALL SELECT scan_id, 'CHECK_UNAVAILABLE', 'info', item_id, NULL, 'test billing', NULL FROM named WHERE side = 'rx' AND name IS NULL
      UNION ALL SELECT t.scan_id, 'TEST_NOT_BILLED', CASE WHEN soft IS NULL THEN 'critical' ELSE 'warning' END, rx_item, NULL, NULL, soft FROM tests t JOIN lf USING (scan_id) WHERE found = 0
      UNION ALL SELECT scan_id, 'PANEL_PARTIAL', 'warning', rx_item, covers[1], NULL, NULL FROM tests WHERE found > 0 AND len(missing) > 0
      UNION ALL SELECT scan_id, 'TEST_UNRESOLVED', 'info', NULL, item_id, NULL, NULL FROM loose WHERE name IS NULL
      UNION ALL SELECT scan_id, 'CHECK_UNAVAILABLE', 'info', NULL, item_id, 'test authorisation', NULL FROM loose WHERE coalesce(trim(test_name), '') = ''
      UNION ALL SELECT scan_id, 'TEST_NOT_PRESCRIBED', CASE WHEN doubt IS NULL THEN 'critical' ELSE 'warning' END, NULL, item_id, NULL, doubt FROM loose WHERE coalesce(trim(test_name), '') <> ''
      UNION ALL SELECT scan_id, 'CHECK_UNAVAILABLE', 'info', NULL, NULL, 'test authorisation', doubt FROM lf WHERE doubt IS NOT NULL AND nb > 0
      UNION ALL SELECT scan_id, 'TEST_DUPLICATE', 'warning', NULL, item_id, NULL, NULL FROM named WHERE side = 'bill' AND quantity > 1
      UNION ALL SELECT scan_id, 'CHECK_UNAVAILABLE', 'info', NULL, CASE WHEN count(*) = 1 THEN min(item_id) END, 'repeat test billing', NULL FROM named WHERE side = 'bill' AND quantity IS NULL GROUP BY scan_id
      UNION ALL SELECT scan_id, 'TEST_DUPLICATE', 'warning', NULL, item_id, NULL, NULL FROM (SELECT * FROM named WHERE side = 'bill' AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scan_id, name ORDER BY ordinal) > 1)) SELECT * FROM f""",
    "report_rules": f"""WITH {_FACTS}, {_NAMES}, h AS (SELECT * FROM facts WHERE has_report), c AS (SELECT DISTINCT side, scan_id, component FROM parts WHERE scan_id IN (SELECT scan_id FROM h)),
      o AS (SELECT scan_id, component FROM c WHERE side = 'rx'), b AS (SELECT scan_id, component FROM c WHERE side = 'bill'), r AS (SELECT scan_id, component FROM c WHERE side = 'report'),
      q AS (SELECT *, coalesce(lab_bill, false) OR scan_id IN (SELECT scan_id FROM b) AS compared, coalesce(NOT investigations, false) OR scan_id IN (SELECT scan_id FROM o) AS readable,
        list_filter(regexp_split_to_array(replace(lower(report_patient), '.', ' '), '\\s+'), lambda z: NOT list_contains(['mr', 'mrs', 'ms', 'miss', 'dr', 'master', 'baby', 'b/o', 'c/o', ''], z)) AS x, list_filter(regexp_split_to_array(replace(lower(rx_patient), '.', ' '), '\\s+'), lambda z: NOT list_contains(['mr', 'mrs', 'ms', 'miss', 'dr', 'master', 'baby', 'b/o', 'c/o', ''], z)) AS y FROM h),
      f AS (SELECT scan_id, 'TEST_BILLED_NOT_REPORTED' AS rule_code, 'critical' AS severity, {_NONE} AS check_name, component FROM (SELECT * FROM b EXCEPT SELECT * FROM r)
        UNION ALL SELECT scan_id, 'CHECK_UNAVAILABLE', 'info', 'billed against reported', NULL FROM q WHERE NOT compared UNION ALL SELECT scan_id, 'TEST_REPORTED_NOT_BILLED', 'info', NULL, component FROM (SELECT * FROM r EXCEPT SELECT * FROM b) WHERE scan_id IN (SELECT scan_id FROM q WHERE compared)
        UNION ALL SELECT scan_id, 'TEST_REPORTED_NOT_ORDERED', 'warning', NULL, component FROM (SELECT * FROM r EXCEPT SELECT * FROM o) WHERE scan_id IN (SELECT scan_id FROM q WHERE readable)
        UNION ALL SELECT DISTINCT scan_id, 'CHECK_UNAVAILABLE', 'info', 'reported against ordered', NULL FROM r WHERE scan_id NOT IN (SELECT scan_id FROM q WHERE readable)
        UNION ALL SELECT scan_id, 'REPORT_PATIENT_MISMATCH', 'warning', NULL, NULL FROM q WHERE len(x) > 0 AND len(y) > 0 AND NOT list_has_any(x, y) UNION ALL SELECT scan_id, 'REPORT_DATE_ANOMALY', 'warning', NULL, NULL FROM h WHERE rx_date - collected > 1
        UNION ALL SELECT scan_id, 'CHECK_UNAVAILABLE', 'info', 'report timing', NULL FROM h WHERE rx_date IS NULL OR collected IS NULL UNION ALL SELECT DISTINCT scan_id, 'CHECK_UNAVAILABLE', 'info', 'reported tests', NULL FROM named WHERE side = 'report' AND name IS NULL) SELECT * FROM f""",
    "resubmission": f"""{WITH}, k AS (SELECT *, lower(regexp_replace(bill_no, '[^A-Za-z0-9]', '', 'g')) AS no FROM scans), byno AS (SELECT a.scan_id, b.scan_id AS prior, b.created_on AS made FROM k a JOIN k b ON a.no = b.no AND a.pharmacy_name = b.pharmacy_name AND (b.created_on, b.scan_id) < (a.created_on, a.scan_id)),
      n AS (SELECT scan_id, lower(regexp_replace(drug_name, '[^A-Za-z0-9]', '', 'g')) AS n, line_total FROM bill), s AS (SELECT scan_id, list_distinct(list(n)) AS names, count(*) AS held FROM n GROUP BY 1),
      byl AS (SELECT a.scan_id, b.scan_id AS prior, b.created_on AS made FROM k a JOIN k b ON a.pharmacy_name = b.pharmacy_name AND a.bill_date = b.bill_date AND (b.created_on, b.scan_id) < (a.created_on, a.scan_id) JOIN s x ON x.scan_id = a.scan_id JOIN s y ON y.scan_id = b.scan_id
        WHERE len(list_intersect(x.names, y.names)) / greatest(len(x.names), len(y.names)) >= 0.8 AND a.scan_id NOT IN (SELECT scan_id FROM byno)),
      f AS (SELECT scan_id, arg_min(prior, (made, prior)) AS prior, min(method) AS method, count(*) - 1 AS others FROM (SELECT *, 'number' AS method FROM byno UNION ALL SELECT *, 'lines' FROM byl) GROUP BY 1),
      t AS (SELECT scan_id, n, max(line_total) AS amount, bool_or(line_total IS NOT NULL) AS has, count(*) AS c FROM n GROUP BY 1, 2),
      u AS (SELECT f.scan_id, t.n, t.amount FROM f JOIN t ON t.scan_id = f.scan_id), w AS (SELECT f.scan_id, t.n, t.amount FROM f JOIN t ON t.scan_id = f.prior),
      d AS (SELECT scan_id, count(*) AS c FROM (SELECT coalesce(u.scan_id, w.scan_id) AS scan_id FROM u FULL JOIN w ON u.scan_id = w.scan_id AND u.n = w.n WHERE u.n IS NULL OR w.n IS NULL OR u.amount <> w.amount) GROUP BY 1),
      e AS (SELECT f.*, coalesce(c, 0) + CAST(a.claimed_amount <> b.claimed_amount AS INT) + CAST(x.held IS DISTINCT FROM y.held AS INT) AS changed FROM f LEFT JOIN d USING (scan_id) JOIN scans a ON a.scan_id = f.scan_id JOIN scans b ON b.scan_id = f.prior LEFT JOIN s x ON x.scan_id = f.scan_id LEFT JOIN s y ON y.scan_id = f.prior)
      SELECT scan_id, CASE WHEN changed > 0 THEN 'POSSIBLE_RESUBMISSION' ELSE 'DUPLICATE_BILL' END AS rule_code, prior AS prior_scan_id, method, others, changed FROM e""",
}
