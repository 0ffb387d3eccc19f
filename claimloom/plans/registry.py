"""The queries over claims, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text
from claimloom.operators import history, pairing, rules
from claimloom.plans.claims import BILL_ITEMS, RX_ITEMS, SCANS, bill_items, normal, plain, rx_items, scans

WITH = f"WITH bill AS ({normal(BILL_ITEMS)}), rx AS ({normal(RX_ITEMS)}), scans AS ({plain(SCANS)})"
#: Lines paired by their place in the order; the assignment itself isn't expressed in SQL.
SAME_PLACE = "pairs AS (SELECT r.scan_id, r.item_id AS rx_item, b.item_id AS bill_item FROM rx r JOIN bill b ON r.scan_id = b.scan_id AND r.ordinal = b.ordinal)"


def same_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, b = rx_items(spark, sf_dir).alias("r"), bill_items(spark, sf_dir).alias("b")
    return r.join(b, (F.col("r.scan_id") == F.col("b.scan_id")) & pairing.same_line("r.ordinal", "b.ordinal")).select("r.scan_id", F.col("r.item_id").alias("rx_item"), F.col("b.item_id").alias("bill_item"))


def _plain_findings(found: DataFrame) -> DataFrame:
    return found.drop("check_name", "detail")


def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.similarity(rx_items(spark, sf_dir), bill_items(spark, sf_dir))


def assignment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.assign(similarity_matrix(spark, sf_dir))


def unmatched_billed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.unmatched(bill_items(spark, sf_dir), same_place(spark, sf_dir), "bill_item").select("scan_id", "item_id", "drug_name")


def strength_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_findings(rules.strength_and_form(same_place(spark, sf_dir), rx_items(spark, sf_dir), bill_items(spark, sf_dir)))


def line_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_findings(rules.line_arithmetic(bill_items(spark, sf_dir)))


def date_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_findings(rules.document_dates(scans(spark, sf_dir)))


def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_findings(rules.expiry(bill_items(spark, sf_dir), scans(spark, sf_dir)))


def duplicate_therapy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_findings(rules.duplicate_therapy(bill_items(spark, sf_dir)))


def low_confidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_findings(rules.low_confidence(rx_items(spark, sf_dir), billed=False).union(rules.low_confidence(bill_items(spark, sf_dir), billed=True)))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_findings(rules.all_findings(same_place(spark, sf_dir), rx_items(spark, sf_dir), bill_items(spark, sf_dir), scans(spark, sf_dir)))


def verdict_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(findings(spark, sf_dir), rx_items(spark, sf_dir), scans(spark, sf_dir))


def rule_histogram_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.frequent_codes(findings(spark, sf_dir), scans(spark, sf_dir))


def early_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.early_repeats(scans(spark, sf_dir), bill_items(spark, sf_dir))


def duplicate_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.duplicate_bills(scans(spark, sf_dir))


def licence_inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.licence_conflicts(scans(spark, sf_dir))


def allowance_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.allowance(scans(spark, sf_dir))


def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.dashboard(scans(spark, sf_dir))


def per_day_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.per_day(scans(spark, sf_dir), "created_on")


def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.normalise_name(F.concat_ws("-", "p_brand", "p_name", "p_type")).alias("name"))


def gstin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat(F.lpad((F.col("s_suppkey") % 37 + 1).cast("string"), 2, "0"), F.lit("AAPFU"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"), F.lit("F1ZV"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", number.alias("gstin")).select("s_suppkey", "gstin", text.gstin_check_digit(F.col("gstin")).alias("digit"), text.gstin_valid(F.col("gstin")).alias("valid"))


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k long", {"mode": "PERMISSIVE"})
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", parsed["k"].alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("parsed"), F.sum("k").alias("k_sum"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (similarity_matrix, assignment_pairs, unmatched_billed, strength_rules, line_arithmetic, date_anomaly, expiry, duplicate_therapy, low_confidence_items, findings, verdict_score, rule_histogram_top20, early_repeat, duplicate_bill, licence_inconsistent, allowance_balance, dashboard_totals, per_day_gapfill, name_normalise, gstin_check, event_json)

_STRENGTH = """
SELECT scan_id, rule_code, CASE WHEN rule_code IN ('STRENGTH_MISMATCH', 'FORM_MISMATCH') THEN 'critical' ELSE 'info' END AS severity, rx_item AS prescribed_ref, bill_item AS billed_ref FROM (
  SELECT scan_id, rx_item, bill_item, s AS rule_code FROM judged UNION ALL SELECT scan_id, rx_item, bill_item, f FROM judged UNION ALL
  SELECT scan_id, rx_item, bill_item, CASE WHEN substitution AND coalesce(s, '') <> 'STRENGTH_MISMATCH' THEN 'BRAND_SUBSTITUTION' END FROM judged
) WHERE rule_code IS NOT NULL"""
_JUDGED = """judged AS (
  SELECT p.scan_id, rx_item, bill_item,
    CASE WHEN r.strength_value IS NULL OR b.strength_value IS NULL THEN 'CHECK_UNAVAILABLE' WHEN abs(r.strength_value - b.strength_value) >= 1e-6 OR r.strength_unit <> b.strength_unit THEN 'STRENGTH_MISMATCH' WHEN r.strength_unit IS NULL OR b.strength_unit IS NULL THEN 'STRENGTH_UNIT_UNSTATED' END AS s,
    CASE WHEN r.form IS NULL OR b.form IS NULL THEN 'CHECK_UNAVAILABLE' WHEN r.form <> b.form THEN 'FORM_MISMATCH' END AS f, r.salt = b.salt AND r.drug_name <> b.drug_name AS substitution
  FROM pairs p JOIN rx r ON p.scan_id = r.scan_id AND p.rx_item = r.item_id JOIN bill b ON p.scan_id = b.scan_id AND p.bill_item = b.item_id)"""
_ARITHMETIC = """
SELECT scan_id, 'LINE_TOTAL_MISMATCH' AS rule_code, 'warning' AS severity, CAST(NULL AS VARCHAR) AS prescribed_ref, item_id AS billed_ref FROM (
  SELECT *, quantity * unit_price AS gross, quantity * unit_price - coalesce(discount, 0) - line_total AS short, round_even(CAST(quantity * unit_price AS DOUBLE) / per_pack, 2) - CAST(coalesce(discount, 0) AS DOUBLE) - CAST(line_total AS DOUBLE) AS packed FROM bill WHERE quantity IS NOT NULL AND line_total IS NOT NULL
) WHERE abs(short) > 0.05 AND NOT coalesce(units_basis IS DISTINCT FROM 'unit' AND abs(packed) <= 0.050001, false) AND NOT (short > 0 AND discount IS NULL AND CAST(short AS DOUBLE) <= 0.3 * CAST(gross AS DOUBLE))
UNION ALL SELECT DISTINCT scan_id, 'CHECK_UNAVAILABLE', 'info', NULL, NULL FROM bill WHERE quantity IS NULL OR line_total IS NULL"""
_DATES = """
SELECT scan_id, CASE WHEN lag IS NULL THEN 'CHECK_UNAVAILABLE' ELSE 'DATE_ANOMALY' END AS rule_code, CASE WHEN lag IS NULL THEN 'info' ELSE 'warning' END AS severity, CAST(NULL AS VARCHAR) AS prescribed_ref, CAST(NULL AS VARCHAR) AS billed_ref
FROM (SELECT scan_id, bill_date - rx_date AS lag FROM scans) WHERE lag IS NULL OR lag < 0 OR lag > 30"""
_EXPIRY = """
SELECT b.scan_id, CASE WHEN expiry < bill_date THEN 'EXPIRED_ITEM' ELSE 'EXPIRY_NEAR' END AS rule_code, CASE WHEN expiry < bill_date THEN 'critical' ELSE 'warning' END AS severity, CAST(NULL AS VARCHAR) AS prescribed_ref, item_id AS billed_ref
FROM bill b JOIN scans s ON b.scan_id = s.scan_id WHERE expiry - bill_date <= 30
UNION ALL SELECT DISTINCT b.scan_id, 'CHECK_UNAVAILABLE', 'info', NULL, NULL FROM bill b JOIN scans s ON b.scan_id = s.scan_id WHERE expiry IS NULL OR bill_date IS NULL"""
_THERAPY = """
SELECT scan_id, 'DUPLICATE_THERAPY' AS rule_code, 'warning' AS severity, CAST(NULL AS VARCHAR) AS prescribed_ref, arg_min(item_id, ordinal) AS billed_ref FROM bill WHERE salt IS NOT NULL GROUP BY scan_id, salt HAVING count(*) > 1
UNION ALL SELECT DISTINCT scan_id, 'CHECK_UNAVAILABLE', 'info', NULL, NULL FROM bill WHERE salt IS NULL"""
_LOW = """
SELECT scan_id, 'LOW_CONFIDENCE_FIELD' AS rule_code, 'info' AS severity, item_id AS prescribed_ref, CAST(NULL AS VARCHAR) AS billed_ref FROM rx WHERE name_agreement < 1
UNION ALL SELECT scan_id, 'LOW_CONFIDENCE_FIELD', 'info', NULL, item_id FROM bill WHERE name_agreement < 1"""
ALL = f"{WITH}, {SAME_PLACE}, {_JUDGED}, found AS (" + " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (_STRENGTH, _ARITHMETIC, _DATES, _EXPIRY, _THERAPY, _LOW)) + ")"

ORACLE: dict[str, str] = {
    "similarity_matrix": f"""{WITH} SELECT r.scan_id, r.item_id AS rx_item, b.item_id AS bill_item, round(0.60 * CASE WHEN r.salt IS NOT NULL AND b.salt IS NOT NULL AND (r.drug_name = b.drug_name OR r.salt = b.salt) THEN 1 ELSE 0 END
      + 0.25 * CASE WHEN r.strength_unit IS NOT DISTINCT FROM b.strength_unit AND abs(r.strength_value - b.strength_value) < 1e-6 THEN 1 ELSE 0 END + 0.15 * CASE WHEN r.form = b.form THEN 1 ELSE 0 END, 4)::DOUBLE AS score FROM rx r JOIN bill b ON r.scan_id = b.scan_id""",
    "unmatched_billed": f"{WITH}, {SAME_PLACE} SELECT scan_id, item_id, drug_name FROM bill b WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.scan_id = b.scan_id AND p.bill_item = b.item_id)",
    "strength_rules": f"{WITH}, {SAME_PLACE}, {_JUDGED} {_STRENGTH}",
    "line_arithmetic": f"{WITH} {_ARITHMETIC}",
    "date_anomaly": f"{WITH} {_DATES}",
    "expiry": f"{WITH} {_EXPIRY}",
    "duplicate_therapy": f"{WITH} {_THERAPY}",
    "low_confidence_items": f"{WITH} {_LOW}",
    "findings": f"{ALL} SELECT * FROM found",
    "verdict_score": f"""{ALL}, read AS (SELECT scan_id, avg(CASE WHEN drug_name IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 OR avg(name_agreement) < 0.67 AS unclear FROM rx GROUP BY scan_id),
      names AS (SELECT s.scan_id, coalesce(unclear, false) OR rx_runs = '3,3,2' OR bill_runs = '5,4,5' AS unclear FROM scans s LEFT JOIN read USING (scan_id)),
      counts AS (SELECT scan_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (rule_code = 'CHECK_UNAVAILABLE') AS u FROM found GROUP BY scan_id)
      SELECT n.scan_id, coalesce(c, 0) AS critical_count, coalesce(w, 0) AS warning_count, coalesce(u, 0) AS unavailable_count, CASE WHEN unclear THEN 'inconclusive' WHEN c > 0 THEN 'mismatch' WHEN w > 0 THEN 'match_with_warnings' ELSE 'match' END AS verdict,
        CASE WHEN NOT unclear THEN greatest(0, 100 - 25 * coalesce(c, 0) - 8 * coalesce(w, 0)) END AS score FROM names n LEFT JOIN counts USING (scan_id)""",
    "rule_histogram_top20": f"{ALL} SELECT rule_code, count(*) AS n FROM found WHERE severity IN ('critical', 'warning') AND scan_id IN (SELECT scan_id FROM scans ORDER BY created_on DESC, scan_id DESC LIMIT 20) GROUP BY rule_code",
    "early_repeat": f"""{WITH}, courses AS (SELECT DISTINCT b.scan_id, salt, employee_number, bill_date, bill_no, course_days FROM bill b JOIN scans s ON b.scan_id = s.scan_id WHERE salt IS NOT NULL AND bill_date IS NOT NULL)
      SELECT n.scan_id, n.salt, t.scan_id AS prior_scan_id, CAST(n.bill_date - t.bill_date AS BIGINT) AS gap_days, CAST(t.course_days AS BIGINT) AS course_days FROM courses n JOIN courses t ON n.employee_number = t.employee_number AND n.salt = t.salt AND n.scan_id <> t.scan_id AND n.bill_no <> t.bill_no AND n.bill_date - t.bill_date >= 0 AND n.bill_date - t.bill_date < t.course_days
      QUALIFY row_number() OVER (PARTITION BY n.scan_id, n.salt ORDER BY t.bill_date DESC, t.scan_id DESC) = 1""",
    "duplicate_bill": f"""{WITH} SELECT a.scan_id, arg_min(b.scan_id, (b.created_on, b.scan_id)) AS first_scan_id, count(*) AS earlier_scans FROM scans a JOIN scans b ON a.pharmacy_name = b.pharmacy_name AND a.bill_no = b.bill_no AND (b.created_on < a.created_on OR (b.created_on = a.created_on AND b.scan_id < a.scan_id)) GROUP BY a.scan_id""",
    "licence_inconsistent": f"{WITH} SELECT pharmacy_name, count(DISTINCT lower(regexp_replace(licence_no, '[^A-Za-z0-9]', '', 'g'))) AS licences, count(*) AS scans FROM scans WHERE licence_no IS NOT NULL GROUP BY pharmacy_name HAVING count(DISTINCT lower(regexp_replace(licence_no, '[^A-Za-z0-9]', '', 'g'))) > 1",
    "allowance_balance": f"""{WITH}, used AS (SELECT employee_number, year(created_on - INTERVAL 3 MONTH) AS y, CAST(coalesce(sum(claimed_amount) FILTER (review_status = 'reviewed'), 0) AS DECIMAL(18,2)) AS used, count(*) FILTER (review_status <> 'reviewed') AS awaiting FROM scans GROUP BY 1, 2)
      SELECT employee_number, y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS allowance_year, used, awaiting, CAST(greatest(0, 12000 - used) AS DECIMAL(18,2)) AS balance FROM used""",
    "dashboard_totals": f"{WITH} SELECT review_status, count(*) AS scans, CAST(sum(claimed_amount) AS DECIMAL(18,2)) AS claimed, CAST(list_sort(list(processing_ms))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS BIGINT) AS median_ms FROM scans GROUP BY review_status",
    "per_day_gapfill": f"""{WITH}, days AS (SELECT unnest(generate_series((SELECT min(created_on) FROM scans), (SELECT max(created_on) FROM scans), INTERVAL 1 DAY)) AS at)
      SELECT CAST(d.at AS DATE) AS day, count(s.scan_id) AS n FROM days d LEFT JOIN scans s ON s.created_on = CAST(d.at AS DATE) GROUP BY 1""",
    "name_normalise": r"""SELECT p_partkey, trim(regexp_replace(upper(regexp_replace(concat_ws('-', p_brand, p_name, p_type), '[-_.,/''"()\[\]]', ' ', 'g')), '\s+', ' ', 'g')) AS name FROM part""",
    "gstin_check": """WITH g AS (SELECT s_suppkey, lpad(CAST(s_suppkey % 37 + 1 AS VARCHAR), 2, '0') || 'AAPFU' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') || 'F1ZV' AS gstin FROM supplier),
      p AS (SELECT s_suppkey, gstin, list_sum(list_transform(range(1, 15), lambda i: (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(gstin, i, 1)) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) // 36 + (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(gstin, i, 1)) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) % 36)) AS total FROM g),
      d AS (SELECT *, substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((36 - total % 36) % 36 + 1 AS BIGINT), 1) AS digit FROM p)
      SELECT s_suppkey, gstin, digit, substr(gstin, 15, 1) = digit AS valid FROM d""",
    "event_json": "SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')) AS parsed, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
