"""Queries over the store, the inputs, readings by run and the chain of name resolution, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import consensus, resolution
from claimloom.plans.claims import BILL_ITEMS, SCANS, bill_items, plain, rx_items, scans, view
from claimloom.plans.extended import DICTIONARY
from claimloom.plans.words import LINES
from claimloom.sources import inputs, store

EVENTS = f"""
SELECT scan_id, scan_id * 10 + 1 AS seq, 'open' AS kind, CAST(NULL AS STRING) AS payload, CAST(NULL AS DECIMAL(18,2)) AS amount FROM ({SCANS}) a WHERE scan_id % 3 = 0 UNION ALL SELECT scan_id, scan_id * 10 + 2, 'decide', concat('d', CAST(scan_id AS STRING)), CAST(scan_id AS DECIMAL(18,2)) FROM ({SCANS}) b WHERE scan_id % 4 = 0
UNION ALL SELECT scan_id, scan_id * 10 + 3, 'decide', 'later', CAST(7 AS DECIMAL(18,2)) FROM ({SCANS}) c WHERE scan_id % 8 = 0 UNION ALL SELECT scan_id, scan_id * 10 + 4, 'complete', NULL, NULL FROM ({SCANS}) d WHERE scan_id % 6 = 0
UNION ALL SELECT scan_id, scan_id * 10 + 5 + k, 'certify', NULL, NULL FROM ({SCANS}) e CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) n WHERE scan_id % 5 = 0 UNION ALL SELECT scan_id, scan_id * 10 + 9, 'delete', NULL, NULL FROM ({SCANS}) f WHERE scan_id % 50 = 7"""
SET = f"SELECT DISTINCT employee_number, CAST(employee_number % 5 AS INT) AS seq, CAST(9000 + employee_number AS DECIMAL(18,2)) AS annual_amount, concat('Set ', employee_name) AS employee_name FROM ({SCANS}) s WHERE employee_number % 4 = 0"
OLD = f"SELECT scan_id, CASE scan_id % 5 WHEN 0 THEN 'Asha' WHEN 1 THEN 'Asha  Rao' WHEN 2 THEN 'Asha Devi Rao' WHEN 3 THEN 'A B C D' ELSE '' END AS employee_name, CASE scan_id % 4 WHEN 0 THEN '{{{{}}}}' WHEN 1 THEN '{{{{\"a\":1}}}}' ELSE ' ' END AS decisions_json FROM ({SCANS}) s"
FILES = "SELECT p_partkey AS file, CASE p_partkey % 6 WHEN 0 THEN 'image/JPEG; q=1' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/plain' WHEN 3 THEN NULL ELSE 'image/png' END AS content_type, CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 11 = 0 THEN 20000000 ELSE p_size * 1000 END AS length FROM {part}"
RUNS = f"SELECT scan_id AS doc_id, CAST(run AS INT) AS run, (scan_id + run) % 17 = 0 AS failed FROM ({SCANS}) s CROSS JOIN (SELECT 0 AS run UNION ALL SELECT 1 AS run UNION ALL SELECT 2 AS run) r WHERE (scan_id * 3 + run) % 13 <> 5"
PAGES = f"SELECT scan_id, CASE page WHEN 1 THEN 'bill' ELSE 'prescription' END AS slot, CAST(page AS INT) AS page_no, concat('c', CAST(page AS STRING)) AS content FROM ({SCANS}) s CROSS JOIN (SELECT 1 AS page UNION ALL SELECT 2 AS page) p WHERE scan_id % 3 <> 0"
LEGACY = f"SELECT scan_id, 'old rx' AS prescription_image, CASE WHEN scan_id % 2 = 0 THEN 'old bill' END AS bill_image FROM ({SCANS}) s"
BOXES = f"SELECT scan_id, ordinal AS run, linenumber % 4 / 10.0 AS l, linenumber % 3 / 10.0 AS t, 0.5 + linenumber % 2 / 10.0 AS r, CASE WHEN ordinal % 5 = 0 THEN 0.1 ELSE 0.7 END AS b FROM ({BILL_ITEMS}) x WHERE ordinal <= 3"
TESTS = f"SELECT scan_id, ordinal, CASE WHEN ordinal <= 2 THEN 'own' ELSE 'lab' END AS side, concat('billtest-', lpad(CAST(ordinal AS STRING), 2, '0')) AS item_id, drug_name AS test_name FROM ({BILL_ITEMS}) x"


def scan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.review_states(scans(spark, sf_dir), view(spark, sf_dir, EVENTS))


def allowance_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.allowance_views(scans(spark, sf_dir), store.allowances(view(spark, sf_dir, SET)), "1995-96", 50)


def migrated_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = store.migrated(view(spark, sf_dir, OLD))
    return store.migrated(once).select("scan_id", "first_name", "middle_name", "last_name", "review_status")


def account_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.accounts(scans(spark, sf_dir))


def transcriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = store.transcription(rx_items(spark, sf_dir), bill_items(spark, sf_dir))
    return shown.select("scan_id", F.array_join(F.transform("medicines", lambda m: F.coalesce(m["name"], F.lit("?"))), "|").alias("medicines"), F.array_join(F.transform("lines", lambda x: F.coalesce(x["amount"], F.lit("?"))), "|").alias("amounts"))


def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.checked_uploads(view(spark, sf_dir, FILES)).select("file", "refused")


def incomplete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.incomplete_documents(view(spark, sf_dir, RUNS), 3)


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view(spark, sf_dir, RUNS).select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("image_sha"), F.lit("bill").alias("doc_type"), F.lit(3).alias("runs"), F.lit("m").alias("model"), F.lit("p4").alias("prompt_version"), F.lit("dmy").alias("date_order")).distinct().withColumn("key", inputs.content_key())
    cache = asked.where("doc_id % 3 <> 0").select("key", F.when(F.col("doc_id") % 5 == 0, "{broken").otherwise('{"a": 1}').alias("payload"))
    return inputs.cache_misses(asked, cache).select("doc_id", "key")


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.pages_of(view(spark, sf_dir, PAGES), view(spark, sf_dir, LEGACY))


def dictionary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = view(spark, sf_dir, DICTIONARY).withColumn("therapeutic_class", F.col("salt"))
    return inputs.search_dictionary(entries, part="an", schedule="H").select("ordinal", "brand", "salt")


def merged_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, TESTS)
    return inputs.merge_lab_bill(rows.where("side = 'own'"), rows.where("side = 'lab'"))


def box_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = view(spark, sf_dir, BOXES).select("scan_id", "run", F.array(*(F.col(c).cast("double") for c in "ltrb")).alias("box"))
    found = consensus.box_consensus(boxes, ["scan_id"], 3)
    return found.select("scan_id", F.round(F.get("box", F.lit(0)), 6).alias("left"), F.round(F.get("box", F.lit(2)), 6).alias("right"), "agreement")


def warning_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, RUNS).select("doc_id", "run", F.array(F.concat(F.lit("w"), (F.col("doc_id") % 4).cast("string")), F.concat(F.lit("r"), F.col("run").cast("string")), F.lit("w1")).alias("warnings"), F.array(F.col("run") + 1, F.lit(2)).alias("unreadable_pages"))
    told = consensus.warnings_in_order(runs).join(consensus.seen_pages(runs), "doc_id")
    return told.select("doc_id", F.array_join("warnings", ",").alias("warnings"), F.array_join("pages", ",").alias("pages"))


def aligned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of each bill, of which the second misspells and the third drops lines."""
    lines = view(spark, sf_dir, BILL_ITEMS, ("scan_id", "ordinal", "drug_name", "raw_text", "quantity")).select(F.col("scan_id").alias("doc_id"), "ordinal", F.concat_ws(" ", "drug_name", "raw_text", F.col("quantity").cast("string")).alias("raw_text"))
    spelt = lines.withColumn("raw_text", F.regexp_replace("raw_text", "o", "0"))
    runs = [df.withColumn("run", F.lit(k)) for k, df in enumerate((lines, spelt, lines.where("ordinal % 4 <> 3")))]
    return consensus.kept_lines(consensus.align(runs[0].union(runs[1]).union(runs[2])), 3)


def resolution_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.resolve(view(spark, sf_dir, LINES).select("raw"), view(spark, sf_dir, DICTIONARY))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.plans.registry import verdict_score
    from claimloom.plans.review import rebucketed_totals, row_decisions

    documents = store.export_json(scans(spark, sf_dir), row_decisions(spark, sf_dir), rebucketed_totals(spark, sf_dir), verdict_score(spark, sf_dir))
    return documents.select("scan_id", F.get_json_object("document", "$.summary.verdict").alias("verdict"), F.get_json_object("document", "$.review.claimed_amount").alias("claimed"), F.get_json_object("document", "$.envelope_version").alias("version"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (scan_states, allowance_views, migrated_scans, account_names, transcriptions, upload_checks, incomplete_documents, cache_misses, page_lists, dictionary_search, merged_tests, box_consensus, warning_lists, aligned_runs, resolution_chain, exported)

_SCANS = f"scans AS ({plain(SCANS)})"
_IOU = "greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.b, b.b) - greatest(a.t, b.t))"

ORACLE: dict[str, str] = {
    "scan_states": f"""WITH {_SCANS}, e AS ({plain(EVENTS)}), f AS (SELECT scan_id, bool_or(kind = 'delete') AS gone, bool_or(kind = 'open') AS o, bool_or(kind = 'complete') AS c, arg_max(payload, seq) FILTER (kind = 'decide') AS d, arg_max(amount, seq) FILTER (kind = 'decide') AS a, min(seq) FILTER (kind = 'certify') AS certified_at FROM e GROUP BY 1)
      SELECT scan_id, CASE WHEN c THEN 'reviewed' WHEN o THEN 'under_review' ELSE 'submitted' END AS review_status, d AS decisions, CAST(coalesce(a, 0) AS DECIMAL(18,2)) AS claimed_amount, year(created_on - INTERVAL 3 MONTH) || '-' || lpad(CAST((year(created_on - INTERVAL 3 MONTH) + 1) % 100 AS VARCHAR), 2, '0') AS allowance_year, certified_at
      FROM scans LEFT JOIN f USING (scan_id) WHERE NOT coalesce(gone, false)""",
    "allowance_views": f"""WITH {_SCANS}, s AS (SELECT employee_number, arg_max(annual_amount, seq) AS annual_amount, arg_max(employee_name, seq) AS set_name FROM ({plain(SET)}) x GROUP BY 1), own AS (SELECT * FROM scans WHERE created_on BETWEEN DATE '1995-04-01' AND DATE '1996-03-31'),
      u AS (SELECT employee_number, sum(claimed_amount) FILTER (review_status = 'reviewed' AND scan_id <> 50) AS used, count(*) FILTER (review_status = 'reviewed' AND scan_id <> 50) AS n, count(*) FILTER (review_status <> 'reviewed') AS w FROM own GROUP BY 1), a AS (SELECT employee_number, arg_max(employee_name, (created_on, scan_id)) AS seen FROM scans GROUP BY 1)
      SELECT a.employee_number, coalesce(set_name, seen) AS employee_name, CAST(coalesce(annual_amount, 12000) AS DECIMAL(18,2)) AS annual, CAST(coalesce(used, 0) AS DECIMAL(18,2)) AS used, CAST(greatest(0, coalesce(annual_amount, 12000) - coalesce(used, 0)) AS DECIMAL(18,2)) AS balance, coalesce(n, 0) AS scans_counted, coalesce(w, 0) AS awaiting
      FROM a LEFT JOIN u USING (employee_number) LEFT JOIN s USING (employee_number)""",
    "migrated_scans": f"""WITH o AS (SELECT *, regexp_split_to_array(trim(employee_name), '\\s+') AS w FROM ({plain(OLD)}) x) SELECT scan_id, CASE WHEN len(w) <= 3 THEN w[1] ELSE trim(employee_name) END AS first_name, CASE WHEN len(w) = 3 THEN w[2] ELSE '' END AS middle_name, CASE WHEN len(w) IN (2, 3) THEN w[-1] ELSE '' END AS last_name,
      CASE WHEN trim(decisions_json) IN ('', '{{}}') THEN 'submitted' ELSE 'reviewed' END AS review_status FROM o""",
    "account_names": f"WITH {_SCANS} SELECT employee_number, arg_max(employee_name, (created_on, scan_id)) AS display_name, count(*) AS scans FROM scans GROUP BY 1",
    "transcriptions": f"""WITH b AS ({plain(BILL_ITEMS)}), r AS (SELECT scan_id, ordinal, CASE WHEN scan_id % 29 = 0 OR (scan_id + ordinal) % 13 = 0 THEN NULL WHEN (scan_id + ordinal) % 11 = 0 THEN drug_name || ' Forte' ELSE drug_name END AS name FROM b WHERE (scan_id + ordinal) % 7 <> 0),
      x AS (SELECT scan_id, string_agg(coalesce(name, '?'), '|' ORDER BY ordinal) AS medicines FROM r GROUP BY 1), y AS (SELECT scan_id, string_agg(coalesce(CAST(CAST(line_total AS DECIMAL(18,4)) AS VARCHAR), '?'), '|' ORDER BY ordinal) AS amounts FROM b GROUP BY 1) SELECT scan_id, medicines, amounts FROM x FULL JOIN y USING (scan_id)""",
    "upload_checks": f"""SELECT file, CASE WHEN coalesce(lower(trim(split_part(content_type, ';', 1))), '') NOT IN ('image/jpeg', 'image/jpg', 'image/png', 'image/webp', 'application/pdf') THEN 'UNSUPPORTED_TYPE' WHEN length = 0 THEN 'EMPTY_FILE' WHEN length > 15728640 THEN 'FILE_TOO_LARGE' END AS refused FROM ({plain(FILES)}) f""",
    "incomplete_documents": f"SELECT * FROM (SELECT doc_id, count(DISTINCT run) FILTER (NOT failed) AS runs, count(*) FILTER (failed) AS failed FROM ({plain(RUNS)}) r GROUP BY 1) WHERE runs < 3 OR failed > 0",
    "cache_misses": f"""SELECT DISTINCT doc_id, sha256(concat_ws('|', sha256(CAST(doc_id AS VARCHAR)), 'bill:n3', 'm', 'p4', 'dmy')) AS key FROM ({plain(RUNS)}) r WHERE doc_id % 3 = 0 OR doc_id % 5 = 0""",
    "page_lists": f"""WITH p AS ({plain(PAGES)}), l AS (SELECT * FROM ({plain(LEGACY)}) x WHERE scan_id NOT IN (SELECT scan_id FROM p)) SELECT * FROM p UNION ALL SELECT scan_id, 'prescription', 1, prescription_image FROM l UNION ALL SELECT scan_id, 'bill', 1, bill_image FROM l WHERE bill_image IS NOT NULL""",
    "dictionary_search": f"SELECT ordinal, brand, salt FROM ({plain(DICTIONARY)}) d WHERE schedule = 'H' AND (contains(lower(brand), 'an') OR contains(lower(salt), 'an'))",
    "merged_tests": f"""WITH t AS ({plain(TESTS)}), c AS (SELECT scan_id, count(*) AS n FROM t WHERE side = 'own' GROUP BY 1) SELECT scan_id, item_id, test_name FROM t WHERE side = 'own'
      UNION ALL SELECT scan_id, printf('billtest-%02d', row_number() OVER (PARTITION BY scan_id ORDER BY ordinal) + coalesce(n, 0)), test_name FROM t LEFT JOIN c USING (scan_id) WHERE side = 'lab'""",
    "box_consensus": f"""WITH x AS (SELECT scan_id, run, CAST(l AS DOUBLE) AS l, CAST(t AS DOUBLE) AS t, CAST(r AS DOUBLE) AS r, CAST(b AS DOUBLE) AS b FROM ({plain(BOXES)}) q), s AS (SELECT * FROM x WHERE l BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1 AND r BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND r > l AND b > t),
      m AS (SELECT a.scan_id, a.run, b.l, b.r FROM s a JOIN s b ON a.scan_id = b.scan_id WHERE {_IOU} / ((a.r - a.l) * (a.b - a.t) + (b.r - b.l) * (b.b - b.t) - {_IOU}) >= 0.5), g AS (SELECT scan_id, run, count(*) AS n, avg(l) AS l, avg(r) AS r FROM m GROUP BY 1, 2), k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, run) = 1)
      SELECT d.scan_id, CASE WHEN n >= 2 THEN round(k.l, 6) END AS "left", CASE WHEN n >= 2 THEN round(k.r, 6) END AS "right", round(coalesce(n, 0) / 3, 2)::DOUBLE AS agreement FROM (SELECT DISTINCT scan_id FROM x) d LEFT JOIN k USING (scan_id)""",
    "warning_lists": f"""WITH r AS ({plain(RUNS)}), e AS (SELECT doc_id, run, unnest(['w' || CAST(doc_id % 4 AS VARCHAR), 'r' || CAST(run AS VARCHAR), 'w1']) AS w, generate_subscripts([1, 2, 3], 1) AS k FROM r), f AS (SELECT doc_id, w, min(run * 10 + k) AS first FROM e GROUP BY 1, 2), p AS (SELECT DISTINCT doc_id, unnest([run + 1, 2]) AS page FROM r)
      SELECT a.doc_id, warnings, pages FROM (SELECT doc_id, string_agg(w, ',' ORDER BY first) AS warnings FROM f GROUP BY 1) a JOIN (SELECT doc_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM p GROUP BY 1) b USING (doc_id)""",
}
