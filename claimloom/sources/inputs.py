"""What comes in: uploads, readings by run, the dictionary, pages and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Types of files that are taken, and the schedules of a dictionary.
MIME_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp", "application/pdf")
SCHEDULES = ("OTC", "H", "H1", "X")
MOST_UPLOAD_BYTES = 15 << 20
DICTIONARY = "brand_name string, salt_composition string, common_strengths string, form string, therapeutic_class string, schedule string"


def checked_uploads(files: DataFrame, most: int = MOST_UPLOAD_BYTES) -> DataFrame:
    """Files (content_type, length, ...) with the reason for which each is refused, null for those that are taken."""
    kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
    return files.withColumn("refused", F.when(~kind.isin(*MIME_TYPES), "UNSUPPORTED_TYPE").when(F.col("length") == 0, "EMPTY_FILE").when(F.col("length") > most, "FILE_TOO_LARGE"))


def incomplete_documents(runs: DataFrame, wanted: int) -> DataFrame:
    """(doc_id, runs, failed): documents of which a run failed or is missing; one failed run fails the document."""
    seen = runs.groupBy("doc_id").agg(F.countDistinct(F.when(~F.col("failed"), F.col("run"))).alias("runs"), F.count_if("failed").alias("failed"))
    return seen.where((F.col("runs") < wanted) | (F.col("failed") > 0))


def disagreeing_documents(runs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(doc_id): documents read more than once of which no line is kept though some were seen."""
    many = runs.groupBy("doc_id").agg(F.countDistinct("run").alias("n")).where("n > 1")
    kept = clusters.groupBy("doc_id").agg(F.bool_or("kept").alias("any_kept"), F.bool_or("unstable").alias("any_unstable")).where("NOT any_kept AND any_unstable")
    return many.join(kept, "doc_id").select("doc_id")


def content_key(image: str = "image_sha", kind: str = "doc_type", runs: str = "runs", model: str = "model", prompt: str = "prompt_version", order: str = "date_order"):
    """The key under which a reading is kept: everything that it depends on."""
    return F.sha2(F.concat_ws("|", F.col(image), F.concat(F.col(kind), F.lit(":n"), F.col(runs).cast("string")), F.col(model), F.col(prompt), F.col(order)), 256)


def cache_misses(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key, ...) without a readable entry (key, payload) in the cache; what isn't JSON is a miss."""
    good = cache.where(F.try_parse_json("payload").isNotNull()).select("key")
    return asked.join(good, "key", "left_anti")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, brand, salt, strengths, form, therapeutic_class, schedule) of a CSV; a schedule that isn't known counts as H."""
    rows = spark.read.schema(DICTIONARY).option("header", True).csv(path)
    schedule = F.upper(F.trim(F.coalesce("schedule", F.lit("H"))))
    strengths = F.filter(F.transform(F.split(F.coalesce("common_strengths", F.lit("")), r"\|"), F.trim), lambda x: x != "")
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return rows.select(F.monotonically_increasing_id().alias("ordinal"), F.upper(trimmed("brand_name")).alias("brand"), F.upper(trimmed("salt_composition")).alias("salt"), strengths.alias("strengths"), trimmed("form").alias("form"), trimmed("therapeutic_class").alias("therapeutic_class"), F.when(schedule.isin(*SCHEDULES), schedule).otherwise("H").alias("schedule"))


def search_dictionary(entries: DataFrame, part: str | None = None, therapeutic_class: str | None = None, schedule: str | None = None) -> DataFrame:
    """Entries whose brand or salt has the part, of a class and a schedule where they are given."""
    if part:
        entries = entries.where(F.lower("brand").contains(part.lower()) | F.lower("salt").contains(part.lower()))
    for column, wanted in (("therapeutic_class", therapeutic_class), ("schedule", schedule)):
        entries = entries.where(F.col(column) == wanted) if wanted else entries
    return entries


def pages_of(pages: DataFrame, legacy: DataFrame) -> DataFrame:
    """(scan_id, slot, page_no, content) in order; scans without pages of their own show the two that older records carry."""
    old = legacy.join(pages.select("scan_id").distinct(), "scan_id", "left_anti")
    two = F.array(F.struct(F.lit("prescription").alias("slot"), F.col("prescription_image").alias("content")), F.struct(F.lit("bill").alias("slot"), F.col("bill_image").alias("content")))
    shown = old.select("scan_id", F.explode(two).alias("p")).where("p.content IS NOT NULL").select("scan_id", "p.slot", F.lit(1).alias("page_no"), "p.content")
    return pages.select("scan_id", "slot", "page_no", "content").unionByName(shown).orderBy("scan_id", "slot", "page_no")


def sample_catalogue(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Samples whose files are both there; `samples` has prescription and bill, `files` has path."""
    there = lambda c: files.select(F.col("path").alias(c)).distinct()
    return samples.join(there("prescription"), "prescription", "left_semi").join(there("bill"), "bill", "left_semi")


def merge_lab_bill(own: DataFrame, lab: DataFrame) -> DataFrame:
    """(scan_id, item_id, test_name): the tests of the pharmacy bill and then of the lab bill, whose ids go on from the first's count."""
    from pyspark.sql import Window

    counts = own.groupBy("scan_id").agg(F.count("*").alias("before"))
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy("ordinal")) + F.coalesce("before", F.lit(0))
    again = lab.join(counts, "scan_id", "left").withColumn("item_id", F.format_string("billtest-%02d", place.cast("int")))
    return own.select("scan_id", "item_id", "test_name").unionByName(again.select("scan_id", "item_id", "test_name"))
