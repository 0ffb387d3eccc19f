"""Checks of a scan against those before it, and accounts over many scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.groups import whole_groups
from claimloom.session import laid_out

DEFAULT_ALLOWANCE = "12000.00"


def early_repeats(scans: DataFrame, lines: DataFrame) -> DataFrame:
    """The latest earlier bill of the same employee with the same salt whose course still ran; other bills of the same number don't count."""
    courses = lines.where(F.col("salt").isNotNull()).select("scan_id", "salt").distinct().join(scans.where(F.col("bill_date").isNotNull()).select("scan_id", "employee_number", "bill_date", "bill_no", "course_days"), "scan_id")
    now, then = courses.alias("n"), courses.alias("t")
    gap = F.datediff(F.col("n.bill_date"), F.col("t.bill_date"))
    met = now.join(then, (F.col("n.employee_number") == F.col("t.employee_number")) & (F.col("n.salt") == F.col("t.salt")) & (F.col("n.scan_id") != F.col("t.scan_id")) & (F.col("n.bill_no") != F.col("t.bill_no")) & (gap >= 0) & (gap < F.col("t.course_days")))
    latest = F.row_number().over(Window.partitionBy("scan_id", "salt").orderBy(F.desc("prior_date"), F.desc("prior_scan_id")))
    told = met.select("n.scan_id", "n.salt", F.col("t.scan_id").alias("prior_scan_id"), F.col("t.bill_date").alias("prior_date"), gap.cast("bigint").alias("gap_days"), F.col("t.course_days").cast("bigint").alias("course_days"))
    return told.withColumn("k", latest).where("k = 1").drop("k", "prior_date")


def duplicate_bills(scans: DataFrame) -> DataFrame:
    """The earliest other scan with the same pharmacy and bill number, compared letters and digits alone, and how many there are."""
    keyed = scans.withColumn("no", F.lower(F.regexp_replace("bill_no", r"[^\p{L}\p{N}]", ""))).where("no <> ''")
    order = Window.partitionBy("pharmacy_name", "no").orderBy("created_on", "scan_id")
    placed = keyed.withColumn("first_scan_id", F.first("scan_id").over(order)).withColumn("earlier_scans", F.row_number().over(order) - 1)
    return placed.where("earlier_scans > 0 AND pharmacy_name IS NOT NULL").select("scan_id", "first_scan_id", F.col("earlier_scans").cast("bigint").alias("earlier_scans"))


def line_overlap(scans: DataFrame, lines: DataFrame, least: float = 0.80) -> DataFrame:
    """Pairs of scans of one pharmacy and day whose sets of names overlap by `least` of the larger set; the earlier scan comes first."""
    sets = lines.groupBy("scan_id").agg(F.array_sort(F.collect_set("drug_name")).alias("names"))
    held = scans.where(F.col("bill_date").isNotNull()).select("scan_id", "pharmacy_name", "bill_date").join(sets, "scan_id")
    a, b = held.alias("a"), held.alias("b")
    met = a.join(b, (F.col("a.pharmacy_name") == F.col("b.pharmacy_name")) & (F.col("a.bill_date") == F.col("b.bill_date")) & (F.col("a.scan_id") < F.col("b.scan_id")))
    share = F.size(F.array_intersect("a.names", "b.names")) / F.greatest(F.size("a.names"), F.size("b.names"))
    return met.select(F.col("a.scan_id").alias("first_scan_id"), F.col("b.scan_id").alias("scan_id"), F.round(share, 4).alias("overlap")).where(F.col("overlap") >= least)


def licence_conflicts(scans: DataFrame) -> DataFrame:
    """Pharmacies seen with two or more different licence numbers."""
    key = F.lower(F.regexp_replace("licence_no", r"[^\p{L}\p{N}]", ""))
    return scans.where(key != "").groupBy("pharmacy_name").agg(F.countDistinct(key).alias("licences"), F.count("*").alias("scans")).where("licences > 1")


def allowance_year(day: Column) -> Column:
    """The April to March year of a date, as 2025-26."""
    start = F.year(F.add_months(day, -3))
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def allowance(scans: DataFrame, annual: str = DEFAULT_ALLOWANCE) -> DataFrame:
    """What each employee's reviewed scans used of a year's allowance, what remains, and how many scans wait."""
    reviewed = F.col("review_status") == "reviewed"
    used = F.coalesce(F.sum(F.when(reviewed, F.col("claimed_amount"))), F.lit(0)).cast("decimal(18,2)")
    sums = scans.groupBy("employee_number", allowance_year(F.col("created_on")).alias("allowance_year")).agg(used.alias("used"), F.count_if(~reviewed).alias("awaiting"))
    return sums.withColumn("balance", F.greatest(F.lit(0).cast("decimal(18,2)"), (F.lit(annual).cast("decimal(18,2)") - F.col("used")).cast("decimal(18,2)")))


def dashboard(scans: DataFrame) -> DataFrame:
    """Counts, sums and the upper median of processing time by review status.

    The median is the element at floor(n / 2), found from the counts of the distinct values rather than by gathering a group's rows.
    """
    by_value = scans.groupBy("review_status", "processing_ms").agg(F.count("*").alias("n"), F.sum("claimed_amount").alias("amount"))
    upto = Window.partitionBy("review_status").orderBy("processing_ms").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("review_status")
    placed = by_value.withColumn("below", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
    median = F.min(F.when(F.col("below") > F.floor(F.col("all") / 2), F.col("processing_ms")))
    return placed.groupBy("review_status").agg(F.sum("n").alias("scans"), F.sum("amount").cast("decimal(18,2)").alias("claimed"), median.cast("bigint").alias("median_ms"))


def per_day(rows: DataFrame, day: str) -> DataFrame:
    """Counts for each day from the first to the last, days without rows included."""
    counts = rows.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))
    days = counts.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def frequent_codes(findings: DataFrame, scans: DataFrame, newest: int = 20) -> DataFrame:
    """How often each code of a warning or worse occurs in the newest scans."""
    top = scans.orderBy(F.desc("created_on"), F.desc("scan_id")).limit(newest).select("scan_id")
    return findings.where(F.col("severity").isin("critical", "warning")).join(F.broadcast(top), "scan_id").groupBy("rule_code").agg(F.count("*").alias("n"))


#: Likeness from which two pharmacies or patients are one, and earlier scans below which finding none says little.
SAME_NAME, MEANINGFUL = 85.0, 5


def like_names(names: DataFrame, column: str, least: float = SAME_NAME) -> DataFrame:
    """(name, other) of distinct names that are the same by the order-free likeness, each with itself too.

    Pairs come from an inverted index with a prefix filter, as in `resolution.alike`.
    """
    from claimloom.functions.fuzzy import token_sort_ratio
    from claimloom.operators.likeness import near_pairs

    each = names.select(F.lower(F.trim(column)).alias("name")).where("name <> ''").distinct()
    pairs = near_pairs(each, "name", each.withColumnRenamed("name", "other"), "other", once=False, shared_words=False).where("name <> other")
    return pairs.where(token_sort_ratio("name", "other") >= least).union(each.select("name", F.col("name").alias("other")))


def _earlier_of_number(wide: DataFrame, keyed: DataFrame) -> DataFrame:
    """(scan_id, prior, at, method, n): the earliest scan of the number and shop, and how many there are before this one.

    Both are told from the order within a shop's number, so that a number used often is not met pair by pair.
    """
    place = ("no", "created_on", "scan_id")
    asked = wide.select("shop", *place, F.lit(False).alias("held"))
    every = asked.union(keyed.select(F.col("pharmacy").alias("shop"), *place, F.lit(True).alias("held"))).where("shop IS NOT NULL")
    held, group = F.when(F.col("held"), 1), Window.partitionBy("shop", "no")
    upto = F.count(held).over(group.orderBy("created_on", "scan_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.count(held).over(Window.partitionBy("shop", *place))
    first = F.min(F.when(F.col("held"), F.struct("created_on", "scan_id"))).over(group)
    placed = every.withColumns({"n": upto - same, "first": first}).where("NOT held AND n > 0")
    return placed.select("scan_id", F.col("first.scan_id").alias("prior"), F.col("first.created_on").alias("at"), F.lit("number").alias("method"), "n")


def _places(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Days (the least for none), ids and shops of a number's scans, and the names of the shops."""
    day = pc.fill_null(pc.cast(rows.column("created_on").combine_chunks(), pa.int32()), -(2**31)).to_numpy()
    shop = rows.column("pharmacy").combine_chunks().dictionary_encode()
    return day, rows.column("scan_id").to_numpy(), shop.indices.to_numpy(), shop.dictionary.to_pylist()


def _earlier_of_alike(keyed: DataFrame, pharmacies: DataFrame) -> DataFrame:
    """`_earlier_of_number` over all shops of alike names, with one row for each scan: the earliest of them all and how many there are.

    A number's scans come together once, with the names that are alike beside them, once for each shop that has the number, so scans
    aren't dealt out again for every name like theirs.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "no"):
            number = table.column("no").combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), table.num_rows]
            is_scan = table.column("alike").is_null()
            found = []
            for a, z in zip(cuts, cuts[1:]):
                rows = table.slice(a, z - a)
                held = rows.filter(is_scan.slice(a, z - a))
                if held.num_rows < 2:
                    continue
                day, scan, shop, shops = _places(held)
                order = np.lexsort((scan, day))
                day, scan, shop = day[order], scan[order], shop[order]
                steps = np.concatenate([[0], np.cumsum((np.diff(day) != 0) | (np.diff(scan) != 0))])
                by_shop = np.argsort(shop, kind="stable")
                of = {name: x for name, x in zip(shops, np.split(by_shop, np.cumsum(np.bincount(shop))[:-1]))}
                names = rows.filter(pc.invert(is_scan.slice(a, z - a)))
                for name, others in zip(names.column("pharmacy").to_pylist(), names.column("alike").to_pylist()):
                    asked, met = of.get(name), [of[x] for x in others if x in of]
                    if asked is None or not met:
                        continue
                    at = np.sort(np.concatenate(met))
                    n = np.searchsorted(steps[at], steps[asked])
                    first = at[0]
                    found.append((scan[asked[n > 0]], n[n > 0], scan[first], day[first]))
            if found:
                sizes = [len(x[0]) for x in found]
                days = np.repeat(np.array([x[3] for x in found], np.int32), sizes)
                yield from pa.table({
                    "scan_id": np.concatenate([x[0] for x in found]), "prior": np.repeat(np.array([x[2] for x in found], np.int64), sizes),
                    "at": pa.array(days, mask=days == -(2**31)).cast(pa.date32()), "n": np.concatenate([x[1] for x in found]).astype(np.int64),
                }).to_batches()

    scans = keyed.where("pharmacy IS NOT NULL").select("no", "pharmacy", "created_on", "scan_id")
    alike = pharmacies.groupBy(F.col("name").alias("pharmacy")).agg(F.collect_list("other").alias("alike"))
    names = scans.select("no", "pharmacy").distinct().join(alike, "pharmacy").select("no", "pharmacy", F.lit(None).cast("date").alias("created_on"), F.lit(None).cast("long").alias("scan_id"), "alike")
    every = scans.withColumn("alike", F.lit(None).cast("array<string>")).union(names)
    # By a hash of the number, so that a shuffle of its own brings both together.
    dealt = every.repartition(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("no")).sortWithinPartitions("no")
    return dealt.mapInArrow(each, "scan_id long, prior long, at date, n long").select("scan_id", "prior", "at", F.lit("number").alias("method"), "n")


def resubmissions(scans: DataFrame, lines: DataFrame, *, pharmacies: DataFrame | None = None, least_overlap: float = 0.80) -> DataFrame:
    """(scan_id, rule_code, prior_scan_id, method, others, changed): the earliest other bill that this one repeats, and what changed since.

    First bills of the same number and pharmacy are met; where none is, those of the pharmacy and day whose lines overlap. A bill with
    differences may be a corrected one. `pharmacies` has (name, other) of alike names; without it names must be equal. Scans are met
    with earlier ones alone.
    """
    fold = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    keyed = scans.select("scan_id", "created_on", "bill_date", "claimed_amount", F.lower(F.trim("pharmacy_name")).alias("pharmacy"), fold(F.col("bill_no")).alias("no"))
    wide = keyed.withColumn("shop", F.col("pharmacy")) if pharmacies is None else keyed.join(pharmacies.select(F.col("name").alias("pharmacy"), F.col("other").alias("shop")), "pharmacy")
    earlier = lambda a, b: F.struct(F.col(f"{b}.created_on"), F.col(f"{b}.scan_id")) < F.struct(F.col(f"{a}.created_on"), F.col(f"{a}.scan_id"))
    numbered = keyed.where("no <> ''")
    by_number = laid_out(_earlier_of_number(wide.where("no <> ''"), numbered) if pharmacies is None else _earlier_of_alike(numbered, pharmacies))
    names = lines.select("scan_id", fold(F.col("drug_name")).alias("n"), "line_total").where("n <> ''")
    sets = names.groupBy("scan_id").agg(F.collect_set("n").alias("names"), F.count("*").alias("held"))
    rest = wide.join(by_number.select("scan_id").distinct(), "scan_id", "left_anti").join(sets, "scan_id").alias("a")
    on_day = rest.join(keyed.join(sets, "scan_id").alias("b"), (F.col("a.shop") == F.col("b.pharmacy")) & (F.col("a.bill_date") == F.col("b.bill_date")) & earlier("a", "b"))
    share = F.size(F.array_intersect("a.names", "b.names")) / F.greatest(F.size("a.names"), F.size("b.names"))
    by_lines = on_day.where(share >= least_overlap).select(F.col("a.scan_id").alias("scan_id"), F.col("b.scan_id").alias("prior"), F.col("b.created_on").alias("at"), F.lit("lines").alias("method"), F.lit(1).cast("long").alias("n"))
    first = laid_out(by_number.union(by_lines).groupBy("scan_id").agg(F.min_by("prior", F.struct("at", "prior")).alias("prior_scan_id"), F.first("method").alias("method"), F.sum("n").alias("met")))
    totals = names.groupBy("scan_id", "n").agg(F.max("line_total").alias("amount"))
    now = first.select("scan_id", "prior_scan_id").join(totals, "scan_id")
    then = first.select("scan_id", "prior_scan_id").join(totals.select(F.col("scan_id").alias("prior_scan_id"), F.col("n"), F.col("amount").alias("was")), "prior_scan_id")
    changed = now.select("scan_id", "n", F.col("amount"), F.lit(True).alias("has")).join(then.select("scan_id", "n", "was", F.lit(True).alias("had")), ["scan_id", "n"], "full")
    lines_changed = changed.where(F.col("has").isNull() | F.col("had").isNull() | (F.col("amount") != F.col("was"))).groupBy("scan_id").agg(F.count("*").alias("changed_lines"))
    sizes = keyed.join(sets.select("scan_id", "held"), "scan_id", "left").select("scan_id", "claimed_amount", "held")
    told = first.join(lines_changed, "scan_id", "left").join(sizes, "scan_id").join(sizes.select(F.col("scan_id").alias("prior_scan_id"), F.col("claimed_amount").alias("was_amount"), F.col("held").alias("was_held")), "prior_scan_id")
    differs = F.coalesce("changed_lines", F.lit(0)) + F.coalesce((F.col("claimed_amount") != F.col("was_amount")).cast("long"), F.lit(0)) + (~F.col("held").eqNullSafe(F.col("was_held"))).cast("long")
    return told.select("scan_id", F.when(differs > 0, "POSSIBLE_RESUBMISSION").otherwise("DUPLICATE_BILL").alias("rule_code"), "prior_scan_id", "method", (F.col("met") - 1).alias("others"), differs.alias("changed"))


def history_findings(scans: DataFrame, lines: DataFrame, *, pharmacies: DataFrame | None = None) -> DataFrame:
    """What earlier scans say about each: repeated or re-issued bills, courses claimed again, licences that differ, and checks not made.

    With fewer than MEANINGFUL earlier scans, finding no duplicate says little; only the earliest scans of all can be so.
    """
    from claimloom.operators.rules import told, unavailable

    again = resubmissions(scans, lines, pharmacies=pharmacies)
    repeats = early_repeats(scans, lines)
    shops = licence_conflicts(scans)
    earliest = scans.orderBy("created_on", "scan_id").limit(MEANINGFUL).select("scan_id", "created_on")
    placed = earliest.withColumn("k", F.row_number().over(Window.orderBy("created_on", "scan_id")))
    unlike = scans.where("licence_no IS NOT NULL").join(shops.select("pharmacy_name"), "pharmacy_name", "left_semi")
    parts = (
        told(again, F.col("rule_code"), F.when(F.col("rule_code") == "DUPLICATE_BILL", "critical").otherwise("warning"), detail=F.to_json(F.struct("prior_scan_id", "method", "others"))),
        told(repeats, "EARLY_REPEAT", "warning", detail=F.to_json(F.struct("salt", "prior_scan_id", "gap_days"))),
        told(unlike, "LICENCE_INCONSISTENT", "warning"),
        unavailable(placed.where("k = 1"), "scan history"),
        unavailable(placed.where("k > 1").join(again.select("scan_id"), "scan_id", "left_anti"), "duplicate bill"),
        unavailable(scans.where("bill_date IS NULL"), "early repeat"),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
