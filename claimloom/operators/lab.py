"""Ordered, billed and reported tests, compared by the components that each panel has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import lab_names, text
from claimloom.operators.rules import told, unavailable
from claimloom.session import written as stored


def panel_table(spark) -> DataFrame:
    """(panel, place, component, billable): the panels as a small table; derived components aren't billable."""
    rows = [(p, k, c, c not in lab_names.DERIVED) for p, parts in lab_names.PANELS.items() for k, c in enumerate(parts)]
    return spark.createDataFrame(rows, "panel string, place int, component string, billable boolean")


def resolve_names(tests: DataFrame, *, fuzzy: bool = True) -> DataFrame:
    """`tests` with kind, name and method, from their test_name or else raw_text; distinct texts alone are looked up.

    What they are is stored, so that its size is known before it is joined: a few texts go to the tests, which stay where they lie.
    The first step that knows a key decides. Of parts, a panel with a test is that test, tests without a panel are the first of them,
    and a panel whose component isn't known is nothing.
    """
    written = tests.withColumn("written", text.label(F.col("test_name"), F.col("raw_text")))
    keys = written.where(F.col("written").isNotNull()).select("written").distinct().select("written", F.explode(lab_names.candidates(F.col("written"))).alias("c")).select("written", "c.*")
    known = keys.select("key").distinct().select("key", lab_names.lookup(F.col("key"), fuzzy=fuzzy).alias("m")).where("m IS NOT NULL").select("key", "m.*")
    found = keys.join(known, "key").groupBy("written").agg(
        F.min_by(F.struct("kind", "name", F.concat("method", F.element_at(F.array(F.lit(""), F.lit("_untimed"), F.lit("_parenthetical")), F.col("step") + 1)).alias("method")), F.when(F.col("step") < 3, F.col("step"))).alias("whole"),
        F.max(F.when(F.col("step") == 3, F.col("kind") == "panel")).alias("panel"),
        F.min_by("name", F.when((F.col("step") == 3) & (F.col("kind") == "test"), F.col("part"))).alias("part"),
    )
    told_ = found.select("written", F.coalesce("whole", F.when(F.col("part").isNotNull(), F.struct(F.lit("test").alias("kind"), F.col("part").alias("name"), F.when(F.col("panel"), "panel_component").otherwise("component_only").alias("method")))).alias("m"))
    return written.join(stored(told_), "written", "left").select(*tests.columns, "written", "m.kind", "m.name", "m.method")


def components(tests: DataFrame, panels: DataFrame) -> DataFrame:
    """One row for each component of each test; a test that is no panel is its own component. `panels` has (panel, component, billable)."""
    known = panels.withColumnRenamed("panel", "test_name")
    parts = tests.where(F.col("test_name").isNotNull()).join(known, "test_name", "left")
    return parts.select("scan_id", "item_id", "ordinal", "test_name", F.coalesce("component", "test_name").alias("component"), F.coalesce("billable", F.lit(True)).alias("billable"))


def coverage(ordered: DataFrame, billed: DataFrame) -> DataFrame:
    """For each ordered test, how many of its billable components a billed line covers, and PANEL_PARTIAL or TEST_NOT_BILLED."""
    have = billed.select("scan_id", "component").distinct().withColumn("billed", F.lit(True))
    need = ordered.where("billable").join(have, ["scan_id", "component"], "left")
    counted = need.groupBy("scan_id", "item_id", "test_name").agg(F.count("*").alias("required"), F.count("billed").alias("covered"))
    code = F.when(F.col("covered") == 0, "TEST_NOT_BILLED").when(F.col("covered") < F.col("required"), "PANEL_PARTIAL")
    return counted.withColumn("rule_code", code)


def report_axis(ordered: DataFrame, billed: DataFrame, reported: DataFrame) -> DataFrame:
    """Differences between the three sets of components of a scan that has a report."""
    sets = [x.select("scan_id", "component").distinct() for x in (ordered, billed, reported)]
    held = reported.select("scan_id").distinct()
    missing = lambda a, b, code: a.join(held, "scan_id", "left_semi").join(b, ["scan_id", "component"], "left_anti").withColumn("rule_code", F.lit(code))
    asked, charged, told_ = sets
    return missing(charged, told_, "TEST_BILLED_NOT_REPORTED").union(missing(told_, charged, "TEST_REPORTED_NOT_BILLED")).union(missing(told_, asked, "TEST_REPORTED_NOT_ORDERED"))


def parts_of(tests: DataFrame, panels: DataFrame) -> DataFrame:
    """(scan_id, item_id, ordinal, name, place, component, billable) of resolved tests."""
    known = tests.where(F.col("name").isNotNull()).join(panels.withColumnRenamed("panel", "of"), (F.col("kind") == "panel") & (F.col("name") == F.col("of")), "left")
    return known.select("scan_id", "item_id", "ordinal", "name", F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("component", "name").alias("component"), F.coalesce("billable", F.lit(True)).alias("billable"))


def pair_tests(ordered: DataFrame, billed: DataFrame, panels: DataFrame) -> DataFrame:
    """(scan_id, rx_item, bill_item, covers, similarity, found, required, missing) for ordered tests of which a component is billed.

    `bill_item` is the first covering line, by the order of components and then of the bill; `covers` names all, repeats included.
    """
    need, have = parts_of(ordered, panels), parts_of(billed, panels)
    offered = have.select("scan_id", "component", F.col("item_id").alias("bill_item"), F.col("ordinal").alias("bill_ordinal"))
    met = need.join(offered, ["scan_id", "component"], "left")
    each = met.groupBy("scan_id", "item_id", "name", "place", "component", "billable").agg(F.sort_array(F.collect_list(F.when(F.col("bill_item").isNotNull(), F.struct("place", "bill_ordinal", "bill_item")))).alias("lines"))
    by_test = each.groupBy("scan_id", F.col("item_id").alias("rx_item"), "name").agg(
        F.sort_array(F.flatten(F.collect_list("lines"))).alias("lines"),
        F.count_if(F.size("lines") > 0).alias("found"),
        F.count_if("billable").alias("required"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("billable") & (F.size("lines") == 0), F.struct("place", "component")))), lambda x: x["component"]).alias("missing"),
    )
    covers = F.transform("lines", lambda x: x["bill_item"])
    share = F.when(F.size("missing") == 0, 1.0).otherwise(F.round(F.col("found") / F.col("required"), 4))
    return by_test.select("scan_id", "rx_item", "name", F.when(F.size("lines") > 0, F.get(covers, F.lit(0))).alias("bill_item"), covers.alias("covers"), share.alias("similarity"), "found", "required", "missing")


def _no_bill() -> Column:
    """no_lab_bill or lab_bill_unreadable, for a scan without billed tests."""
    none_billed = F.col("n_billed") == 0
    return F.when(none_billed & F.coalesce(~F.col("lab_bill"), F.col("has_items")), "no_lab_bill").when(none_billed & F.coalesce(F.col("lab_bill"), F.lit(False)), "lab_bill_unreadable")


def _doubt() -> Column:
    """Why a scan's orders can't tell which tests were not ordered."""
    none_ordered = F.col("n_ordered") == 0
    return F.when(F.col("unknown") > 0, "unidentified_orders").when(none_ordered & F.coalesce(F.col("investigations"), F.lit(False)), "orders_unreadable").when(none_ordered & F.col("investigations").isNull(), "orders_unconfirmed")


def scan_gaps(ordered: DataFrame, billed: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_id, gap, findings): the same as `review.document_gaps` of `lab_findings`, of tests that have an item_id, without pairing any.

    Where the bill is missing or unreadable nothing is billed, so every ordered test with a name is without a bill; each scan's counts tell that.
    """
    wanted = ordered.groupBy("scan_id").agg(F.count("*").alias("n_ordered"), F.count_if(F.col("name").isNull()).alias("unknown"), F.size(F.collect_set(F.when(F.col("name").isNotNull(), F.struct("item_id", "name")))).cast("long").alias("named"))
    charged = billed.groupBy("scan_id").agg(F.count("*").alias("n_billed"))
    counted = scans.select("scan_id", "investigations", "lab_bill", "has_items").join(wanted.join(charged, "scan_id", "full"), "scan_id").fillna(0, ["n_billed", "n_ordered", "unknown", "named"])
    bill = F.when(_no_bill() == "no_lab_bill", "lab_bill_missing").otherwise(_no_bill())
    orders = F.when(_doubt().isNotNull() & (F.col("n_billed") > 0), "orders_unreadable")
    gap = F.when(bill.isNotNull(), F.struct(bill.alias("gap"), F.col("named").alias("n"))).when(orders.isNotNull(), F.struct(orders.alias("gap"), F.lit(1).cast("long").alias("n")))
    return counted.select("scan_id", gap.alias("g")).where("g.n > 0").groupBy("scan_id", "g.gap").agg(F.sum("g.n").alias("findings"))


def lab_findings(ordered: DataFrame, billed: DataFrame, scans: DataFrame, panels: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """TEST_UNRESOLVED, TEST_NOT_BILLED, PANEL_PARTIAL, TEST_NOT_PRESCRIBED and TEST_DUPLICATE, softened where the other side can't support them.

    Tests carry written, kind, name; `scans` has investigations (true, false or null) and lab_bill (whether one was handed in, null if
    not stated) and has_items. A scan without tests on either side and without a section for them has no findings. `pairs` are those of `pair_tests`,
    if the caller has them.
    """
    pairs = pair_tests(ordered, billed, panels) if pairs is None else pairs
    met = pairs.where("found > 0")
    facts = scans.select("scan_id", "investigations", "lab_bill", "has_items")
    facts = facts.join(billed.groupBy("scan_id").agg(F.count("*").alias("n_billed"), F.count_if(F.coalesce(F.trim("test_name"), F.lit("")) == "").alias("unnamed")), "scan_id", "left")
    facts = facts.join(ordered.groupBy("scan_id").agg(F.count("*").alias("n_ordered"), F.count_if(F.col("name").isNull()).alias("unknown")), "scan_id", "left").fillna(0, ["n_billed", "unnamed", "n_ordered", "unknown"])
    softened = _no_bill().when(F.col("unnamed") > 0, "unidentified_billed_lines")
    facts = facts.select("scan_id", "n_billed", softened.alias("softened"), _doubt().alias("doubt"))
    detail = lambda c: F.when(c.isNotNull(), F.to_json(F.struct(c.alias("softened_code"))))
    soft = lambda c: F.when(c.isNull(), "critical").otherwise("warning")
    unknown = ordered.where("name IS NULL")
    absent = pairs.where("found = 0").join(facts, "scan_id")
    partial = met.where(F.size("missing") > 0)
    consumed = met.select("scan_id", F.explode("covers").alias("item_id")).distinct()
    loose = billed.join(consumed, ["scan_id", "item_id"], "left_anti").join(facts, "scan_id")
    named = F.coalesce(F.trim("test_name"), F.lit("")) != ""
    item = F.col("item_id")
    counted = billed.where(F.col("quantity") > 1)
    uncounted = billed.where(F.col("quantity").isNull()).groupBy("scan_id").agg(F.count("*").alias("n"), F.min_by("item_id", "ordinal").alias("first"))
    again = billed.where(F.col("name").isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("scan_id", "name").orderBy("ordinal"))).where("k > 1")
    doubtful = facts.where("doubt IS NOT NULL AND n_billed > 0")
    parts = [
        told(unknown, "TEST_UNRESOLVED", "info", rx=item),
        unavailable(unknown, "test billing", rx=item),
        told(absent, "TEST_NOT_BILLED", soft(F.col("softened")), rx=F.col("rx_item"), detail=detail(F.col("softened"))),
        told(partial, "PANEL_PARTIAL", "warning", F.col("rx_item"), F.col("bill_item"), detail=F.to_json(F.struct(F.col("missing").alias("missing_components")))),
        told(loose.where("name IS NULL"), "TEST_UNRESOLVED", "info", bill=item),
        unavailable(loose.where(~named), "test authorisation", bill=item),
        told(loose.where(named), "TEST_NOT_PRESCRIBED", soft(F.col("doubt")), bill=item, detail=detail(F.col("doubt"))),
        unavailable(doubtful, "test authorisation", detail=detail(F.col("doubt"))),
        told(counted, "TEST_DUPLICATE", "warning", bill=item),
        unavailable(uncounted, "repeat test billing", bill=F.when(F.col("n") == 1, F.col("first"))),
        told(again, "TEST_DUPLICATE", "warning", bill=item),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def report_findings(ordered: DataFrame, billed: DataFrame, reported: DataFrame, scans: DataFrame, panels: DataFrame) -> DataFrame:
    """The report of a scan against its bill and orders, its patient and its date; `scans` has rx_patient, report_patient, rx_date, collected, has_report, investigations, lab_bill.

    Reports are compared by their test names alone, so `reported` should be resolved without its raw text.
    """
    held = scans.where("has_report")
    sets = [parts_of(x, panels).select("scan_id", "component").distinct() for x in (ordered, billed, reported)]
    asked, charged, told_ = (x.join(held.select("scan_id"), "scan_id", "left_semi") for x in sets)
    minus = lambda a, b: a.join(b, ["scan_id", "component"], "left_anti")
    flagged = held.join(charged.select("scan_id").distinct().withColumn("billed_any", F.lit(True)), "scan_id", "left").join(asked.select("scan_id").distinct().withColumn("asked_any", F.lit(True)), "scan_id", "left")
    compared = flagged.where(F.coalesce("billed_any", F.lit(False)) | F.coalesce("lab_bill", F.lit(False))).select("scan_id")
    readable = flagged.where(F.coalesce("asked_any", F.lit(False)) | F.coalesce(~F.col("investigations"), F.lit(False))).select("scan_id")
    named = F.to_json(F.struct("component"))
    days = F.datediff("rx_date", "collected")
    unread = reported.where("name IS NULL").select("scan_id").distinct().join(held.select("scan_id"), "scan_id", "left_semi")
    parts = [
        told(minus(charged, told_), "TEST_BILLED_NOT_REPORTED", "critical", detail=named),
        unavailable(held.join(compared, "scan_id", "left_anti"), "billed against reported"),
        told(minus(told_, charged).join(compared, "scan_id", "left_semi"), "TEST_REPORTED_NOT_BILLED", "info", detail=named),
        told(minus(told_, asked).join(readable, "scan_id", "left_semi"), "TEST_REPORTED_NOT_ORDERED", "warning", detail=named),
        unavailable(told_.select("scan_id").distinct().join(readable, "scan_id", "left_anti"), "reported against ordered"),
        told(held.where(~text.same_person(F.col("report_patient"), F.col("rx_patient"))), "REPORT_PATIENT_MISMATCH", "warning"),
        told(held.where(days > GRACE_DAYS), "REPORT_DATE_ANOMALY", "warning", detail=F.to_json(F.struct(days.alias("days_before")))),
        unavailable(held.where(days.isNull()), "report timing"),
        unavailable(unread, "reported tests"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


#: Days that a sample may be taken before the prescription.
GRACE_DAYS = 1
