"""Test rows that account for every line, and sinks whose batches can be repeated."""

import collections
import datetime

from claimloom.operators import lab, lab_rows
from claimloom.sources import store

TEST = "scan_id long, ordinal int, item_id string, test_name string, raw_text string, quantity double"


def resolved(spark, rows):
    return lab.resolve_names(spark.createDataFrame(rows, TEST), fuzzy=False)


def test_every_line_has_its_row(spark):
    panels = lab.panel_table(spark)
    name = "Thyroid Profile"
    parts = [r.component for r in panels.where(panels.panel == name).orderBy("place").collect()]
    ordered = [(1, 1, "o1", name, None, 1.0), (1, 2, "o2", None, "scribble", 1.0), (1, 3, "o3", "Cortisol", None, 1.0), (2, 1, "o1", name, None, 1.0)]
    billed = [(1, 1 + k, f"b{k}", p, None, 1.0) for k, p in enumerate(parts)] + [(1, 90, "b90", "Handling charge", None, 1.0), (3, 1, "b0", parts[0], None, 1.0)]
    got = lab_rows.rows_of_tests(resolved(spark, ordered), resolved(spark, billed), panels)
    rows = {(r.scan_id, r.row_key): r for r in got.collect()}
    first = rows[1, "o1-b0"]
    assert first.covers_count == len(parts) and not first.covered and len(parts) > 1
    for k in range(1, len(parts)):
        assert rows[1, f"covered-b{k}"].covered_by == name and rows[1, f"covered-b{k}"].covered
    assert {k for k in rows if k[1].startswith(("rxt-", "bt-"))} == {(1, "rxt-o2"), (1, "rxt-o3"), (1, "bt-b90"), (2, "rxt-o1"), (3, "bt-b0")}
    lines = collections.Counter((r.scan_id, r.bill_item) for r in rows.values() if r.bill_item)
    assert lines == collections.Counter((r[0], r[2]) for r in billed)
    none = spark.createDataFrame([], "scan_id long, rule_code string, severity string, prescribed_ref string, billed_ref string")
    states = {r.row_key: (r.state, r.claimable) for r in lab_rows.states_of_tests(got, none).where("scan_id = 1").collect()}
    assert states["o1-b0"] == states["covered-b1"] == ("clean", True) and states["bt-b90"] == states["rxt-o2"] == ("unchecked", False)
    empty = resolved(spark, [])
    assert lab_rows.rows_of_tests(empty, empty, panels).count() == 0


def test_a_batch_written_twice_is_stored_once(spark, tmp_path):
    day = datetime.date
    scans = spark.createDataFrame([(1, day(2024, 3, 31), 99), (2, day(2024, 4, 1), 99), (3, day(2024, 5, 1), 99)], "scan_id long, created_on date, critical_count int")
    verdicts = spark.createDataFrame([(i, "match", i, 0, 0) for i in (1, 2, 3)], "scan_id long, verdict string, critical_count int, warning_count int, unavailable_count int")
    path = str(tmp_path / "scans")
    for _ in range(2):
        store.save_scans(scans.where("scan_id < 3"), verdicts, path, "a")
    store.save_scans(scans.where("scan_id = 3"), verdicts, path, "b")
    rows = spark.read.parquet(path).collect()
    assert sorted((r.scan_id, r.critical_count, r.batch) for r in rows) == [(1, 1, "a"), (2, 2, "a"), (3, 3, "b")]
    assert {r.scan_id: r.allowance_year for r in rows}[1] != {r.scan_id: r.allowance_year for r in rows}[2]
    pages = spark.createDataFrame([(1, "bill", 1, "x"), (1, "bill", 2, None), (2, "prescription", 1, "y")], "scan_id long, slot string, page_no int, content string")
    for _ in range(2):
        store.save_pages(pages, str(tmp_path / "pages"), "a")
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 3


def test_submitters_see_their_columns_alone(spark):
    held = {c: "x" for c in store.SUBMITTER} | {"verdict": "match", "claimed_amount": "9", "decisions_json": "{}"}
    row = spark.createDataFrame([tuple(held.values())], list(held))
    assert store.submitter_view(row).columns == list(store.SUBMITTER)
