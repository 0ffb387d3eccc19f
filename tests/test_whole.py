"""Findings over the optimal assignment against brute force."""

import itertools
import json

from claimloom.operators import amounts, counterparts
from claimloom.operators.pairing import assign, similarity
from claimloom.plans import extended
from claimloom.plans.claims import scans

SF = "/root/testdata/sf0.001"
LINE = "scan_id long, item_id string, drug_name string, salt string, strength_value double, strength_unit string, form string"


def test_assignment_crosses_places(spark):
    rx = [(1, "rx-1", "A", "a", 5.0, "mg", "tablet"), (1, "rx-2", "B", "b", 10.0, "mg", "syrup")]
    bill = [(1, "bill-1", "C", "c", 1.0, "mg", "drops"), (1, "bill-2", "A", "a", 5.0, "mg", "tablet"), (1, "bill-3", "B2", "b", 10.0, "mg", "syrup")]
    score = lambda r, b: 0.6 * (r[3] == b[3]) + 0.25 * (r[4:6] == b[4:6]) + 0.15 * (r[6] == b[6])
    best = max(itertools.permutations(bill, 2), key=lambda p: sum(map(score, rx, p)))
    want = {(r[1], b[1]) for r, b in zip(rx, best) if score(r, b) > 0.55}
    got = assign(similarity(spark.createDataFrame(rx, LINE), spark.createDataFrame(bill, LINE))).collect()
    assert {(r.rx_item, r.bill_item) for r in got} == want == {("rx-1", "bill-2"), ("rx-2", "bill-3")}


def test_whole_findings_and_verdicts(spark):
    whole = extended._whole(spark, SF)  # what whole_findings and whole_verdict_score return, worked out once
    pairs = whole.pairs.collect()
    lines = {(x.side, x.scan_id, x.item_id): x for x in whole.lines.collect()}
    has_bill, has_rx = {(p.scan_id, p.bill_item) for p in pairs}, {(p.scan_id, p.rx_item) for p in pairs}
    found = whole.findings.collect()
    told = lambda code, ref: {(f.scan_id, f[ref]) for f in found if f.rule_code == code}
    assert told("BILL_NOT_PRESCRIBED", "billed_ref") == {k[1:] for k in lines if k[0] == "bill"} - has_bill
    assert told("RX_NOT_BILLED", "prescribed_ref") == {k[1:] for k in lines if k[0] == "rx"} - has_rx
    compared = {(r.scan_id, r.bill_item): r for r in amounts.compared(whole.pairs, whole.lines.where("side = 'rx'"), whole.lines.where("side = 'bill'")).collect()}
    for code in ("QUANTITY_SHORT", "QUANTITY_EXCESS", "QUANTITY_AMBIGUOUS"):
        assert told(code, "billed_ref") == {k for k, r in compared.items() if r.rule_code == code} and told(code, "billed_ref")
    for f in found:
        if f.rule_code in ("QUANTITY_SHORT", "QUANTITY_EXCESS"):
            d = json.loads(f.detail)
            assert (d["billed_units"] < d["expected_units"]) == (f.rule_code == "QUANTITY_SHORT") and d["billed_units"] == d["billed_quantity"] * (1 if d.get("units_basis") == "unit" else d["units_per_pack"])
    conflicts = set()
    for p in pairs:
        r, b = lines["rx", p.scan_id, p.rx_item], lines["bill", p.scan_id, p.bill_item]
        if r.salt and b.salt and "fuzzy" in (r.method, b.method) and None not in (r.therapeutic_class, b.therapeutic_class) and r.therapeutic_class != b.therapeutic_class:
            conflicts.add((p.scan_id, p.bill_item))
    assert told("SALT_DIFFERENT_CLASS", "billed_ref") == conflicts and conflicts
    assert {x.method for x in lines.values()} >= {"exact", "fuzzy", "unresolved"}
    assert {s for s, _ in told("SUBTOTAL_MISMATCH", "billed_ref")} == {r.scan_id for r in extended.total_checks(spark, SF).where("subtotal_code = 'SUBTOTAL_MISMATCH'").collect()}
    seen = {}
    for f in found:
        seen.setdefault(f.scan_id, []).append(f.seq)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in seen.values())
    assert {f.rule_code for f in found} >= {"SCHEDULE_H_UNBACKED", "TEST_NOT_BILLED", "TEST_BILLED_NOT_REPORTED", "GSTIN_INVALID", "EARLY_REPEAT", "LICENCE_INCONSISTENT", "PATIENT_NAME_MISMATCH", "ILLEGIBLE_RX", "DUPLICATE_THERAPY"}
    assert all(f.check_name for f in found if f.rule_code == "CHECK_UNAVAILABLE")
    scored = whole.verdicts.collect()
    assert {v.scan_id for v in scored} == {r.scan_id for r in scans(spark, SF).collect()} and len(scored) == 1500
    critical = {f.scan_id for f in found if f.severity == "critical"}
    assert all(v.verdict in ("mismatch", "inconclusive") for v in scored if v.scan_id in critical)


def test_counterparts_of_every_kind_of_line(spark):
    """Each billed line of every name, text and form beside one identified and one unidentified prescribed line."""
    texts = ("Dolo", None, "Hand soap 75g", "Home delivery")
    kinds = [(salt, name, form) for salt in ("p", None) for name in texts for form in ("tablet", "other", "service", None)]
    rx, bill, want = [], [], set()
    for scan, (salt, name, form) in enumerate(kinds):
        for lab in (False, True):
            key = 2 * scan + lab
            rx += [(key, "rx-1", "q", "Pan", "tablet", lab), (key, "rx-2", None, None, None, lab)][: 1 + scan % 2]
            bill.append((key, "bill-1", salt, name, name, form))
            worded = any(w in (name or "").lower() for w in ("soap", "delivery"))
            unplaced = salt is None and not worded and form not in ("other", "service")
            severity = "critical" if not unplaced and not lab else "warning"
            want.add((key, "RX_NOT_BILLED", severity, "rx-1", None))
            if severity == "warning":
                want.add((key, "CHECK_UNAVAILABLE", "info", "rx-1", None))
            if scan % 2:
                want |= {(key, "RX_NOT_BILLED", "warning", "rx-2", None), (key, "CHECK_UNAVAILABLE", "info", "rx-2", None)}
            other = form in ("other", "service") or (salt is None and form is None)
            severity = "info" if other else "critical" if salt and not scan % 2 else "warning"
            want.add((key, "BILL_NOT_PRESCRIBED", severity, None, "bill-1"))
            if severity == "warning":
                want.add((key, "CHECK_UNAVAILABLE", "info", None, "bill-1"))
    alone = spark.createDataFrame(rx, "scan_id long, item_id string, salt string, drug_name string, form string, lab_only boolean")
    left = spark.createDataFrame(bill, "scan_id long, item_id string, salt string, drug_name string, raw_text string, form string")
    got = {(f.scan_id, f.rule_code, f.severity, f.prescribed_ref, f.billed_ref) for f in counterparts.unmatched_findings(alone, left).collect()}
    assert got == want
