"""Sweeps in place of pairs: every claim of one patient and salt, and assignments of whole batches."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa

from claimloom.operators import latest, pairing, priors

DAY = dt.date(2026, 1, 1)


def test_one_patient_with_very_many_claims(spark):
    """One patient claims one salt 20,000 times within some weeks: claims are swept in order, and the latest is what order alone says."""
    n = 20_000
    day = "date_add(DATE'2026-01-01', CAST(id % 20 AS INT))"
    scans = spark.range(n).selectExpr("id AS scan_id", f"{day} AS created_on", f"{day} AS bill_date", "'Ishan Roy' AS patient_name", "'City' AS pharmacy_name", "concat('B', id) AS bill_no")
    courses = spark.range(n).selectExpr("id AS scan_id", "1 AS ordinal", "'x' AS salt", "CAST(IF(id % 20 = 3, NULL, 30) AS INT) AS days")
    found = priors.early_repeats(scans, courses)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    got = {r.scan_id: (r.prior_scan_id, r.gap_days, r.undated) for r in found.collect()}
    for k in range(1, n):
        on = k % 20
        held = k - 20 if k >= 20 and on != 3 else n - 20 + on - (2 if on == 4 else 1)
        assert got[k] == (held, on - held % 20, k >= 20 if on == 3 else k == 4)
    assert len(got) == n - 1


def test_blocks_that_cannot_fit_are_passed_over(monkeypatch):
    """Answers of a sweep with small blocks and with none equal those of a loop over pairs."""
    rng = random.Random(4)
    rows = []
    for k in range(600):
        held = rng.random() < 0.7
        rows.append(("g" + str(rng.randrange(3)), rng.randrange(40), rng.randrange(40), k, held, rng.choice([None, "1", "2"]), rng.randrange(4), rng.choice([None, 3, 10, 25]) if held else None, [rng.randrange(600) for _ in range(9)] if not held and rng.random() < 0.3 else None))
    rows.sort(key=lambda r: (r[0], r[1], r[2], r[3], r[4], -r[6]))
    date = lambda c: pa.array([DAY + dt.timedelta(r[c]) for r in rows], pa.date32())
    table = pa.table({"key": [r[0] for r in rows], "bill_date": date(1), "created_on": date(2), "scan_id": [r[3] for r in rows], "salt": ["s"] * len(rows), "held": [r[4] for r in rows],
                      "bill": pa.array([r[5] for r in rows], pa.string()), "ordinal": pa.array([r[6] for r in rows], pa.int32()), "days": pa.array([r[7] for r in rows], pa.int32()), "alike": pa.array([r[8] for r in rows], pa.list_(pa.int64()))})
    want = {}
    for a in (r for r in rows if not r[4]):
        fit = [t for t in rows if t[4] and t[0] == a[0] and t[1] <= a[1] and (t[2], t[3]) < (a[2], a[3]) and (t[7] is None or a[1] - t[1] < t[7]) and not (a[5] and a[5] == t[5]) and t[3] not in (a[8] or [])]
        if fit:
            want[a[3]] = max(fit, key=lambda t: (t[1], t[2], t[3], -t[6]))[3]
    for blocks in ((), (4096, 64), (16, 4), (2,)):
        monkeypatch.setattr(latest, "BLOCKS", blocks)
        assert {r["scan_id"]: r["prior"] for r in latest._sweep(table).to_pylist()} == want and len(want) > 50


def test_assignments_of_whole_batches_and_of_matrices_with_gaps(spark):
    rng, by = random.Random(3), {}
    for s in range(400):
        n, m = rng.randint(1, 5), rng.randint(1, 6)
        for i in range(n):
            for j in range(m):
                if s % 17 or rng.random() < 0.8:
                    by.setdefault(s, []).append((f"rx-{i if s % 5 else 9 - i}", f"bill-{j}", rng.choice([0.0, 0.15, 0.25, 0.4, 0.6, 0.75, 0.85, 1.0])))
    want = []
    for s, told in by.items():
        left, right = sorted({x[0] for x in told}), sorted({x[1] for x in told})
        grid = np.zeros((len(left), len(right)))
        for r, c, x in told:
            grid[left.index(r), right.index(c)] = x
        want += [(s, left[x], right[y], grid[x, y]) for x, y in pairing.best_assignment(grid) if grid[x, y] > pairing.THRESHOLD]
    rows = [(s, *x) for s, told in by.items() for x in told]
    rng.shuffle(rows)
    got = pairing.assign(spark.createDataFrame(rows, "scan_id long, rx_item string, bill_item string, score double")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
