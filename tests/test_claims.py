"""Every query over claims against its SQL in DuckDB, and the assignment against brute force."""

import itertools

import duckdb
import numpy as np
import pytest

from claimloom.operators.pairing import best_assignment
from claimloom.plans import documents, extended, lab_rows, priors, readings, registry, review, store, words

SF = "/root/testdata/sf0.001"
PARTS = (extended, words, documents, review, store, readings, priors, lab_rows)
QUERIES = registry.queries() | {f.__name__: f for part in PARTS for f in part.QUERIES}
ORACLE = registry.ORACLE | {k: v for part in PARTS for k, v in part.ORACLE.items()}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "customer", "supplier", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([float(r[i]) if type(r[i]).__name__ in ("Decimal", "float") else r[i] for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SF), tables.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    held = rows(got.columns, [tuple(r) for r in got.collect()])
    assert held == rows(want.columns, want.fetchall()) and held


def test_assignment_has_the_largest_sum():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, m = rng.integers(1, 5, 2)
        scores = rng.choice([0, 0.15, 0.25, 0.4, 0.6, 1.0], (n, m))
        pairs = best_assignment(scores)
        assert len(pairs) == min(n, m) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
        wide = scores if n <= m else scores.T
        best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert abs(sum(scores[a, b] for a, b in pairs) - best) < 1e-9


def test_assignment_pairs_are_one_to_one_and_above_the_threshold(spark):
    got = registry.assignment_pairs(spark, SF).collect()
    assert got and all(r.score > 0.55 for r in got)
    assert len({(r.scan_id, r.rx_item) for r in got}) == len({(r.scan_id, r.bill_item) for r in got}) == len(got)


def test_days_without_rows_are_filled(spark):
    from claimloom.operators.history import per_day

    days = spark.sql("SELECT explode(array(date'2026-02-27', date'2026-03-02', date'2026-03-02')) AS d")
    assert [(str(r.day), r.n) for r in per_day(days, "d").orderBy("day").collect()] == [("2026-02-27", 1), ("2026-02-28", 0), ("2026-03-01", 0), ("2026-03-02", 2)]


def test_check_digit(spark):
    from pyspark.sql import functions as F

    from claimloom.functions.text import gstin_valid

    rows = spark.createDataFrame([("27AAPFU0939F1ZV",), ("27AAPFU0939F1ZW",), (None,)], "g string").select(gstin_valid(F.col("g")).alias("v")).collect()
    assert [r.v for r in rows] == [True, False, None]


def test_common_length_and_ratios():
    from claimloom.functions.fuzzy import common_length, ratio, set_ratio, sorted_ratio

    def plainly(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b, 1):
                row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
        return row[-1]

    rng = np.random.default_rng(7)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abc "), n)) for n in rng.integers(0, 12, 2))
        assert common_length(a, b) == plainly(a, b)
    assert sorted_ratio("DOE JANE", "JANE DOE") == 100 and set_ratio("JANE DOE", "JANE M DOE") == 100 and set_ratio("", "X") == 0 and ratio("", "") == 100


def test_alike_equals_all_pairs(spark):
    from claimloom.functions.fuzzy import set_ratio, sorted_ratio
    from claimloom.operators.resolution import alike

    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("ABC"), n)) for n in rng.integers(1, 6, 60)})
    brands = [(f"{a} {b}".strip(), s, i) for i, (a, b, s) in enumerate(zip(words, words[3:] + ["", "", ""], itertools.cycle("PQR")))]
    names = sorted({*words, *(x[0] for x in brands), "ACB BA", "A", "AXB"})
    got = {(r.name, r.salt) for r in alike(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(brands, "brand string, salt string, ordinal long")).collect()}
    want = set()
    for n in names:
        near = [(min(set_ratio(n, b), sorted_ratio(n, b)), s) for b, s, _ in brands]
        best = max(near)[0]
        salts = {s for k, s in near if k >= best - 1e-9}
        if best >= 80 and len(salts) == 1:
            want.add((n, salts.pop()))
    assert got == want and got


def test_odd_sigs_and_packs(spark):
    from pyspark.sql import functions as F

    from claimloom.functions import sig, units

    rows = spark.createDataFrame([("1/0-1", "5/0", "0'S"), ("", "", ""), (None, None, None), ("1¼+½", "3 wks", "1 L"), ("as needed", "12", "3 Box")], "f string, d string, p string")
    got = rows.select(sig.doses_per_day(F.col("f")), sig.duration_days(F.col("d")), units.pack_size(F.col("p"))["method"]).collect()
    assert [tuple(r) for r in got] == [(None, None, "apostrophe_s"), (None, None, None), (None, None, None), (1.75, 21, "volume"), (None, None, "unrecognised")]
