"""Pairing prescribed with billed lines: scored join, optimal assignment, what stays alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.forms import normalise_form
from claimloom.functions.units import normalise_strength
from claimloom.operators.groups import whole_groups

#: Weights of drug, strength and form, and the score that a pair must exceed.
WEIGHTS, THRESHOLD = (0.60, 0.25, 0.15), 0.55
#: Matrices of which a task keeps the assignment.
MATRICES = 100_000


def normalised(lines: DataFrame) -> DataFrame:
    """Lines with their strengths in base units and their forms by one name."""
    strength = normalise_strength(F.col("strength_value"), F.col("strength_unit"))
    return lines.withColumns({"strength_value": strength["value"], "strength_unit": F.when(F.col("strength_value").isNotNull() | F.col("strength_unit").isNotNull(), strength["unit"]), "form": normalise_form(F.col("form"))})


def strengths_equal(a: str, b: str) -> Column:
    """Units equal, both missing counting as equal, and values within 1e-6."""
    return F.col(f"{a}.strength_unit").eqNullSafe(F.col(f"{b}.strength_unit")) & (F.abs(F.col(f"{a}.strength_value") - F.col(f"{b}.strength_value")) < 1e-6)


def same_line(a: Column | str, b: Column | str) -> Column:
    """Whether two names of lines are equal, as a condition beside the equality of scans, not as a key of the join.

    Lines lie by scan; a join by scan and line would deal both sides out anew, a join by scan with this condition takes them as they lie.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(a == b, F.lit(False))


def similarity(rx: DataFrame, bill: DataFrame) -> DataFrame:
    """(scan_id, rx_item, bill_item, score) for all lines of a scan; a line without a salt is unresolved and scores 0 for its drug."""
    r, b = normalised(rx).alias("r"), normalised(bill).alias("b")
    resolved = F.col("r.salt").isNotNull() & F.col("b.salt").isNotNull()
    same = resolved & ((F.col("r.drug_name") == F.col("b.drug_name")) | (F.col("r.salt") == F.col("b.salt")))
    score = sum(w * F.coalesce(c, F.lit(False)).cast("double") for w, c in zip(WEIGHTS, (same, strengths_equal("r", "b"), F.col("r.form") == F.col("b.form"))))
    return r.join(b, F.col("r.scan_id") == F.col("b.scan_id")).select("r.scan_id", F.col("r.item_id").alias("rx_item"), F.col("b.item_id").alias("bill_item"), F.round(score, 4).alias("score"))


def best_assignment(scores: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of the one-to-one choice with the largest sum, by shortest augmenting paths over the smaller side."""
    if scores.shape[0] > scores.shape[1]:
        return sorted((r, c) for c, r in best_assignment(scores.T))
    n, m = scores.shape
    cost = np.zeros((n + 1, m + 1))
    cost[1:, 1:] = scores.max(initial=0) - scores
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        slack, before, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[column]:
            done[column] = True
            reduced = cost[owner[column]] - u[owner[column]] - v
            better = ~done & (reduced < slack)
            better[0] = False
            slack[better], before[better] = reduced[better], column
            open_ = np.where(done, np.inf, slack)
            open_[0] = np.inf
            nearest = int(open_.argmin())
            by = open_[nearest]
            u[owner[done]] += by
            v[done] -= by
            slack[~done] -= by
            column = nearest
        while column:
            owner[column] = owner[before[column]]
            column = before[column]
    return sorted((int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c])


def _plain_choice(grids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which matrices of one shape have a choice that is plain to see, and its pairs above the threshold: matrix and place in it.

    Where each line of the smaller side has one best partner, no two the same, no other choice has as large a sum. Lines to whom all
    partners are alike, none above the threshold, change nothing.
    """
    _, n, m = grids.shape
    side = grids if n <= m else grids.transpose(0, 2, 1)
    top, pick = side.max(2), side.argmax(2)
    single = (side == top[:, :, None]).sum(2) == 1
    free = (side == side[:, :, :1]).all(2) & (top <= threshold)
    partners = np.sort(np.where(single, pick, side.shape[2] + np.arange(side.shape[1])), axis=1)
    sure = (single | free).all(1) & (np.diff(partners, axis=1) > 0).all(1)
    which, line = np.nonzero(single & (top > threshold) & sure[:, None])
    other = pick[which, line]
    return sure, which, line * m + other if n <= m else other * m + line


def assign(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs of the assignment with the largest total over a scan's whole matrix, of which those above the threshold stay.

    Scans lie together in sorted partitions and are read in batches, as one call for each small matrix would cost more than the
    assignment; the last scan of a batch waits for the next one. Scores have few values, so of equal matrices one is worked out.
    """
    solved: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}

    def best(grid: np.ndarray) -> list[tuple[int, int]]:
        key = (*grid.shape, grid.tobytes())
        if key not in solved:
            if len(solved) >= MATRICES:
                solved.clear()
            solved[key] = [(x, y) for x, y in best_assignment(grid) if grid[x, y] > threshold]
        return solved[key]

    def whole_scans(rows: pa.Table) -> pa.Table:
        """Pairs of whole scans, sorted; names of lines go by their place in the order of all of the batch."""
        scan, score = rows.column("scan_id").to_numpy(), rows.column("score").to_numpy()
        names, places = [], []
        for c in ("rx_item", "bill_item"):
            coded = rows.column(c).combine_chunks().dictionary_encode()
            held = coded.dictionary.to_numpy(zero_copy_only=False)
            names.append(np.sort(held))
            places.append(np.searchsorted(names[-1], held)[coded.indices.to_numpy()])
        order = np.lexsort((*places[::-1], scan))
        scan, score, r, c = scan[order], score[order], places[0][order], places[1][order]
        cuts = np.concatenate([[0], np.flatnonzero(scan[1:] != scan[:-1]) + 1, [len(scan)]])
        begins, sizes = cuts[:-1], np.diff(cuts)
        run = np.concatenate([[1], ((r[1:] != r[:-1]) | (scan[1:] != scan[:-1])).astype(int)])
        n_rx = np.add.reduceat(run, begins)
        n_bill = sizes // n_rx
        # A scan's rows are its whole matrix if each prescribed line comes with the same billed ones.
        off = np.arange(len(scan)) - np.repeat(begins, sizes)
        across = np.repeat(n_bill, sizes)
        fits = (run == (off % across == 0)) & (c == c[np.repeat(begins, sizes) + off % across]) & ((off % across == 0) | (c != np.roll(c, 1)))
        whole = np.logical_and.reduceat(fits, begins) & (n_rx * n_bill == sizes)
        asked = np.maximum.reduceat(score, begins) > threshold
        found = [np.zeros(0, int)]
        shapes = n_rx * (int(sizes.max()) + 1) + n_bill
        for shape in np.unique(shapes[asked & whole]):
            of = np.flatnonzero(asked & whole & (shapes == shape))
            n, m = int(n_rx[of[0]]), int(n_bill[of[0]])
            every = score[begins[of][:, None] + np.arange(n * m)]
            sure, which, place = _plain_choice(every.reshape(-1, n, m), threshold)
            found.append(begins[of[which]] + place)
            of = of[~sure]
            if not len(of):
                continue
            grids, which = np.unique(every[~sure], axis=0, return_inverse=True)
            pairs = [np.array([x * m + y for x, y in best(grid.reshape(n, m))], int) for grid in grids]
            counts = np.array([len(p) for p in pairs])
            starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
            flat, times = np.concatenate(pairs), counts[which.ravel()]
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            found.append(np.repeat(begins[of], times) + flat[np.repeat(starts[which.ravel()], times) + inner])
        at = np.concatenate(found)
        rest = []
        for k in np.flatnonzero(asked & ~whole):
            a, z = cuts[k], cuts[k + 1]
            (left, i), (right, j) = (np.unique(p[a:z], return_inverse=True) for p in (r, c))
            grid = np.zeros((len(left), len(right)))
            grid[i, j] = score[a:z]
            rest += [(scan[a], left[x], right[y], grid[x, y]) for x, y in best(grid)]
        more = [np.array(x) for x in zip(*rest)] or [np.zeros(0, int)] * 4
        named = lambda side, own, others: pa.array(names[side][np.concatenate([own[at], others.astype(int)])], pa.string())
        told = lambda own, others, kind: pa.array(np.concatenate([own[at], others]), kind)
        return pa.table({"scan_id": told(scan, more[0].astype(int), pa.int64()), "rx_item": named(0, r, more[1]), "bill_item": named(1, c, more[2]), "score": told(score, more[3].astype(float), pa.float64())})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "scan_id"):
            if rows.num_rows:
                yield from whole_scans(rows).to_batches()

    return scored.repartition("scan_id").sortWithinPartitions("scan_id").mapInArrow(each, "scan_id long, rx_item string, bill_item string, score double")


def unmatched(lines: DataFrame, pairs: DataFrame, item: str) -> DataFrame:
    """Lines that no pair has."""
    a, b = lines.alias("a"), pairs.select("scan_id", item).alias("b")
    return a.join(b, (F.col("a.scan_id") == F.col("b.scan_id")) & same_line("a.item_id", f"b.{item}"), "left_anti")
