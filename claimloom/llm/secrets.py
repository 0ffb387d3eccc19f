"""Secrets in text by sliding-window entropy, in DataFrame functions alone.

Three kinds of span come from patterns: assignments to a credential's name, access keys and long hexadecimal runs. The method adds the
kind `entropy`: in every run of key characters a window slides by one character at a time. The counts of the window's characters are
kept as they change, one in and one out, and with them the sum of n * log2(n), from which the window's Shannon entropy follows. The
span runs from the first to the last window whose entropy reaches the limit of the run's character class. Runs that match an allow
pattern (identifiers that are random yet public, names), windows that touch a covered stretch (placeholders) and spans that lie in a span of another kind are left out.

Positions come from the pieces between matches and the matches themselves, so they count code points and a text is never cut. The work
grows in proportion to the text: every value that a lambda needs again is bound once, and running sums copy no more than a chunk.

Defined results: a null or empty text has no spans; repeated rows are scanned alike; a null id is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in the order in which spans with the same start are listed, and their patterns.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Key characters, the shortest run that is a candidate, and the width of the window.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SHORTEST, WIDTH = 20, 20
#: Entries that a running sum or maximum takes at a time.
CHUNK = 256
#: Code points of a block that masked texts are put together from.
BLOCK = 4096
#: Character classes, the first that fits a run holding, with the least entropy in bits that makes a window suspect: what all but some
#: 3 % of random windows over 16, 62 and 36 characters reach.
CLASSES = (("hexadecimal", r"^[0-9a-fA-F]+$", 3.0), ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3.7), ("one case", r"^(?=.*[0-9])(?=.*[A-Za-z])", 3.5))
#: Runs that are no secrets as a whole, each as what it is made of and what it may not hold: UUIDs, paths and names joined by signs,
#: numbers after words included. None repeats a group without bound, which would cost Java's matcher stack for each repeat.
ALLOWED = ((r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", None), (r"^[A-Za-z/_=-]*$", None), (r"^[a-z0-9/_=-]*$", "[0-9][a-z]"), (r"^[A-Z0-9/_=-]*$", "[0-9][A-Z]"))
#: Stretches that no window may touch, each with its length; the rest of the run is scanned. Repeats need none, their entropy is low.
COVERED = ((r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])", 36), ("(?i)example", 7), ("(?i)sample", 6), ("(?i)dummy", 5), ("(?i)placeholder", 11), ("(?i)xxxx", 4))
MASK = "[SECRET]"


_INTS = "CAST(array() AS ARRAY<INT>)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often a lambda inside asks for it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The running merge, from 0 on, of whole numbers; in chunks, so that no step copies more than a chunk or the chunks' ends."""

    def inside(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr(_INTS).alias("out"))
        step = lambda s, x: let(merge(s["at"], x), lambda now: F.struct(now.alias("at"), F.concat(s["out"], F.array(now)).alias("out")))
        return F.aggregate(part, start, step, lambda s: s["out"])

    def shifted(chunks: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), inside(F.transform(chunks, lambda c: F.element_at(c, -1))))
        return let(before, lambda b: F.flatten(F.transform(chunks, lambda c, k: F.transform(c, lambda x: merge(F.element_at(b, k + 1), x)))))

    def over(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: inside(F.slice(v, k * CHUNK + 1, F.lit(CHUNK))))
        return F.when(F.size(v) > 0, let(chunks, shifted)).otherwise(F.expr(_INTS))

    return let(values, over)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, part) of every match, leftmost first and not overlapping; part: the text of the group."""

    def placed(found: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        ends = running(F.zip_with(gaps, found, lambda g, w: F.length(g) + F.length(w)), lambda a, x: a + x)
        each = F.arrays_zip(ends.alias("end"), found.alias("whole"), parts.alias("part"))
        return F.transform(each, lambda m: F.struct((m["end"] - F.length(m["whole"])).alias("start"), m["end"].alias("end"), m["part"].alias("part")))

    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, part: STRING>>)")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def suspect_windows(run: Column, limit: Column, width: int = WIDTH) -> Column:
    """(first, last): the starts of the first and last window of the run whose entropy reaches the limit; null if none does.

    The window's counts change by one event at a time: a character leaves (its number negative) or comes in.
    """
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    weights = F.array(*(F.lit(n * math.log2(n) if n > 1 else 0.0) for n in range(width + 2)))
    events = lambda c: F.flatten(F.transform(c, lambda x, i: F.when(i >= width, F.array(-F.get(c, i - width), x)).otherwise(F.array(x))))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def slide(state: Column, event: Column) -> Column:
        def counted(had: Column) -> Column:
            at, now = F.abs(event), had + F.signum(event).cast("int")
            n = F.concat(F.slice(state["n"], F.lit(1), at - 1), F.array(now), F.slice(state["n"], at + 1, F.lit(len(ALPHABET))))
            return F.struct(n.alias("n"), (state["s"] + F.get(weights, now) - F.get(weights, had)).alias("s"), (state["i"] + (event > 0).cast("int")).alias("i"))

        def told(now: Column) -> Column:
            hit = (event > 0) & (now["i"] >= width) & (F.lit(math.log2(width)) - now["s"] / width >= limit - 1e-9)
            place = now["i"] - width
            return F.struct(now["n"].alias("n"), now["s"].alias("s"), now["i"].alias("i"), F.when(hit & state["first"].isNull(), place).otherwise(state["first"]).alias("first"), F.when(hit, place).otherwise(state["last"]).alias("last"))

        return let(let(F.element_at(state["n"], F.abs(event)), counted), told)

    return let(codes, lambda c: F.aggregate(events(c), start, slide, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))))


def _limit(run: Column) -> Column:
    """The limit of the run's class; null for a run of no class or on the allow list."""
    allowed = reduce(lambda a, b: a | b, (run.rlike(p) & ~run.rlike(but) if but else run.rlike(p) for p, but in ALLOWED))
    by_class = reduce(lambda rest, c: F.when(run.rlike(c[1]), F.lit(c[2])).otherwise(rest), reversed(CLASSES), F.lit(None).cast("double"))
    return F.when(~allowed, by_class)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, *, text: str = "text", width: int = WIDTH) -> DataFrame:
    """(row, base, spans): the columns of `docs` as a struct, the pattern spans and all spans, as (start, rank, end, kind) in order."""
    body = F.coalesce(F.col(f"row.{text}").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    base = F.array_sort(
        F.concat(
            _spans(F.filter(matches(body, ASSIGN, 2), lambda m: F.length(m["part"]) >= 6), "assign"),
            _spans(matches(body, ACCESS), "access"),
            _spans(matches(body, HEX), "hex"),
        )
    )
    bare = reduce(lambda t, c: F.regexp_replace(t, c[0], " " * c[1]), COVERED, body)
    runs = matches(bare, f"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
    limited = F.filter(F.transform(runs, lambda m: F.struct(m["start"].alias("start"), m["part"].alias("part"), _limit(m["part"]).alias("limit"))), lambda m: m["limit"].isNotNull())
    measured = F.transform(limited, lambda m: F.struct(m["start"].alias("start"), suspect_windows(m["part"], m["limit"], width).alias("w")))
    hits = F.transform(F.filter(measured, lambda m: m["w"]["first"].isNotNull()), lambda m: F.struct((m["start"] + m["w"]["first"]).alias("start"), (m["start"] + m["w"]["last"] + width).alias("end")))

    def outside(spans: Column) -> Column:
        """All spans in order, but for the entropy spans that one of another kind covers: one that begins no later and ends no earlier."""
        reach = running(F.transform(spans, lambda x: F.when(x["kind"] == "entropy", 0).otherwise(x["end"])), F.greatest)
        kept = F.filter(F.arrays_zip(spans.alias("span"), reach.alias("reach")), lambda x: (x["span"]["kind"] != "entropy") | (x["reach"] < x["span"]["end"]))
        return F.transform(kept, lambda x: x["span"])

    found = rows.select("row", base.alias("base"), hits.alias("hits"))
    return found.select("row", "base", F.when(F.size("hits") == 0, F.col("base")).otherwise(let(F.array_sort(F.concat("base", _spans(F.col("hits"), "entropy"))), outside)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per row of `docs`."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs, **options).select("row.doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _pieces(body: Column, cuts: Column) -> Column:
    """The parts (start, end) of a text, read from blocks of it so that no part costs a walk over the whole text."""

    def piece(blocks: Column, cut: Column) -> Column:
        within = lambda k: F.greatest(cut["start"] - k * BLOCK, F.lit(0))
        part = lambda k: F.substring(F.get(blocks, k), within(k) + 1, F.least(cut["end"] - k * BLOCK, F.lit(BLOCK)) - within(k))
        held = F.sequence(F.floor(cut["start"] / BLOCK).cast("int"), F.floor((cut["end"] - 1) / BLOCK).cast("int"))
        return F.when(cut["end"] > cut["start"], F.array_join(F.transform(held, part), "")).otherwise("")

    return let(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: F.transform(cuts, lambda c: piece(blocks, c)))


def redact(docs: DataFrame, *, text: str = "text", mask: str = MASK, **options) -> DataFrame:
    """`docs` with every span, joined with those it overlaps, replaced by the mask; other columns and rows stay."""
    body = F.col(f"row.{text}").cast("string")
    reach = let(F.transform("spans", lambda x: x["end"]), lambda e: running(e, F.greatest))

    def gaps(upto: Column) -> Column:
        """The text between a span that begins past all before it and these, and what follows the last."""
        spans = F.transform("spans", lambda x, i: F.struct(F.when(i > 0, F.get(upto, i - 1)).otherwise(0).alias("start"), x["start"].alias("end"), (i == 0).alias("first")))
        fresh = F.filter(spans, lambda x: x["first"] | (x["end"] >= x["start"]))
        return F.concat(F.transform(fresh, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), F.array(F.struct(F.element_at(upto, -1).alias("start"), F.length(body).alias("end"))))

    clean = F.when(F.size("spans") > 0, F.array_join(_pieces(body, let(reach, gaps)), mask)).otherwise(body)
    return scan(docs, text=text, **options).select(*(clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
