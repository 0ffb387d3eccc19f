"""Quality rules on documents, the main one being cross-document line frequency.

A line is normalised (lower case, digits as 0, white space joined) and hashed. For each host the documents that hold a line are counted,
a document being a distinct text, so exact copies count once. A line in more documents than `least` and more than `share` of the host's
documents, or in more than `enough` documents whatever their share, is boilerplate: it is removed, and a document of whose words less than
`keep` remain is rejected as depleted. A few base
rules on the text alone come before. Lines go to the shuffle as hashes; frequent lines come back to the documents as one
broadcast of all hosts' lines while they are few, and beyond that by a join that sends each text only the lines that it holds.

Defined results: a null or empty text has no words and fails the base rules; null hosts are a host of their own; repeated rows are judged
alike and count once; an empty table gives an empty result; other columns are ignored (`clean` keeps all).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import checkpoint, columns, slices, words_of

#: A line is boilerplate in more than this many documents of its host and more than this share of them, or in more than ENOUGH of them: a
#: line in five documents is enough in hosts of up to 250 documents, the share decides up to 500,000, and ENOUGH beyond.
LEAST_DOCS, SHARE, ENOUGH = 4, 0.02, 10_000
#: Share of a document's words that must remain, and the rules on the text alone.
KEEP, LEAST_WORDS, MOST_REPEATED, WINDOW = 0.3, 10, 20, 5
#: Up to so many frequent lines they are sent to all tasks.
MOST_BROADCAST = 100_000
SYMBOLS = "[#*$%&|<>]"

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_left long, kept_text string"


def line_hash(line: str) -> int | None:
    """The hash of a line as normalised, as a signed long; None for a line without a word."""
    import xxhash

    words = re.sub("[0-9]", "0", line.lower()).split()
    return int.from_bytes(xxhash.xxh64_digest(" ".join(words)), "big", signed=True) if words else None


def text_lines(docs: DataFrame) -> DataFrame:
    """(host, text_hash, line): the distinct lines of each row."""
    schema = pa.schema([("host", pa.string()), ("text_hash", pa.int64()), ("line", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines = [sorted({h for x in (t or "").split("\n") if (h := line_hash(x)) is not None}) for t in batch.column("text").to_pylist()]
            at = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
            yield columns(schema, host=batch.column("host").take(pa.array(at)), text_hash=batch.column("text_hash").take(pa.array(at)), line=[h for x in lines for h in x])

    return docs.mapInArrow(run, "host string, text_hash long, line long")


def frequent_lines(lines: DataFrame, documents_of: DataFrame, least: int, share: float, enough: int) -> DataFrame:
    """(host, line) of lines in more than `least` documents and more than `share` of the host's, or in more than `enough`."""
    counts = lines.distinct().groupBy("host", "line").count().where(F.col("count") > least)
    return counts.join(documents_of, counts["host"].eqNullSafe(documents_of["host"])).where((F.col("count") > share * F.col("documents")) | (F.col("count") > enough)).select(counts["host"], "line")


def repeated_words(codes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, the words in windows that occur twice or more in it; codes: one number per word, starts as from words_of."""
    n_words = np.diff(starts)
    n = np.maximum(n_words - window + 1, 0)
    if not n.sum():
        return np.zeros(len(n_words), np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[:-1], n)
    rng = np.random.default_rng(3)
    value = rng.integers(1, 1 << 63, codes.max() + 1, dtype=np.uint64)[codes]
    h = rng.integers(1, 1 << 63, len(n), dtype=np.uint64)[doc]
    for k in range(window):
        h = (h ^ value[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + window + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[: len(codes)] > 0)])
    return covered[starts[1:]] - covered[starts[:-1]]


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip("\x20\t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def without_lines(text: str | None, bad: frozenset[int]) -> str | None:
    return "\n".join(x for x in text.split("\n") if line_hash(x) not in bad) if text and bad else text


def measure(docs: DataFrame, shared: Broadcast | None = None) -> DataFrame:
    """The metrics of each row of (row, text, host, bad); the lines to remove are those that `shared` has for the host, or else `bad`."""
    schema = pa.schema([("row", pa.null()), *((n, {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[t]) for n, t in (x.split() for x in METRICS.split(", ")))])

    none: frozenset[int] = frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            starts, words = words_of(texts)
            n_words = np.diff(starts)
            chars = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))])
            repeated = repeated_words(words.dictionary_encode().indices.to_numpy(), starts)
            whole = batch.column("text").to_pylist()
            bad = [shared.value.get(h, none) for h in batch.column("host").to_pylist()] if shared else [frozenset(x or ()) for x in batch.column("bad").to_pylist()]
            kept = [without_lines(t, b) for t, b in zip(whole, bad)]
            left = n_words if kept == whole else np.diff(words_of(pa.array(kept, pa.string()))[0])
            failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
            out = schema.set(0, pa.field("row", batch.schema.field("row").type))
            yield columns(out, row=batch.column("row"), n_words=n_words, word_chars=chars[starts[1:]] - chars[starts[:-1]], n_symbols=pc.count_substring_regex(texts, SYMBOLS).cast(pa.int64()), n_dup_lines=[duplicate_lines(t or "") for t in whole], n_repeat_words=repeated, base_failed=failed, n_left=left, kept_text=kept)

    row = next(f.dataType.simpleString() for f in docs.schema if f.name == "row")
    return docs.select("row", "text", "host", "bad").mapInArrow(run, f"row {row}, {METRICS}")


def judge(docs: DataFrame, *, carry: list[str] | None = None, text: str = "text", host: str = "source", least: int = LEAST_DOCS, share: float = SHARE, enough: int = ENOUGH, keep: float = KEEP) -> DataFrame:
    """(row, the metrics, kept), one row per row of `docs`; row: a struct of the columns `carry`, by default all but the text."""
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), body.alias("text"), F.col(f"`{host}`").cast("string").alias("host"), F.xxhash64(body).alias("text_hash"))
    lines = text_lines(rows.select("host", "text", "text_hash"))
    sizes = rows.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    frequent = checkpoint(frequent_lines(lines, sizes, least, share, enough))
    if frequent.count() <= MOST_BROADCAST:
        by_host: dict[str | None, set[int]] = {}
        for r in frequent.collect():  # at most MOST_BROADCAST rows
            by_host.setdefault(r["host"], set()).add(r["line"])
        shared = docs.sparkSession.sparkContext.broadcast({h: frozenset(x) for h, x in by_host.items()})
        measured = measure(rows.withColumn("bad", F.lit(None).cast("array<long>")), shared)
    else:
        hit = lines.distinct().join(frequent.withColumnRenamed("host", "at"), ["line"]).where(F.col("host").eqNullSafe(F.col("at")))
        bad = hit.groupBy("host", "text_hash").agg(F.collect_list("line").alias("bad"))
        held = rows.join(bad, rows["host"].eqNullSafe(bad["host"]) & (rows["text_hash"] == bad["text_hash"]), "left")
        measured = measure(held.select("row", "text", rows["host"], "bad"))
    depleted = F.col("n_left") < F.greatest(F.lit(1), F.lit(keep) * F.col("n_words"))
    return measured.withColumn("kept", ~F.col("base_failed") & ~depleted)


def report(docs: DataFrame, **options) -> DataFrame:
    """What the rules find in every row of `docs`, and their verdict."""
    return judge(docs, carry=["doc_id"], **options).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left")


def clean(docs: DataFrame, *, text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """The rows of `docs` that are kept, without the lines that were removed; a column `length` follows the text."""
    judged = judge(docs, text=text, **options).where("kept")
    size = F.when(F.length("kept_text").isNull(), None).otherwise(F.length("kept_text"))
    column = lambda c: F.col("kept_text") if c == text else F.when(F.col("n_left") == F.col("n_words"), F.col(f"row.`{c}`")).otherwise(size) if c == length else F.col(f"row.`{c}`")
    return judged.select(*(column(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


#: White space as Python's str.split has it.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_APART = r"[\x20\x09-\x0D]"
#: What op3_quality returns, over the table of documents.
ORACLE_SQL = rf"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS body, text FROM documents),
lines AS (SELECT r, source, body, unnest(string_split(body, chr(10))) AS line FROM rows_),
flat AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '{_SPACE}', ' ', 'g')) AS flat_line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS line_words FROM lines),
hosts AS (SELECT source, count(*) AS documents FROM (SELECT DISTINCT source, text FROM documents) GROUP BY source),
frequent AS (SELECT f.source, flat_line FROM (SELECT source, flat_line, count(DISTINCT body) AS n FROM flat WHERE flat_line <> '' GROUP BY source, flat_line) f
  JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE n > {LEAST_DOCS} AND (n > CAST({SHARE} AS DOUBLE) * documents OR n > {ENOUGH})),
by_line AS (SELECT r, CAST(sum(line_words) AS BIGINT) AS n_words, CAST(sum(CASE WHEN q.flat_line IS NULL THEN line_words ELSE 0 END) AS BIGINT) AS n_left,
    count(*) FILTER (line_words > 0) - count(DISTINCT CASE WHEN line_words > 0 THEN line END) AS n_dup_lines
  FROM flat f LEFT JOIN frequent q ON f.source IS NOT DISTINCT FROM q.source AND f.flat_line = q.flat_line GROUP BY r),
words AS (SELECT r, unnest(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(body, '[^\x20\x09-\x0D]+'), 1) AS i FROM rows_),
grams AS (SELECT r, i, word || ' ' || {" || ' ' || ".join(f"lead(word, {k}) OVER w" for k in range(1, WINDOW))} AS gram FROM words WINDOW w AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM grams WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range({WINDOW}) AS t(k) GROUP BY r),
told AS (SELECT doc_id, n_words, CAST(length(regexp_replace(body, '{_APART}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(strlen(body) - strlen(regexp_replace(body, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_left
  FROM rows_ JOIN by_line USING (r) LEFT JOIN covered USING (r)),
failed AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM told)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_left >= greatest(1, CAST({KEEP} AS DOUBLE) * n_words) AS kept, n_left FROM failed
"""
