"""Ranked lexical search as a blocked product of sparse matrices.

Items times terms (1 where an item has the term) by terms times documents (integer impacts) gives items times documents, the scores. The
documents are a written table of sparse columns: each document's number of terms and the counts of those terms that some item has. Tasks
take blocks of documents of at most BLOCK entries, turn each into rows of terms and merge for every item the rows of its terms, in the
way of Gustavson, into one row of scores. Of a block's row only the `top` best go on; they are merged with those of the task's blocks before,
and a last reduction per item takes the best of all tasks.

Items come in blocks too, of at most ITEM_TERMS terms together, so what is sent to tasks is bounded however many items there are; each
block of items is a product of its own.

An item's score for a document is the sum over the item's terms of w * ((10^9 * tf) div (1000 * tf + 20 * m)); w falls with the number of
documents that hold the term, m grows with the document's length against the mean. All counts are of the whole table.

Defined results: a null or empty text has no terms and is never found; repeated rows are found each, with a rank each; equal scores go by
ascending id, null last; rows of items with one id are one item, as are all without an id; an item without terms finds nothing; an
empty table of either kind gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import columns, shared_folder, slices, terms_of

TOP = 50
#: Entries of the matrix that a block of documents holds, unless one document alone has more; terms of a block of items.
BLOCK, ITEM_TERMS = 2_000_000, 1_000_000
#: Stands for no id, after all ids.
LAST = (1 << 63) - 1


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def item_blocks(items: DataFrame, key: str, text: str, most: int = ITEM_TERMS) -> Iterator[tuple[list[int | None], list[list[str]]]]:
    """Ids and distinct terms of items, in blocks of about `most` terms; items are read one after the other."""
    ids: list[int | None] = []
    held: list[list[str]] = []
    rows = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).groupBy("item_id").agg(F.collect_set("text").alias("texts"))
    for r in rows.orderBy("item_id").toLocalIterator():
        own = sorted(set(terms_of(pa.array(r["texts"], pa.string()))[1].to_pylist()))
        if ids and sum(map(len, held)) + len(own) > most:
            yield ids, held
            ids, held = [], []
        ids.append(r["item_id"])
        held.append(own)
    if any(held):
        yield ids, held


def matrix(docs: DataFrame, vocabulary: list[str], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts), one row per row of `docs` that has a term: how many it has, and the counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = pa.array(shared.value, pa.string()), len(shared.value)
        for batch in slices(batches, "text"):
            starts, words = terms_of(batch.column("text"))
            seen = words.dictionary_encode()
            code = pc.fill_null(pc.index_in(seen.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[seen.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            entry, times = np.unique(doc[code >= 0] * size + code[code >= 0], return_counts=True)
            at = np.searchsorted(entry // size, np.arange(batch.num_rows + 1))
            cut = lambda values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int32)))
            out = columns(schema, doc_id=batch.column("doc_id"), n=np.diff(starts), terms=cut(entry % size), counts=cut(times))
            yield out.filter(pa.array(np.diff(starts) > 0))

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """The places of the `top` highest scores, equal ones by ascending id."""
    if len(scores) > top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:top]


def product(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray, items: list[np.ndarray], top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, ids, scores) of each item's best documents in one block; entry k says that a term has an impact in a document."""
    order = np.argsort(term, kind="stable")
    doc, impact = doc[order], impact[order]
    terms, first = np.unique(term[order], return_index=True)
    ends, row = np.append(first[1:], len(term)), np.zeros(len(ids), np.int64)
    for k, own in enumerate(items):
        at = np.searchsorted(terms, own)
        at = at[(at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == own)] if len(terms) else at[:0]
        if not len(at):
            continue
        for a, z in zip(first[at].tolist(), ends[at].tolist()):
            row[doc[a:z]] += impact[a:z]  # a term has one entry for each document
        found = np.flatnonzero(row > 0)
        scores = row[found]
        row[found] = 0
        some = best(scores, ids[found], top)
        yield k, ids[found[some]], scores[some]


def scores_of(table: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """(item, doc_id, score): for each item the best documents of each task."""
    shared = table.sparkSession.sparkContext.broadcast((items, weights))
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def take(batch: pa.RecordBatch) -> None:
            terms, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy().astype(np.int64)
            term = terms.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy())
            n = batch.column("n").to_numpy()
            length = 100 - 50 + np.array([(50 * x * documents) // total for x in n.tolist()], np.int64)  # Python's integers don't overflow
            impact = w[term] * ((1_000_000_000 * counts) // (1000 * counts + 20 * length[doc]))
            ids = pc.fill_null(batch.column("doc_id"), LAST).to_numpy()
            for k, found, score in product(doc, term, impact, ids, own, top):
                if k in kept:
                    found, score = np.concatenate([kept[k][0], found]), np.concatenate([kept[k][1], score])
                some = best(score, found, top)
                kept[k] = found[some], score[some]

        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
                take(batch.slice(at, stop - at))
                at = stop
        for k, (found, score) in sorted(kept.items()):
            yield columns(schema, item=np.full(len(found), k), doc_id=pa.array(found, mask=found == LAST), score=score)

    return table.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", most: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` highest-scoring documents of those with a score above 0."""
    spark, out = docs.sparkSession, None
    for number, (ids, terms) in enumerate(item_blocks(items, item_key, item_text, most)):
        vocabulary = sorted({t for x in terms for t in x})
        place = f"{shared_folder(spark)}/terms-{number}"
        matrix(docs, vocabulary, key=key, text=text).write.parquet(place)
        table = spark.read.parquet(place)
        documents, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = {r["term"]: r["count"] for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # a row for each term of the block
        weights = np.array([weight(documents, holding.get(k, 0)) for k in range(len(vocabulary))], np.int64)
        code = {t: k for k, t in enumerate(vocabulary)}
        found = scores_of(table, [np.array([code[t] for t in x], np.int64) for x in terms], weights, documents, total, top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")  # as many rows as the block has items
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


#: What op13_ranking returns, over the tables of documents and items.
ORACLE_SQL = rf"""
WITH terms AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
lengths AS (SELECT r, doc_id, count(*) AS n FROM terms GROUP BY r, doc_id),
totals AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM lengths),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counts AS (SELECT r, term, count(*) AS tf FROM terms SEMI JOIN items USING (term) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
impacts AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * documents) // total)))) AS impact
  FROM counts JOIN weights USING (term) JOIN lengths USING (r), totals),
scores AS (SELECT item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM items JOIN impacts USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= {TOP}
"""
