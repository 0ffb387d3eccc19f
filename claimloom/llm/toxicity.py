"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag of its character n-grams, with marks at its ends, and of itself; each n-gram owns a row of the embedding table by hash.
A document is the mean of its words' vectors, and a two-class softmax on the mean gives the score. Both layers are learned together by
minibatch Adagrad, so an unseen misspelling of an abusive word lies near it through the n-grams it kept.

The model is fitted on the driver from at most `TOXIC_ROWS` and `CLEAN_ROWS` labelled rows of the two classes, chosen by a hash of their
ids; that bound is the only sampling here. Scoring covers every whole text. As the model is linear past the embedding, a word's share of the two logits
is one number each, so a task keeps these numbers for the distinct words it meets.

Defined results: a null or empty text has no words and gets the model's score for a zero vector; repeated rows score alike; without
labelled rows of both classes every score is 0; an empty table gives an empty result; other columns are ignored. A row with a null id
is scored, never learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import columns, slices, words_of

#: Labelled rows of each class that the model is fitted on, at most.
TOXIC_ROWS, CLEAN_ROWS = 1500, 4500
BUCKETS, DIM, SHORTEST, LONGEST = 1 << 18, 8, 3, 6
EPOCHS, BATCH, RATE, CALM, GAIN, SEED = 6, 32, 1.0, 1e-6, 60.0, 2
THRESHOLD = 0.7
#: Distinct words whose shares a task keeps; past it the table starts anew.
CACHE_WORDS = 300_000


def ngrams(word: str) -> list[int]:
    """The rows of a word's n-grams; upper and lower case are one."""
    marked = f"<{word.lower()}>".encode("utf-32-le")
    size = len(marked) // 4
    grams = [zlib.crc32(marked[4 * i : 4 * (i + n)]) % BUCKETS for n in range(SHORTEST, LONGEST + 1) for i in range(size - n + 1)]
    return [*grams, zlib.crc32(marked, 1) % BUCKETS]


@dataclass
class Model:
    embedding: np.ndarray  # float32, BUCKETS x DIM
    weights: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def row_logits(self) -> np.ndarray:
        """What a row of the embedding adds to the difference of the two logits."""
        return (self.embedding @ (self.weights[:, 1] - self.weights[:, 0]) * GAIN).astype(np.float32)


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and their weights of each text: the mean over words of the mean over the word's n-grams."""
    starts, words = words_of(pa.array(texts, pa.string()))
    coded = words.dictionary_encode()
    grams = [np.array(ngrams(w), np.int32) for w in coded.dictionary.to_pylist()]
    codes, out = coded.indices.to_numpy(), []
    for a, b in zip(starts[:-1], starts[1:]):
        used, times = np.unique(codes[a:b], return_counts=True)
        if not len(used):
            out.append((np.empty(0, np.int32), np.empty(0, np.float32)))
            continue
        rows = np.concatenate([grams[k] for k in used])
        share = np.concatenate([np.full(len(grams[k]), n / len(grams[k])) for k, n in zip(used, times)])
        kept, place = np.unique(rows, return_inverse=True)
        out.append((kept, (np.bincount(place, share) / (b - a)).astype(np.float32)))
    return out


def train(texts: list[str | None], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit embedding and softmax together; rows that no text touched stay zero and add nothing to a score."""
    rng = np.random.default_rng(seed)
    e, w, b = np.zeros((BUCKETS, DIM), np.float32), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    seen_e, seen_w, seen_b = np.full(BUCKETS, CALM, np.float32), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    docs = bags(texts)
    weight = len(labels) / (2.0 * np.bincount(labels, minlength=2))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            batch = [k for k in order[at : at + BATCH] if len(docs[k][0])]
            if not batch:
                continue
            rows, share = (np.concatenate([docs[k][i] for k in batch]) for i in (0, 1))
            sizes = np.array([len(docs[k][0]) for k in batch])
            first = np.cumsum(sizes) - sizes
            hidden = GAIN * np.add.reduceat(e[rows] * share[:, None], first, axis=0)
            logits = hidden @ w + b
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p *= weight[labels[batch]][:, None] / len(batch)
            dw, db, dh = hidden.T @ p, p.sum(axis=0), GAIN * (p @ w.T)
            used, place = np.unique(rows, return_inverse=True)
            spread = np.repeat(dh, sizes, axis=0) * share[:, None]
            de = np.stack([np.bincount(place, spread[:, d], len(used)) for d in range(DIM)], axis=1)
            seen_e[used] += (de**2).mean(axis=1)
            seen_w += dw**2
            seen_b += db**2
            e[used] -= (RATE * de / np.sqrt(seen_e[used])[:, None]).astype(np.float32)
            w -= 0.1 * RATE * dw / np.sqrt(seen_w)
            b -= 0.1 * RATE * db / np.sqrt(seen_b)
    return Model(e, w, b)


class Scorer:
    """Scores of texts, with the shares of words met so far."""

    def __init__(self, row_logits: np.ndarray, bias: float, most: int = CACHE_WORDS):
        self.rows, self.bias, self.most = row_logits, bias, most
        self.known: dict[str, float] = {}

    def share(self, word: str) -> float:
        if (x := self.known.get(word)) is None:
            grams = ngrams(word)
            x = self.known[word] = float(self.rows[grams].sum() / len(grams))
        return x

    def scores(self, texts: pa.Array) -> np.ndarray:
        starts, words = words_of(texts)
        coded = words.dictionary_encode()
        if len(self.known) > self.most:
            self.known.clear()
        shares = np.fromiter(map(self.share, coded.dictionary.to_pylist()), np.float64)
        total = np.concatenate([[0.0], np.cumsum(shares[coded.indices.to_numpy()])]) if len(words) else np.zeros(1)
        mean = (total[starts[1:]] - total[starts[:-1]]) / np.maximum(1, np.diff(starts))
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -500, 500)))


def remainder(key: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "utf-8")), F.lit(by))


def sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (CLEAN_ROWS, TOXIC_ROWS)) -> tuple[list[str | None], np.ndarray]:
    """Texts and labels of at most `most` rows of classes 0 and 1, none of them held out; the ids are chosen before any text moves."""
    open_rows = labels.where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [open_rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[k]) for k in (0, 1)]
    chosen = by_hash[0].union(by_hash[1])  # at most sum(most) ids, so it can be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toPandas()
    rows = rows.sort_values(["doc_id", "text"], na_position="first").drop_duplicates("doc_id")
    return [t if isinstance(t, str) else None for t in rows["text"]], rows["toxic"].to_numpy(np.int64)


def score_documents(docs: DataFrame, labels: DataFrame, *, most: tuple[int, int] = (CLEAN_ROWS, TOXIC_ROWS), threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""
    texts, marks = sample(docs, labels, most)
    learned = len(set(marks.tolist())) == 2
    model = train(texts, marks) if learned else None
    shared = docs.sparkSession.sparkContext.broadcast((model.row_logits(), float(model.bias[1] - model.bias[0])) if model else None)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value) if shared.value else None
        for batch in slices(batches, "text"):
            yield columns(schema, doc_id=batch.column("doc_id"), score=scorer.scores(batch.column("text")) if scorer else np.zeros(batch.num_rows))

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
