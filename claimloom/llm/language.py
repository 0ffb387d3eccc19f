"""Language identification by compression.

Each language has a zstandard dictionary of raw content, made of sampled text in lower case. A text, in lower case too, is cut into blocks, each block is compressed with
every dictionary, and the language whose dictionary makes the whole smallest is chosen. Where the second best comes within `MARGIN` of
the best, the row is marked as rejected: the guess is still told, as is the score that its margin gives.

The dictionaries are made on the driver from the whole texts of at most `SAMPLE_ROWS` rows of each language; that bound is the only
sampling here. Every text is classified whole.

Defined results: a null text, or one without a letter, is `und` with score 0; with no language learned all rows are `und`; repeated rows
get equal results; a null id is classified, never learned from; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import columns, slices

SAMPLE_ROWS = 64
LEVEL, BLOCK = 3, 2048
#: The least difference between the two smallest sizes, as a share of the larger, that isn't narrow.
MARGIN = 0.02
#: How fast the score falls with the difference in compressed bits for each byte of text.
SHARPNESS = 20.0
UNKNOWN = "und"


def remainder(key: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "utf-8")), F.lit(by))


def contents(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 10) -> dict[str, bytes]:
    """Raw content for each language: the rows least by hash among those that aren't held out, found without bringing a language together."""
    have = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder(F.col("doc_id"), 5) != 0))
    counts = {r["lang"]: r["count"] for r in have.groupBy("lang").count().collect()}
    if not counts:
        return {}
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cut = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2 * rows + 20) / n))))[F.col("lang")]
    few = have.withColumn("h", hashed).where(F.col("h") < cut).select("lang", "h", "doc_id", "text")
    first = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))).where(F.col("k") <= rows)
    out: dict[str, list[str]] = {}
    for r in first.orderBy("lang", F.desc("k")).collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(x).lower().encode() for lang, x in sorted(out.items())}


class Classifier:
    """Compressors with one dictionary for each language."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.languages, self.compressors = list(content), []
        for data in content.values():
            own = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            self.compressors.append(z.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes, block: int = BLOCK) -> np.ndarray:
        parts = [text[i : i + block] for i in range(0, len(text), block)]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.compressors])

    def classify(self, text: str) -> tuple[str, float, bool]:
        """The language, its score and whether the margin is wide enough."""
        data = text.lower().encode()
        sizes = self.sizes(data)
        best = int(sizes.argmin())
        odds = np.exp(-SHARPNESS * 8 * (sizes - sizes[best]) / len(data))
        second = np.sort(sizes)[1] if len(sizes) > 1 else np.inf
        return self.languages[best], float(1 / odds.sum()), bool(second - sizes[best] >= MARGIN * second)


def classify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of `docs`."""
    content = contents(docs, **options)
    shared = docs.sparkSession.sparkContext.broadcast(content)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in slices(batches, "text"):
            letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_pylist()
            found = [model.classify(t) if ok and model.languages else (UNKNOWN, 0.0, False) for t, ok in zip(batch.column("text").to_pylist(), letters)]
            yield columns(schema, doc_id=batch.column("doc_id"), lang_pred=[x[0] for x in found], score=[x[1] for x in found], rejected=[not x[2] for x in found])

    told = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return told.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
