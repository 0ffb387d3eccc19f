"""License scans by an exact set-similarity join of text blocks with license notices.

Texts are taken as words (lower case). A block is a window of 2 * L words that starts at a multiple of L, L being a template's length class (the
least power of two from SHORTEST on that holds the template), so wherever a template's words stand, however their lines are broken, some block holds all of
them. A block meets a template if it contains the stated share of the template's different words.

The words of all templates are ordered by the number of documents of the whole table that hold them, rarest first, and the join filters by it. Prefix: of a
template with n words of which k must be there, one of the n - k + 1 rarest must be, so only blocks with such a word are looked at.
Length: such a block must hold k template words at least. Position: a shared word at place p of the template and q of the block leaves
room for 1 + min(n - p - 1, m - q - 1) more. Only what passes is counted, and every block that meets a threshold does pass.
Other words can't add to an overlap, so blocks are taken on the words of templates alone; the templates' words are all that tasks hold.

Phrases that name a license, word by word, are labels of their own.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are scanned each; a null id is kept; an empty
table gives an empty result; other columns are ignored. Equal shares are settled by label and place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import columns, slices, terms_of

#: The share of a template's words that a block must hold, in hundredths, and the least length class.
PERCENT, SHORTEST = 80, 16
#: Words of all templates together, at most: they are sent to every task.
MOST_WORDS = 200_000

#: Phrases and the labels that they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices by label, as their authors ask for them.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mit-line": "Released under the MIT License",
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}

FOUND = "doc_id long, n_words long, phrases array<struct<label string, word long>>, blocks array<struct<label string, first_word long, end_word long, shared int, words int>>"


def terms(text: str) -> list[str]:
    return terms_of(pa.array([text]))[1].to_pylist()


def needed(words: int, percent: int) -> int:
    """The least number of shared words that is the stated share of `words`."""
    return -(-percent * words // 100)


def length_class(words: int) -> int:
    size = SHORTEST
    while size < words:
        size *= 2
    return size


@dataclass
class Index:
    """Templates and phrases over one vocabulary, whose order is that of the words' frequency."""

    vocabulary: list[str]
    labels: list[str]
    sets: list[np.ndarray]  # each template's words, rarest first
    classes: list[int]
    phrases: list[tuple[str, np.ndarray]]
    percent: int

    @classmethod
    def of(cls, templates: dict[str, str], phrases: dict[str, str], frequency: dict[str, int], percent: int) -> Index:
        spoken = {label: terms(text) for label, text in sorted(templates.items())}
        named = {phrase: terms(phrase) for phrase in sorted(phrases)}
        vocabulary = sorted({w for x in (*spoken.values(), *named.values()) for w in x}, key=lambda w: (frequency.get(w, 0), w))
        rank = {w: k for k, w in enumerate(vocabulary)}
        return cls(vocabulary, list(spoken), [np.unique([rank[w] for w in x]) for x in spoken.values()], [length_class(len(x)) for x in spoken.values()], [(phrases[p], np.array([rank[w] for w in x])) for p, x in named.items()], percent)

    def prepare(self) -> None:
        """What a task looks things up in, made there once: for each length class its templates, their prefixes by word, and which words they have."""
        self.codes = pa.array(self.vocabulary, pa.string())
        self.by_class = []
        for size in sorted(set(self.classes)):
            own = [t for t, c in enumerate(self.classes) if c == size and len(self.sets[t])]
            has = np.zeros((len(self.vocabulary), len(own)), bool)
            least, prefix = np.array([needed(len(self.sets[t]), self.percent) for t in own]), []
            for k, t in enumerate(own):
                has[self.sets[t], k] = True
                prefix += [(w, k, p) for p, w in enumerate(self.sets[t][: len(self.sets[t]) - least[k] + 1].tolist())]
            words, which, place = np.array(sorted(prefix), np.int64).reshape(-1, 3).T
            self.by_class.append((size, own, has, least, np.searchsorted(words, np.arange(len(self.vocabulary) + 1)), which, place))

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's words start, and each word's number in the vocabulary or -1."""
        starts, words = terms_of(texts)
        seen = words.dictionary_encode()
        known = pc.fill_null(pc.index_in(seen.dictionary, self.codes), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return starts, known[seen.indices.to_numpy()] if len(words) else np.empty(0, np.int64)

    def blocks(self, starts: np.ndarray, codes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, template, first word, end, shared words) of every block that meets a template's threshold."""
        out = []
        at = np.flatnonzero(codes >= 0)
        word, doc = codes[at], np.searchsorted(starts, at, side="right") - 1
        step = at - starts[doc]
        for size, own, has, least, first, which, place in self.by_class:
            wide = int((starts[1:] - starts[:-1]).max(initial=0)) // size + 2
            window = doc * wide + step // size  # the block that begins at or before the word; the word is in the one before it too
            rare = first[word + 1] > first[word]
            near = np.unique(window[rare])
            near = np.union1d(near, near[near % wide > 0] - 1)
            if not len(near):
                continue
            both = np.concatenate([window, window[window % wide > 0] - 1])
            held = np.concatenate([word, word[window % wide > 0]])
            keep = near[np.minimum(np.searchsorted(near, both), len(near) - 1)] == both
            merged = np.unique(both[keep] * len(self.vocabulary) + held[keep])  # a block's different words, rarest first
            block, held = merged // len(self.vocabulary), merged % len(self.vocabulary)
            edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
            run = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            count = first[held + 1] - first[held]
            hit = np.repeat(np.arange(len(held)), count)
            entry = np.repeat(first[held], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            t, p, q, r = which[entry], place[entry], hit - edges[run[hit]], run[hit]
            held_in, total = np.diff(edges)[r], has.sum(axis=0)[t]
            fit = (held_in >= least[t]) & (np.minimum(p, q) + 1 + np.minimum(total - p - 1, held_in - q - 1) >= least[t])
            pairs = np.unique(r[fit] * len(own) + t[fit])
            for k, j in zip((pairs // len(own)).tolist(), (pairs % len(own)).tolist()):
                shared = int(has[held[edges[k] : edges[k + 1]], j].sum())
                if shared >= least[j]:
                    text, begin = int(block[edges[k]]) // wide, int(block[edges[k]]) % wide * size
                    out.append((text, own[j], begin, min(begin + 2 * size, int(starts[text + 1] - starts[text])), shared))
        return out

    def places(self, starts: np.ndarray, codes: np.ndarray) -> list[tuple[int, str, int]]:
        """(text, label, first word) of every place where a phrase's words stand one after the other."""
        out = []
        for label, words in self.phrases:
            at = np.flatnonzero(codes == words[0])
            for k, w in enumerate(words[1:], 1):
                at = at[at + k < len(codes)]
                at = at[codes[at + k] == w]
            doc = np.searchsorted(starts, at, side="right") - 1
            inside = at + len(words) <= starts[doc + 1]
            out += ((d, label, a) for d, a in zip(doc[inside].tolist(), (at - starts[doc])[inside].tolist()))
        return out


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many rows of `docs` (text) each of the given words is; each task adds its rows up before the shuffle."""
    given, schema = sorted(set(words)), pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(len(given), np.int64), pa.array(given, pa.string())
        for batch in slices(batches, "text"):
            starts, found = terms_of(batch.column("text"))
            seen = found.dictionary_encode()
            code = pc.fill_null(pc.index_in(seen.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[seen.indices.to_numpy()] if len(found) else np.empty(0, np.int64)
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            total += np.bincount(np.unique(doc[code >= 0] * len(given) + code[code >= 0]) % len(given), minlength=len(given))
        yield columns(schema, word=given, n=total)

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}  # a row for each template word


def scan(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, phrases, blocks), one row per row of `docs`: where phrases stand, and every block that meets a template's threshold."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = [w for x in (*templates.values(), *phrases) for w in terms(x)]
    if len(words) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words; scan with some of them at a time")
    shared = docs.sparkSession.sparkContext.broadcast(Index.of(templates, phrases, frequencies(rows, words), percent))
    phrase, block = pa.struct([("label", pa.string()), ("word", pa.int64())]), pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("shared", pa.int32()), ("words", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("phrases", pa.list_(phrase)), ("blocks", pa.list_(block))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        index.prepare()
        for batch in slices(batches, "text"):
            starts, codes = index.coded(batch.column("text"))
            named: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for d, label, at in sorted(index.places(starts, codes), key=lambda x: (x[0], x[2], x[1])):
                named[d].append({"label": label, "word": at})
            for d, t, a, z, n in sorted(index.blocks(starts, codes), key=lambda x: (x[0], x[2], x[1])):
                found[d].append({"label": index.labels[t], "first_word": a, "end_word": z, "shared": n, "words": len(index.sets[t])})
            yield columns(schema, doc_id=batch.column("doc_id"), n_words=np.diff(starts), phrases=named, blocks=found)

    return rows.mapInArrow(run, FOUND)


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs`: its words, the phrases' places and labels, all labels, and the largest share of a template (1 for a phrase)."""
    label = lambda name: F.transform(name, lambda x: x["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    words, share = F.transform("phrases", lambda x: x["word"]), F.transform("blocks", lambda x: x["shared"] / x["words"])
    return scan(docs, **options).select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(label("phrases")).alias("base_labels"),
        joined(F.concat(label("phrases"), label("blocks"))).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max(share), F.lit(0.0))).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )


def _oracle() -> str:
    """What the report returns, over the table of documents, by counting every block against every template."""
    sizes = {label: (len(set(terms(x))), length_class(len(terms(x)))) for label, x in TEMPLATES.items()}
    of_template = ", ".join(f"('{label}', '{w}')" for label, x in sorted(TEMPLATES.items()) for w in sorted(set(terms(x))))
    of_size = ", ".join(f"('{label}', {n}, {size}, {needed(n, PERCENT)})" for label, (n, size) in sorted(sizes.items()))
    most = max(len(terms(p)) for p in PHRASES)
    phrases = ", ".join(f"('{' '.join(terms(p))}', {len(terms(p))}, '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM rows_),
phrases (phrase, n, label) AS (VALUES {phrases}),
runs AS (SELECT r, i, word, {", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, most))} FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
named AS (SELECT r, i, label FROM runs JOIN phrases ON phrase = CASE n {" ".join(f"WHEN {n} THEN word" + "".join(f" || ' ' || w{k}" for k in range(1, n)) for n in range(1, most + 1))} END),
templates (label, word) AS (VALUES {of_template}),
sizes (label, n, size, least) AS (VALUES {of_size}),
hits AS (SELECT DISTINCT r, label, n, least, i // size - back AS block, word FROM words JOIN templates USING (word) JOIN sizes USING (label), (VALUES (0), (1)) AS b(back) WHERE i // size >= back),
blocks AS (SELECT r, label, block, count(*) / n AS share FROM hits GROUP BY r, label, block, n, least HAVING count(*) >= least),
by_phrase AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM named GROUP BY r),
by_block AS (SELECT r, count(*) AS n_blocks, max(share) AS share FROM blocks GROUP BY r),
all_labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM named UNION ALL SELECT r, label FROM blocks) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM rows_ LEFT JOIN by_phrase USING (r) LEFT JOIN by_block USING (r) LEFT JOIN all_labels USING (r)
"""


ORACLE_SQL = _oracle()
