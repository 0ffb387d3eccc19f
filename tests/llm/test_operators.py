"""The other operators against brute force, held-out accuracy and planted cases on small tables."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from claimloom.llm import fingerprint, fm_index, language, mixing, quality, secrets, substring, toxicity
from tests.llm.helpers import SCHEMA, empty_documents, odd_documents

WORD = r"[^\x20\x09-\x0D]+"
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def four_bits(char, k):
    x = (char + (k + 1) * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 % 2**64
    return (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64 >> 60


def test_walks_agree_in_lanes_and_in_plain_python(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 900))) for _ in range(90)]
    points = [fingerprint.code_points(t) for t in texts]
    lanes = [fingerprint.as_text(*x) for x in fingerprint.fingerprints_of(points)]
    monkeypatch.setattr(fingerprint, "FEW", 10_000)
    assert lanes == [fingerprint.as_text(*x) for x in fingerprint.fingerprints_of(points)]

    def one(text):  # the definition, a character at a time
        at, out = 0, []
        for c, k in zip(fingerprint.char_class(fingerprint.code_points(text)), fingerprint.code_points(text)):
            step = int(fingerprint.STEPS[c * fingerprint.PERIOD + at % fingerprint.PERIOD])
            out += [k] * step
            at += step
        return out

    for text, print_ in zip(texts, lanes):
        emitted = one(text)
        end, samples = fingerprint.from_text(print_)
        assert end == len(emitted) and samples.tolist() == [four_bits(int(emitted[p]), k) for k, p in enumerate(fingerprint.PLACES) if p < end]


def test_edit_report(spark):
    docs = odd_documents(spark, [(None, "a second without id", "fr", "c", 19), (4, "another four", "en", "a", 12), (9, "z" * 200_000, "en", "a", 200_000)])
    rows = fingerprint.edit_report(docs).collect()
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=lambda r: (*r[:2], hashlib.md5(r[2].encode()).digest()[:12]))
    want = collections.Counter()
    for k, (has, doc, text) in enumerate(texts):
        after, n = texts[(k + 1) % len(texts)][2], len(text)
        want[(doc if has else None, n, sha(text[: n - n // 4] + after[: n // 4]))] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert next(r for r in rows if r.doc_id == 3).near_edited > 0.5
    for r in rows:
        own, edited = (set(fingerprint.band_keys(fingerprint.from_text(x)[1]).tolist()) for x in (r.fingerprint, r.edited_fingerprint))
        assert r.edited_bands == len(own & edited) and r.edited_near == (r.edited_bands > 0 and r.near_edited >= fingerprint.LIKENESS)
        assert r.next_near == (r.next_bands > 0 and r.near_next >= fingerprint.LIKENESS)
    assert any(r.next_near for r in rows) and not all(r.next_near for r in rows)  # rows 0 and 4 are alike, as are both rows 4
    assert fingerprint.edit_report(empty_documents(spark)).count() == 0


def test_fingerprint_near_duplicates(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("etaoin shrdlu") for _ in range(1500)) for _ in range(6)]
    rows = [(10 * k + j, t[:700] + "x" * j + t[700:], "en", "s", 0) for k, t in enumerate(base) for j in range(3)]
    got = {r.doc_id: r.class_id for r in fingerprint.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[d] == d // 10 * 10 for d, *_ in rows)


def test_bands_find_the_pairs_at_the_likeness(spark):
    """Of all pairs at the stated likeness, by the share of characters that were edited, 0.9 at least are in one class."""
    rng, rows = random.Random(14), []
    letter = lambda: rng.choice("etaoin shrdlu")
    for k in range(240):
        chars = [letter() for _ in range(rng.randrange(300, 3000))]
        rows.append((2 * k, "".join(chars), "en", "s", 0))
        for _ in range(max(1, int(len(chars) * (0.0005, 0.002, 0.005, 0.01)[k % 4]))):
            i = rng.randrange(len(chars))
            chars[i : i + 1] = rng.choice([[], [letter()], [chars[i], letter()]])
        rows.append((2 * k + 1, "".join(chars), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    prints = {r.doc_id: fingerprint.from_text(r.fingerprint) for r in fingerprint.fingerprints(docs).collect()}
    got = {r.doc_id: r.class_id for r in fingerprint.near_duplicates(docs).collect()}
    pairs = [(a, b) for a in prints for b in prints if a < b and fingerprint.likeness(prints[a], prints[b]) >= fingerprint.LIKENESS]
    assert len(pairs) >= 60 and sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    classes = collections.Counter(got.values())
    assert max(classes.values()) == 2 and all(c // 2 == d // 2 for d, c in got.items())
    odd = {r.doc_id: r.class_id for r in fingerprint.near_duplicates(odd_documents(spark)).collect()}
    assert odd[0] == odd[4] == 0 and odd[1] == odd[2] == 1 and fingerprint.near_duplicates(empty_documents(spark)).count() == 0


def brute_classes(rows):
    """The least id of the component of each row (doc_id, fingerprint), by all pairs that share a band and reach the likeness."""
    prints = [fingerprint.from_text(x) for _, x in rows]
    keys = [set(fingerprint.band_keys(samples).tolist()) for _, samples in prints]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if rows[a][1] == rows[b][1] or (keys[a] & keys[b] and fingerprint.likeness(prints[a], prints[b]) >= fingerprint.LIKENESS):
                root = [root[a] if r == root[b] else r for r in root]
    least = {}
    for (doc, _), r in zip(rows, root):
        least[r] = min(least.get(r, doc), doc)
    return {doc: least[r] for (doc, _), r in zip(rows, root)}


@pytest.mark.parametrize("most", (4096, 8))
def test_classes_equal_all_pairs_of_the_corpus(spark, most):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = [(10**6 + k, "lorem ipsum dolor sit amet " * 30 + "z" * (k % 7), "en", "s", 0) for k in range(40)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(copies, SCHEMA).select("doc_id", "text"))
    rows = [(r.doc_id, fingerprint.as_text(*fingerprint.fingerprints_of([fingerprint.code_points(r.text or "")])[0])) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in fingerprint.near_duplicates(docs, most=most).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) < len(got) - 39
    if most == 4096:
        report = fingerprint.edit_report(docs).collect()
        assert {r.doc_id: r.class_id for r in report} == got and {r.doc_id: r.fingerprint for r in report} == dict(rows)


def test_index_counts_every_stretch():
    rng = np.random.default_rng(0)
    for depth in (1, 2, 5, 8):
        texts = [rng.integers(1, 5, rng.integers(0, 30)) for _ in range(12)]
        index = fm_index.FMIndex(np.concatenate([np.append(t, 0) for t in texts]), depth)
        asked = texts + [np.where((q := rng.integers(-1, 5, 20)) == 0, -1, q) for _ in range(5)]
        flat, sizes = np.concatenate(asked), np.array([len(t) for t in asked])
        starts = np.cumsum(sizes) - sizes
        found = index.matches(flat, starts, sizes)
        for t, s in zip(asked, starts):
            for i in range(len(t)):
                w = t[i : i + depth]
                assert found[s + i] == (sum((x[k : k + depth] == w).all() for x in texts for k in range(len(x) - depth + 1)) if len(w) == depth else 0)


@pytest.mark.parametrize("most", [400_000, 150])
def test_substring_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(substring, "SHARD_WORDS", most)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    passage = " ".join(word() for _ in range(60))
    rows = [(100 + k, " ".join(word() for _ in range(50)) + " " + passage + "\n" + " ".join(word() for _ in range(k)), "en", "s", 0) for k in range(30)]
    rows += [(200, "same " * 90, "en", "s", 0), (201, " ".join(passage.split()[:35]), "en", "s", 0), (202, " ".join(passage.split()[:34]), "en", "s", 0)]
    rows += [(201, passage + " other text with the same id", "en", "s", 0), (None, "no id " + passage, "en", "s", 0), (None, "same " * 50, "en", "s", 0)]
    docs = odd_documents(spark, rows)
    texts = [(r.doc_id, re.findall(WORD, r.text or "")) for r in docs.collect()]
    seen = collections.Counter(tuple(w[i : i + 35]) for _, w in texts for i in range(len(w) - 34))
    want = collections.Counter()
    for doc, w in texts:
        gone = {i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)}
        want[(doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    got = collections.Counter(tuple(r) for r in substring.remove_repeats(docs).drop("kept").collect())
    assert got == want
    assert substring.remove_repeats(empty_documents(spark)).count() == 0


def test_quality_base_and_lines(spark):
    boiler, rng = "All rights reserved by the publisher of this page in 2024", random.Random(5)
    text = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    rows = [(1000 + k, f"{text(30)}\n{boiler.replace('2024', str(2000 + k))}", "en", "h", 0) for k in range(30)]
    rows += [(2000, f"{boiler}\n{boiler} ", "en", "h", 0), (2001, f"{boiler}\n{text(12)}", "en", "other", 0)]
    docs = odd_documents(spark, rows)
    got = quality.report(docs).collect()
    assert len(got) == docs.count()
    by_text = collections.defaultdict(set)
    for r in docs.collect():
        by_text[r.doc_id].add(r.text)
    for r in got:
        (t,) = by_text[r.doc_id]
        w = re.findall(WORD, t or "")
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 10 or 100 * len(twice) > 20 * len(w))
    flat = lambda x: " ".join(re.sub("[0-9]", "0", x.lower()).split())
    texts = {(r.source, r.text) for r in docs.collect()}
    hosts = collections.Counter(h for h, _ in texts)
    held = collections.Counter((h, x) for h, t in texts for x in {flat(x) for x in (t or "").split("\n")} if x)
    source = {(r.doc_id, r.text): r.source for r in docs.collect()}
    for r in got:
        (t,) = by_text[r.doc_id]
        h = source[r.doc_id, t]
        left = [x for x in (t or "").split("\n") if not (held[h, flat(x)] > quality.LEAST_DOCS and (held[h, flat(x)] > quality.SHARE * hosts[h] or held[h, flat(x)] > quality.ENOUGH))]
        n_left = len(re.findall(WORD, "\n".join(left)))
        assert r.n_left == n_left and r.kept == (not r.base_failed and n_left >= max(1, quality.KEEP * r.n_words))
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[1000 + k] for k in range(30)) and not kept[2000] and kept[2001]
    clean = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert "rights" not in clean[1003].text and clean[1003].n_chars == len(clean[1003].text) and "rights" in clean[2001].text and 2000 not in clean
    assert quality.report(empty_documents(spark)).count() == 0


def test_quality_acts_on_the_tables(spark):
    least = {"0.01": (100, 0), "0.1": (2000, 3)}
    for sf, (shortened, depleted) in least.items():
        told = quality.report(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"))
        assert told.where("n_left < n_words").count() >= shortened and told.where("not base_failed and not kept").count() >= depleted


def test_quality_a_line_in_very_many_documents_needs_no_share(spark):
    rows = [(k, f"own line {'abcdefghij'[k % 10] * (k // 10 + 1)} one two three four five six seven\n{'shared by some' if k < 40 else 'none ' + 'x' * k}", "h") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert quality.report(docs, share=0.5).where("n_left < n_words").count() == 0
    assert {r.doc_id for r in quality.report(docs, share=0.5, enough=39).where("n_left < n_words").collect()} == set(range(40))


def test_quality_many_lines_take_the_join(spark, monkeypatch):
    rows = [(k, "\n".join(f"line {'abcdefgh'[j]} of every page here" for j in range(3)) + f"\n{'unique ' * 3}{'z' * k} own words {'y' * k} end", "en", None if k % 2 else "h", 0) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, quality.report(docs).collect()))
    monkeypatch.setattr(quality, "MOST_BROADCAST", 0)
    assert sorted(map(str, quality.report(docs).collect())) == want and "n_left=3" not in want[0]


def test_mixing_equals_sql_and_target(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = collections.Counter(map(str, con.sql(f"SELECT doc_id, source, copies, copy, mix_key FROM ({mixing.ORACLE_SQL})").fetchall()))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs).select("row.doc_id", "row.source", "copies", "copy", "mix_key").collect()
    assert collections.Counter(str(tuple(r)) for r in got) == want
    many = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text", "IF(id % 4 = 0, 'a', 'b') AS source", "1 AS copies")
    counts = {r.source: r["count"] for r in mixing.mix(many, weights={"a": 3.0, "b": 1.0}).groupBy("row.source").count().collect()}
    assert abs(counts["a"] - 15_000) < 600 and abs(counts["b"] - 5_000) < 400
    assert mixing.mix(empty_documents(spark)).count() == 0 and mixing.mix(odd_documents(spark)).select("row.*").columns == odd_documents(spark).columns


def test_large_poisson_means(spark):
    from pyspark.sql import functions as F

    drawn = spark.range(4000).select(mixing.copies(F.col("id").cast("string"), F.lit(40.0)).alias("n")).toPandas()["n"]
    assert abs(drawn.mean() - 40) < 0.5 and abs(drawn.var() - 40) < 4


ALLOWED_RUNS = (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"[A-Za-z]*+([/_=-][A-Za-z]*+)*+", r"[a-z]*+[0-9]*+([/_=-][a-z]*+[0-9]*+)*+", r"[A-Z]*+[0-9]*+([/_=-][A-Z]*+[0-9]*+)*+")


def brute_secrets(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    base = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        run = m[0]
        limit = next((x for _, p, x in secrets.CLASSES if re.search(p, run)), None)
        if limit is None or any(re.fullmatch(p, run) for p in ALLOWED_RUNS):
            continue
        entropy = lambda w: -sum(c / 20 * math.log2(c / 20) for c in collections.Counter(w).values())
        hits = [i for i in range(len(run) - 19) if entropy(run[i : i + 20]) >= limit - 1e-9]
        if hits:
            a, b = m.start() + hits[0], m.start() + hits[-1] + 20
            if not any(s <= a and b <= e for s, _, e, _ in base):
                more.append((a, 3, b, "entropy"))
    told = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(x))
    return told(base), told(base + more)


def test_secrets_against_brute_force(spark):
    rng = random.Random(6)
    key = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/": "".join(rng.choice(a) for _ in range(n))
    texts = [f"é {key(44)} and {key(30, '0123456789abcdef')} end", f"PassWord = '{key(9)}' TOKEN:abc Api_Key=x{key(20)} secret=token: abcdefgh", f"AKIA{key(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')} AKIA123", "123e4567-e89b-12d3-a456-426614174000 internationalization/of/everything_is_fine", f"aaaaaaaaaaaaaaaaaaaaaaaaaaa{key(60)}", "\n".join(f"k{i}={key(25)}" for i in range(40)), "𝒳 " * 30 + key(40), "$1 \\0 " + key(33), "x" * 5000 + " " + key(300)]
    docs = odd_documents(spark, [(500 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    by = {r.doc_id: r.text or "" for r in docs.collect()}
    got = secrets.report(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        base, all_ = brute_secrets(by[r.doc_id])
        assert r.spans == all_ and r.base_sha256 == sha(base) and (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(f"{k}:") for k in secrets.KINDS[:3])
    assert sum("entropy" in r.spans for r in got) >= 5
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for doc, t in by.items():
        out, at = [], 0
        for s, e in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in brute_secrets(t)[1].split(",") if x):
            if s >= at:
                out += [t[at:s], secrets.MASK]
            at = max(at, e)
        assert (clean[doc] or "") == "".join(out) + t[at:]
    assert secrets.report(empty_documents(spark)).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.classify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.93
    odd = {r.doc_id: r for r in language.classify(odd_documents(spark)).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[5].lang_pred == "und" and odd[3].lang_pred in ("en", "fr")
    assert language.classify(empty_documents(spark)).count() == 0


def test_toxicity_learns_misspellings(spark):
    rng = random.Random(7)
    plain = [f"{rng.choice('bcdfglmn')}{rng.choice('aeiou')}{rng.choice('rst')}{rng.choice('aeiou')}" for _ in range(200)]
    text = lambda bad: " ".join(rng.choice(plain) for _ in range(60)) + (f" {bad} " if bad else " ") + " ".join(rng.choice(plain) for _ in range(20))
    rows = [(k, text(rng.choice(["worthless", "pathetic", "disgusting"]) if k % 3 == 0 else ""), "en", "s", 0) for k in range(600)]
    rows += [(10_000 + k, text("wortthless" if k % 2 else ""), "en", "s", 0) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    # one unseen misspelling among 80 words, learned from some 400 documents; chance is 0.5
    auc = np.mean([got[10_000 + a].score > got[10_000 + b].score for a in range(1, 40, 2) for b in range(0, 40, 2)])
    assert auc > 0.75 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    texts, marks = toxicity.sample(docs, labels)
    assert len(texts) == len(marks) < 600
    model = toxicity.train(texts, marks)
    for r in docs.limit(20).collect():  # the score from the layers as they are: mean of words' mean embeddings, softmax
        words = [model.embedding[toxicity.ngrams(w)].astype(float).mean(axis=0) for w in r.text.split()]
        logits = toxicity.GAIN * np.mean(words, axis=0) @ model.weights + model.bias
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(logits[0] - logits[1]))) < 1e-4
    odd = toxicity.score_documents(odd_documents(spark), labels).collect()
    assert len(odd) == odd_documents(spark).count() and toxicity.score_documents(empty_documents(spark), labels).count() == 0
