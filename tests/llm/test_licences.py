"""License scans against a count of every block with every template."""

import random

from claimloom.llm import licences
from tests.llm.helpers import empty_documents, odd_documents


def brute_blocks(text, templates=licences.TEMPLATES, percent=licences.PERCENT):
    words, out = licences.terms(text or ""), []
    for label, notice in templates.items():
        own, size = set(licences.terms(notice)), licences.length_class(len(licences.terms(notice)))
        for begin in range(0, len(words), size):
            shared = len(own & set(words[begin : begin + 2 * size]))
            if 100 * shared >= percent * len(own):
                out.append((begin, label, min(begin + 2 * size, len(words)), shared, len(own)))
    return sorted(out)


def texts():
    rng, out = random.Random(12), []
    common = "the of and software license work is under a this to by version gnu public mit cc apache general".split()
    for label, notice in sorted(licences.TEMPLATES.items()):
        words = notice.split()
        for lost in (0.0, 0.1, 0.2, 0.35):
            kept = [w if rng.random() >= lost else "xyz" for w in words]
            before, after = ([rng.choice(common + ["alpha", "béta", "42"]) for _ in range(rng.randrange(0, 90))] for _ in range(2))
            out.append(" ".join(before) + "\n# " + "\n * ".join(" ".join(kept[i : i + 9]) for i in range(0, len(kept), 9)) + "\n" + " ".join(after))
    return out


def test_blocks_against_all_windows(spark):
    docs = odd_documents(spark, [(100 + k, t, "en", "a", 1) for k, t in enumerate(texts())])
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    got = {}
    for r in licences.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(sorted((b.first_word, b.label, b.end_word, b.shared, b.words) for b in r.blocks))
    for doc, text in whole:
        assert all(x == brute_blocks(text) for x in got[doc]) or doc is None
    assert sum(len(x[0]) for x in got.values()) > 60


def test_a_notice_is_found_wherever_it_stands(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["x"] * rng.randrange(0, 300)) + " " + notice + " y" * rng.randrange(0, 300), label) for k, (label, notice) in enumerate(sorted(licences.TEMPLATES.items()) * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    for r in licences.report(docs).join(docs.select("doc_id", "label"), "doc_id").collect():
        assert r.label in r.labels.split(",") and r.score == 1.0


def test_phrases(spark):
    rows = [(1, "MIT License mit\nlicense, MIT-LICENSE"), (2, "mit"), (3, "license"), (4, "The GNU (General) Public: License CC-BY cc"), (5, "Mit Licensee"), (6, "by mit"), (7, "license apache")]
    got = {r.doc_id: r for r in licences.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (3, 0, 4, "mit", 1.0)
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels) == (2, 1, 5, "cc-by,gpl")
    assert all(got[k].n_base == 0 and got[k].first_word is None and got[k].base_labels == "" for k in (2, 3, 5, 6, 7))


def test_empty_table_and_other_templates(spark):
    assert licences.report(empty_documents(spark)).count() == 0
    one = {"own": "alpha beta gamma delta epsilon"}
    docs = odd_documents(spark, [(50, "Alpha, gamma; delta (beta)", "en", "a", 1), (51, "alpha beta gamma", "en", "a", 1)])
    got = {r.doc_id: r for r in licences.report(docs, templates=one, phrases={}).collect()}
    assert got[50].labels == "own" and got[50].score == 0.8 and got[51].labels == "" and got[51].score == 0.0
    assert licences.report(docs, templates={}, phrases={}).where("labels <> '' or score <> 0").count() == 0


def test_very_long_text(spark):
    text = "filler words here " * 700_000 + licences.TEMPLATES["mit"] + " tail" * 100
    row = licences.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert "mit" in row.labels.split(",") and row.n_words > 2_100_000
