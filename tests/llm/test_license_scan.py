import random
import re

import numpy as np

from arenaflow.llm import license_scan as ls

TEXTS = [
    None, "", "Released under the MIT License.", "mit-license MIT LICENSE apache license", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "the license of mit", "licensed under cc and by nc in 4",
    "word " * 5000 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software", "éMIT License mit LICENSEİ", "general public license general public license",
    "Licensed under the very Apache License Version 2.0", "under the mit",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for p, label in ls.PHRASES.items():
        n = len(p.split())
        found = [i for i in range(len(words) - n + 1) if words[i : i + n] == p.split()]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_and_added_labels(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x")], "doc_id long, text string, labels string")
    rows = sorted(ls.scan_licenses(docs).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(TEXTS) + 1
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[6].labels == "cc-by-nc" and got[6].score == 1 and got[9].labels == "mit" and got[7].labels == "" and got[8].labels == ""
    assert got[12].labels == "apache" and got[12].score > 0.7 and got[13].labels == ""
    assert ls.scan_licenses(docs.filter("false")).count() == 0


def test_document_frequency_counts_every_document(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    t = ls.Templates(ls.TEMPLATES, 0.7)
    df = ls.document_frequency(ls.licence_facts(docs, t))
    assert df == {c: n for w, c in t.code.items() if (n := sum(w in ls.words_of(x or "") for x in TEXTS))}


def aligned(text, t):
    """Labels and score by aligning every template with the whole text."""
    words = ls.words_of(text or "")
    codes = np.array([t.code.get(w, -1) for w in words], int)
    found = {k: 1 - e / len(t.words[k]) for k in range(len(t.labels)) if (e := ls.accepted(t, k, codes)) is not None}
    return {t.labels[k] for k in found}, max(found.values(), default=0.0)


def test_whole_table_labels_and_scores_equal_alignment_of_all_templates(spark):
    t = ls.Templates(ls.TEMPLATES, 0.7)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: aligned(r.text, t) for r in docs.collect()}
    seen = 0
    for r in ls.scan_licenses(docs).collect():
        labels, score = want[r.doc_id]
        assert r.score == score and set(r.labels.split(",")) - {""} == labels | set(r.base_labels.split(",")) - {""}
        seen += bool(labels)
    assert seen > 10


def test_changed_licences_in_long_files_equal_alignment(spark):
    rng, t = random.Random(9), ls.Templates(ls.TEMPLATES, 0.7)
    filler = [*t.vocabulary, *(f"x{i}" for i in range(300))]
    texts = []
    for i in range(120):
        words = rng.choices(filler, k=rng.choice([0, 5, 300, 3000]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(ls.TEMPLATES))
            own = [x for w in ls.TEMPLATES[k][1].split() for x in rng.choice([[w]] * 8 + [[], [w, "new"], ["new"]])]
            at = rng.randint(0, len(words))
            words[at:at] = own
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in ls.scan_licenses(docs).collect()}
    hits = 0
    for i, x in enumerate(texts):
        labels, score = aligned(x, t)
        assert got[i].score == score and set(got[i].labels.split(",")) - {""} == labels | set(got[i].base_labels.split(",")) - {""}, x[:200]
        hits += bool(labels)
    assert 30 < hits < 120


def test_every_template_finds_itself(spark):
    docs = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(ls.TEMPLATES)], "doc_id long, text string")
    for r in ls.scan_licenses(docs).collect():
        assert ls.TEMPLATES[r.doc_id][0] in r.labels.split(",") and r.score == 1


def test_whole_table_base_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in ls.scan_licenses(docs).collect()}
    assert got == want
