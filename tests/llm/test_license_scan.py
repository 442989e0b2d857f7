import re

from helpers import no_docs, odd_docs
from molspark.llm import license_scan
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}

TEXTS = [
    "Licensed under the MIT License.",
    "under the MIT license under-the MIT; LICENSE",
    "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "This work is licensed under the GNU General Public License, version 2.",
    "This work is licensed under the brand new GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any individual person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction",
    "All rights reserved.",
    "all rights are reserved",
    "the license of the public is general",
    "free of charge to any other place",
    ("word " * 50 + "Released under the MIT License. ") * 40,
]


def expected(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        parts = phrase.split()
        hits = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def by_text(rows):
    return {r["doc_id"]: r for r in rows}


def test_exact_places_and_votes(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = by_text(license_scan.scan_licenses(docs).collect())
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == expected(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0.0 <= r["score"] <= 1.0
    labels = {i: rows[i]["labels"] for i in rows}
    assert labels == {
        0: "mit", 1: "mit", 2: "apache-2,cc-by-nc", 3: "gpl-3", 4: "gpl-2", 5: "gpl-3", 6: "mit", 7: "all-rights-reserved", 8: "", 9: "", 10: "", 11: "mit"
    }
    assert rows[9]["score"] == 0.0 and rows[7]["score"] == 1.0
    assert 0.8 <= rows[6]["score"] <= 1.0
    assert rows[11]["n_base"] == 40


def test_diagonals_equal_brute_force(spark):
    """Every (template, place) where at least one k-gram matches lies in a span found by the join."""
    templates = license_scan.Templates(license_scan.TEMPLATES, license_scan.PHRASES)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    scanned = license_scan.scan(docs, templates).withColumnRenamed("doc_id", "row").cache()
    segments = scanned.select("row", F.inline("segments"))
    spans = license_scan.diagonals(segments, templates).collect()
    for i, text in enumerate(TEXTS):
        words = WORD.findall(text.translate(LOWER))
        for t, (template, _) in enumerate(license_scan.TEMPLATES):
            parts = template.split()
            grams = {tuple(parts[k : k + 3]) for k in range(len(parts) - 2)}
            for at in range(len(words) - 2):
                if tuple(words[at : at + 3]) in grams:
                    assert any(s["row"] == i and s["template"] == t and s["low"] <= at and at + 3 <= s["high"] for s in spans)


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("row", "labels")
    rows = license_scan.scan_licenses(docs).collect()
    assert len(rows) == docs.count()
    texts = sorted((r["text"] or "" for r in docs.collect()), key=str)
    assert sorted(r["n_words"] for r in rows) == sorted(expected(t)[0] for t in texts)
    assert {(r["labels"], r["score"]) for r in rows} == {("", 0.0)}
    assert license_scan.scan_licenses(no_docs(spark)).count() == 0


def test_changed_words_at_either_end_and_far_between_grams(spark):
    mit = license_scan.TEMPLATES[2][0].split()
    far = list(mit)
    for at in (5, 8, 11, 14, 17):  # no three words in a row are left between
        far[at] = "changed"
    texts = [
        "licensed beneath the GNU Lesser General Public License",
        "licensed under the GNU Lesser General Public licence",
        " ".join(far),
        "see " * 60 + " ".join(far) + " see" * 60,
        "general public license",
        "licensed beneath the GNU Lesser General Public License, all rights reserved",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = by_text(license_scan.scan_licenses(docs).collect())
    assert [rows[i]["labels"] for i in range(6)] == ["lgpl", "lgpl", "mit", "mit", "", "all-rights-reserved,lgpl"]
    assert rows[0]["score"] == rows[1]["score"] == 0.875
    assert rows[2]["score"] == rows[3]["score"] == 1 - 5 / len(mit)
