"""License scan by diagonal voting.

A scan of the texts keeps, around every word k-gram that some template has, a segment of
template word numbers that reaches as far as any template with that k-gram can. Spark joins the rolling k-grams of the segments to their positions in the
templates; each match votes for the diagonal (document position minus template position) it lies
on, neighbouring diagonals are merged so that a few words more or fewer do not break a span, and
each span is verified by the longest common word sequence of the template and the words between
the places where its diagonals begin and end. Of verified spans whose matched words overlap, the
one with most of them counts.

Grams are numbers of word tuples over the closed template vocabulary, so equal numbers are equal
words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molspark.llm.common import slices
from molspark.session import materialize

# Phrases whose exact places are counted, and notices that the vote looks for.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "mit",
    ),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the bsd 3 clause license", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("dedicated to the public domain under cc0 1 0 universal", "cc0"),
    ("all rights reserved", "all-rights-reserved"),
]
K = 3
#: Words that neighbouring diagonals of a template may be apart: a share of its words, at most SLACK.
SLACK, SLACK_SHARE = 4, 4
#: Share of a template's words that its span must hold in order.
COVERAGE = 0.8

#: Every byte that is no word byte becomes a blank, A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def license_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Templates:
    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]):
        texts = [t for t, _ in templates] + [p for p, _ in phrases]
        self.number = {w: i for i, w in enumerate(sorted({w for t in texts for w in license_words(t.encode())}), 1)}
        self.base = len(self.number) + 1
        self.words = [[self.number[w] for w in license_words(t.encode())] for t, _ in templates]
        self.labels = [label for _, label in templates]
        self.phrases = [([self.number[w] for w in license_words(p.encode())], label) for p, label in phrases]
        if any(len(w) < K for w in self.words):
            raise ValueError(f"a template has fewer than {K} words")
        self.slack = [min(SLACK, len(w) // SLACK_SHARE) for w in self.words]
        #: Words by which a place of any template goes beyond one of its k-grams, at most.
        self.reach = max((len(w) + s for w, s in zip(self.words, self.slack, strict=True)), default=0)

    def grams(self) -> list[tuple[int, int, int]]:
        """(gram, template, position) of all rolling k-grams."""
        return [
            (sum(w * self.base ** (K - 1 - j) for j, w in enumerate(words[at : at + K])), t, at)
            for t, words in enumerate(self.words)
            for at in range(len(words) - K + 1)
        ]


def _rolling(ids: np.ndarray, base: int) -> np.ndarray:
    """Gram numbers by start; -1 where a word is no template word."""
    n = len(ids) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    grams, known = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(K):
        grams = grams * base + ids[j : j + n]
        known &= ids[j : j + n] > 0
    return np.where(known, grams, -1)


def _places(ids: np.ndarray, phrase: list[int]) -> np.ndarray:
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = ids[:n] == phrase[0]
    for j in range(1, len(phrase)):
        hit &= ids[j : j + n] == phrase[j]
    return np.flatnonzero(hit)


def _segments(ids: np.ndarray, live: np.ndarray, reach: int) -> list[dict]:
    if not len(live):
        return []
    cuts = np.flatnonzero(np.diff(live) > reach) + 1
    out = []
    for part in np.split(live, cuts):
        lo, hi = max(0, int(part[0]) - reach), min(len(ids), int(part[-1]) + K + reach)
        out.append({"start": lo, "ids": ids[lo:hi].tolist()})
    return out


_SCANNED = """doc_id {kind}, n_words long, n_base long, first_word long, last_word long,
    base array<string>, segments array<struct<start: int, ids: array<int>>>"""


def scan(docs: DataFrame, templates: Templates) -> DataFrame:
    """Per row the number of words, the exact places of the phrases, and the segments in which a
    template may lie; texts go no further than this."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = np.unique([g for g, _, _ in templates.grams()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = templates.number.get
        types = pa.struct([("start", pa.int32()), ("ids", pa.list_(pa.int32()))])
        for batch in slices(batches):
            out: dict[str, list] = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base", "segments")}
            for text in batch.column(1).to_pylist():
                words = license_words(text or b"")
                ids = np.fromiter((i or 0 for i in map(number, words)), np.int32, len(words))
                places = [(label, _places(ids, phrase)) for phrase, label in templates.phrases]
                every = np.concatenate([p for _, p in places]) if places else np.zeros(0, np.int64)
                out["n_words"].append(len(words))
                out["n_base"].append(len(every))
                out["first_word"].append(int(every.min()) if len(every) else None)
                out["last_word"].append(int(every.max()) if len(every) else None)
                out["base"].append([label for label, p in places if len(p)])
                grams = _rolling(ids.astype(np.int64), templates.base)
                live = np.flatnonzero(grams >= 0)
                live = live[np.isin(grams[live], found)]
                out["segments"].append(_segments(ids, live, templates.reach))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(types)]
            arrays = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *out])

    return rows.mapInArrow(run, _SCANNED.format(kind=kind))


def diagonals(segments: DataFrame, templates: Templates) -> DataFrame:
    """(row, start, template, low, high, first, last): spans of document positions whose k-grams lie
    on neighbouring diagonals of a template, and the first and last of these diagonals."""
    spark = segments.sparkSession
    at = F.explode(F.sequence(F.lit(0), F.size("ids") - K))
    places = segments.where(F.size("ids") >= K).select("row", "start", "ids", at.alias("at"))
    gram = F.lit(0).cast("long")
    for j in range(K):
        gram = gram * templates.base + F.element_at("ids", F.col("at") + 1 + j)
    positions = spark.createDataFrame(templates.grams(), "gram long, template int, position int")
    votes = places.select("row", "start", (F.col("start") + F.col("at")).alias("word"), gram.alias("gram")).join(F.broadcast(positions), "gram")
    votes = votes.groupBy("row", "start", "template", (F.col("word") - F.col("position")).alias("diagonal")).agg(
        F.min("word").alias("low"), F.max("word").alias("high")
    )
    sizes = spark.createDataFrame(list(enumerate(templates.slack)), "template int, slack int")
    ordered = Window.partitionBy("row", "start", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(ordered) > F.col("slack")
    spans = votes.join(F.broadcast(sizes), "template").withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    spans = spans.withColumn("span", F.sum("new").over(ordered))
    return spans.groupBy("row", "start", "template", "span").agg(
        F.min("low").alias("low"), (F.max("high") + K).alias("high"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last")
    )


def common_words(a: list[int], b: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence, and of the shortest head of ``b`` that has it."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1], row.index(row[-1])


def placed(words: list[int], window: list[int]) -> tuple[int, int, int] | None:
    """Matched words and the borders of their place in ``window``; nothing if they are too few."""
    need = COVERAGE * len(words)
    if sum((Counter(words) & Counter(window)).values()) < need:
        return None
    matched, end = common_words(words, window)
    if matched < need:
        return None
    _, size = common_words(words[::-1], window[:end][::-1])
    return matched, end - size, end


def verify(spans: DataFrame, segments: DataFrame, templates: Templates) -> DataFrame:
    """(row, label, score): the label and covered share of each span that holds, one per place."""
    per_segment = spans.groupBy("row", "start").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans"))
    together = segments.join(per_segment, ["row", "start"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, start, ids, found in zip(pdf["row"], pdf["start"], pdf["ids"], pdf["spans"], strict=True):
                held = []
                for span in found:
                    t = span["template"]
                    words, slack = templates.words[t], templates.slack[t]
                    origin = max(0, span["first"] - slack - start)
                    place = placed(words, [int(i) for i in ids[origin : max(0, span["last"] + len(words) + slack - start)]])
                    if place:
                        matched, low, high = place
                        held.append((matched, matched / len(words), start + origin + low, start + origin + high, templates.labels[t]))
                held.sort(key=lambda h: (-h[0], -h[1], h[2], h[4]))
                taken: list[tuple[int, int]] = []
                for _, score, low, high, label in held:
                    if all(high <= a or low >= b for a, b in taken):
                        taken.append((low, high))
                        out.append((row, label, score))
            yield pd.DataFrame(out, columns=["row", "label", "score"])

    return together.mapInPandas(run, "row long, label string, score double")


def scan_licenses(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    ``score`` is the best covered share of a template, 1 where a phrase stands, 0 without either.
    Null and empty texts have no words and empty labels. Rows are told apart by a number of
    their own, so repeated or null ids repeat their results. Ties between overlapping spans go
    to the fuller, earlier and alphabetically first. An empty table gives an empty one; other
    columns are ignored.
    """
    templates = templates or Templates(TEMPLATES, PHRASES)
    scanned = scan(docs, templates).withColumn("row", F.monotonically_increasing_id())
    scanned = materialize(scanned, "license-scan")
    segments = scanned.select("row", F.inline("segments"))
    held = verify(diagonals(segments, templates), segments, templates)
    voted = held.groupBy("row").agg(F.collect_set("label").alias("voted"), F.max("score").alias("best"))
    joined = scanned.drop("segments").join(voted, "row", "left")
    none = F.array().cast("array<string>")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("voted", none))).alias("labels"),
        score.alias("score"),
    )
