"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary of byte strings.
The probability of a word (a lower-cased run of letters after a space) is the sum over all ways
to cut it into pieces, worked out for all languages together by a forward pass; a text's is the
product over its words. Piece probabilities are fitted by expectation maximisation: a forward
and a backward pass over the counted words of a bounded sample give the expected uses of each
piece, which Spark sums by language and piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molspark.llm.common import slices, worker_memory
from molspark.session import materialize

#: Labelled rows per language that the model is fitted on, as expected number of a hash sample.
FIT_ROWS = 500
MAX_LANGUAGES = 256
#: Expectation maximisation starts from even probabilities and ends with the first round in which
#: the log probability of the counted words of no language grows by this share of it.
ENOUGH = 1e-3
#: Probability mass that each language spreads evenly over the vocabulary.
FLOOR = 1e-3
#: Letters of a piece at most; longer tokens of the vocabulary are left out.
LONGEST = 16
#: Bytes after which the forward pass rescales its sums.
RESCALE = 8
#: Words whose scores a worker remembers; a full memory loses its newer half.
REMEMBERED_WORDS = 300_000
UNDETERMINED = "und"

#: Runs of more letters are cut every 64, so that a text without spaces stays in bounds.
_RUNS = re.compile(r"[^\W\d_]{1,64}")


def words(text: str) -> list[str]:
    """Lower-cased runs of word characters without digits."""
    return _RUNS.findall(text.lower())


def piece_vocabulary(ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces in order of rank: tokens of up to ``LONGEST`` bytes, all single bytes among
    them, so that every word has a segmentation."""
    pieces = sorted((t for t in ranks if len(t) <= LONGEST), key=ranks.__getitem__)
    return pieces + [bytes([b]) for b in range(256) if bytes([b]) not in ranks]


def _table(group: list[bytes], ids: dict[bytes, int], longest: int, none: int) -> np.ndarray:
    """Pieces of words of equal length by (end, size, word); ``none`` where there is no piece."""
    n = len(group[0])
    table = np.full((n + 1, min(n, longest) + 1, len(group)), none, np.int32)
    for end in range(1, n + 1):
        for size in range(1, min(end, longest) + 1):
            table[end, size] = [ids.get(w[end - size : end], none) for w in group]
    return table


@dataclass
class Model:
    languages: list[str]
    pieces: list[bytes]
    probabilities: np.ndarray  # languages by pieces, and a column of zeros for no piece
    ids: dict[bytes, int] = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))

    def _forward(self, table: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of each word, by language. Sums up to each end
        are rescaled together now and then, so long words do not underflow."""
        ends, _, n = table.shape
        sums = np.zeros((ends, n, len(self.languages)))
        sums[0] = 1.0
        logs = np.zeros((n, len(self.languages)))
        for end in range(1, ends):
            for size in range(1, min(end, self.longest) + 1):
                pieces = table[end, size]
                if (pieces != len(self.pieces)).any():
                    sums[end] += sums[end - size] * self.probabilities[:, pieces].T
            if end % RESCALE == 0:
                divisor = sums[end].copy()
                logs += np.log(divisor)
                sums[max(0, end - self.longest) : end + 1] /= divisor
        return np.log(sums[-1]) + logs

    def log_probabilities(self, found: list[bytes]) -> np.ndarray:
        """Natural log of the summed probability of each word, by language."""
        out = np.zeros((len(found), len(self.languages)))
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(found):
            by_size.setdefault(len(w), []).append(i)
        for size, at in by_size.items():
            step = max(1, 400_000 // (size * (len(self.languages) + 1) + 1))
            for start in range(0, len(at), step):
                part = at[start : start + step]
                out[part] = self._forward(_table([found[i] for i in part], self.ids, self.longest, len(self.pieces)))
        return out

    def expected(self, found: list[bytes], counts: np.ndarray, language: int) -> np.ndarray:
        """Expected uses of each piece in the counted words under one language."""
        return self.counted(found, counts, language)[0]

    def counted(self, found: list[bytes], counts: np.ndarray, language: int) -> tuple[np.ndarray, float]:
        """Expected uses, and the log probability of the counted words. Words of any length take
        part: both passes rescale their sums."""
        uses, logs = np.zeros(len(self.pieces) + 1), 0.0
        p = self.probabilities[language]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(found):
            by_size.setdefault(len(w), []).append(i)
        for size, at in by_size.items():
            step = max(1, 400_000 // (size * min(size, self.longest) + 1))
            for start in range(0, len(at), step):
                part = at[start : start + step]
                table = _table([found[i] for i in part], self.ids, self.longest, len(self.pieces))
                logs += self._count(table, p, counts[part], uses)
        return uses[:-1], logs

    def _count(self, table: np.ndarray, p: np.ndarray, counts: np.ndarray, uses: np.ndarray) -> float:
        """Adds the expected uses in words of equal length to ``uses``; returns their log probability.
        Each end has a divisor of its own, the same in both passes."""
        ends, _, n = table.shape
        forward, backward, divisors = np.zeros((ends, n)), np.zeros((ends, n)), np.ones((ends, n))
        forward[0] = 1.0
        weights = p[table]
        for end in range(1, ends):
            carried = np.ones(n)  # divisors of the ends that a piece passes
            for size in range(1, min(end, self.longest) + 1):
                forward[end] += forward[end - size] / carried * weights[end, size]
                carried = carried * divisors[end - size]
            reached = forward[end] > 0.0
            divisors[end, reached] = forward[end, reached]
            forward[end] = reached
        backward[-1] = forward[-1]  # a word that no pieces make up has no uses
        for end in range(ends - 1, 0, -1):
            carried = divisors[end].copy()
            for size in range(1, min(end, self.longest) + 1):
                share = weights[end, size] / carried * backward[end]
                backward[end - size] += share
                np.add.at(uses, table[end, size], counts * share * forward[end - size])
                carried = carried * divisors[end - size]
        return float((counts * forward[-1] * np.log(divisors).sum(0)).sum())


def _spaced(word: str) -> bytes:
    return (" " + word).encode("utf-8", "surrogatepass")


def _sample(docs: DataFrame) -> DataFrame:
    """About ``FIT_ROWS`` rows of every language, by a hash of the id."""
    counted = docs.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counted:
        return docs
    rate = F.lit(1.0)
    for row in counted:
        rate = F.when(F.col("lang") == row["lang"], F.lit(min(1.0, FIT_ROWS / row["count"]))).otherwise(rate)
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) < rate * (1 << 20))


def _word_counts(sample: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in words(text or ""):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    return sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, pieces: list[bytes]) -> Model:
    """Fit on rows (doc_id, text, lang); rows without a language must be left out by the caller.

    All words of the sample take part, whatever their length. Per round Spark sums expected uses by
    (language, piece), and log probabilities by language (piece -1); at most one number for each
    of ``MAX_LANGUAGES`` languages and each piece of the fixed vocabulary comes to the driver."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(_word_counts(_sample(docs)).repartition(tasks, "lang", "word"), "langid-words")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    size = len(pieces)
    model = Model(languages, pieces, np.hstack([np.full((len(languages), size), 1.0 / size), np.zeros((len(languages), 1))]))
    last = np.full(len(languages), -np.inf)
    while languages:
        shared = spark.sparkContext.broadcast(model)

        def uses(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total: dict[str, np.ndarray] = {}
            logs: dict[str, float] = {}
            now = shared.value
            for pdf in batches:
                for lang, rows in pdf.groupby("lang"):
                    found = [_spaced(w) for w in rows["word"]]
                    part, log = now.counted(found, rows["n"].to_numpy(), now.languages.index(lang))
                    total[lang], logs[lang] = total.get(lang, 0) + part, logs.get(lang, 0.0) + log
            for lang, sums in total.items():
                at = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": lang, "piece": np.append(at, -1).astype(np.int32), "uses": np.append(sums[at], logs[lang])})

        summed = counts.mapInPandas(uses, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        found = summed.toPandas()
        ends = found[found["piece"] < 0].set_index("lang")["uses"].reindex(languages).fillna(0.0).to_numpy()
        found = found[found["piece"] >= 0]
        matrix = np.zeros((len(languages), size + 1))
        matrix[[languages.index(x) for x in found["lang"]], found["piece"].astype(int)] = found["uses"]
        matrix[:, :size] = (1 - FLOOR) * matrix[:, :size] / np.maximum(matrix.sum(1, keepdims=True), 1e-300) + FLOOR / size
        model = Model(languages, pieces, matrix)
        shared.unpersist()
        if (ends - last <= ENOUGH * np.abs(ends)).all():
            break
        last = ends
    return model


class _Scorer:
    """Scores of words with a worker's memory of them; row 0 is what has no letter."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.limit = min(REMEMBERED_WORDS, 8_000_000 // max(1, len(model.languages)))
        self.scores = np.zeros((1, len(model.languages)))

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the log probabilities by language and the number of words with a letter."""
        lists = [words(t) for t in texts]
        flat = [w for ws in lists for w in ws]
        distinct = set(flat)
        new = distinct - self.rows.keys()
        if len(self.rows) + len(new) > self.limit:
            kept = dict(list(self.rows.items())[: self.limit // 2])
            self.scores = self.scores[: 1 + max(kept.values(), default=0)]
            self.rows = kept
            new = distinct - self.rows.keys()
        fresh = [w for w in new if any(map(str.isalpha, w))]
        self.rows.update(dict.fromkeys(new, 0))
        self.rows.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh)), strict=True))
        self.scores = np.vstack([self.scores, self.model.log_probabilities([_spaced(w) for w in fresh])])
        at = np.fromiter(map(self.rows.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in lists])
        sums = np.zeros((len(texts), self.scores.shape[1]))
        for k in range(sums.shape[1]):
            sums[:, k] = np.bincount(owner, self.scores[at, k], len(texts))
        return sums, np.bincount(owner, at > 0, len(texts))


def predict(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Append ``lang_pred`` and ``score``, the winner's share of the probability of the whole
    text under even priors; of equal languages the first by name wins.

    A text that is null, empty or without a letter, and any text under a model without
    languages, is ``und`` with score 0. Columns with these names are replaced, others kept;
    rows are neither shuffled nor dropped, so repeated rows repeat and an empty table stays so.
    The model is broadcast: its size is bounded by ``MAX_LANGUAGES`` and the vocabulary.
    """
    rows = docs.drop(lang_pred, score)
    at = rows.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    stamp = hash((model.probabilities.tobytes(), tuple(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_memory(("langid", stamp), lambda: _Scorer(shared.value))
        names = np.array([*shared.value.languages, UNDETERMINED], object)
        for batch in slices(batches):
            sums, letters = scorer.totals([t or "" for t in batch.column(at).to_pylist()])
            if sums.shape[1] == 0:
                best, share = np.zeros(len(letters), int), np.zeros(len(letters))
            else:
                best = sums.argmax(1)
                share = 1.0 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            best = np.where(letters > 0, best, len(names) - 1)
            share = np.where(letters > 0, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(share, pa.float64())], [*batch.schema.names, lang_pred, score]
            )

    schema = T.StructType(list(rows.schema.fields)).add(lang_pred, "string").add(score, "double")
    return rows.mapInArrow(run, schema)
