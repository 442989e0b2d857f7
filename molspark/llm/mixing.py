"""Mixing documents to target domain weights with soft membership.

A classifier trained on a labelled table gives each document a posterior over domains:
multinomial logistic regression over the presence of hashed words, restricted to the features
whose share differs most clearly between the domains. Nonnegative rates per document are then fitted
by projected-gradient least squares so that the expected tokens of each domain, rate times tokens
times posterior, reach the targets, with a small pull of all rates towards one. Documents whose
likeliest domain is to be kept have rates of one at least: that is their bound in the fit.

Posteriors are whole numbers of 1/1024, so a rate is a function of few values: documents of equal
posteriors are added up to one cell, and every gradient step is one aggregation over the cells that
brings a number per domain to the driver. A task follows a cell's rate through the steps so far, so
no state is kept between them. At the solution a rate is one projected step from one, along the
posterior and the residuals of the domains, relative to a domain's own tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molspark.llm import license_scan
from molspark.llm.common import forget, slices, words_of
from molspark.llm.license_scan import license_words
from molspark.session import materialize

#: Labelled rows that the classifier is fitted on, at most, the first by a hash of the id.
FIT_ROWS = 6_000
#: Hashed features; those that take part, at most; and the deviation from equal shares, in
#: standard errors, that one of them must show.
BUCKETS, CHOSEN, CLEAR = 1 << 18, 1024, 4.0
#: Gradient steps of the regression, their length, and the weight of the squared coefficients.
FITTING_STEPS, FITTING_LENGTH, SHRINK = 400, 0.05, 2e-4
#: Posteriors are rounded to this many parts.
PARTS = 1024
#: Pull of rates towards one against the squared relative residuals, which is also how far a domain's
#: tokens may stay from their target, as a share of its own; the change of a rate below which the steps
#: end; and steps at most, some three times as many as the pull allows for that change.
PULL, ENOUGH, STEPS = 1e-2, 1e-5, 400
#: Tokens of the mix beyond what gives every wanted domain a mean rate of one.
MARGIN = 1.02

#: Words that a task of the fit remembers the features of; its memory ends with it.
REMEMBERED = 1 << 16
#: Bytes of texts whose distinct words are looked up together; larger sets leave the processor's caches.
READ_BYTES = 128 << 10
#: Odd factor that turns a word's hash into that of a part.
_TURN = 0x9E3779B97F4A7C15
#: The bytes of ``license_words``, with line breaks left as they are.
_PART_BYTES = bytes(b if b == 10 else license_scan.WORD_BYTES[b] for b in range(256))


class _Remembered(dict):
    """Results of a function of one word, remembered by a task."""

    def __init__(self, make: Callable[[bytes], tuple[int, ...]]):
        self.make = make

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.make(word)
        if len(word) <= 64:
            self[word] = found
        return found


def _marks(word: bytes) -> tuple[int, ...]:
    """Buckets of a word, as it stands and of its parts without punctuation. A word is hashed once for
    both; the second kind is the first turned by a fixed rule."""
    whole = xxhash.xxh3_64_intdigest(word)
    parts = ((xxhash.xxh3_64_intdigest(part) * _TURN >> 20) % BUCKETS for part in license_words(word))
    return (whole % BUCKETS, *parts)


def _measures(raw: list[bytes], distinct: set[bytes]) -> tuple[bytes, bytes]:
    """Names of the steps of two measures, of repetition and of length."""
    return b"ratio %d" % (10 * len(distinct) // max(1, len(raw))), b"length %d" % len(raw).bit_length()


def features(text: bytes, marks: _Remembered | None = None) -> np.ndarray:
    """Buckets of the distinct words with and without punctuation, and of two measures of
    repetition and length."""
    marks = _Remembered(_marks) if marks is None else marks
    raw = words_of(text)
    distinct, found = set(raw), set()
    for word in distinct:
        found.update(marks[word])
    found.update(_marks(name)[0] for name in _measures(raw, distinct))
    return np.array(sorted(found), np.int64)


@dataclass
class Classifier:
    domains: list[str]
    bias: np.ndarray  # by domain
    slot: np.ndarray  # row in ``weights`` by bucket, -1 for features that take no part
    weights: np.ndarray  # by row and domain

    def read(self, texts: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """Numbers of words and posteriors of texts. Each distinct word of them all is hashed once, and
        only words with rows, which are few, are looked up text by text; nothing is remembered."""
        raws = [words_of(text) for text in texts]
        sets = [set(raw) for raw in raws]
        rows_of = _chosen_rows(set().union(*sets), self.slot)
        known, out = set(rows_of), []
        for raw, distinct in zip(raws, sets, strict=True):
            rows: set[int] = set()
            for word in distinct & known:
                rows.update(rows_of[word])
            rows.update(row for name in _measures(raw, distinct) if (row := int(self.slot[_marks(name)[0]])) >= 0)
            logs = self.bias + self.weights[sorted(rows)].sum(0)
            shares = np.exp(logs - logs.max())
            out.append((len(raw), np.rint(PARTS * shares / shares.sum()) / PARTS))
        return out

    def posterior(self, text: bytes) -> np.ndarray:
        return self.read([text])[0][1]


def _chosen_rows(distinct: set[bytes], slot: np.ndarray) -> dict[bytes, list[int]]:
    """The rows of the words that have any, by the rules of ``_marks``. The parts of all words are taken
    in one step, since no word holds a line break; a word that is its own only part is hashed once."""
    words = list(distinct)
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    split = b"\n".join(words).translate(_PART_BYTES).split(b"\n")
    odd = [at for at, (word, parts) in enumerate(zip(words, split, strict=False)) if word != parts]
    own = np.ones(len(words), bool)
    own[odd] = False
    lists = [split[at].split() for at in odd]
    flat = [part for parts in lists for part in parts]
    part = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
    owner = np.repeat(np.array(odd, np.int64), [len(parts) for parts in lists])
    owners = np.concatenate([np.arange(len(words)), np.flatnonzero(own), owner])
    turned = np.concatenate([whole[own], part]) * np.uint64(_TURN) >> np.uint64(20)
    rows = slot[(np.concatenate([whole, turned]) % np.uint64(BUCKETS)).astype(np.int64)]
    found: dict[bytes, list[int]] = {}
    for at in np.flatnonzero(rows >= 0).tolist():
        found.setdefault(words[owners[at]], []).append(int(rows[at]))
    return found


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> Classifier:
    """From rows (doc_id, text) and labels (doc_id, domain). Ids that occur several times among
    the labels take the last domain in the order of ``domains``; null ids, unknown domains and
    labels without a document are left out. The sample is limited before it is broadcast, and of
    its rows only the chosen features come to the driver."""
    order = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")).cast("int") - 1
    told = labelled.where(F.col("doc_id").isNotNull()).select("doc_id", order.alias("label")).where("label >= 0")
    told = told.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id").select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number = np.zeros((BUCKETS, len(domains)), np.int32), np.zeros(len(domains), np.int64)
        marks = _Remembered(_marks)
        for batch in slices(batches):
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[features(text or b"", marks), label] += 1
                number[label] += 1
        bucket, label = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([bucket, np.full(len(domains), -1)]), pa.int32()),
                pa.array(np.concatenate([label, np.arange(len(domains))]), pa.int32()),
                pa.array(np.concatenate([seen[bucket, label], number]), pa.int64()),
            ],
            ["bucket", "label", "n"],
        )

    summed = rows.mapInArrow(count, "bucket int, label int, n long").groupBy("bucket", "label").agg(F.sum("n").alias("n"))
    per_bucket = summed.groupBy("bucket").agg(F.collect_list(F.struct("label", "n")).alias("counts")).where(F.size("counts") > 0)
    seen, number = np.zeros((BUCKETS, len(domains))), np.zeros(len(domains))
    for row in per_bucket.toLocalIterator():
        for label, n in row["counts"]:
            if row["bucket"] < 0:
                number[label] = n
            else:
                seen[row["bucket"], label] = n
    everyone = seen.sum(1, keepdims=True) / max(1.0, number.sum())
    error = np.sqrt(np.maximum(everyone * (1 - everyone), 1e-9) * np.maximum(number, 1.0))
    deviation = (np.abs(seen - everyone * number) / error).max(1)
    chosen = np.argsort(-deviation, kind="stable")[:CHOSEN]
    chosen = chosen[deviation[chosen] >= CLEAR]
    slot = np.full(BUCKETS, -1, np.int64)
    slot[chosen] = np.arange(len(chosen))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Remembered(_marks)
        for batch in slices(batches):
            found = [slot[features(t or b"", marks)] for t in batch.column(1).to_pylist()]
            lists = pa.array([r[r >= 0].astype(np.int32) for r in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["label", "present"])

    fitted = rows.mapInArrow(keep, "label int, present array<int>").collect()
    x = np.zeros((len(fitted), len(chosen)), np.float32)
    for i, row in enumerate(fitted):
        x[i, row["present"]] = 1
    bias, weights = _regress(x, np.array([row["label"] for row in fitted], np.int64), np.log((number + 1) / (number.sum() + len(domains))))
    return Classifier(list(domains), bias, slot, weights)


def _regress(x: np.ndarray, labels: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by gradient steps with running scales, from log shares."""
    bias, weights = bias.copy(), np.zeros((x.shape[1], len(bias)))
    truth = np.eye(len(bias))[labels]
    mean = [np.zeros_like(weights), np.zeros_like(bias)]
    square = [np.zeros_like(weights), np.zeros_like(bias)]
    for step in range(1, FITTING_STEPS + 1 if len(x) else 1):
        logits = x @ weights.astype(np.float32) + bias
        shares = np.exp(logits - logits.max(1, keepdims=True))
        miss = (shares / shares.sum(1, keepdims=True) - truth) / len(x)
        for k, (value, slope) in enumerate(((weights, x.T @ miss.astype(np.float32) + SHRINK * weights), (bias, miss.sum(0)))):
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope**2
            value -= FITTING_LENGTH * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return bias, weights


@dataclass
class Mix:
    classifier: Classifier
    residual: np.ndarray  # by domain, what the rates leave, relative to the domain's own tokens
    kept: np.ndarray  # by domain, whether its documents stay at least once
    change: float = 0.0  # of any rate in the last step, at most

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        return np.maximum(least_rates(posteriors, self.kept), 1.0 - posteriors @ self.residual / PULL)


def least_rates(posteriors: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """One for rows whose likeliest domain, the first of equal ones, is kept; else zero."""
    return kept[posteriors.argmax(1)].astype(float) if len(posteriors) else np.zeros(0)


def stepped(posteriors: np.ndarray, least: np.ndarray, pulls: list[np.ndarray]) -> np.ndarray:
    """Extrapolated rates after the steps so far, from one. Each step goes along the posterior and the
    pull towards one and is projected to the least rates; then the last change is carried on by the
    share that suits the curvature."""
    carry = (1 - np.sqrt(PULL / (1 + PULL))) / (1 + np.sqrt(PULL / (1 + PULL)))
    ahead = before = np.ones(len(posteriors))
    for pull in pulls:
        rates = np.maximum(least, ahead - (posteriors @ pull + PULL * (ahead - 1.0)) / (1.0 + PULL))
        ahead, before = rates + carry * (rates - before), rates
    return ahead


def solve(sums: Callable[[list[np.ndarray]], np.ndarray], own: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """The relative residuals of the least-squares rates, by accelerated projected-gradient steps, and
    how far the last step still changed a rate. ``sums`` gives the tokens by domain of the rates after
    steps along given pulls. Domains without tokens have no residual."""
    pulls: list[np.ndarray] = []
    scale, change = np.where(own > 0, own, 1.0), np.inf
    while len(pulls) < STEPS and change > ENOUGH:
        residual = np.where(own > 0, (sums(pulls) - target) / scale, 0.0)
        if pulls:
            change = float(np.abs(residual - pulls[-1]).max() / PULL)
        pulls.append(residual)
    return pulls[-1], change


def with_posteriors(docs: DataFrame, classifier: Classifier, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_tokens and posteriors (one number per domain); a null text counts as empty."""
    new = [prefix + "n_tokens", prefix + "posteriors"]
    rows = docs.drop(*new)
    at = rows.columns.index(text)
    schema = T.StructType(list(rows.schema.fields)).add(new[0], "long").add(new[1], T.ArrayType(T.DoubleType()))
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, READ_BYTES):
            found = shared.value.read([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()])
            counts, lists = zip(*found, strict=True)
            arrays = [pa.array(counts, pa.int64()), pa.array([v.tolist() for v in lists], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *new])

    return rows.mapInArrow(run, schema)


def fit_rates(scored: DataFrame, classifier: Classifier | None, targets: dict[str, float], keep: bool = False, prefix: str = "") -> Mix:
    """Fit rates to target shares of tokens by domain, from rows with n_tokens and posteriors.

    The mix is as large as needed to give every domain with a positive target a mean rate of at
    least one, so wanted documents are repeated rather than dropped; domains with target 0 go
    towards rate 0. With ``keep`` every document whose likeliest domain has a positive target stays
    at least once. Every step brings one number per domain to the driver."""
    share = np.array(list(targets.values())) / sum(targets.values())
    k, kept = len(share), (share > 0) & keep
    names = [F.col(prefix + "posteriors")[i].alias(f"p{i}") for i in range(k)]
    cells = scored.select(F.col(prefix + "n_tokens").alias("n"), *names).groupBy(*(f"p{i}" for i in range(k))).agg(F.sum("n").alias("n"))
    cells = materialize(cells.where("n > 0"), "mixing-cells")

    def sums(pulls: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                posteriors = np.column_stack([batch.column(i).to_numpy() for i in range(k)])
                rates = stepped(posteriors, least_rates(posteriors, kept), pulls)
                total = (batch.column(k).to_numpy() * rates) @ posteriors
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"s{i}" for i in range(k)])

        parts = cells.mapInArrow(run, ", ".join(f"s{i} double" for i in range(k)))
        return np.array([x or 0.0 for x in parts.agg(*(F.sum(f"s{i}") for i in range(k))).first()])

    own = sums([])
    if own.sum() <= 0:
        return Mix(classifier, np.zeros(k), kept)
    wanted = share > 0
    size = MARGIN * (own[wanted] / share[wanted]).max()
    residual, change = solve(sums, own, size * share)
    return Mix(classifier, residual, kept, change)


def with_rates(scored: DataFrame, mix: Mix, doc_id: str = "doc_id", prefix: str = "") -> DataFrame:
    """Rows of ``with_posteriors`` with domain (the likeliest, the first named of equal ones),
    posterior (its probability), rate and copies in place of the posteriors; expressions only."""
    posteriors = F.col(prefix + "posteriors")
    likely = F.array_max(posteriors)
    at = F.array_position(posteriors, likely).cast("int")
    along = F.zip_with(posteriors, F.array(*map(F.lit, mix.residual.tolist())), lambda p, y: p * y)
    free = 1.0 - F.aggregate(along, F.lit(0.0), lambda total, x: total + x) / PULL
    least = F.element_at(F.array(*(F.lit(float(x)) for x in mix.kept)), at)
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.lit("mixing")), F.lit(1 << 20)) / float(1 << 20)
    found = scored.withColumns({
        prefix + "domain": F.element_at(F.array(*map(F.lit, mix.classifier.domains)), at),
        prefix + "posterior": likely,
        prefix + "rate": F.greatest(least, free),
    })
    return found.withColumn(prefix + "copies", F.floor(F.col(prefix + "rate") + draw).cast("long")).drop(prefix + "posteriors")


_NEW = ("n_tokens", "domain", "posterior", "rate", "copies")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: bool = False, prefix: str = "") -> DataFrame:
    """Append n_tokens, domain, posterior, rate and copies to all rows of ``docs`` (doc_id, text, ...).

    ``copies`` rounds the rate up or down by a hash of the id, so its expectation is the rate, and a
    rate of one or more gives a copy at least. Null and empty texts have no tokens and the posterior of
    an empty text. Columns with the new names are replaced, all others kept; rows are not dropped,
    repeated rows repeat, and an empty table stays so. Texts are read once for classifier and rates:
    the rows with their posteriors are written, and both the fit and the result read that table."""
    if not targets or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets must be shares of domains")
    rows = docs.drop(*(prefix + name for name in (*_NEW, "posteriors")))
    classifier = fit_classifier(rows.select("doc_id", "text"), labelled, list(targets))
    scored = materialize(with_posteriors(rows, classifier, prefix=prefix), "mixing-posteriors")
    return with_rates(scored, fit_rates(scored, classifier, targets, keep, prefix), prefix=prefix)


def repeated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: bool = True) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies, with its own columns. With ``keep``
    a row whose likeliest domain has a positive target appears at least once."""
    drawn = mixed(docs, labelled, targets, keep, prefix="__mix_").where("__mix_copies > 0")
    return drawn.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), "__mix_copies")).alias("__mix_copy")).drop("__mix_copy")


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else low or good by quality; rows without
    both labels are left out."""
    domain: Column = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())


#: Shares of the mix's tokens by domain of the labels table.
TARGETS = {"good": 0.88, "low": 0.12, "toxic": 0.0}
