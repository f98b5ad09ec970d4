"""Mixing to target weights, with soft membership in domains.

A classifier learned from a labelled table gives every document a probability
for each domain. Nonnegative rates are then fitted by projected gradient steps,
so that the expected tokens of each domain, the sum of rate x tokens x
probability, come to their target. A step moves the rate of a document by its
probabilities times one vector that all documents share, so the fit keeps no
rates: each iteration is one aggregate of a few numbers over a narrow table, and
the rate of any document follows from its probabilities and the steps taken.

Defined results: null and empty texts have no words, one token, and the
probabilities of a text without features. Repeated rows get equal rates. Labels
that are null, or whose document is missing, are not learned from; without any
label all documents are of one domain and keep the rate that its target asks.
An empty table gives an empty result. Columns are carried along as they are.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.llm.arrays import Slice, byte_class, mix, texts_in
from treelens.operators.workspace import written

# Letters, digits and all bytes beyond ASCII make words; the rest separates them.
NO_WORD = byte_class(bytes([*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]))
CAPITAL = byte_class(bytes(range(65, 91)))
MARK = byte_class(b"!#$%&*<>|=~^@")


@dataclass(frozen=True)
class MixRules:
    """Target of each domain as a multiple of its expected tokens; sample and model size; steps.

    The fit ends where all totals are within `tolerance` of their targets, as a
    share of the domain's tokens, and warns if it cannot get there. Rates within
    `snap` of one count as one where documents are drawn.
    """

    targets: dict[str, float] = field(default_factory=lambda: {"good": 1.0, "plain": 0.5, "toxic": 0.05})
    sample: int = 8000
    features_per_text: int = 4096
    bucket_bits: int = 18
    min_texts: int = 5
    features_per_domain: int = 200
    min_score: float = 10.0
    epochs: int = 200
    decay: float = 1e-4
    steps: int = 60
    tolerance: float = 1e-4
    snap: float = 1e-3


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain that the two labels of a document make."""
    known = quality.isNotNull() & toxic.isNotNull()
    kind = F.when(toxic == 1, "toxic").when(quality == 1, "good").otherwise("plain")
    return F.when(known, kind)


# ---- features ----


def features(part: Slice, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text in a row, the text of each, and the words of each text."""
    lower = Slice(part.data, part.starts, lower=True)
    words = lower.words(NO_WORD)
    n_words = np.bincount(words.text, minlength=part.count)
    mask = np.uint64((1 << bits) - 1)
    bucket = (lower.hashes(words) & mask).astype(np.int64)
    sizes = np.maximum(np.diff(part.starts), 1)
    shares = [part.per_text(CAPITAL[part.data]) / sizes, part.per_text(MARK[part.data]) / sizes]
    # How marked, how loud and how repetitive a text is, in rough steps.
    pairs = np.unique((words.text << bits) | bucket)
    distinct = np.bincount(pairs >> bits, minlength=part.count) / np.maximum(n_words, 1)
    shares.append(distinct)
    extra = []
    for k, share in enumerate(shares):
        step = np.minimum(np.floor(share * 20), 20).astype(np.uint64)
        extra.append((mix(step + np.uint64(1000 * (k + 1))) & mask).astype(np.int64))
    own = np.concatenate([(np.arange(part.count) << bits) | e for e in extra])
    pairs = np.unique(np.concatenate([pairs, own]))
    return pairs & ((1 << bits) - 1), pairs >> bits, n_words


# ---- the classifier, fitted on the driver to a bounded sample ----


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    bits: int

    def probabilities(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and number of words of each text."""
        bucket, text, n_words = features(part, self.bits)
        logits = np.tile(self.bias, (part.count, 1))
        starts = np.searchsorted(text, np.arange(part.count))
        # Every text has features, so no sum is over an empty range.
        if part.count:
            logits += np.add.reduceat(self.weights[bucket], starts, axis=0)
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), n_words


def labelled_sample(documents: DataFrame, labels: DataFrame, rules: MixRules) -> list[tuple[str, bytes]]:
    """At most about `sample` labelled texts as buckets, chosen by a hash of their ids."""
    known = labels.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "domain")
    total = known.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = known.where(place < int(1_000_000 * min(1.0, rules.sample / max(total, 1))) + 1)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(chosen, "doc_id").select("doc_id", "domain", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in texts_in(batch.column(2)):
                bucket, text, _ = features(part, rules.bucket_bits)
                bounds = np.searchsorted(text, np.arange(part.count + 1))
                coded = []
                for k in range(part.count):
                    own = bucket[bounds[k] : bounds[k + 1]]
                    if len(own) > rules.features_per_text:
                        own = own[np.argsort(mix(own.astype(np.uint64)))[: rules.features_per_text]]
                    coded.append(own.astype("<u4").tobytes())
                head = [c.slice(first, last - first) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*head, pa.array(coded, pa.binary())], ["doc_id", "domain", "buckets"])

    found = rows.mapInArrow(run, "doc_id long, domain string, buckets binary").collect()
    return [(r.domain, bytes(r.buckets)) for r in sorted(found, key=lambda r: (r.doc_id, r.domain, bytes(r.buckets)))]


def telling(column: np.ndarray, row: np.ndarray, y: np.ndarray, k: int, rules: MixRules) -> np.ndarray:
    """The buckets whose presence tells most about each domain, by the chi-square statistic."""
    size, n = 1 << rules.bucket_bits, len(y)
    texts = np.bincount(column, minlength=size).astype(float)
    chosen = [np.zeros(0, np.int64)]
    for j in range(k):
        inside = (y == j).sum()
        seen = np.bincount(column, (y[row] == j).astype(float), size)
        spread = np.maximum(texts * (n - texts) * inside * (n - inside), 1.0)
        score = np.where(texts >= rules.min_texts, (seen * n - texts * inside) ** 2 * n / spread, 0.0)
        best = np.argsort(-score, kind="stable")[: rules.features_per_domain]
        chosen.append(best[score[best] > rules.min_score])
    return np.unique(np.concatenate(chosen))


def fit(sample: list[tuple[str, bytes]], rules: MixRules) -> Classifier:
    """Softmax regression over the telling buckets, by Adam over the whole sample."""
    domains = sorted({d for d, _ in sample}) or sorted(rules.targets)[:1]
    size, k = 1 << rules.bucket_bits, len(domains)
    weights, bias = np.zeros((size, k), np.float32), np.zeros(k)
    if k > 1:
        buckets = [np.frombuffer(b, "<u4").astype(np.int64) for _, b in sample]
        column = np.concatenate(buckets)
        row = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
        y = np.searchsorted(domains, [d for d, _ in sample])
        used = telling(column, row, y, k, rules)
        keep = np.isin(column, used)
        column, row = np.searchsorted(used, column[keep]), row[keep]
        truth = np.eye(k)[y]
        bias = np.log(np.bincount(y, minlength=k) / len(y))
        w = np.zeros((len(used), k))
        state = [np.zeros_like(w), np.zeros_like(w)]
        for step in range(1, rules.epochs + 1):
            logits = bias + np.stack([np.bincount(row, w[column, j], len(y)) for j in range(k)], 1)
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - truth) / len(y)
            grad = np.stack([np.bincount(column, error[row, j], len(used)) for j in range(k)], 1) + rules.decay * w
            state[0] += 0.1 * (grad - state[0])
            state[1] += 0.01 * (grad * grad - state[1])
            scale = (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
            w -= 0.05 * scale * state[0] / (np.sqrt(state[1]) + 1e-9)
            bias -= 0.05 * error.sum(0)
        weights[used] = w
    return Classifier(domains, weights, bias, rules.bucket_bits)


# ---- rates ----


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after all steps, from the probabilities of the documents."""
    rate = np.ones(len(p))
    for step in steps:
        rate = np.maximum(0.0, rate - p @ step)
    return rate


def posteriors(documents: DataFrame, model: Classifier) -> DataFrame:
    """`doc_id`, `n_tokens` and `p` of every document; its words and an end mark are its tokens."""
    send = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in texts_in(batch.column(1)):
                p, n_words = send.value.probabilities(part)
                arrays = [
                    batch.column(0).slice(first, last - first),
                    pa.array(n_words.astype(np.int64) + 1),
                    pa.array(list(p), pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "p"])

    return source.mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sums(table: DataFrame, width: int, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain after `steps`, and the matrix of n p p' over documents with a rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, moment = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            p, n = matrix(batch.column(1), width), batch.column(0).to_numpy().astype(float)
            rate = rates(p, steps)
            total += (n * rate) @ p
            moment += (p * (n * (rate > 0))[:, None]).T @ p
        flat = np.concatenate([total, moment.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    parts = table.select("n_tokens", "p").mapInArrow(run, "i long, v double")
    out = np.zeros(width + width * width)
    for row in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[row.i] = row.v
    return out[:width], out[width:].reshape(width, width)


def fit_rates(table: DataFrame, domains: list[str], rules: MixRules) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps of projected gradient descent; also the targets and what they came to.

    A step is the gradient of the squared distance to the targets, measured in
    the metric in which it would reach them at once if no rate came to zero: the
    moments of the documents that still have one. A step that leads further away
    is taken again in the metric of all documents, in which none does.
    """
    k = len(domains)
    supply, whole = sums(table, k, [])
    wanted = np.array([rules.targets.get(d, 1.0) for d in domains]) * supply
    steps: list[np.ndarray] = []
    now, moment = supply, whole

    def apart(reached: np.ndarray) -> float:
        return float(np.max(np.abs(reached - wanted) / np.maximum(supply, 1.0), initial=0.0))

    while apart(now) > rules.tolerance and len(steps) < rules.steps:
        tried = [*steps, np.linalg.lstsq(moment, now - wanted, rcond=1e-12)[0]]
        after, left = sums(table, k, tried)
        if apart(after) > apart(now):
            tried = [*steps, np.linalg.lstsq(whole, now - wanted, rcond=1e-12)[0]]
            after, left = sums(table, k, tried)
            if apart(after) >= apart(now):
                break
        steps, now, moment = tried, after, left
    if apart(now) > rules.tolerance:
        told = ", ".join(f"{d}: {r:.6g} of {w:.6g}" for d, r, w in zip(domains, now, wanted))
        warnings.warn(f"no rates come to within {rules.tolerance} of the targets; expected tokens are {told}", stacklevel=2)
    return steps, wanted, now


@dataclass
class Mix:
    """What a fit leaves: the classifier and the steps; enough for the rate of any document."""

    model: Classifier
    steps: list[np.ndarray]
    wanted: np.ndarray
    reached: np.ndarray


def fit_mix(documents: DataFrame, labels: DataFrame, rules: MixRules) -> tuple[Mix, DataFrame]:
    """Fit to `documents`; `labels` has `doc_id` and `domain`. Also the table of probabilities."""
    model = fit(labelled_sample(documents, labels, rules), rules)
    table = written(posteriors(documents, model), "posteriors")
    return Mix(model, *fit_rates(table, model.domains, rules)), table


def mixing(documents: DataFrame, labels: DataFrame, rules: MixRules | None = None) -> DataFrame:
    """`doc_id`, `n_tokens`, the likeliest `domain`, its probability and the `rate` of every document."""
    fitted, table = fit_mix(documents, labels, rules or MixRules())
    names, steps, k = np.array(fitted.model.domains, dtype=object), fitted.steps, len(fitted.model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = matrix(batch.column(2), k)
            top = p.argmax(1)
            arrays = [
                *batch.columns[:2],
                pa.array(names[top], pa.string()),
                pa.array(p.max(1)),
                batch.column(2),
                pa.array(rates(p, steps)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "domain", "probability", "p", "rate"])

    schema = "doc_id long, n_tokens long, domain string, probability double, p array<double>, rate double"
    return table.mapInArrow(run, schema)


def mixing_stage(documents: DataFrame, labels: DataFrame, rules: MixRules | None = None) -> DataFrame:
    """Each document as many times as its rate says; same columns.

    A rate between two whole numbers is drawn by a hash of id and text, so that
    the expected tokens are those of the fit; a rate close to one is
    one. The rate follows from the text, so nothing is joined or shuffled.
    """
    rules = rules or MixRules()
    fitted, _ = fit_mix(documents, labels, rules)
    send = documents.sparkSession.sparkContext.broadcast(fitted)
    text, width = documents.columns.index("text"), len(documents.columns)
    # A name that no column has.
    draw = "draw" + "_" * max(map(len, documents.columns))
    drawn = documents.withColumn(draw, F.xxhash64("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:width]
            plain = pa.RecordBatch.from_arrays(batch.columns[:width], names)
            draws = mix(batch.column(width).to_numpy().view(np.uint64)) / 2.0**64
            for first, last, part in texts_in(batch.column(text)):
                p, _ = send.value.model.probabilities(part)
                rate = rates(p, send.value.steps)
                rate = np.where(np.abs(rate - 1) <= rules.snap, 1.0, rate)
                copies = np.floor(rate + draws[first:last]).astype(np.int64)
                yield plain.take(pa.array(np.repeat(np.arange(first, last), copies)))

    return drawn.mapInArrow(run, documents.schema)


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_labels(spark, sf_dir))
