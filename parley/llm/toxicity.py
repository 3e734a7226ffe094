"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import kernels as K
from parley.llm import storage

BUCKETS = 1 << 20
#: First letters of a word, in bytes, that are features beside the whole word.
PREFIXES = (4, 5, 6)
#: Expected bound on the labelled positives that the classifier is fitted on.
POSITIVE_TEXTS = 4000
#: A bucket is a feature if so many positives hold it, and if it is so much more frequent among them than in all texts.
MIN_POSITIVE, MIN_LIFT = 4, 1.5
#: Unlabelled texts, and features in them, of one part of the training.
PART_TEXTS, PART_SLOTS = 16000, 4_000_000
EPOCHS, RATE, DECAY = 400, 0.05, 1e-4
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(array: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) of whole words and of their first letters, lower case, without punctuation at the ends.

    ``wanted`` has a flag for each bucket; the others are left out.
    """
    texts = K.Texts(array)
    data = K.LOWER[texts.data]
    start, end, owner = texts.spans(~(K.SPACE[data] | _EDGE[data]))
    parts = [(K.span_hashes(data, start, end), owner)]
    for k in PREFIXES:
        long = end - start > k
        parts.append((K.mix(K.span_hashes(data, start[long], start[long] + k) + np.uint64(k)), owner[long]))
    bucket = (np.concatenate([h for h, _ in parts]) % np.uint64(BUCKETS)).astype(np.int64)
    owner = np.concatenate([o for _, o in parts])
    if wanted is not None:
        inside = np.flatnonzero(wanted[bucket])
        bucket, owner = bucket[inside], owner[inside]
    both = np.unique(owner * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    @functools.cached_property
    def weight_of(self) -> np.ndarray:
        """Weight of each bucket, 0 where it is no feature."""
        weight = np.zeros(BUCKETS)
        weight[self.buckets] = self.weights
        return weight

    def logits(self, array: pa.Array) -> np.ndarray:
        whose, bucket = features(array, self.weight_of != 0)
        return np.bincount(whose, weights=self.weight_of[bucket], minlength=len(array)) + self.bias


def risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Non-negative risk of the log odds of a sample, and the direction to step against, for each text.

    With the logistic loss l and class prior p the risk is p E+[l(+)] + max(0, Eu[l(-)] - p E+[l(-)]):
    positives count negatively among the unlabelled. While the part under the max is not below 0 the
    direction is the risk's gradient; below 0 it leads out of there.
    """
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    as_negative, as_positive = np.logaddexp(0, z), np.logaddexp(0, -z)
    inner = as_negative[~positive].sum() / n_u - prior * as_negative[positive].sum() / n_p
    pull = np.where(positive, -prior * p / n_p, p / n_u)  # gradient of the inner part
    grad = np.where(positive, prior * (p - 1) / n_p, 0.0) + pull if inner >= 0 else -pull
    return float(prior * as_positive[positive].sum() / n_p + max(0.0, inner)), grad


def train(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative positive-unlabelled ``risk``."""
    n = len(positive)
    weights, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(rows, weights=weights[cols], minlength=n) + bias
        grad = risk(z, positive, prior)[1]
        whole = np.append(np.bincount(cols, weights=grad[rows], minlength=n_features) + DECAY * weights, grad.sum())
        first, second = 0.9 * first + 0.1 * whole, 0.999 * second + 0.001 * whole**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def _positives(texts: DataFrame, seen: DataFrame) -> DataFrame:
    """Texts labelled as toxic, about POSITIVE_TEXTS of them at most, drawn by a hash of the id."""
    toxic = seen.where("toxic = 1").select("doc_id")
    share = POSITIVE_TEXTS / max(1, toxic.count())
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return storage.written(texts.join(storage.broadcast_if_small(toxic.where(draw < share)), "doc_id", "left_semi").select("text"))


def _holders(texts: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """Number of texts that hold each of the wanted buckets, and of all texts as bucket -1."""
    flags = texts.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for block in K.blocks(batch):
                total += np.bincount(features(block.column(0), flags.value)[1], minlength=BUCKETS + 1)
                total[-1] += block.num_rows
        held = np.flatnonzero(total)
        for at in range(0, len(held), 1 << 16):
            some = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(some == BUCKETS, -1, some)), pa.array(total[some])], ["bucket", "n"])

    return K.map_batches(texts.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _slots(texts: DataFrame, chosen: np.ndarray) -> DataFrame:
    """For each text the places among ``chosen`` of the buckets that it holds, ascending."""
    shared = texts.sparkSession.sparkContext.broadcast(chosen)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(BUCKETS, bool)
        wanted[shared.value] = True
        for batch in batches:
            for block in K.blocks(batch):
                whose, bucket = features(block.column(0), wanted)
                ends = np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=block.num_rows))))
                places = np.searchsorted(shared.value, bucket).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places))], ["slots"])

    return K.map_batches(texts.select("text"), pick, "slots array<int>")


def _lists(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Items of each list, and the items of all lists in one."""
    sizes = [np.diff(b.column(0).offsets.to_numpy()) for b in batches]
    items = [b.column(0).flatten().to_numpy() for b in batches]
    return np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64), np.concatenate([np.zeros(0, np.int32), *items])


def train_parts(unlabelled: DataFrame, positive: tuple[np.ndarray, np.ndarray], n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias from all unlabelled texts: the mean of the parts' own solutions by their texts.

    ``unlabelled`` is a written table of slots, ``positive`` the slots of all positives, which every
    part is trained against. Rows are dealt to parts of at most about PART_TEXTS texts and PART_SLOTS
    features in turn, so that copies are spread evenly, and are sorted there, so that a part that is
    computed again gives the same weights.
    """
    n, items = unlabelled.agg(F.count("*"), F.sum(F.size("slots"))).first()
    parts = max(1, -(-n // PART_TEXTS), -(-(items or 0) // PART_SLOTS))
    shared = unlabelled.sparkSession.sparkContext.broadcast(positive)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, cols = _lists(list(batches))
        if not len(sizes):
            return
        known_sizes, known = shared.value
        rows = np.repeat(np.arange(len(known_sizes) + len(sizes)), np.concatenate([known_sizes, sizes]))
        flags = np.arange(len(known_sizes) + len(sizes)) < len(known_sizes)
        weights, bias = train(rows, np.concatenate([known, cols]), flags, n_features, prior)
        got = np.append(weights, bias) * len(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_features + 1)), pa.array(got), pa.array(np.full(n_features + 1, len(sizes)))], ["slot", "weight", "n"])

    solved = K.map_batches(unlabelled.repartition(parts).sortWithinPartitions("slots"), solve, "slot long, weight double, n long")
    # Decimals, so that the order of the parts does not matter.
    mean = solved.groupBy("slot").agg((F.sum(F.col("weight").cast("decimal(28,9)")).cast("double") / F.sum("n")).alias("weight"))
    found = np.zeros(n_features + 1)
    for row in mean.collect():
        found[row["slot"]] = row["weight"]
    return found[:-1], float(found[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Classifier from confirmed positives and unlabelled texts.

    ``labels`` has doc_id and toxic; rows with toxic = 1 are the positives, and the class prior is
    their share of the labelled rows, by the rule of succession, so that it is never 0 or 1. An id
    that is labelled more than once is positive if one of its labels is; null ids and labels count for
    nothing. All texts of ``docs`` are the unlabelled, whatever their label, repeated rows each;
    null texts are left out, empty ones hold no feature. Features are the buckets that stand out among
    positives, compared with all texts: ``MIN_POSITIVE`` and ``MIN_LIFT`` say how, ties do not
    arise, and the others have no weight. Only the positives are bounded, to about POSITIVE_TEXTS;
    training covers all unlabelled texts, in parts (``train_parts``). None if no positive has a text,
    as in empty tables.
    """
    seen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = seen.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not n_toxic:
        return None
    prior = (n_toxic + 1) / (n + 2)
    texts = docs.where("text is not null").select("doc_id", "text")
    positive = _positives(texts, seen)
    held = storage.written(_holders(positive, None))
    size = held.where("bucket = -1").first()
    if size is None:
        return None
    wanted = np.zeros(BUCKETS, bool)
    wanted[[r["bucket"] for r in held.where((F.col("bucket") >= 0) & (F.col("n") >= MIN_POSITIVE)).collect()]] = True
    everywhere = storage.written(_holders(texts, wanted))
    n_u = everywhere.where("bucket = -1").first()["n"]
    # Among texts of which a share of ``prior`` is positive, a feature of positives alone is 1/prior times as frequent among them.
    lift = F.col("n") / F.lit(float(size["n"])) / ((F.col("u") + 1) / F.lit(float(n_u + 1)))
    strong = held.join(everywhere.select("bucket", F.col("n").alias("u")), "bucket").where((F.col("bucket") >= 0) & (F.col("n") >= MIN_POSITIVE) & (lift > MIN_LIFT))
    chosen = np.array(sorted(r["bucket"] for r in strong.select("bucket").collect()), np.int64)
    if not len(chosen):
        return Model(chosen, np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    known = _lists(_slots(positive, chosen).orderBy("slots").toArrow().combine_chunks().to_batches())
    weights, bias = train_parts(storage.written(_slots(texts, chosen)), known, len(chosen), prior)
    return Model(chosen, weights, bias, prior)


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score from 0 to 1 and predicted (score >= 0.5) of every whole text.

    A null or empty text has the score of a text without features; without a model all score 0.
    Texts of any length are read whole; a score of exactly 0.5 is predicted 1. Repeated ids give a
    row each; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for block in K.blocks(batch):
                score = np.zeros(block.num_rows) if known is None else 1 / (1 + np.exp(-np.clip(known.logits(K.fill(block.column(1))), -40, 40)))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return K.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int")
