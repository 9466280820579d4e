"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.frames import fold_bucket, slices, stored, texts

# Hashed trigrams of character shapes, and plain measures of the text beside them.
SHAPE_BUCKETS = 256
MEASURES = 7
FEATURES = SHAPE_BUCKETS + MEASURES
# The classifier is fitted on at most so many trusted positives and so many unlabelled rows, those of the
# smallest hashes of id and text; the driver receives FEATURES numbers of each. The class prior is counted over
# all unlabelled rows.
FIT_ROWS = 8_000
# Mini-batches of 512 rows of either set; the weights are averaged over the second half of them.
STEPS = 3_000
RATE = 0.05
DECAY = 1e-4
# Bytes of a text measured at a time.
PIECE = 1 << 22

# Letters of either case, digits, blanks and line ends are one shape each; other ASCII is its own shape.
_SHAPE = np.array(
    [
        128 if b >= 128 or chr(b).islower() else 129 if chr(b).isupper() else 130 if chr(b).isdigit() else b
        for b in range(256)
    ],
    np.uint32,
)


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        margin = ((features - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def text_features(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of shape trigrams, and measures; all zeros for a NULL or empty text."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    grams = np.zeros(SHAPE_BUCKETS, np.int64)
    words = distinct = echoes = size = longest = upper = marks = 0
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        shape = _SHAPE[np.frombuffer(b"\n" + piece + b"\n", np.uint8)]
        mixed = (shape[:-2] * np.uint32(31) + shape[1:-1]) * np.uint32(31) + shape[2:]
        grams += np.bincount((mixed * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int64), minlength=SHAPE_BUCKETS)
        own = piece.split()
        words += len(own)
        distinct += len(set(own))
        longest = max(longest, max(map(len, own), default=0))
        echoes += sum(map(eq, own, own[1:]))
        size += len(piece)
        upper += int((shape == 129).sum())
        marks += int(((shape < 128) & (shape > 32)).sum())
    out[:SHAPE_BUCKETS] = np.sqrt(grams / grams.sum())
    # The number of distinct words grows more slowly than that of words; its exponent tells repetition.
    out[SHAPE_BUCKETS:] = (
        np.log1p(distinct) / np.log1p(words) if words else 0,
        np.sqrt(echoes / max(1, words)),
        np.log1p(words) / 10,
        np.log1p(size / max(1, words)),
        upper / size,
        marks / size,
        np.log1p(longest) / 10,
    )
    return out


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> Classifier:
    """A logistic model that minimises the non-negative unbiased risk of trusted positives and unlabelled rows.

    The risk is ``prior * P(l+) + max(0, U(l-) - prior * P(l-))``, with the logistic loss ``l``; when the
    bracket turns negative, its gradient is reversed. Without positives or unlabelled rows the model says one
    score everywhere: 1/2 without positives, else 1.
    """
    if not len(positives) or not len(unlabelled):
        zeros = np.zeros(FEATURES)
        return Classifier(zeros, zeros + 1, zeros, 30.0 if len(positives) else 0.0, 1.0 if len(positives) else 0.5)
    mean, scale = _measure(positives, unlabelled)
    weights, bias = _descend((positives - mean) / scale, (unlabelled - mean) / scale, prior)
    return Classifier(mean, scale, weights, bias, prior)


def separator(positives: np.ndarray, unlabelled: np.ndarray) -> Classifier:
    """A logistic model that tells positives from unlabelled rows; scores above its quantiles bound the prior."""
    mean, scale = _measure(positives, unlabelled)
    weights, bias = _descend((positives - mean) / scale, (unlabelled - mean) / scale, None)
    return Classifier(mean, scale, weights, bias, 0.5)


def _measure(positives: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([positives, unlabelled])
    return every.mean(axis=0), every.std(axis=0) + 0.01


def estimate_prior(above_p: np.ndarray, n_p: int, above_u: np.ndarray, n_u: int) -> float:
    """The share of positives among the unlabelled rows, from the shares of both sets above each of some scores.

    Of the rows that score above a threshold, the unlabelled share over the positive share bounds the prior
    from above; the smallest such bound over thresholds is taken, with a margin for the number of rows. Two
    standard errors are taken off: a prior too high would leave the risk of negatives below zero before they
    are told apart.
    """
    if not n_p or not n_u:
        return 0.5
    margin = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(n_u) + 1 / np.sqrt(n_p))
    bound = (above_u + margin) / above_p
    best = int(bound.argmin())
    spread = 2 * np.sqrt(above_u[best] * (1 - above_u[best]) / n_u + above_p[best] * (1 - above_p[best]) / n_p)
    return float(np.clip((above_u[best] - spread) / above_p[best], 0.01, 0.99))


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None) -> tuple[np.ndarray, float]:
    """Adam over mini-batches of both sets; without a prior, plain logistic regression of p against u."""
    rng = np.random.default_rng(7)
    weights = np.zeros(p.shape[1] + 1)
    first, second, step = np.zeros_like(weights), np.zeros_like(weights), 0
    settled, kept = np.zeros_like(weights), 0
    p, u = np.hstack([p, np.ones((len(p), 1))]), np.hstack([u, np.ones((len(u), 1))])
    size = 512
    rounds = max(1, -(-max(len(p), len(u)) // size))
    total = min(STEPS, 100 * rounds)
    for _ in range(total):
        a, b = p[rng.integers(0, len(p), size)], u[rng.integers(0, len(u), size)]
        sa, sb = _sigmoid(a @ weights), _sigmoid(b @ weights)
        if prior is None:
            gradient = (a * (sa - 1)[:, None]).mean(axis=0) + (b * sb[:, None]).mean(axis=0)
        else:
            as_positive = (a * (sa - 1)[:, None]).mean(axis=0)
            as_negative = (b * sb[:, None]).mean(axis=0) - prior * (a * sa[:, None]).mean(axis=0)
            negative_risk = -np.log1p(-sb + 1e-12).mean() + prior * np.log1p(-sa + 1e-12).mean()
            gradient = prior * as_positive + as_negative if negative_risk >= 0 else -as_negative
        gradient = gradient + DECAY * weights
        step += 1
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weights = weights - RATE / (1 + step / 200) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if step > total // 2:
            settled, kept = settled + weights, kept + 1
    settled = settled / kept
    return settled[:-1], float(settled[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``version`` and ``features`` of every row; the text is read once and goes no further."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [text_features(t).astype(np.float32) for t in batch.column("text").to_pylist()]
            flat = pa.array(np.concatenate(values))
            lists = pa.FixedSizeListArray.from_arrays(flat, FEATURES).cast(pa.list_(pa.float32()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("version"), lists], names=["doc_id", "version", "features"])

    whole = docs.select("doc_id", "version", F.col("text").cast("binary").alias("text"))
    return whole.mapInArrow(rows, "doc_id long, version long, features array<float>")


def train(docs: DataFrame, trusted: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """Fit on the texts of ``trusted`` (``doc_id`` only) as positives and on all ``docs`` as unlabelled.

    Of either set, the ``rows`` rows of the smallest hashes of id, then of text, are fitted on: a sample that
    depends on nothing but ids and texts, and is bounded however often an id repeats. Rows with a NULL id teach
    nothing; rows equal in id and text are one in the sample. Half of the sample, by another hash, tells
    positives from unlabelled rows; the prior comes from that model's scores of the other half's positives and
    of all unlabelled rows but those it has learned from, which Spark counts.
    """
    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("version"))
    order = [F.xxhash64("doc_id"), "doc_id", "version"]
    half = F.pmod(F.xxhash64("doc_id", "version", F.lit("half")), F.lit(2)).cast("int")
    ids = trusted.where("doc_id IS NOT NULL").select("doc_id").distinct()
    names = known.select("doc_id", "version").distinct()
    ids = stored(names.select("doc_id").distinct().join(ids, "doc_id", "left_semi").orderBy(*order[:2]).limit(rows), "quality-ids")
    # At most `rows` ids, then at most `rows` rows of either set, whatever the table's size.
    picked_p = names.join(F.broadcast(ids), "doc_id", "left_semi").orderBy(*order).limit(rows)
    picked_u = names.orderBy(*order).limit(rows)
    picked = stored(
        picked_p.withColumn("trusted", F.lit(True)).unionByName(picked_u.withColumn("trusted", F.lit(False))), "quality-rows"
    )
    sample = known.join(F.broadcast(picked.select("doc_id", "version").distinct()), ["doc_id", "version"])
    sample = featured(sample.dropDuplicates(["doc_id", "version"])).join(F.broadcast(picked), ["doc_id", "version"])
    # Sorted here, where the bounded sample goes anyway: Spark would measure its texts twice or write a file for each partition.
    table = sample.select("*", half.alias("half"), order[0].alias("lot")).toArrow()
    table = table.sort_by([(c, "ascending") for c in ("lot", "doc_id", "version", "trusted")])
    matrix = table.column("features").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, FEATURES)
    positive, halves = (table.column(c).to_numpy().astype(bool) for c in ("trusted", "half"))
    fit_p, test_p = matrix[positive & ~halves], matrix[positive & halves]
    fit_u = matrix[~positive & ~halves]
    prior = 0.5
    if len(fit_p) and len(test_p) and len(fit_u):
        model = separator(fit_p, fit_u)
        scores = np.sort(model.scores(test_p))
        limits = np.quantile(scores, np.linspace(0, 0.9, 91))
        learned = picked.where("NOT trusted").where(half == 0).select("doc_id", "version")
        others = known.join(F.broadcast(learned), ["doc_id", "version"], "left_anti")
        above, n = _above(others, model, limits)
        prior = estimate_prior(1 - np.searchsorted(scores, limits) / len(scores), len(scores), above / max(1, n), n)
    return fit(matrix[positive], matrix[~positive], prior)


def _above(docs: DataFrame, model: Classifier, limits: np.ndarray) -> tuple[np.ndarray, int]:
    """How many rows score each of the ascending ``limits`` or more, and how many there are; sums of one row a batch."""
    shared = docs.sparkSession.sparkContext.broadcast((model, limits))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = shared.value
        counts, n = np.zeros(len(limits), np.int64), 0
        for batch in slices(batches):
            scores = np.sort(model.scores(np.array([text_features(t) for t in batch.column("text").to_pylist()], np.float32)))
            counts += len(scores) - np.searchsorted(scores, limits)
            n += len(scores)
        places = np.arange(len(limits) + 1, dtype=np.int32)
        yield pa.record_batch([pa.array(places), pa.array(np.append(counts, n))], names=["place", "n"])

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(rows, "place int, n long")
    sums = {r["place"]: r["n"] for r in counted.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    return np.array([sums.get(i, 0) for i in range(len(limits))], np.float64), sums.get(len(limits), 0)


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score``, the probability of good quality, of every row; NULL is scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([text_features(t) for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(shared.value.scores(values))], names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, score double")


def score_learned(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from the rows whose ``fold_bucket`` is not 0, score all: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Trusted positives are rows labelled 1; an id with both labels is none. A NULL id is held out.
    """
    fold = fold_bucket("doc_id")
    good = labels.where(fold != 0).groupBy("doc_id").agg(F.min("quality").alias("low")).where("low = 1").select("doc_id")
    model = train(docs.where(fold != 0), good)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(fold == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
