"""Toxicity classifier: a linear model of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.frames import fold_bucket, slices, stored

# Lengths of the character n-grams, which are hashed to so many buckets.
ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 20
# The classifier is fitted on at most so many labelled rows, those of the smallest (id hash, text hash).
FIT_ROWS = 20_000
# Buckets whose ratio stands out most are features; those whose signed root of the likelihood ratio is
# below NOISE are left to chance. The driver receives FEATURES counts and the features of FIT_ROWS rows.
FEATURES = 2_048
NOISE = 4.0
SMOOTHING = 1.0
# Characters hashed at a time.
PIECE = 1 << 18
STEPS = 600
RATE = 0.05
DECAY = 1e-4

_BASE = np.uint64(0x9E3779B1)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_GAP = " " * max(ORDERS)


@dataclass
class Classifier:
    """``slot`` has the place of each bucket among the features, or -1; ``weights`` hold the ratio already."""

    slot: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        margin = np.array([self.weights[found].sum() for found in rows]) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, blanks between and around them, and where each text starts.

    The gaps are as long as the longest n-gram, so none reaches from one text into the next.
    """
    parts = [" ".join((t or "").lower().split()) for t in texts]
    starts = np.cumsum([0] + [len(p) + len(_GAP) for p in parts])
    return np.frombuffer((_GAP + _GAP.join(parts) + _GAP).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def buckets(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, buckets of the n-grams that start there and after) for all orders, a piece of the codes at a time."""
    longest = max(ORDERS)
    for at in range(0, len(codes), PIECE):
        piece = codes[at : at + PIECE + longest - 1].astype(np.uint64)
        hashes, length = piece, 1
        for order in ORDERS:
            while length < order:
                hashes = hashes[:-1] * _BASE + piece[length:]
                length += 1
            count = min(PIECE, len(hashes))
            if count > 0:
                yield at, ((hashes[:count] + np.uint64(order)) * _SPREAD >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features(texts: list[str | None], slot: np.ndarray) -> list[np.ndarray]:
    """The distinct features of each text, by their places in ``slot``."""
    codes, starts = joined(texts)
    width = int(slot.max(initial=-1)) + 1
    found = []
    for at, bucket in buckets(codes):
        place = slot[bucket]
        hit = np.flatnonzero(place >= 0)
        found.append((np.searchsorted(starts, at + hit, "right") - 1) * width + place[hit])
    every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    cuts = np.searchsorted(every, np.arange(1, len(texts)) * width)
    return [row % max(1, width) for row in np.split(every, cuts)] if texts else []


def bucket_counts(texts: list[str | None], toxic: list[int], counts: np.ndarray, seen: np.ndarray) -> None:
    """Add to ``counts[class, bucket]`` the texts of each class that hold the bucket; ``seen`` is scratch."""
    for text, kind in zip(texts, toxic):
        codes, _ = joined([text])
        own = np.concatenate([bucket for _, bucket in buckets(codes)])
        order = np.arange(len(own))
        seen[own] = order
        counts[kind, own[seen[own] == order]] += 1


def ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Naive Bayes log-count ratios of the shares of toxic and of clean texts that hold a feature."""
    return np.log((toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - np.log((clean + SMOOTHING) / (n_clean + 2 * SMOOTHING))


def fit(rows: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, slot: np.ndarray) -> Classifier:
    """Logistic regression of the label on the features, each worth its ratio; Adam over all rows at once.

    Without rows of both classes the model says the share of toxic rows everywhere (a half without rows).
    """
    n, hits = len(toxic), int(toxic.sum()) if len(toxic) else 0
    share = (hits + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if not hits or hits == n or not len(ratio):
        return Classifier(slot, np.zeros(len(ratio)), bias)
    at = np.concatenate(rows).astype(np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    weights = np.zeros(len(ratio) + 1)
    weights[-1] = bias
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        margin = np.bincount(row, (weights[:-1] * ratio)[at], n) + weights[-1]
        off = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic) / n
        gradient = np.append(np.bincount(at, off[row], len(ratio)) * ratio + DECAY * weights[:-1], off.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weights = weights - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Classifier(slot, weights[:-1] * ratio, float(weights[-1]))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """Fit on the texts of ``docs`` (``doc_id``, ``text``) whose id ``labels`` (``doc_id``, ``toxic``) marks 0 or 1.

    An id with both labels, a NULL id and a NULL label teach nothing. Rows equal in id and text are one; of
    the rest, the ``rows`` of the smallest hashes of id, then of text, are taken. Their texts go to a stored
    table once; tasks count for every bucket the toxic and the clean texts that hold it, Spark adds the
    counts, and the ratios of the buckets that stand out most scale the features.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).where("toxic = high").drop("high")
    version = F.xxhash64("text").alias("version")
    order = [F.xxhash64("doc_id"), "doc_id", "version"]
    ids = docs.select("doc_id").join(known, "doc_id").distinct().orderBy(*order[:2]).limit(rows)
    ids = F.broadcast(stored(ids, "toxicity-ids"))  # at most `rows` ids
    found = docs.select("doc_id", "text", version).join(ids, "doc_id")
    picked = stored(found.select("doc_id", "toxic", "version").distinct().orderBy(*order).limit(rows), "toxicity-rows")
    sample = docs.select("doc_id", "text", version).join(F.broadcast(picked), ["doc_id", "version"])
    sample = stored(sample.dropDuplicates(["doc_id", "version"]).select("doc_id", "version", "toxic", "text"), "toxicity-sample")

    sizes = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = sample.select("toxic", "text").mapInArrow(_count_rows, "bucket int, toxic int, clean int")
    counted = counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strength = _strength(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    best = counted.withColumn("strength", strength).where(F.col("strength") >= NOISE)
    best = best.orderBy(F.desc("strength"), "bucket").limit(FEATURES).toArrow()
    slot = np.full(1 << BUCKET_BITS, -1, np.int16)
    slot[best.column("bucket").to_numpy()] = np.arange(best.num_rows)
    ratio = ratios(best.column("toxic").to_numpy(), best.column("clean").to_numpy(), n_toxic, n_clean)

    shared = spark.sparkContext.broadcast(slot)

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = pa.array([f.tolist() for f in features(batch.column("text").to_pylist(), shared.value)], pa.list_(pa.int16()))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "version", "toxic")), lists], names=schema.names)

    schema = T.StructType([*sample.schema.fields[:3], T.StructField("features", T.ArrayType(T.ShortType()))])
    table = sample.mapInArrow(feature_rows, schema).orderBy(*order).toArrow()
    held = [np.array(f, np.int64) for f in table.column("features").to_pylist()]
    return fit(held, table.column("toxic").to_numpy().astype(np.float64), ratio, slot)


def _strength(toxic, clean, n_toxic: int, n_clean: int):
    """Root of the likelihood ratio of a bucket's share in the two classes, against one share in both."""
    total, n = toxic + clean, max(1, n_toxic + n_clean)
    parts = [(toxic, n_toxic), (clean, n_clean)]
    gain = F.lit(0.0)
    for count, size in parts:
        for cell, expected in ((count, total * size / n), (F.lit(size) - count, (F.lit(n) - total) * size / n)):
            gain = gain + F.when(cell > 0, 2 * cell * F.log(cell / expected)).otherwise(0.0)
    return F.sqrt(F.greatest(gain, F.lit(0.0)))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, seen = np.zeros((2, 1 << BUCKET_BITS), np.int32), np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in slices(batches):
        bucket_counts(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), counts, seen)
    some = np.flatnonzero(counts.any(axis=0))
    for part in np.array_split(some, max(1, len(some) >> 16)):
        columns = [pa.array(part.astype(np.int32)), pa.array(counts[1, part]), pa.array(counts[0, part])]
        yield pa.record_batch(columns, names=["bucket", "toxic", "clean"])


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score``, the probability of toxicity, of every row, NULL and empty texts too.

    Ids keep their type, NULL and repeated ones included; NULL is scored as an empty text. Whole texts are
    read, a piece at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = features(batch.column("text").to_pylist(), shared.value.slot)
            yield pa.record_batch([batch.column("doc_id"), pa.array(shared.value.scores(found), pa.float64())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, schema)


def score_learned(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Learn from the rows whose ``fold_bucket`` is not 0, score all: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Rows with a NULL id are held out. An empty table gives an empty result; extra columns are ignored.
    """
    fold = fold_bucket("doc_id")
    model = train(docs.where(fold != 0).select("doc_id", "text"), labels.where(fold != 0).select("doc_id", "toxic"))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(fold == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
