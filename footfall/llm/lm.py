"""Language-model scores: exact word counts of the whole corpus, and a gated recurrent model over its frequent words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm import gru
from footfall.llm.frames import fold_bucket, keep_freed, slices, stored

# The end of a document as a word; no word holds a line end.
END = b"\n"
# Words whose counts are sent to every task: the most frequent ones of at most HEAD_BYTES. All others are
# joined. The first of them, with the end and the sum of all other words, are the model's vocabulary.
HEAD_WORDS, HEAD_BYTES = 200_000, 64
# Words of each class of the vocabulary: "any other word" alone, then the end and the words by falling frequency.
CLASS_SIZES = (1, 7, 8, 16, 16, 16, 32, 32, *[gru.CLASS_WORDS] * 30)
CLASSES, VOCABULARY = len(CLASS_SIZES), sum(CLASS_SIZES)
# The model's number of each entry of the vocabulary.
NUMBERS = np.concatenate([c * gru.CLASS_WORDS + np.arange(size) for c, size in enumerate(CLASS_SIZES)]).astype(np.int32)
# The recurrent weights are fitted on all training documents in ROUNDS parts; each part is dealt to tasks of
# about TASK_WORDS words, whose weights are averaged.
ROUNDS, TASK_WORDS = 3, 4_000_000
FAN_IN = 32
# Distinct words that a counting task holds, and words that a scoring task packs into lanes.
COUNT_WORDS, SCORE_WORDS = 300_000, 4_000_000

_RARE, _END = NUMBERS[:2].tolist()  # "any other word", and the end


class Lexicon:
    """What every task knows of the corpus: the frequent words, their counts, and the totals."""

    def __init__(self, words: list[bytes], counts: list[int], end_count: int, tokens: int, distinct: int):
        self.place = {word: i for i, word in enumerate(words)}
        self.counts = np.array(counts, np.int64)
        self.tokens, self.distinct = tokens, distinct
        self.end_count = end_count
        self.frequent = min(len(words), VOCABULARY - 2)  # these have numbers of their own
        own = int(self.counts[: self.frequent].sum()) + end_count
        self.rare_tokens = tokens - own
        self.rare_words = distinct - self.frequent - (end_count > 0)

    def base_offset(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    def rare_offset(self) -> float:
        return float(np.log10(self.rare_tokens + 0.5 * (self.rare_words + 1)))

    def class_counts(self) -> np.ndarray:
        """Counts of the vocabulary by class; -1 where no word is."""
        flat = np.full(CLASSES * gru.CLASS_WORDS, -1.0)
        flat[_RARE], flat[_END] = self.rare_tokens, self.end_count
        flat[NUMBERS[2 : 2 + self.frequent]] = self.counts[: self.frequent]
        return flat.reshape(CLASSES, gru.CLASS_WORDS)

    def numbers(self, places: np.ndarray) -> np.ndarray:
        """The model's word numbers of head places (-1: not in the head), with the end behind them."""
        own = (places >= 0) & (places < self.frequent)
        return np.append(NUMBERS[np.where(own, places + 2, 0)], _END)


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return text.lower().split() if text else []


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word``, ``n`` over all rows, with one END a row (NULL texts have only that)."""
    return (
        docs.select(F.col(text_col).cast("binary").alias("text"))
        .mapInArrow(_count, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def record() -> pa.RecordBatch:
        return pa.record_batch([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counts: Counter[bytes] = Counter()
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            counts.update(split_words(text))
        counts[END] += batch.num_rows
        if len(counts) > COUNT_WORDS:
            yield record()
            counts.clear()
    if counts:
        yield record()


def lexicon(counts: DataFrame) -> Lexicon:
    """The frequent words and totals of a stored count table; the driver receives at most HEAD_WORDS words.

    Words are taken by classes of frequency, 64 to each doubling, from the most frequent down while they
    fit: a filter, where a sort for the first HEAD_WORDS would send that many of each partition to one task.
    """
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == END, F.col("n"))).alias("e")).first()
    level = F.floor(F.log2("n") * 64).cast("int")
    short = counts.where((F.col("word") != END) & (F.length("word") <= HEAD_BYTES)).withColumn("level", level)
    taken, least = 0, None
    for row in sorted(short.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # at most 64 levels a bit
        taken += row["count"]
        if taken > HEAD_WORDS:
            break
        least = row["level"]
    head = short.where(F.col("level") >= least).select("word", "n").toArrow() if least is not None else None
    pairs = sorted(zip(head.column("word").to_pylist(), head.column("n").to_pylist()), key=lambda p: (-p[1], p[0])) if head else []
    return Lexicon([w for w, _ in pairs], [n for _, n in pairs], total["e"] or 0, total["n"] or 0, total["v"])


def fit(encoded: DataFrame, words: Lexicon) -> gru.Weights:
    """The recurrent weights, by rounds of training in parallel and averaging; ``encoded`` has the ``numbers`` and ``lot`` of every document to learn from.

    Each document is in one round, told by its lot, the hash of its id and text, so rounds are the same on every
    run. Weights are averaged in a tree of tasks; the driver receives at most FAN_IN sets of them.
    """
    spark = encoded.sparkSession
    weights = gru.initial(words.class_counts())
    tasks = max(1, round(words.tokens / ROUNDS / TASK_WORDS))
    for part in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)
        trained = (
            encoded.where(F.col("lot") % ROUNDS == part)
            .select("lot", "numbers")
            .repartition(tasks)
            .sortWithinPartitions("lot", "numbers")
            .select("numbers")
            .mapInArrow(_train(shared), "weights binary, size double")
        )
        means = _averaged(trained, tasks).toArrow()
        if means.num_rows:
            (flat, _) = _mean(means)
            weights = gru.unpack(flat, CLASSES)
    return weights


def _train(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        keep_freed()
        for batch in slices(batches):
            docs += map(_unpacked, batch.column("numbers").to_pylist())
        if docs:
            yield _weighted(gru.pack(gru.train(shared.value, docs, _END)), float(sum(map(len, docs))))

    return rows


def _unpacked(numbers: bytes) -> np.ndarray:
    return np.frombuffer(numbers, "<u2")


def _averaged(trained: DataFrame, rows: int) -> DataFrame:
    """Weights of all tasks averaged FAN_IN at a time, until no more than that are left."""
    while rows > FAN_IN:
        rows = -(-rows // FAN_IN)
        trained = trained.repartition(rows).mapInArrow(_combine, trained.schema)
    return trained


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, size = None, 0.0
    for batch in batches:
        flat, own = _mean(batch)
        size += own
        total = flat * own if total is None else total + flat * own
    if size:
        yield _weighted(total / size, size)


def _mean(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, float]:
    sizes = np.array(rows.column("size").to_pylist())
    parts = [np.frombuffer(w, np.float32).astype(np.float64) * s for w, s in zip(rows.column("weights").to_pylist(), sizes)]
    return (sum(parts) / sizes.sum(), float(sizes.sum())) if parts else (np.zeros(1), 0.0)


def _weighted(flat: np.ndarray, size: float) -> pa.RecordBatch:
    raw = flat.astype(np.float32).tobytes()
    return pa.record_batch([pa.array([raw], pa.binary()), pa.array([size], pa.float64())], names=["weights", "size"])


_ENCODED_ARROW = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("lot", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("n_tokens", pa.int64()),
        ("n_known", pa.int64()), ("head_log", pa.float64()), ("n_rare", pa.int64()), ("rare_log", pa.float64()), ("numbers", pa.binary()),
    ]
)
_ENCODED = "row long, doc_id long, lot long, word binary, times long, n_tokens long, n_known long, head_log double, n_rare long, rare_log double, numbers binary"
_SCORED_ARROW = pa.schema([*(_ENCODED_ARROW.field(c) for c in ("row", "doc_id", "n_tokens", "n_known", "head_log", "n_rare", "rare_log")), ("model_log", pa.float64())])
_SCORED = "row long, doc_id long, n_tokens long, n_known long, head_log double, n_rare long, rare_log double, model_log double"


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    All rows whose ``held_out`` is false are learned from: their exact word counts give the base score and
    the probability of rare words, and all of them fit the recurrent weights. ``score`` is the model's log10
    probability of the whole text: states go on from window to window to the document's end; a word outside
    the vocabulary costs the model's probability of "any other word" times its smoothed share among those.
    NULL and empty texts are the end alone; ids may be NULL or repeat.

    Texts are turned into word numbers once, for training and scoring. Words outside the head are written beside
    them, counted by document, and joined with the counts by word; so no task holds the vocabulary, and a
    document's rows meet only as sums.
    """
    counts = stored(word_counts(docs.where(~held_out), text_col), "lm-counts")
    words = lexicon(counts)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    # Rows that are not learned from have no lot.
    lot = F.when(~held_out, F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("fit")), F.lit(1_000_000)))
    whole = docs.select(F.col(id_col).alias("doc_id"), lot.alias("lot"), F.col(text_col).cast("binary").alias("text"))
    rows = stored(whole.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_encode(shared), _ENCODED), "lm-rows")
    encoded = rows.where("numbers IS NOT NULL")
    weights = fit(encoded.where("lot IS NOT NULL"), words)
    log = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    tail = (
        rows.where("word IS NOT NULL")
        .select("row", "word", "times")
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * log).alias("tail_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    )
    scored = encoded.drop("lot", "word", "times").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(weights)), _SCORED)
    whole = scored.join(tail, "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * words.base_offset()).alias("base_score"),
        (F.col("model_log") + F.col("rare_log") + tail_log - F.col("n_rare") * words.rare_offset()).alias("score"),
    )


def score_learned(docs: DataFrame) -> DataFrame:
    """Scores of all rows, learned from those whose ``fold_bucket`` is not 1; a NULL id is held out."""
    fold = fold_bucket("doc_id")
    held_out = F.coalesce(fold == 1, F.lit(True))
    scored = score_documents(docs, held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _encode(shared):
    """A row for each text, with its word numbers and sums over the head, and one for each of its words outside the head."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        get, logs = words.place.get, np.log10(words.counts + 0.5)
        end_log = float(np.log10(words.end_count + 0.5))

        def record(names: tuple[str, ...], found: list[tuple]) -> pa.RecordBatch:
            columns = dict(zip(names, zip(*found)))
            empty = pa.nulls(len(found))
            return pa.record_batch(
                [pa.array(columns[f.name], f.type) if f.name in columns else empty.cast(f.type) for f in _ENCODED_ARROW], schema=_ENCODED_ARROW
            )

        for batch in slices(batches):
            held: list[tuple] = []
            tail: list[tuple[int, bytes, int]] = []
            for row, doc, lot, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "lot", "text"))):
                own = split_words(text)
                places = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
                head = places[places >= 0]
                known = logs[head]
                rare = head >= words.frequent
                held.append((row, doc, lot, len(own) + 1, len(head) + (words.end_count > 0), float(known.sum()) + end_log,
                             int(rare.sum()) + len(own) - len(head), float(known[rare].sum()), words.numbers(places).astype("<u2").tobytes()))
                if len(head) < len(own):
                    missing = Counter([own[i] for i in np.flatnonzero(places < 0).tolist()])
                    tail += [(row, word, n) for word, n in missing.items()]
            yield record(("row", "doc_id", "lot", "n_tokens", "n_known", "head_log", "n_rare", "rare_log", "numbers"), held)
            if tail:
                yield record(("row", "word", "times"), tail)

    return rows


def _score(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        numbers: list[np.ndarray] = []
        size = 0
        keep_freed()

        def flush() -> pa.RecordBatch:
            model = gru.score(shared.value, numbers, _END) / np.log(10)
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [table.column(name).combine_chunks() for name in _SCORED_ARROW.names[:-1]]
            return pa.record_batch([*columns, pa.array(model)], schema=_SCORED_ARROW)

        for batch in slices(batches):
            own = [_unpacked(n) for n in batch.column("numbers").to_pylist()]
            held.append(batch.select(_SCORED_ARROW.names[:-1]))
            numbers += own
            size += sum(map(len, own))
            if size >= SCORE_WORDS:
                yield flush()
                held, numbers, size = [], [], 0
        if held:
            yield flush()

    return rows
