"""Language ID: each document's mixture of languages by expectation-maximisation over n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.frames import fold_bucket, slices, texts

# Letter trigrams are hashed to so many buckets.
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
# Added to each count of a language's trigrams.
SMOOTHING = 0.5
# EM stops when no proportion moves by more, or after so many rounds.
TOLERANCE = 1e-3
ROUNDS = 30
# Log-likelihood a further language must gain, in units of the log of the number of trigrams. Trigrams
# overlap and so are far from independent; hence more than the usual half.
PENALTY = 3.0

_LETTER = regex.compile(r"\p{L}")
# Bytes of letters stay, all others part words; bytes outside ASCII count as letters.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


@dataclass
class Languages:
    """Trigram probabilities by language; the last row is the uniform background that no language owns."""

    names: list[str]
    probability: np.ndarray  # (languages + 1, BUCKETS)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Languages:
    """Trigram counts of all rows with a language, added up by Spark; rows with a NULL in either column teach nothing.

    The driver receives at most BUCKETS numbers for each distinct language.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    counts = (
        rows.where("lang IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(_count_rows, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    table = counts.toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    of = {name: i for i, name in enumerate(names)}
    matrix = np.full((len(names) + 1, BUCKETS), SMOOTHING)
    lang = np.array([of[x] for x in table.column("lang").to_pylist()], np.int64)
    matrix[lang, table.column("bucket").to_numpy()] += table.column("n").to_numpy()
    return Languages(names, matrix / matrix.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``version``, ``lang_pred``, ``score`` and ``mixture`` (language to proportion) of every row.

    EM estimates the proportions of the languages and of a uniform background that explain the text's
    trigrams. Languages join one by one, in order of their share in the mixture of all, as long as the
    likelihood, penalised by PENALTY times the log of the trigrams a language, grows. ``lang_pred`` is the
    largest of those chosen, ``score`` its proportion. NULL texts, texts without a letter and texts that a
    model without languages sees are ``und`` with score 0; NULL and repeated ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores, mixtures = [], [], []
            for name, score, mixture in mixtures_of(batch.column("text").to_pylist(), shared.value):
                names.append(name)
                scores.append(score)
                mixtures.append(mixture)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("version"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(mixtures, pa.map_(pa.string(), pa.float64())),
                ],
                names=["doc_id", "version", "lang_pred", "score", "mixture"],
            )

    rows = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("version"), "text")
    return rows.mapInArrow(predict, "doc_id long, version long, lang_pred string, score double, mixture map<string,double>")


def identify_learned(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose ``fold_bucket`` is not 0, predict all; ``held_out`` tells rows not learned from.

    A NULL id is in no fold and is held out.
    """
    fold = fold_bucket("doc_id")
    model = train(docs.where(fold != 0))
    return identify(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, model: Languages, least: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are ``und`` or whose largest language explains less than ``least``."""
    whole = docs.select(F.struct("*").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = mixtures_of(batch.column("text").to_pylist(), shared.value)
            yield batch.select(["doc"]).filter(pa.array([name != "und" and score >= least for name, score, _ in found], pa.bool_()))

    return whole.mapInArrow(keep, whole.select("doc").schema).select("doc.*")


def _buckets(text: bytes) -> np.ndarray:
    """The bucket of every trigram whose middle is part of a word."""
    lower = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    folded = _FOLD[np.frombuffer(b" " + lower + b" ", np.uint8)]
    middle = np.flatnonzero(folded[1:-1] != 32)
    wide = folded.astype(np.uint32)
    grams = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])[middle]
    return (grams * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _pieces(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    for at in range(0, len(text), size):
        yield text[at : at + size]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            own = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for piece in _pieces(text):
                own += np.bincount(_buckets(piece), minlength=BUCKETS)
    for lang, counts in totals.items():
        some = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())],
            names=["lang", "bucket", "n"],
        )


def mixtures_of(rows: list[bytes | None], model: Languages) -> list[tuple[str, float, list[tuple[str, float]]]]:
    """(largest language, its proportion, proportions of the chosen languages) of each text."""
    out: list[tuple[str, float, list[tuple[str, float]]]] = [("und", 0.0, [])] * len(rows)
    if not model.names:
        return out
    held, grams, counts, sizes = [], [], [], []
    for i, text in enumerate(rows):
        if text and _LETTER.search(text.decode("utf-8", "replace")):
            total = np.zeros(BUCKETS, np.int64)
            for piece in _pieces(text):
                total += np.bincount(_buckets(piece), minlength=BUCKETS)
            some = np.flatnonzero(total)
            held.append(i)
            grams.append(some)
            counts.append(total[some])
            sizes.append(len(some))
            if sum(sizes) >= 1 << 16:
                _choose(out, held, grams, counts, sizes, model)
                held, grams, counts, sizes = [], [], [], []
    if held:
        _choose(out, held, grams, counts, sizes, model)
    return out


def _choose(out, held, grams, counts, sizes, model: Languages) -> None:
    """Fill in the results of some documents, all at once."""
    likely = np.ascontiguousarray(model.probability[:, np.concatenate(grams)])
    weight = np.concatenate(counts).astype(float)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(held)), sizes)
    languages, docs = len(model.names), np.arange(len(held))
    total = np.add.reduceat(weight, starts)
    share = _em(likely, weight, starts, owner, np.ones((languages + 1, len(held)), bool))[0]
    order = np.argsort(-share[:-1], axis=0, kind="stable")
    allowed = np.zeros((languages + 1, len(held)), bool)
    allowed[-1] = True
    allowed[order[0], docs] = True
    best, score = _em(likely, weight, starts, owner, allowed)
    active = docs
    for size in range(1, languages):
        # Only documents whose last language was worth it, and whose next has a share at all, go on.
        active = active[share[order[size, active], active] > TOLERANCE]
        if not len(active):
            break
        wider = allowed[:, active]
        wider[order[size, active], np.arange(len(active))] = True
        own = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in active.tolist()])
        lengths = np.array(sizes)[active]
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        mixed, gained = _em(likely[:, own], weight[own], begin, np.repeat(np.arange(len(active)), lengths), wider)
        better = gained - score[active] > PENALTY * np.log(total[active] + 1)
        active = active[better]
        best[:, active], score[active], allowed[:, active] = mixed[:, better], gained[better], wider[:, better]
    top = best[:-1].argmax(axis=0)
    for place, doc in enumerate(held):
        chosen = [(model.names[lang], float(best[lang, place])) for lang in np.flatnonzero(allowed[:-1, place]).tolist()]
        out[doc] = (model.names[top[place]], min(1.0, float(best[top[place], place])), chosen)


def _em(likely, weight, starts, owner, allowed) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (components by documents) among the allowed components, and the log-likelihoods."""
    share = allowed / allowed.sum(axis=0)
    total = np.add.reduceat(weight, starts)
    used = np.flatnonzero(allowed.any(axis=1))
    for _ in range(ROUNDS):
        joint = likely[used] * share[used][:, owner]
        joint *= weight / joint.sum(axis=0)
        fresh = np.zeros_like(share)
        fresh[used] = np.add.reduceat(joint, starts, axis=1) / total
        moved = np.abs(fresh - share).max()
        share = fresh
        if moved < TOLERANCE:
            break
    mixed = (likely[used] * share[used][:, owner]).sum(axis=0)
    return share, np.add.reduceat(weight * np.log(mixed), starts)
