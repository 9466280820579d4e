"""Substring dedup: repeated runs of sentences, then repeated runs of words wherever they begin, removed from all documents but the first."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.decontaminate import _filter
from footfall.llm.frames import forget, slices, stored, tasks, texts
from footfall.llm.near_copies import _WORD_BYTES, _passes
from footfall.llm.words import blocks, window_hashes, word_hashes

# A span is the shortest run, from a sentence on or up to its end, with so many sentences and words, or one sentence with so many words.
SPAN_SENTENCES = 2
SPAN_WORDS = 25
# Runs of so many words go wherever they begin; in any of them, the smallest hash of a seed's words is looked up.
RUN_WORDS, SEED_WORDS = 50, 20

_BREAK = re.compile(rb"[.!?]+[ \t\n\x0b\x0c\r]+|\n+")
_SPANS = "key binary, doc_id long, version long, place int, size int"
_CUT = "doc_id long, n_sentences int, n_removed int, n_run_words int, kept binary"
_SPANS_ARROW = pa.schema(
    [("key", pa.binary()), ("doc_id", pa.int64()), ("version", pa.int64()), ("place", pa.int32()), ("size", pa.int32())]
)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = SPAN_SENTENCES, words: int = SPAN_WORDS
) -> DataFrame:
    """``doc_id``, ``version``, ``place``, ``size`` (in sentences) of every span that is not the first of its kind.

    Sentences end at ``.``, ``!`` or ``?`` before white space and at line ends; they compare by their words
    (parted by ASCII white space), A-Z lower-cased. Spans are, from each sentence on and back from each sentence's
    end, the shortest run of at least ``sentences`` sentences and ``words`` words (none where the text ends
    before), and each single sentence of at least ``words`` words. The
    first span of a kind is that of the smallest (id, text hash, place). Repeats within a document count. NULL texts and NULL ids take no part; rows that repeat id and text are one document.

    Spans go by (hash, document, place) to range partitions, so that one passage of a third of all documents
    is cut over many tasks. A task streams its rows and finds all but the first of a run; only the first row of
    a partition waits for the runs that the partitions before end with, one row of each.
    """
    rows = (
        texts(docs, id_col, text_col)
        .where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("version"), "text")
        .mapInArrow(_span_rows(sentences, words), _SPANS)
    )
    return _not_first(rows)


def _not_first(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``version``, ``place``, ``size`` of the rows that are not the first of their key."""
    # Stored, as the ranges are told by a run over all rows before they are dealt.
    rows = stored(rows, "span-rows")
    order = ["key", "doc_id", "version", "place"]
    dealt = rows.repartitionByRange(tasks(rows.sparkSession), *order).sortWithinPartitions(*order)
    runs = stored(dealt.mapInArrow(_stream_runs, _SPANS + ", state string"), "span-runs")
    forget(rows)
    # At most two rows of a partition are not decided within it.
    edges = runs.where("state <> 'repeat'")
    firsts = edges.groupBy("key").agg(F.min(F.struct("doc_id", "version", "place")).alias("first"))
    late = (
        edges.where("state = 'open'").join(F.broadcast(firsts), "key").where(F.struct("doc_id", "version", "place") != F.col("first"))
    )
    columns = ["doc_id", "version", "place", "size"]
    return runs.where("state = 'repeat'").select(columns).unionByName(late.select(columns))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that lose sentences: ``doc_id``, ``n_sentences``, ``n_removed`` and ``kept`` (the text left,
    UTF-8 bytes).

    Sentences go that any repeated span covers, with the white space behind them. See `repeated_spans`.
    """
    return _cut_spans(docs, id_col, text_col, "inner", **options)


def _cut_spans(docs: DataFrame, id_col: str, text_col: str, how: str, **options) -> DataFrame:
    spans = _by_document(repeated_spans(docs, id_col, text_col, **options))
    whole = texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    joined = whole.join(spans, _same_document(), how)
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_sentences int, n_removed int, kept binary")


def _by_document(repeats: DataFrame) -> DataFrame:
    spans = repeats.groupBy("doc_id", "version").agg(F.collect_list(F.struct("place", "size")).alias("spans"))
    return stored(spans, "span-lists").withColumnsRenamed({"doc_id": "k_doc", "version": "k_version"})


def _same_document() -> Column:
    return (F.col("doc_id") == F.col("k_doc")) & (F.col("version") == F.col("k_version"))


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, seed_words: int = SEED_WORDS, **options
) -> DataFrame:
    """Every row of ``docs``: ``doc_id``, ``n_sentences``, ``n_removed``, ``n_run_words`` and ``kept`` (the text left, UTF-8 bytes; NULL for a NULL text).

    First, ``n_removed`` sentences go as in `without_repeats`. Of what is left, all runs of ``run_words`` words go that
    are not the first of their kind, wherever they begin and end: ``n_run_words`` words with the white space behind
    them. Words compare as in sentences; the first is that of the smallest (id, hash of the text left, place). Within
    a document, a run counts as repeated if it does not overlap its first.

    Any run holds a seed, the ``seed_words`` words of the smallest hash in it; documents without a seed that occurs
    twice stay where they are, of others only runs that hold such a seed meet.
    """
    spark = docs.sparkSession
    cut = stored(_cut_spans(docs, id_col, text_col, "left", **options), "span-cut").withColumn("version", F.xxhash64("kept"))
    known = cut.where("doc_id IS NOT NULL AND kept IS NOT NULL").select("doc_id", "version", F.col("kept").alias("text"))
    seeds = stored(known.mapInArrow(_seed_rows(run_words, seed_words), "key long, doc_id long, version long, place int"), "run-seeds")
    often = stored(seeds.groupBy("key").count().where("count > 1").select("key"), "run-often")
    hits = seeds.join(often, "key").groupBy("doc_id", "version").agg(F.collect_set("place").alias("places"))
    hits = stored(hits, "run-hits").withColumnsRenamed({"doc_id": "k_doc", "version": "k_version"})
    passed = _passes(spark.sparkContext.broadcast(_filter(hits.select(F.xxhash64("k_doc", "k_version").alias("seed")))))
    marked = cut.withColumn("hit", passed(F.xxhash64("doc_id", "version")))
    looked_at = stored(marked.where("hit").join(hits, _same_document(), "left").drop("hit", "k_doc", "k_version"), "run-texts")
    rows = looked_at.where("places IS NOT NULL").select("doc_id", "version", F.col("kept").alias("text"), "places")
    rows = stored(rows.mapInArrow(_run_rows(run_words, seed_words), _SPANS), "run-rows")
    own = rows.where("key IS NULL").select("doc_id", "version", "place", "size")
    runs = _by_document(_not_first(rows.where("key IS NOT NULL")).unionByName(own))
    columns = ["doc_id", "n_sentences", "n_removed", "kept"]
    changed = looked_at.drop("places").join(runs, _same_document(), "left").select(*columns, "spans").mapInArrow(_cut_words, _CUT)
    return marked.where("NOT hit").select("doc_id", "n_sentences", "n_removed", F.lit(0).alias("n_run_words"), "kept").unionByName(changed)


def split_sentences(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, lower-cased words) of the sentences; white space and blank sentences go with the one before."""
    out: list[tuple[int, int, list[bytes]]] = []
    start = 0
    for end in [m.end() for m in _BREAK.finditer(text)] + [len(text)]:
        words = text[start:end].lower().split()
        if words:
            out.append((start, end, words))
        elif out:
            out[-1] = (out[-1][0], end, out[-1][2])
        start = end
    return out


def spans_of(text: bytes, sentences: int, words: int) -> Iterator[tuple[bytes, int, int]]:
    """(hash, first sentence, sentences) of every span of a text."""
    found = split_sentences(text)
    digests = [xxhash.xxh3_128_digest(b" ".join(w)) for _, _, w in found]
    lengths = [len(w) for _, _, w in found]
    sums = [0, *accumulate(lengths)]
    # A single sentence may reach the words; a run is the shortest one from its start or to its end.
    runs = {(place, place + 1) for place in range(len(found)) if lengths[place] >= words}
    end = 0
    for place in range(len(found)):
        while end < len(found) and (sums[end] - sums[place] < words or end - place < sentences):
            end += 1
        if sums[end] - sums[place] < words or end - place < sentences:
            break
        runs.add((place, end))
    place = 0
    for end in range(1, len(found) + 1):
        while end - place > sentences and sums[end] - sums[place + 1] >= words:
            place += 1
        if end - place >= sentences and sums[end] - sums[place] >= words:
            runs.add((place, end))
    for place, end in sorted(runs):
        yield xxhash.xxh3_128_digest(b"".join(digests[place:end])), place, end - place


def _span_rows(sentences: int, words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, docs, versions, places, sizes = [], [], [], [], []
            for doc, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text"))):
                for key, place, size in spans_of(text, sentences, words):
                    keys.append(key)
                    docs.append(doc)
                    versions.append(version)
                    places.append(place)
                    sizes.append(size)
            if keys:
                columns = zip((keys, docs, versions, places, sizes), _SPANS_ARROW)
                yield pa.record_batch([pa.array(c, f.type) for c, f in columns], schema=_SPANS_ARROW)

    return rows


def _stream_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition: its first as ``open``, repeats as ``repeat``, the first of its last run as ``head``."""
    schema = _SPANS_ARROW.append(pa.field("state", pa.string()))

    def record(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    head = before = None
    opened = 0
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in _SPANS_ARROW.names)):
            if before is not None and row[0] == before[0]:
                if row != before:  # else the same document once more
                    out.append((*row, "repeat"))
            else:
                head = row
                opened += 1
                if before is None:
                    out.append((*row, "open"))
            before = row
        yield from record(out)
    if opened > 1:
        yield from record([(*head, "head")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        totals, removed, kept = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            sentences = split_sentences(text or b"")
            totals.append(len(sentences))
            if not spans:
                removed.append(0)
                kept.append(text)
                continue
            keep = [True] * len(sentences)
            for span in spans:
                keep[span["place"] : span["place"] + span["size"]] = [False] * span["size"]
            removed.append(keep.count(False))
            kept.append(b"".join([text[s:e] for (s, e, _), k in zip(sentences, keep) if k]))
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(totals, pa.int32()), pa.array(removed, pa.int32()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_sentences", "n_removed", "kept"],
        )


def seeds_of(hashes: np.ndarray, owner: np.ndarray, run: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The places, ascending, and hashes of the smallest seeds of all runs of words of one owner each."""
    if len(hashes) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = window_hashes(hashes, seed) | np.uint64(1)
    width = run - seed + 1
    least = _sliding(np.minimum, own, width)
    least[owner[: len(least)] != owner[run - 1 :]] = 0
    # A seed is the smallest of some run if the greatest of the runs' smallest ones around it is no smaller.
    edge = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, least, edge)), width) == own)
    return places, own[places]


def _sliding(choose: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """What is chosen of each ``width`` neighbours."""
    out, size = values.copy(), 1
    while size < width:
        step = min(size, width - size)
        out = choose(out[:-step], out[step:])
        size += step
    return out


def _seed_rows(run: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = batch.column("text").to_pylist()
            for first, last in blocks(found):
                starts, _, hashes = word_hashes(b"\n".join(found[first:last]).lower(), _WORD_BYTES)
                offsets = np.cumsum([0, *(len(t) + 1 for t in found[first:last])])
                owner = np.searchsorted(offsets, starts, "right") - 1
                places, keys = seeds_of(hashes, owner, run, seed)
                own = owner[places]
                columns = [pa.array(keys.view(np.int64)), *(batch.column(c).take(pa.array(first + own)) for c in ("doc_id", "version")),
                           pa.array((places - np.searchsorted(owner, own)).astype(np.int32))]
                yield pa.record_batch(columns, names=["key", "doc_id", "version", "place"])

    return rows


def runs_of(text: bytes, places: list[int], run: int, seed: int) -> Iterator[tuple[bytes | None, int, int]]:
    """(hash, first word, words) of each kind of run that holds a seed at one of the places, from its first on as far as it overlaps that.

    Later ones are repeats whatever other documents hold; the words they cover come without a hash.
    """
    words = text.lower().split()
    begins = np.zeros(max(0, len(words) - run + 1), bool)
    for place in places:
        begins[max(0, place + seed - run) : place + 1] = True
    found: dict[bytes, list[int]] = {}
    covered = np.zeros(len(words) + 2, np.int8)
    for place in np.flatnonzero(begins).tolist():
        first = found.setdefault(xxhash.xxh3_128_digest(b" ".join(words[place : place + run])), [place, place])
        if place < first[0] + run:
            first[1] = place
        else:
            covered[place + 1 : place + run + 1] = 1
    for key, (place, last) in found.items():
        yield key, place, last + run - place
    edges = np.flatnonzero(np.diff(covered)).tolist()
    for start, end in zip(edges[::2], edges[1::2]):
        yield None, start, end - start


def _run_rows(run: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for doc, version, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text", "places"))):
                found = [(key, doc, version, place, size) for key, place, size in runs_of(text, places, run, seed)]
                if found:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), _SPANS_ARROW)], schema=_SPANS_ARROW)

    return rows


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        gone, kept = [], []
        for text, spans in zip(batch.column("kept").to_pylist(), batch.column("spans").to_pylist()):
            if not spans:
                gone.append(0)
                kept.append(text)
                continue
            starts = word_hashes(text, _WORD_BYTES)[0]
            keep = np.ones(len(starts), bool)
            for span in spans:
                keep[span["place"] : span["place"] + span["size"]] = False
            ends = np.append(starts[1:], len(text)).tolist()
            gone.append(int((~keep).sum()))
            kept.append(text[: starts[0]] + b"".join([text[s:e] for s, e, k in zip(starts.tolist(), ends, keep.tolist()) if k]))
        columns = [*(batch.column(c) for c in ("doc_id", "n_sentences", "n_removed")), pa.array(gone, pa.int32()), pa.array(kept, pa.binary())]
        yield pa.record_batch(columns, names=["doc_id", "n_sentences", "n_removed", "n_run_words", "kept"])
