"""Benchmark decontamination: greedy string tiling of documents against benchmark items."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.frames import slices, stored, texts
from footfall.llm.words import blocks, window_hashes, word_hashes

# Words of a seed, and of the shortest tile.
MIN_MATCH = 5
# Share of an item's words that tiles must cover.
COVERAGE = 0.5
# Bits of the filter that keeps seeds of no item from being shuffled: 4 MB, whatever the benchmark's size.
FILTER_BITS = 1 << 25
_BUCKET = 32_768  # bits of one `bitmap_construct_agg`

_MATCHES = "doc_id long, version long, item long, item_id long, n_words int, covered int, n_tiles int"


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
) -> DataFrame:
    """``doc_id``, ``version``, ``item_id``, ``coverage``, ``n_tiles`` for every item that a document holds.

    Words are runs of ASCII letters and digits and of characters outside ASCII, lower-cased. Tiles are the
    longest common runs of at least ``min_match`` words, marked greedily without overlap, so passages in
    another order still count; an item leaks when tiles cover at least ``coverage`` of its words.

    Items with equal texts are one item with the smallest id. Items of fewer than ``min_match`` words, NULL
    and empty texts never match; NULL ids are kept as they are; ``version`` (``xxhash64`` of the text) tells
    rows with equal ids apart.
    """
    items = stored(
        texts(benchmark, item_id_col, item_text_col)
        .where("text IS NOT NULL")
        .groupBy(F.xxhash64("text").alias("item"))
        .agg(F.min("doc_id").alias("item_id"), F.first("text").alias("text"))
        .mapInArrow(_item_words(min_match), "item long, item_id long, words array<long>, seeds array<struct<seed:long,place:int>>"),
        "benchmark-items",
    )
    seeds = items.select("item", F.explode("seeds").alias("s")).select("item", "s.seed", "s.place")
    keep = docs.sparkSession.sparkContext.broadcast(_filter(seeds))
    found = (
        texts(docs, id_col, text_col)
        .where("text IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("version"), "text")
        .mapInArrow(_doc_seeds(min_match, keep), "doc_id long, version long, seed long, places array<int>")
    )
    first = seeds.groupBy("item", "seed").agg(F.min("place").alias("place"))
    shared = (
        found.join(first, "seed")
        .groupBy("doc_id", "version", "item")
        .agg(F.collect_list(F.struct("place", "places")).alias("matches"))
    )
    tiled = shared.join(items.select("item", "item_id", "words"), "item").select(
        "doc_id", "version", "item", "item_id", "words", "matches"
    )
    return (
        tiled.mapInArrow(_tile(min_match), _MATCHES)
        .select("doc_id", "version", "item_id", (F.col("covered") / F.col("n_words")).alias("coverage"), "n_tiles")
        .where(F.col("coverage") >= coverage)
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an item, all columns as they are."""
    bad = stored(
        leaks(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("k_doc"), F.col("version").alias("k_version")).distinct(),
        "leaks",
    )
    whole = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col(text_col).cast("binary")).alias("version"))
    match = F.col("doc")[id_col].eqNullSafe(F.col("k_doc")) & (F.col("version") == F.col("k_version"))
    return whole.join(bad, match, "left_anti").select("doc.*")


def _lower(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def _item_words(min_match: int):
    shape = pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, seeds = [], []
            for text in batch.column("text").to_pylist():
                hashes = word_hashes(_lower(text))[2]
                words.append(hashes.view(np.int64).tolist())
                runs = window_hashes(hashes, min_match).view(np.int64).tolist()
                seeds.append([{"seed": seed, "place": place} for place, seed in enumerate(runs)])
            yield pa.record_batch(
                [batch.column("item"), batch.column("item_id"), pa.array(words, pa.list_(pa.int64())), pa.array(seeds, shape)],
                names=["item", "item_id", "words", "seeds"],
            )

    return rows


def _filter(seeds: DataFrame) -> np.ndarray:
    """One bit for each seed, packed; built by Spark in buckets, so the driver gets at most FILTER_BITS."""
    bit = F.pmod("seed", F.lit(FILTER_BITS))
    parts = (
        seeds.select((bit / _BUCKET).cast("int").alias("bucket"), F.pmod(bit, F.lit(_BUCKET)).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    packed = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in parts:
        packed[bucket * _BUCKET // 8 :][: _BUCKET // 8] = np.frombuffer(bytes(bits), np.uint8)
    return packed


def _doc_seeds(min_match: int, keep):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = keep.value
        for batch in slices(batches):
            every = [_lower(t) for t in batch.column("text").to_pylist()]
            for first, last in blocks(every):
                part = every[first:last]
                starts, _, hashes = word_hashes(b"\n".join(part))
                seeds = window_hashes(hashes, min_match)
                if not len(seeds):
                    continue
                bits = (seeds & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                hit = np.flatnonzero(packed[bits >> 3] >> (bits & 7).astype(np.uint8) & 1)
                if not len(hit):
                    continue
                # Runs that begin in one text and end in the next are none.
                text_at = np.cumsum([0] + [len(t) + 1 for t in part])
                owner = np.searchsorted(text_at, starts[hit], "right") - 1
                same = owner == np.searchsorted(text_at, starts[hit + min_match - 1], "right") - 1
                hit, owner = hit[same], owner[same]
                word_at = np.searchsorted(starts, text_at[:-1])
                places: dict[tuple[int, int], list[int]] = defaultdict(list)
                for own, seed, place in zip(owner.tolist(), seeds[hit].view(np.int64).tolist(), (hit - word_at[owner]).tolist()):
                    places[own, seed].append(place)
                if not places:
                    continue
                owners = pa.array([first + own for own, _ in places])
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(owners),
                        batch.column("version").take(owners),
                        pa.array([seed for _, seed in places], pa.int64()),
                        pa.array(list(places.values()), pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "version", "seed", "places"],
                )

    return rows


def _tile(min_match: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, covered, counts = [], [], []
            for words, matches in zip(batch.column("words").to_pylist(), batch.column("matches").to_pylist()):
                # The document's words wherever it shares a seed, as the item's own words tell them.
                known: dict[int, int] = {}
                for match in matches:
                    run = words[match["place"] : match["place"] + min_match]
                    for place in match["places"]:
                        known.update(zip(range(place, place + min_match), run))
                sequence: list[int | None] = []
                last = None
                for place in sorted(known):
                    if last is not None and place != last + 1:
                        sequence.append(None)
                    sequence.append(known[place])
                    last = place
                tiles = greedy_string_tiling(sequence, words, min_match)
                sizes.append(len(words))
                covered.append(sum(length for _, _, length in tiles))
                counts.append(len(tiles))
            yield pa.record_batch(
                [batch.column(c) for c in ("doc_id", "version", "item", "item_id")] + [pa.array(x, pa.int32()) for x in (sizes, covered, counts)],
                names=["doc_id", "version", "item", "item_id", "n_words", "covered", "n_tiles"],
            )

    return rows


def greedy_string_tiling(text: list[int | None], pattern: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in pattern, length), longest first, no word in two tiles.

    Each round takes the length of the longest common run of unmarked words. For that length, running
    Karp-Rabin hashes of the text's unmarked runs are looked up among the pattern's; matches are compared
    word by word and marked, earliest first. ``None`` in the text matches nothing.
    """
    text_free, pattern_free = [w is not None for w in text], [True] * len(pattern)
    tiles: list[tuple[int, int, int]] = []
    while (length := _longest(text, text_free, pattern, pattern_free)) >= min_match:
        table: dict[int, list[int]] = defaultdict(list)
        for place, value in _running_hashes(pattern, pattern_free, length):
            table[value].append(place)
        for place, value in list(_running_hashes(text, text_free, length)):
            if not all(text_free[place : place + length]):
                continue
            for at in table.get(value, ()):
                if all(pattern_free[at : at + length]) and text[place : place + length] == pattern[at : at + length]:
                    text_free[place : place + length] = pattern_free[at : at + length] = [False] * length
                    tiles.append((place, at, length))
                    break
    return tiles


_MODULUS = (1 << 61) - 1
_RADIX = 1_000_003


def _running_hashes(words: list[int | None], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin hashes of all runs of ``length`` free words."""
    drop = pow(_RADIX, length - 1, _MODULUS)
    value = run = 0
    for i, word in enumerate(words):
        if not free[i] or word is None:
            value = run = 0
            continue
        if run == length:
            value -= words[i - length] * drop
        else:
            run += 1
        value = (value * _RADIX + word) % _MODULUS
        if run == length:
            yield i - length + 1, value


def _longest(text: list[int | None], text_free: list[bool], pattern: list[int], pattern_free: list[bool]) -> int:
    """The length of the longest common run of free words, by bisection."""
    low, high = 0, min(len(text), len(pattern))
    while low < high:
        middle = (low + high + 1) // 2
        known = defaultdict(list)
        for place, value in _running_hashes(pattern, pattern_free, middle):
            known[value].append(place)
        if known and any(
            text[place : place + middle] == pattern[at : at + middle]
            for place, value in _running_hashes(text, text_free, middle)
            for at in known.get(value, ())
        ):
            low = middle
        else:
            high = middle - 1
    return low
