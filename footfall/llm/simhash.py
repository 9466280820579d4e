"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.components import connected_components
from footfall.llm.frames import slices, stored, texts

# Shingle hashes whose bits are counted at a time.
HASH_BLOCK = 1 << 17
# Node pairs that the trie join holds at a time, and fingerprints of whole groups that it takes at a time.
PAIR_BLOCK = 1 << 18
GROUP_BLOCK = 1 << 16
# Fingerprints sharing a block beyond which the rest is cut into blocks once more.
GROUP_ROWS = 4_096


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id``, ``version`` (``xxhash64`` of the text) and the 64-bit ``fingerprint`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; shingles are all runs of ``width``
    words, repeats included (fewer words: the whole sequence). A bit is 1 if more than half of the shingles'
    XXH64 (seed 42) have it. NULL, empty and blank texts have fingerprint zero; a NULL id stays NULL.
    """
    rows = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("version"), "text")
    return rows.mapInArrow(_fingerprint_rows(width), "doc_id long, version long, fingerprint long")


def near_fingerprints(prints: DataFrame, budget: int = 2) -> DataFrame:
    """All pairs ``a < b`` of distinct ``fingerprint`` values that differ in at most ``budget`` bits, each once.

    Of ``budget + 1`` blocks of bits, one is equal in any such pair; so every fingerprint goes once per block
    to the group of its block value. In each task the groups form a forest of binary tries. The self-join
    walks node pairs together, a bit a level, adds up the differing bits and drops a pair of nodes once they
    exceed the budget. A group of more than GROUP_ROWS fingerprints is cut by blocks of its remaining bits,
    and again: after two such steps at most ``2 ** 20`` values can share a group, so its size is bounded.
    """
    distinct = prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
    open_groups = distinct.select("fingerprint", F.lit(0).cast("long").alias("mask"))
    joined = None
    for depth in range(3):
        cut = open_groups.mapInArrow(_cut(budget + 1), "fingerprint long, mask long, block long")
        if depth < 2:
            cut = stored(cut, "simhash-blocks")
            crowded = stored(
                cut.groupBy("mask", "block").count().where(F.col("count") > GROUP_ROWS).select("mask", "block"), "simhash-crowded"
            )
            open_groups = cut.join(crowded, ["mask", "block"], "left_semi").select("fingerprint", "mask")
            cut = cut.join(crowded, ["mask", "block"], "left_anti").select("fingerprint", "mask", "block")
        pairs = (
            cut.repartition("mask", "block")
            .sortWithinPartitions("mask", "block")
            .mapInArrow(_trie_join(budget), "a long, b long")
        )
        joined = pairs if joined is None else joined.unionByName(pairs)
    return joined.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """``doc_id``, ``version``, ``fingerprint``, ``component_id`` of every row.

    ``component_id`` is the smallest id reachable by links of fingerprints that differ in at most ``budget``
    bits, the row's own included; equal fingerprints link. A NULL id joins its component without naming it
    (the component is NULL if it has no other id). Repeated rows come back as often as they are.
    """
    prints, members = _grouped(docs, id_col, text_col, width, budget)
    return prints.join(members, "fingerprint").select("doc_id", "version", "fingerprint", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """The stored fingerprints of all rows, and the component of each distinct fingerprint."""
    prints = stored(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    classes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "simhash-classes")
    return prints, members(classes, near_fingerprints(classes, budget))


def members(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``fingerprint``, ``root``, ``component_id`` of stored ``classes`` (``fingerprint``, ``low`` id) under ``links`` (``a``, ``b``).

    Only the root tells components apart: if an id repeats, it may be the smallest of several components.
    """
    roots = connected_components(links)
    rooted = stored(
        classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
            "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root")
        ),
        "simhash-roots",
    )
    # Stored, so that the join shuffles both sides and can split the rows of a large component.
    lows = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lows")
    return stored(rooted.join(lows, "root").select("fingerprint", "root", "component_id"), "simhash-members")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest id (then of the smallest text hash).

    Rows that are equal in id and text are one row. Where no row of a component has an id, one row of each
    of its fingerprints stays.
    """
    return first_of_each(docs, *_grouped(docs, id_col, text_col, width, budget), id_col, text_col)


def first_of_each(docs: DataFrame, prints: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that `one_of_each` keeps, by the ``fingerprint`` of each row and the ``root`` of each fingerprint."""
    # Rows of one fingerprint meet in map tasks first and are one row when they meet their component.
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "version")
    chosen = stored(
        prints.groupBy("fingerprint")
        .agg(F.min(rank).alias("low"))
        .join(members, "fingerprint")
        .groupBy("root", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("alone"))
        .agg(F.min("low").alias("low"))
        .select(F.col("low.doc_id").alias("k_doc"), F.col("low.version").alias("k_version")),
        "simhash-chosen",
    )
    whole = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("own"), F.xxhash64(F.col(text_col).cast("binary")).alias("version"))
    match = F.col("own").eqNullSafe(F.col("k_doc")) & (F.col("version") == F.col("k_version"))
    kept = whole.join(chosen, match)
    return kept.groupBy("own", "version").agg(F.first("doc").alias("doc")).select("doc.*")


def _fingerprint_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [_fingerprint(text, width) for text in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("version"), pa.array(np.array(values, np.uint64).view(np.int64))],
                names=["doc_id", "version", "fingerprint"],
            )

    return rows


def _fingerprint(text: bytes | None, width: int) -> int:
    words = text.lower().split() if text else []  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), HASH_BLOCK):
        pieces = zip(starts[at : at + HASH_BLOCK].tolist(), ends[at : at + HASH_BLOCK].tolist())
        hashes = np.array([hashed(joined[s:e], 42) for s, e in pieces], "<u8")
        ones += _bit_counts(hashes)
    over = (ones * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return counts


def _free_blocks(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` blocks of about equal size, high bits first."""
    free = [bit for bit in range(63, -1, -1) if not mask >> bit & 1]
    return [sum(1 << bit for bit in part.tolist()) for part in np.array_split(np.array(free), parts)]


def _cut(parts: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fingerprint").to_numpy(zero_copy_only=False)
            masks = batch.column("mask").to_numpy(zero_copy_only=False)
            for mask in np.unique(masks):
                own = values[masks == mask]
                for block in _free_blocks(int(mask), parts):
                    wider = np.array([int(mask) & 2**64 - 1 | block], np.uint64).view(np.int64)[0]
                    yield pa.record_batch(
                        [pa.array(own), pa.array(np.full(len(own), wider)), pa.array(own & wider)],
                        names=["fingerprint", "mask", "block"],
                    )

    return cut


def _trie_join(budget: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("fingerprint", "mask", "block")))
            rows += batch.num_rows
            if rows >= GROUP_BLOCK:
                values, masks, blocks = (np.concatenate(x) for x in zip(*held))
                # The last group may go on in the next batch.
                same = (masks == masks[-1]) & (blocks == blocks[-1])
                cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
                yield from _linked(values[:cut], masks[:cut], blocks[:cut], budget)
                held, rows = [(values[cut:], masks[cut:], blocks[cut:])], len(values) - cut
        if rows:
            yield from _linked(*(np.concatenate(x) for x in zip(*held)), budget)

    return join


def _linked(values: np.ndarray, masks: np.ndarray, blocks: np.ndarray, budget: int) -> Iterator[pa.RecordBatch]:
    if not len(values):
        return
    keys = values.view(np.uint64)
    group = np.concatenate(([0], np.cumsum((masks[1:] != masks[:-1]) | (blocks[1:] != blocks[:-1]))))
    order = np.lexsort((keys, group))
    keys, group = keys[order], group[order]
    # Groups cut in another order may meet in the same bits; a fingerprint counts once.
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])))
    keys, group = keys[fresh], group[fresh]
    ends = np.flatnonzero(np.concatenate((group[1:] != group[:-1], [True]))) + 1
    starts = np.concatenate(([0], ends[:-1]))
    crowd = ends - starts > 1
    for left, right in trie_self_join(keys, starts[crowd], ends[crowd], budget):
        left, right = keys[left].view(np.int64), keys[right].view(np.int64)
        yield pa.record_batch([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["a", "b"])


def trie_self_join(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of keys within one group that differ in at most ``budget`` bits.

    ``keys`` are distinct and ascending within each group ``[start, end)``: a node of the group's binary trie
    is then a range of places. A pair of nodes is (low1, high1, low2, high2, level, differing bits so far).
    Pairs are split level by level, at most PAIR_BLOCK at a time, the others wait on a stack.
    """
    zeros = np.zeros(len(starts), np.int64)
    stack = [np.stack([starts, ends, starts, ends, zeros + 63, zeros])]
    while stack:
        nodes = stack.pop()
        if nodes.shape[1] > PAIR_BLOCK:
            stack.append(nodes[:, PAIR_BLOCK:])
            nodes = nodes[:, :PAIR_BLOCK]
        lo1, hi1, lo2, hi2, level, cost = nodes
        if not nodes.shape[1]:
            continue
        # A pair of leaves is decided by its keys' remaining bits.
        leaf = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        a, b = lo1[leaf], lo2[leaf]
        near = (np.bitwise_count(keys[a] ^ keys[b]) <= budget) & (a != b)
        if near.any():
            yield a[near], b[near]
        lo1, hi1, lo2, hi2, level, cost = nodes[:, ~leaf]
        if not len(lo1):
            continue
        mid1, mid2 = _split(keys, lo1, hi1, level), _split(keys, lo2, hi2, level)
        own = (lo1 == lo2) & (hi1 == hi2)
        kids = [
            (lo1, mid1, lo2, mid2, cost, None),
            (mid1, hi1, mid2, hi2, cost, None),
            (lo1, mid1, mid2, hi2, cost + 1, None),
            (mid1, hi1, lo2, mid2, cost + 1, ~own),  # of a node with itself the mirror image is left out
        ]
        fresh = []
        for p, q, r, s, c, also in kids:
            good = (q > p) & (s > r) & (c <= budget) & ~((p == r) & (q == s) & (q - p == 1))
            if also is not None:
                good &= also
            fresh.append(np.stack([p, q, r, s, level - 1, c])[:, good])
        stack.append(np.concatenate(fresh, axis=1))


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each range of keys that agree above ``level``, the first place whose bit ``level`` is 1."""
    lo, hi = lo.copy(), hi.copy()
    shift = level.astype(np.uint64)
    while (open_ := lo < hi).any():
        middle = (lo + hi) // 2
        one = keys[np.minimum(middle, len(keys) - 1)] >> shift & np.uint64(1) == 1
        hi = np.where(open_ & one, middle, hi)
        lo = np.where(open_ & ~one, middle + 1, lo)
    return lo
