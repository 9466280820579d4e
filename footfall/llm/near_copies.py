"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, by SimHash, then by a prefix join.

SimHash fingerprints of the shingles link most copies; their pairs are checked exactly. Similar sets can differ in
many more bits than fingerprints can be joined on, so what they do not join is found by a prefix join.

Shingles go through one exchange, in which only the smallest and largest set of each is kept; what follows meets
no more than the shingles that two sets share, the sets that may be similar by what is known of them, and the
documents of groups with more than one row. Bit filters of fixed size, built in Spark, keep the rest where
it is, texts above all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from footfall.llm.components import connected_components
from footfall.llm.decontaminate import FILTER_BITS, _filter
from footfall.llm.frames import forget, slices, small_batches, stored, texts
from footfall.llm.simhash import _bit_counts, members, near_fingerprints
from footfall.llm.words import window_hashes, word_hashes

WIDTH = 5
# Bits in which SimHash fingerprints of likely copies differ at most.
SIMHASH_BITS = 3
# Similarity as a fraction.
SIMILAR, OF = 4, 5
# Shingles that COMMON of about SAMPLE documents hold, and the most common ones of these, are looked up last.
# This is a hint: no pair depends on it.
SAMPLE, COMMON, MOST = 20_000, 4, 500_000
# How often each set is compared with one other before all pairs that are left are. The result does not depend on it.
ROUNDS = 2
# Longs of a set's sketch.
SKETCH = 8

# All bytes but the blanks that `bytes.split` knows.
_WORD_BYTES = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, the one of the smallest id (then of the smallest text hash).

    Groups are the connected components of pairs with a Jaccard similarity of ``SIMILAR / OF`` or more. NULL
    and blank texts are copies of each other. Rows that are equal in id and text are one row. A row without an id
    stays only where no row of its group has one.
    """
    small_batches(docs.sparkSession)
    prints = prefixes(docs, id_col, text_col)
    classes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "near-classes")
    return first_of_groups(docs, prints, members(classes, links(docs, prints, id_col, text_col)), id_col, text_col)


def first_of_groups(docs: DataFrame, prints: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that `one_of_each` keeps, by the ``fingerprint`` of each row and the ``root`` of each fingerprint.

    Rows that are alone in their group stay where they are; only those that the filter of all others lets pass
    are looked up.
    """
    rows = prints.select("doc_id", "version", "fingerprint").join(members, "fingerprint")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "version")
    # Rows of one group meet in map tasks first and are one row in the exchange.
    groups = rows.groupBy("root").agg(F.min(rank).alias("low"), F.count("*").alias("size"))
    groups = stored(groups.where("size > 1"), "near-groups")
    crowded = rows.join(groups.select("root"), "root")
    special = stored(crowded.select("doc_id", "version").distinct(), "near-special")
    row_hash = F.xxhash64("doc_id", "version")
    passed = _passes(docs.sparkSession.sparkContext.broadcast(_filter(special.select(row_hash.alias("seed")))))

    whole = docs.select(
        F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("binary")).alias("version")
    ).withColumn("hit", passed(row_hash))
    untouched = whole.where(~F.col("hit")).select("doc.*")
    looked_at = whole.where("hit").drop("hit")
    kept = groups.select(F.col("low.doc_id").alias("k_doc"), F.col("low.version").alias("k_version"))
    named = special.select(F.col("doc_id").alias("k_doc"), F.col("version").alias("k_version"))
    match = F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("version") == F.col("k_version"))
    others = looked_at.join(named, match, "left_anti").select("doc.*")
    chosen = looked_at.join(kept.distinct(), match).groupBy("doc_id", "version").agg(F.first("doc").alias("doc")).select("doc.*")
    return untouched.unionByName(others).unionByName(chosen)


def _passes(shared: Broadcast):
    """A look at a bit filter; only hashes go to Python, the rest of a row stays."""

    @F.arrow_udf("boolean")
    def passes(hashes: pa.Array) -> pa.Array:
        return pa.array(_bit(shared.value, hashes.to_numpy().view(np.uint64)))

    return passes


def _bit(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = (values & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (packed[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's distinct runs of ``width`` words, ascending (fewer words: the whole sequence is one)."""
    if not text or not text.strip():
        return np.zeros(0, np.uint64)
    words = word_hashes(text.lower(), _WORD_BYTES)[2]
    return np.unique(window_hashes(words, min(width, len(words))))


def prefixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored: ``doc_id``, ``version``, ``fingerprint`` (a hash of the shingle set), its ``simhash``, ``size``, ``sketch`` and first ``keys``.

    All sets are put in one order, common shingles last. Two sets whose similarity is 4/5 or more share 4/5 of
    either's shingles, so they share one of the first ``size - ceil(4/5 size) + 1`` of either.
    """
    spark = docs.sparkSession
    whole = texts(docs, id_col, text_col)
    share = min(1.0, SAMPLE / max(1, docs.count()))
    lot = F.pmod(F.xxhash64("doc_id", "text", F.lit("common")), F.lit(1_000_000))
    counted = whole.where(lot < round(share * 1_000_000)).select("text").mapInArrow(_shingle_rows, "key long").groupBy("key").count()
    counted = counted.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(MOST)
    common = counted.select("key").toArrow().column("key").to_numpy()
    shared = spark.sparkContext.broadcast(np.sort(common.view(np.uint64)))
    rows = whole.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(
        _prefix_rows(shared), "doc_id long, version long, fingerprint long, simhash long, size int, sketch array<long>, rare int, keys array<long>"
    )
    return stored(rows, "near-prefixes")


def links(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a``, ``b``: pairs of shingle sets that are similar, enough of them to join all that belong together.

    First, sets whose SimHash fingerprints are near are compared, see `simhash_pairs`. Then those that share a prefix key,
    which any similar sets do: ``ROUNDS`` times, each is compared with one other: of the smallest sets of its keys,
    that it is not joined with, the one it shares most keys with. Then all pairs of a key that are not of one
    component by now and whose sketches may be those of similar sets. What is left out would join no components.
    """
    spark = docs.sparkSession
    keys = prints.select("fingerprint", F.explode("keys").alias("key"))
    met = stored(
        keys.groupBy("key").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).where("low <> high").select("key", "low"),
        "near-keys",
    )
    shared = spark.sparkContext.broadcast(_filter(met.select(F.col("key").alias("seed"))))
    some = prints.select("fingerprint", "size", "keys").mapInArrow(_keys_in(shared), "key long, fingerprint long, size int, place int")
    held = stored(some.join(met, "key").distinct(), "near-held")
    forget(met)
    tried = stored(simhash_pairs(prints), "near-tried")
    found = stored(_similar(tried, docs, prints, id_col, text_col), "near-links")
    # Each time, most of a large group is joined. Then all pairs of what is left.
    open_ = _open_keys(held, found)
    for _ in range(ROUNDS):
        lows = open_.groupBy("key").agg(F.min(F.struct("fingerprint", "root")).alias("low"))
        others = open_.join(lows, "key").where("root <> low.root").select(F.col("fingerprint").alias("b"), F.col("low.fingerprint").alias("a"))
        others = stored(_best(others.join(tried, ["a", "b"], "left_anti").groupBy("b", "a")), "near-tried")
        found = stored(found.unionByName(_similar(others, docs, prints, id_col, text_col)), "near-links")
        tried = stored(tried.unionByName(others), "near-tried")
        forget(open_)
        open_ = _open_keys(held, found)
    forget(held)
    asked = open_.select("fingerprint").distinct()
    sketches = prints.select("fingerprint", "sketch").join(asked, "fingerprint", "left_semi").dropDuplicates(["fingerprint"])
    sketched = stored(open_.join(sketches, "fingerprint"), "near-sketched")
    forget(open_)
    a, b = (sketched.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("fingerprint", "size", "place", "root", "sketch")]) for side in "ab")
    near = (F.col("fingerprint_a") < F.col("fingerprint_b")) & (F.col("root_a") != F.col("root_b"))
    pairs = a.join(b, "key").where(near & _sizes_fit("size_a", "size_b") & _places_fit() & _sketches_fit())
    pairs = pairs.select(F.col("fingerprint_a").alias("a"), F.col("fingerprint_b").alias("b")).distinct()
    pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
    last = stored(_similar(pairs, docs, prints, id_col, text_col), "near-links")
    forget(sketched, pairs, tried)
    return found.unionByName(last)


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """``a``, ``b``: sets whose SimHash fingerprints differ in at most ``SIMHASH_BITS`` bits.

    Of the sets of one fingerprint, each is with the smallest; of each fingerprint, the smallest set is with that of
    the smallest near fingerprint.
    """
    values = prints.select("simhash", "fingerprint").distinct()
    lows = stored(values.groupBy("simhash").agg(F.min("fingerprint").alias("low")), "near-simhash")
    near = near_fingerprints(lows.select(F.col("simhash").alias("fingerprint")), SIMHASH_BITS).groupBy("b").agg(F.min("a").alias("a"))
    for side in "ab":
        near = near.join(lows.select(F.col("simhash").alias(side), F.col("low").alias(f"low_{side}")), side)
    equal = values.join(lows, "simhash").where("fingerprint <> low").select(F.col("low").alias("low_a"), F.col("fingerprint").alias("low_b"))
    pairs = near.select("low_a", "low_b").unionByName(equal)
    return pairs.select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b")).distinct()


def _best(candidates: GroupedData) -> DataFrame:
    """``a``, ``b``: for every set ``b`` the one ``a`` that it shares most keys with."""
    counted = candidates.agg(F.count("*").alias("n")).groupBy("b").agg(F.max(F.struct("n", "a")).alias("best"))
    return counted.select(F.col("best.a").alias("a"), "b")


def _open_keys(held: DataFrame, links: DataFrame) -> DataFrame:
    """Stored: the rows of ``held`` whose key has sets of several components by now, each with its ``root``."""
    roots = connected_components(links).withColumnRenamed("node", "fingerprint")
    rooted = held.select("key", "fingerprint", "size", "place").join(roots, "fingerprint", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "fingerprint")), "near-rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("key")
    open_ = stored(rooted.join(stored(several, "near-several"), "key", "left_semi"), "near-open")
    forget(rooted)
    return open_


def _places_fit() -> Column:
    """Whether enough of both sets comes at and after the places of their key.

    At the first key two sets share, all they share lies there or later; similar sets share at least
    4/9 of both sizes together, so at that key this holds.
    """
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    return left * (OF + SIMILAR) >= (F.col("size_a") + F.col("size_b")) * SIMILAR


def _sketches_fit() -> Column:
    """Whether the sketches differ in few enough bits.

    Shared shingles cancel out, each of the others turns one bit at most; of similar sets, at most a ninth of
    both sizes together are others.
    """
    differing = sum(F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH))
    return differing * (OF + SIMILAR) <= (F.col("size_a") + F.col("size_b")) * (OF - SIMILAR)


def _sizes_fit(a: str, b: str):
    return F.least(a, b) * OF >= F.greatest(a, b) * SIMILAR


def _sets(docs: DataFrame, prints: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole shingle sets of the fingerprints in ``asked``, each computed from one of its texts."""
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "version")
    rows = prints.join(asked, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min(rank).alias("low"))
    rows = stored(rows.select("fingerprint", F.col("low.doc_id").alias("k_doc"), F.col("low.version").alias("k_version")), "near-texts")
    seeds = rows.select(F.xxhash64("k_doc", "k_version").alias("seed"))
    passed = _passes(docs.sparkSession.sparkContext.broadcast(_filter(seeds)))
    match = F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("version") == F.col("k_version"))
    found = texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    # An exchange after the filter: a task with two steps in Python has two workers, and both stay when it ends.
    found = found.where(passed(F.xxhash64("doc_id", "version"))).join(rows.hint("merge"), match).select("fingerprint", "text")
    return stored(found.mapInArrow(_set_rows, "fingerprint long, hashes binary").dropDuplicates(["fingerprint"]), "near-sets")


def _asked(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(F.col("a").alias("fingerprint")).union(pairs.select("b")).distinct(), "near-asked")


def _with_both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("fingerprint").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _similar(pairs: DataFrame, docs: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those of the ``pairs`` whose sets have the similarity.

    Pairs of unfitting sizes go first, then those whose prefixes share too little; whole sets are computed for
    what is left.
    """
    sizes = prints.select("fingerprint", "size").distinct()
    fitting = stored(_with_both(pairs, sizes, "size").where(_sizes_fit("size_a", "size_b")).select("a", "b"), "near-fitting")
    asked = _asked(fitting)
    shared = docs.sparkSession.sparkContext.broadcast(_filter(asked.select(F.col("fingerprint").alias("seed"))))
    known = prints.select("fingerprint", "size", "rare", "keys").mapInArrow(_sets_in(shared), "fingerprint long, size int, rare int, keys binary")
    known = stored(known.join(asked, "fingerprint", "left_semi").dropDuplicates(["fingerprint"]), "near-known")
    likely = stored(_with_both(fitting, known, "size", "rare", "keys").mapInArrow(_likely, "a long, b long"), "near-likely")
    forget(known, asked, fitting)
    asked = _asked(likely)
    sets = _sets(docs, prints, asked, id_col, text_col)
    return _with_both(likely, sets, "hashes").mapInArrow(_compared, "a long, b long").distinct()


def _keys_in(shared: Broadcast):
    """Rows for the keys that pass the filter, a set once a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            lists = batch.column("keys")
            flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            hits = _bit(shared.value, flat.view(np.uint64))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            prints = batch.column("fingerprint").to_numpy()
            fresh = np.zeros(batch.num_rows, bool)
            for row, fingerprint in enumerate(prints.tolist()):
                fresh[row] = fingerprint not in seen
                seen.add(fingerprint)
            hit = np.flatnonzero(hits & fresh[owner])
            own = owner[hit]
            columns = [flat[hit], prints[own], batch.column("size").to_numpy()[own], (hit - at[own]).astype(np.int32)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["key", "fingerprint", "size", "place"])

    return rows


def _sets_in(shared: Broadcast):
    """The sets whose fingerprint passes the filter, with their prefix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_bit(shared.value, batch.column("fingerprint").to_numpy().view(np.uint64))))
            texts = [keys.values.to_numpy().tobytes() for keys in batch.column("keys")]
            columns = [*(batch.column(c) for c in ("fingerprint", "size", "rare")), pa.array(texts, pa.binary())]
            yield pa.record_batch(columns, names=["fingerprint", "size", "rare", "keys"])

    return rows


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may be similar by their prefixes."""
    for batch in batches:
        good = []
        for size_a, rare_a, keys_a, size_b, rare_b, keys_b in zip(*(batch.column(f"{c}_{s}").to_pylist() for s in "ab" for c in ("size", "rare", "keys"))):
            most = most_shared(np.frombuffer(keys_a, np.uint64), rare_a, size_a, np.frombuffer(keys_b, np.uint64), rare_b, size_b)
            good.append(most * (OF + SIMILAR) >= (size_a + size_b) * SIMILAR)
        kept = batch.filter(pa.array(good, pa.bool_()))
        yield pa.record_batch([kept.column("a"), kept.column("b")], names=["a", "b"])


def most_shared(a: np.ndarray, rare_a: int, size_a: int, b: np.ndarray, rare_b: int, size_b: int) -> int:
    """An upper limit of what two sets share, by prefixes in one order: rare shingles first, then common ones, each ascending.

    Up to the end of the prefix that ends first in that order, both sets are known, and so is what they share; of
    the rest, they share no more than the smaller rest.
    """
    if not len(a) or not len(b):
        return min(size_a, size_b)
    ends = min((rare < len(keys), keys[-1]) for keys, rare in ((a, rare_a), (b, rare_b)))

    def known(keys: np.ndarray, rare: int) -> int:
        at, own = (rare, keys[rare:]) if ends[0] else (0, keys[:rare])
        return at + int(np.searchsorted(own, ends[1], "right"))

    known_a, known_b = known(a, rare_a), known(b, rare_b)
    both = len(np.intersect1d(a[:known_a], b[:known_b], assume_unique=True))
    return both + min(size_a - known_a, size_b - known_b)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.concatenate([shingles(t) for t in batch.column("text").to_pylist()])
        yield pa.record_batch([pa.array(found.view(np.int64))], names=["key"])


def _set_hash(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes())


def simhash(found: np.ndarray) -> int:
    """The 64-bit SimHash fingerprint of a set: a bit is 1 if more than half of the hashes have it."""
    return int(np.packbits(_bit_counts(found) * 2 > len(found), bitorder="little").view("<u8")[0])


def sketch(found: np.ndarray) -> np.ndarray:
    """For each of ``64 * SKETCH`` buckets of hashes one bit: whether the set holds an odd number of them."""
    bucket = (found * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(64 * SKETCH)
    odd = np.bincount(bucket.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in slices(batches):
            nodes, prints, sizes, sketches, rare, keys = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                nodes.append(_set_hash(found))
                prints.append(simhash(found))
                sizes.append(len(found))
                sketches.append(sketch(found))
                first, own = prefix(found, common)
                keys.append(first)
                rare.append(own)
            bounds = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(keys).view(np.int64)))
            ends = pa.array(np.arange(len(sketches) + 1, dtype=np.int32) * SKETCH)
            sketched = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sketches)))
            nodes, prints = (pa.array(np.array(values, np.uint64).view(np.int64)) for values in (nodes, prints))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("version"), nodes, prints, pa.array(sizes, pa.int32()), sketched, pa.array(rare, pa.int32()), lists],
                names=["doc_id", "version", "fingerprint", "simhash", "size", "sketch", "rare", "keys"],
            )

    return rows


def prefix(found: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The first hashes of an ascending set in the order of all sets, and how many of them are rare."""
    count = len(found) - -(-SIMILAR * len(found) // OF) + 1 if len(found) else 0
    if not len(common) or not count:
        return found[:count], count
    last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
    return np.concatenate([found[~last], found[last]])[:count], min(count, int((~last).sum()))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch(
            [batch.column("fingerprint"), pa.array([f.tobytes() for f in found], pa.binary())],
            names=["fingerprint", "hashes"],
        )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        good = []
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("hashes_a", "hashes_b"))):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            good.append(both * OF >= (len(a) + len(b) - both) * SIMILAR)
        kept = batch.filter(pa.array(good, pa.bool_()))
        yield pa.record_batch([kept.column("a"), kept.column("b")], names=["a", "b"])
