"""Embedding near-dedup: products of int8 tiles with error bounds, doubtful pairs again in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.components import connected_components
from footfall.llm.frames import stored

# Vectors of a block, which one task holds twice; blocks are smaller while there are fewer than MIN_BLOCKS.
BLOCK_ROWS = 8_192
MIN_BLOCKS = 12
# Rows and columns of one product.
TILE_ROWS, TILE_COLUMNS = 512, 2_048
# Up to so many dimensions, sums of int8 products are exact in single precision.
EXACT_DIMENSIONS = 1_024
# What rounding in double precision may add to a cosine.
SLACK = 1e-12

_ROWS = "cls long, links long, root long"


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row.

    Rows link when the cosine of their vectors, in double precision, is at least ``threshold``; vectors of
    different lengths do not. NULL and zero vectors and those with NULL or non-finite components link with
    nothing and are components of their own. ``n_links`` counts rows, so repeated rows link with each other;
    ``component_id`` is the smallest id reachable (a NULL id names none), ``kept`` whether it is the row's own.

    Equal vectors are one class, found by an aggregate; classes are dealt to blocks of bounded size by a hash
    of their number, and every pair of blocks is one group of a shuffle. Within it tiles are multiplied as
    int8; each vector's quantisation error bounds the error of the product, so that most pairs are decided,
    and the rest is computed in full precision. A pair of blocks gives back counts and the roots of its
    components, at most one row a vector: no pairs are written, however many copies a vector has. All pairs
    of blocks are visited, so the work grows with the square of the number of distinct vectors.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    classes = (
        rows.where(_usable("vector"))
        .groupBy("vector")
        .agg(F.min("vec_id").alias("low"), F.count("*").alias("size"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    classes = stored(classes, "vector-classes")  # from here on the numbers are fixed
    blocks = max(1, min(MIN_BLOCKS, classes.count()), -(-classes.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    paired = (
        classes.select("cls", "size", "vector", block.alias("block"), other)
        .select("cls", "size", "vector", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .repartition("i", "j")
        .sortWithinPartitions("i", "j", "block")
    )
    found = stored(paired.mapInArrow(_pair_blocks(threshold), _ROWS), "vector-links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    linked = (
        classes.select("cls", "low", "size")
        .join(counts, "cls", "left")
        .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        .select(
            "cls",
            "low",
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("root", "cls").alias("root"),
        )
    )
    linked = stored(linked, "vector-roots")
    # Stored, so that the join shuffles both sides and can split the rows of a large component.
    lows = stored(linked.groupBy("root").agg(F.min("low").alias("component_id")), "vector-lows")
    named = stored(
        classes.select("cls", "vector").join(linked.join(lows, "root").select("cls", "n_links", "component_id"), "cls").drop("cls"),
        "vector-members",
    )
    return rows.join(named, "vector", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pair_blocks(threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, j), (cls, size, vectors, block) in _groups(batches):
            lengths = np.array([len(v) for v in vectors])
            for length in np.unique(lengths):
                own = lengths == length
                matrix = np.array([v for v, same in zip(vectors, own.tolist()) if same])
                left = block[own] == i
                right = left if i == j else ~left
                found = link_blocks(
                    matrix[left], matrix[right], size[own][left], size[own][right], cls[own][left], cls[own][right], threshold, i == j
                )
                yield pa.record_batch([pa.array(x, pa.int64()) for x in found], names=["cls", "links", "root"])

    return rows


def _groups(batches: Iterator[pa.RecordBatch]):
    """The rows of each pair of blocks; they are sorted by it."""
    held, at = [], None
    for batch in batches:
        keys = batch.column("i").to_numpy().astype(np.int64) << 32 | batch.column("j").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
        for start, end in zip(cuts, cuts[1:]):
            key = int(keys[start])
            if key != at and held:
                yield (at >> 32, at & 0xFFFFFFFF), _columns(held)
                held = []
            at = key
            held.append(batch.slice(start, end - start))
    if held:
        yield (at >> 32, at & 0xFFFFFFFF), _columns(held)


def _columns(held: list[pa.RecordBatch]):
    table = pa.Table.from_batches(held)
    vectors = []
    for chunk in table.column("vector").chunks:
        flat = chunk.flatten().to_numpy()
        vectors += np.split(flat, np.cumsum(chunk.value_lengths().to_numpy())[:-1])
    return table.column("cls").to_numpy(), table.column("size").to_numpy(), vectors, table.column("block").to_numpy()


class Quantised:
    """Unit vectors as int8 times a scale, with the norms of what is kept and what is lost."""

    def __init__(self, matrix: np.ndarray):
        matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
        self.unit = matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        self.scale = np.abs(self.unit).max(axis=1) / 127
        whole = np.rint(self.unit / self.scale[:, None])
        self.values = whole.astype(np.int8)
        kept = whole * self.scale[:, None]
        self.kept = np.sqrt((kept * kept).sum(axis=1))
        self.lost = np.sqrt(((self.unit - kept) ** 2).sum(axis=1))


def link_blocks(left, right, left_size, right_size, left_cls, right_cls, threshold, same) -> tuple[np.ndarray, ...]:
    """(class, rows it links with on the other side, smallest class of its component here) of all linked classes.

    ``same`` says that both sides are one block; a class does not link with itself.
    """
    a = Quantised(left)
    b = a if same else Quantised(right)
    links_a, links_b = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    for r in range(0, len(left), TILE_ROWS):
        for c in range(0, len(right), TILE_COLUMNS):
            if same and c + TILE_COLUMNS <= r:
                continue
            rows, columns = link_tile(a, b, slice(r, r + TILE_ROWS), slice(c, c + TILE_COLUMNS), threshold)
            if same:
                upper = rows < columns
                rows, columns = rows[upper], columns[upper]
            if len(rows):
                links_a += np.bincount(rows, right_size[columns], len(left)).astype(np.int64)
                links_b += np.bincount(columns, left_size[rows], len(right)).astype(np.int64)
                both = columns if same else columns + len(left)
                roots = _roots(rows, both, len(left) + (0 if same else len(right)))
                some = np.unique(np.concatenate([rows, both]))
                edges.append((some, roots[some]))
    cls = left_cls if same else np.concatenate([left_cls, right_cls])
    links = links_a + links_b if same else np.concatenate([links_a, links_b])
    if not edges:
        return cls[:0], links[:0], cls[:0]
    roots = _roots(np.concatenate([x for x, _ in edges]), np.concatenate([y for _, y in edges]), len(cls))
    some = np.flatnonzero(links)
    return cls[some], links[some], cls[roots[some]]


def link_tile(a: Quantised, b: Quantised, rows: slice, columns: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a tile whose cosine is at least the threshold."""
    scale_b, kept_b, lost_b = b.scale[columns], b.kept[columns], b.lost[columns]
    scale_a, kept_a, lost_a = a.scale[rows], a.kept[rows], a.lost[rows]
    left, right = a.values[rows].astype(np.float32), b.values[columns].astype(np.float32)
    if left.shape[1] <= EXACT_DIMENSIONS:
        product = left @ right.T
    else:
        product = sum(
            (left[:, d : d + EXACT_DIMENSIONS] @ right[:, d : d + EXACT_DIMENSIONS].T).astype(np.float64)
            for d in range(0, left.shape[1], EXACT_DIMENSIONS)
        )
    # |u.v - product * scales| <= kept_u lost_v + lost_u kept_v + lost_u lost_v
    worst = kept_a * lost_b.max() + lost_a * kept_b.max() + lost_a * lost_b.max()
    needed = threshold - worst - SLACK
    least = needed / (scale_a * np.where(needed > 0, scale_b.max(), scale_b.min())) - 1
    r, c = np.nonzero(product >= least[:, None])
    about = product[r, c].astype(np.float64) * scale_a[r] * scale_b[c]
    error = kept_a[r] * lost_b[c] + lost_a[r] * kept_b[c] + lost_a[r] * lost_b[c] + SLACK
    linked = about - error >= threshold
    for doubt in np.array_split(np.flatnonzero(~linked & (about + error >= threshold)), max(1, len(r) >> 15)):
        exact = np.einsum("ij,ij->i", a.unit[rows][r[doubt]], b.unit[columns][c[doubt]])
        linked[doubt] = exact >= threshold
    return r[linked] + rows.start, c[linked] + columns.start


def _roots(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest place reachable from each place over the links a-b."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh
