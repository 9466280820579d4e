"""Vector code compression: product codebooks by Lloyd's rounds over partition-local cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.frames import small_batches, stored
from footfall.llm.vectors import integers, pieces, whole_vectors, widest

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Vectors under one set of trees, and points under a node that is not divided further.
TREE_ROWS = 4_096
LEAF = 16
# Distances are roots of exact integers; bounds are widened by more than their rounding.
_WIDER = 1 + 1e-9


@dataclass
class Tree:
    """A cover tree over distinct points, which are ordered so that each subtree is one range.

    ``points`` (with ``weights``, how many rows share each) in that order, ``place`` the point of every row.
    Node i has the point ``centre[i]``, within ``radius[i]`` of all points ``low[i]:high[i]``, and the
    children ``first[i]:last[i]`` (none: a leaf). A node's centre is that of its first child, other
    children's centres are farther than half the radius from those before them, and no point of a child is
    farther than that from its centre. Cumulative sums over the order give every subtree's sum and count.
    """

    points: np.ndarray
    weights: np.ndarray
    place: np.ndarray
    centre: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    radius: np.ndarray

    def sums(self) -> np.ndarray:
        """Row i has the count and the componentwise sum of all rows whose points stand before place i."""
        weighted = np.column_stack([self.weights, self.points * self.weights[:, None]])
        return np.vstack([np.zeros((1, weighted.shape[1]), np.int64), np.cumsum(weighted, axis=0)])


def cover_tree(rows: np.ndarray) -> Tree:
    """Build top-down: a node's points are covered by balls of half its radius, taken greedily."""
    points, place, weights = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    order, nodes = np.arange(len(points)), []
    nodes.append([0, 0, len(points), 0, 0, _radius(points, 0)])
    at = 0
    while at < len(nodes):
        centre, low, high, _, _, radius = nodes[at]
        if high - low > LEAF and radius > 0:
            rest, start = order[low:high].copy(), low
            nodes[at][3] = len(nodes)
            while len(rest):
                squared = _squared(points[rest], points[centre])
                near = 4 * squared <= radius**2
                own = rest[near]
                order[start : start + len(own)] = own
                nodes.append([centre, start, start + len(own), 0, 0, float(np.sqrt(squared[near].max()))])
                start += len(own)
                rest = rest[~near]
                centre = rest[0] if len(rest) else centre
            nodes[at][4] = len(nodes)
        at += 1
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    columns = [np.array(c) for c in zip(*nodes)]
    return Tree(points[order], weights[order], rank[place.ravel()], rank[columns[0]], *columns[1:5], columns[5].astype(np.float64))


def _squared(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    off = points - other
    return (off * off).sum(axis=-1)


def _radius(points: np.ndarray, centre: int) -> float:
    return float(np.sqrt(_squared(points, points[centre]).max()))


def assign(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every distinct point (ties: the lower), and per entry the count and sum of its rows.

    A node's centre is compared with the entries still possible for it. One that is farther than the nearest
    by over twice the radius is nearest to no point below (triangle inequality); with one left, the whole
    subtree goes to it by its cumulative sums. Other nodes hand what is left to their children; points of
    leaves that stay ambiguous are compared exactly.
    """
    sums = tree.sums()
    totals = np.zeros((len(book), sums.shape[1]), np.int64)
    codes = np.empty(len(tree.points), np.int64)
    node, possible = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    while len(node):
        apart = np.sqrt(_squared(tree.points[tree.centre[node]][:, None], book[None]))
        apart[~possible] = np.inf
        limit = (apart.min(axis=1) + 2 * tree.radius[node]) * _WIDER
        possible &= apart <= limit[:, None]
        settled = possible.sum(axis=1) == 1
        entry, low, high = possible[settled].argmax(axis=1), tree.low[node[settled]], tree.high[node[settled]]
        np.add.at(totals, entry, sums[high] - sums[low])
        codes[_ranges(low, high)] = np.repeat(entry, high - low)

        leaf = ~settled & (tree.first[node] == tree.last[node])
        low, high = tree.low[node[leaf]], tree.high[node[leaf]]
        own = _ranges(low, high)
        squared = _squared(tree.points[own][:, None], book[None])
        squared[~np.repeat(possible[leaf], high - low, axis=0)] = np.iinfo(np.int64).max
        codes[own] = squared.argmin(axis=1)
        np.add.at(totals, codes[own], sums[own + 1] - sums[own])

        down = ~settled & ~leaf
        first, last = tree.first[node[down]], tree.last[node[down]]
        possible = np.repeat(possible[down], last - first, axis=0)
        node = _ranges(first, last)
    return codes, totals


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    sizes = high - low
    shift = np.repeat(low - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) if len(low) else np.zeros(0, np.int64)
    return np.arange(len(shift)) + shift


_FIELDS = ("points", "weights", "place", "centre", "low", "high", "first", "last")


def pack(trees: list[Tree]) -> bytes:
    """Points as long integers, all else as short ones, behind their lengths."""
    whole = [getattr(t, f).ravel().astype(np.int32) for t in trees for f in _FIELDS] + [t.radius.view(np.int32) for t in trees]
    return np.concatenate([np.array([len(trees), *map(len, whole)], np.int32), *whole]).tobytes()


def unpack(data: bytes) -> list[Tree]:
    flat = np.frombuffer(data, np.int32)
    count, each = int(flat[0]), len(_FIELDS) + 1
    sizes = flat[1 : 1 + count * each]
    whole = np.split(flat[1 + count * each :], np.cumsum(sizes)[:-1])
    trees = []
    for i in range(count):
        points, weights, *rest = (x.astype(np.int64) for x in whole[i * len(_FIELDS) : (i + 1) * len(_FIELDS)])
        radius = whole[count * len(_FIELDS) + i].copy().view(np.float64)
        trees.append(Tree(points.reshape(len(weights), -1), weights, *rest, radius))
    return trees


def first_entries(rows: DataFrame, width: int, parts: int, entries: int, scale: int, limit: int) -> np.ndarray:
    """The codebooks (part, entry, component) before the first round: parts of the vectors of the smallest ids."""
    head = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).toArrow()
    vectors = integers(head.column("vector").combine_chunks(), width, scale, limit)
    return vectors.reshape(len(vectors), parts, width // parts).transpose(1, 0, 2)


def grow_trees(rows: DataFrame, width: int, parts: int, scale: int, limit: int) -> DataFrame:
    """Stored: ids and labels of each run of ``TREE_ROWS`` vectors of a partition, and the trees of their parts."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, TREE_ROWS):
            whole = integers(batch.column("vector"), width, scale, limit).reshape(batch.num_rows, parts, width // parts)
            packed = pack([cover_tree(whole[:, p]) for p in range(parts)])
            one = pa.array([0, batch.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(one, batch.column(c)) for c in ("vec_id", "label")]
            yield pa.record_batch([*lists, pa.array([packed], pa.binary())], names=["ids", "labels", "trees"])

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(kinds["vec_id"])),
            T.StructField("labels", T.ArrayType(kinds["label"])),
            T.StructField("trees", T.BinaryType()),
        ]
    )
    return stored(rows.mapInArrow(grown, schema), "vector-trees")


def improve(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One of Lloyd's rounds: every part goes to its nearest entry, entries move to the floor of their parts' mean.

    Tasks give a count and a sum for each entry and component; Spark adds them, and the driver receives as
    many numbers as the codebooks hold.
    """
    shared = trees.sparkSession.sparkContext.broadcast(books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for batch in batches:
            for packed in batch.column("trees"):
                for part, tree in enumerate(unpack(packed.as_py())):
                    totals[part] += assign(tree, shared.value[part])[1]
        some = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(some), pa.array(totals.ravel()[some])], names=["cell", "total"])

    added = trees.select("trees").mapInArrow(summed, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    totals = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), np.int64)
    totals[added.column("cell").to_numpy()] = added.column("total").to_numpy()
    totals = totals.reshape(*books.shape[:2], -1)
    count = totals[:, :, :1]
    return np.where(count > 0, totals[:, :, 1:] // np.maximum(count, 1), books)


def encoded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (one byte a part) and ``error`` of every row."""
    shared = trees.sparkSession.sparkContext.broadcast(books)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                codes, error = [], 0
                for part, tree in enumerate(unpack(batch.column("trees")[at].as_py())):
                    book = shared.value[part]
                    nearest = assign(tree, book)[0]
                    codes.append(nearest[tree.place].astype(np.uint8))
                    error = error + _squared(tree.points, book[nearest])[tree.place]
                flat = pa.array([c.tobytes() for c in np.column_stack(codes)], pa.binary())
                own = [batch.column(c)[at].values for c in ("ids", "labels")]
                yield pa.record_batch([*own, flat, pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.elementType for f in trees.schema.fields[:2]}
    schema = T.StructType(
        [
            T.StructField("vec_id", kinds["ids"]),
            T.StructField("label", kinds["labels"]),
            T.StructField("code", T.BinaryType()),
            T.StructField("error", T.LongType()),
        ]
    )
    return trees.mapInArrow(rows, schema)


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and place, joined by commas."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all whole vectors (``vec_id``, ``label``, ``code``, ``error``, ``label_error``) and the codebooks.

    Components are taken as ``floor(scale * x)`` and vectors are cut into ``parts`` equal runs, each coded by
    the nearest of ``entries`` (at most 256) entries of its own codebook. Codebooks start from the vectors of
    the smallest ids (NULL ids last, equal ids by their vectors) and move for ``rounds`` rounds.
    ``label_error`` adds up the errors of equal labels, NULLs being one label. Vectors that are NULL or hold
    NULL or non-finite components are left out; shorter ones and those that ``parts`` does not divide are
    filled up with zeros. Repeated rows each count and each have a result. Without vectors the result is
    empty. Components so large that a squared distance may not fit into a long raise an error.

    The trees are written to the shared folder once; every round reads them, and only sums leave the tasks.
    """
    small_batches(vectors.sparkSession)
    rows = whole_vectors(vectors, vector_col, vec_id=id_col, label=label_col)
    width = -(-max(1, widest(rows)) // parts) * parts
    limit = min(2**30, int(np.sqrt(2**62 / width) / 2))
    books = first_entries(rows, width, parts, entries, scale, limit)
    trees = grow_trees(rows, width, parts, scale, limit)
    if books.size:
        for _ in range(rounds):
            books = improve(trees, books)
    codes = stored(encoded(trees, books), "vector-codes")
    # Stored, so that the join shuffles both sides and can split the rows of a common label.
    sums = stored(codes.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")), "vector-labels")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("own"))).drop("own"), books
