"""Line dedup: range-partitioned line hashes, sorted by document and position, streamed once."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.frames import slices, stored, tasks, texts

BLANKS = b" \t\n\x0b\x0c\r"
# Documents of one line whose verdict a task holds back before it leaves the line to the summary of runs.
RUN_ROWS = 50_000

_LINES = "key binary, doc_id long, version long, n_lines int, places array<int>"
_LINES_ARROW = pa.schema(
    [("key", pa.binary()), ("doc_id", pa.int64()), ("version", pa.int64()), ("n_lines", pa.int32()), ("places", pa.list_(pa.int32()))]
)


def line_keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """One row per document that loses lines: ``doc_id``, ``version``, ``n_lines``, ``n_dropped``, ``keep``.

    A line's key is the line, stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lower-cased. Keys of at least
    ``min_chars`` code points that ``min_docs`` distinct documents hold lose all lines but those of the
    largest id. ``keep`` is the zlib-compressed bitmap of kept lines (numpy ``packbits``), ``version`` the
    ``xxhash64`` of the text, so that rows that repeat an id keep their own bitmaps.

    Rows go by (key, document) to range partitions, largest document first, so a line that a third of all
    documents share is cut over many tasks. Each task streams its rows: the first document of a run keeps its
    lines, the others lose theirs once the run has enough documents. Runs at a partition's ends (or longer
    than RUN_ROWS) are decided by their totals over all partitions: at most two and a few rows a task.

    NULL texts are empty documents; a NULL id takes no part and loses nothing; repeated rows count as one
    document; an empty table gives no rows.
    """
    rows = (
        texts(docs, id_col, text_col)
        .where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("version"), "text")
        .mapInArrow(_line_rows(min_chars), _LINES)
    )
    dealt = rows.repartitionByRange(tasks(docs.sparkSession), "key", F.desc("doc_id")).sortWithinPartitions(
        "key", F.desc("doc_id"), "version"
    )
    runs = stored(dealt.mapInArrow(_stream_runs(min_docs), _LINES + ", decided boolean, new_doc int"), "line-runs")
    totals = (
        runs.where("NOT decided")
        .groupBy("key")
        .agg(F.sum("new_doc").alias("holders"), F.max("doc_id").alias("keeper"))
        .where(F.col("holders") >= min_docs)
    )
    # At most two runs of each range partition, and one for every RUN_ROWS rows, are open.
    late = runs.where("NOT decided").join(F.broadcast(totals), "key").where("doc_id <> keeper")
    columns = ["doc_id", "version", "n_lines", "places"]
    return (
        runs.where("decided")
        .select(columns)
        .unionByName(late.select(columns))
        .groupBy("doc_id", "version")
        .agg(F.first("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
        .mapInArrow(_bitmaps, "doc_id long, version long, n_lines int, n_dropped int, keep binary")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every row of ``docs`` as ``doc`` (a struct of all its columns, the text without its dropped lines),
    with ``n_lines`` before dropping and ``n_dropped``.

    A NULL text counts as one line and stays NULL. See `line_keep_bitmaps` for what is dropped. Only the
    bitmaps are joined to the texts; the texts are shuffled once.
    """
    bitmaps = stored(line_keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), "line-bitmaps")
    keys = bitmaps.select(F.col("doc_id").alias("k_doc"), F.col("version").alias("k_version"), "keep")
    whole = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("rest"), F.col(text_col).cast("binary").alias("text")
    )
    joined = whole.join(
        keys, (F.col("rest")[id_col] == F.col("k_doc")) & (F.xxhash64("text") == F.col("k_version")), "left"
    ).select("rest", "text", "keep")
    shape = T.StructType([*joined.schema[:2], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    kept = joined.mapInArrow(_apply, shape)
    return kept.select(
        F.struct(*[F.col("text").cast("string").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns]).alias("doc"),
        "n_lines",
        "n_dropped",
    )


def recounted(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the number of characters of the text as it is now."""
    return docs.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))


def _line_rows(min_chars: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text"))):
                found: dict[bytes, list[int]] = {}
                parts = text.split(b"\n")
                for place, line in enumerate(parts):
                    # Fewer bytes than characters asked for cannot be enough.
                    if len(line) >= min_chars and len(key := line.strip(BLANKS)) >= min_chars:
                        if key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars:
                            digest = hashlib.blake2b(key.lower(), digest_size=16).digest()
                            found.setdefault(digest, []).append(place)
                out += [(key, doc, version, len(parts), places) for key, places in found.items()]
            yield from _record(out, _LINES_ARROW)

    return lines


def _record(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.record_batch([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def _stream_runs(min_docs: int):
    schema = _LINES_ARROW.append(pa.field("decided", pa.bool_())).append(pa.field("new_doc", pa.int32()))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run is open when other partitions may hold rows of it: the first, the last, and very long ones.
        run, keeper, last_doc, docs, opened = None, None, None, 0, True
        held: list[tuple] = []
        for batch in slices(batches):
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in _LINES_ARROW.names)):
                key, doc = row[:2]
                if key != run:
                    if run is not None:
                        if not opened and docs >= min_docs:
                            out += [(*r, True, 0) for r, _ in held if r[1] != keeper]
                        opened = False
                    run, keeper, last_doc, docs, held = key, doc, None, 0, []
                new = int(doc != last_doc)
                last_doc, docs = doc, docs + new
                held.append((row, new))
                if opened or len(held) > RUN_ROWS:
                    out += [(*r, False, n) for r, n in held]
                    held, opened = [], True
            yield from _record(out, schema)
        yield from _record([(*r, False, n) for r, n in held], schema)

    return stream


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        dropped, keeps = [], []
        for count, places in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist()):
            keep = np.ones(count, bool)
            keep[places] = False
            dropped.append(len(places))
            keeps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("version"), batch.column("n_lines"), pa.array(dropped, pa.int32()), pa.array(keeps, pa.binary())],
            names=["doc_id", "version", "n_lines", "n_dropped", "keep"],
        )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        totals, dropped, kept = [], [], []
        for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist()):
            count, gone = (text or b"").count(b"\n") + 1, 0
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=count)
                gone = count - int(bits.sum())
                text = b"\n".join([line for line, bit in zip(text.split(b"\n"), bits.tolist()) if bit])
            totals.append(count)
            dropped.append(gone)
            kept.append(text)
        yield pa.record_batch(
            [batch.column("rest"), pa.array(kept, pa.binary()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())],
            names=["rest", "text", "n_lines", "n_dropped"],
        )
