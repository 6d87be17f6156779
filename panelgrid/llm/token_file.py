"""Token-id files of patched frame-of-reference blocks.

A file is a Parquet file of segments.  A segment holds the ids of some whole
documents in a row, cut into blocks of 128 ids: each block stores its minimum,
and the differences from it packed at the width that a given share of them
needs; the others, the exceptions, keep their low bits there and their place
and high bits in a list.  A segment's index has each block's start, so that one
block can be read alone.  Spark's own writer stores the segments, so that any
file system that Spark reaches will do, and a failed task leaves no part files.

Plan: documents are range-partitioned by id once (the text shuffles, its ids
do not); each task encodes its sorted documents segment by segment.  A document's
global start is its partition's base plus its place there; the bases are one
row for each partition.

Defined results: null and empty texts hold the end id alone; documents with a
null id come first, rows with equal ids in the order of their texts; an empty
table gives an empty file; other columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelgrid.llm.byte_bpe import slices

BLOCK = 128
#: Share of a block's ids that fit its width.
PERCENTILE = 90
#: Ids after which a segment is closed; a longer document makes a longer segment.
SEGMENT = 1 << 16
#: First bytes of a segment: format, ids in a block, ids, blocks, bytes of the body.
HEADER = np.dtype([("magic", "S4"), ("block", "<u4"), ("n", "<u8"), ("blocks", "<u4"), ("body", "<u8")])
INDEX = np.dtype([("start", "<u8"), ("low", "<u4"), ("width", "u1"), ("exceptions", "u1")])

SEGMENT_SCHEMA = "part int, seq int, before long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One segment's bytes."""
    ids = np.asarray(ids, np.int64)
    count = -(-len(ids) // BLOCK)
    head = np.zeros(1, HEADER)
    head["magic"], head["block"], head["n"], head["blocks"] = b"PFOR", BLOCK, len(ids), count
    if not count:
        return head.tobytes()
    grid = np.concatenate([ids, np.full(count * BLOCK - len(ids), ids[-1])]).reshape(count, BLOCK)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    rank = (BLOCK * percentile + 99) // 100 - 1
    width = _bits(np.partition(delta, rank, axis=1)[:, rank])
    high = delta >> width[:, None]
    n_out = (high > 0).sum(axis=1)
    size = BLOCK // 8 * width + 5 * n_out
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        bits = (delta[rows][:, :, None] >> np.arange(w)) & 1
        packed = np.packbits(bits.astype(np.uint8).reshape(len(rows), BLOCK * w), axis=1, bitorder="little")
        body[start[rows, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(high)
    nth = np.arange(len(row)) - (np.cumsum(n_out) - n_out)[row]
    list_at = start + BLOCK // 8 * width
    body[list_at[row] + nth] = place
    values = high[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(list_at[row] + n_out[row] + 4 * nth)[:, None] + np.arange(4)] = values
    index = np.zeros(count, INDEX)
    index["start"], index["low"], index["width"], index["exceptions"] = start, low, width, n_out
    head["body"] = len(body)
    return head.tobytes() + index.tobytes() + body.tobytes()


def _parts(payload: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    head = np.frombuffer(payload, HEADER, 1)[0]
    if head["magic"] != b"PFOR" or head["block"] != BLOCK:
        raise ValueError("not a segment of this format")
    index = np.frombuffer(payload, INDEX, int(head["blocks"]), HEADER.itemsize)
    return int(head["n"]), index, np.frombuffer(payload, np.uint8, int(head["body"]), HEADER.itemsize + index.nbytes)


def _unpack_blocks(index: np.ndarray, body: np.ndarray) -> np.ndarray:
    start, width = index["start"].astype(np.int64), index["width"].astype(np.int64)
    n_out = index["exceptions"].astype(np.int64)
    delta = np.zeros((len(index), BLOCK), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = body[start[rows, None] + np.arange(BLOCK // 8 * w)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        delta[rows] = bits.astype(np.int64) @ (np.int64(1) << np.arange(w))
    row = np.repeat(np.arange(len(index)), n_out)
    nth = np.arange(len(row)) - (np.cumsum(n_out) - n_out)[row]
    list_at = start + BLOCK // 8 * width
    place = body[list_at[row] + nth].astype(np.int64)
    raw = body[(list_at[row] + n_out[row] + 4 * nth)[:, None] + np.arange(4)]
    delta[row, place] |= np.ascontiguousarray(raw).view("<u4").reshape(-1).astype(np.int64) << width[row]
    return delta + index["low"].astype(np.int64)[:, None]


def unpack(payload: bytes) -> np.ndarray:
    """All ids of a segment."""
    n, index, body = _parts(payload)
    return _unpack_blocks(index, body).reshape(-1)[:n].astype(np.uint32)


def unpack_block(payload: bytes, k: int) -> np.ndarray:
    """The ids of block ``k`` alone."""
    n, index, body = _parts(payload)
    return _unpack_blocks(index[k:k + 1], body).reshape(-1)[:min(BLOCK, n - k * BLOCK)].astype(np.uint32)


def write_token_files(docs: DataFrame, path: str, encoder: Callable, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every document, ``end_id`` after each, in ascending id
    order.  ``encoder()`` gives a worker's :class:`~panelgrid.llm.pretokens.PieceEncoder`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, docs_held, held = [], [], 0

        def segment() -> pa.RecordBatch:
            payload = pack(np.concatenate(ids))
            row = {"part": [part], "seq": [seq], "before": [before], "n_tokens": [held],
                   "doc_ids": [docs_held], "doc_tokens": [[len(x) for x in ids]], "payload": [payload]}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        coder = encoder()
        for batch in (part for whole in batches for part in slices(whole, "text")):
            for doc_id, one in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                ids.append(np.append(one, np.uint32(end_id)))
                docs_held.append(doc_id)
                held += len(ids[-1])
                if held >= SEGMENT:
                    yield segment()
                    seq, before = seq + 1, before + held
                    ids, docs_held, held = [], [], 0
        if ids:
            yield segment()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
               .repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document, read from the files: doc_id, start (ids of all
    documents before it), n_tokens, and its ids as little-endian unsigned
    32-bit integers."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each partition of the writing job.
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg in batch.to_pylist():
                lengths = np.array(seg["doc_tokens"], np.int64)
                ends = np.cumsum(lengths)
                per_doc = np.split(unpack(seg["payload"]), ends[:-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(seg["doc_ids"], pa.int64()), pa.array(seg["start"] + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in per_doc], pa.binary()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in per_doc], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    placed = segments.join(F.broadcast(base), "part").select(
        "doc_ids", "doc_tokens", "payload", (F.col("base") + F.col("before")).alias("start"))
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
