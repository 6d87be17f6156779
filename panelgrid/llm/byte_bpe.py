"""Byte-level BPE encoding and decoding in padded numpy matrices.

Distinct pieces of text are rows; rows of like length share a matrix.  In each
round every row merges its leftmost pair of minimum rank: ranks of neighbouring
ids stand in a second matrix, whose changed cells alone are looked up again in
an open-addressing hash table of pairs.  Rows without a pair to merge leave the
matrix, and each round makes it a column narrower.

Plan: one ``mapInArrow`` over the scan for encoding, one for decoding; no
shuffle.  Worker memory is bounded by an Arrow batch, a chunk of code points
and the remembered pieces.

Defined results: null and empty texts have no ids and decode to nothing; a text
of any length is encoded whole; repeated rows give the same ids; other columns
are passed on.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.pretokens import PieceEncoder, split_bytelevel

NONE = np.int64(1) << 40
#: Widths of the matrices; longer rows are merged one by one.
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64, 128)


class PairTable:
    """Hash table from (left id, right id) to the id of their concatenation."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(4 * max(1, len(left))).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        spot, todo = self._spot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[spot[todo]] == -1
            self.keys[spot[todo[free]]] = keys[todo[free]]  # of those that meet, the last stays
            won = self.keys[spot[todo]] == keys[todo]
            self.values[spot[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            spot[todo] = (spot[todo] + 1) & ((1 << self.bits) - 1)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        scattered = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (scattered >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, which are the ranks too; NONE where a pair has none or an id is below 0."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left.astype(np.int64) << 32 | right.astype(np.int64))
        shape, keys = keys.shape, keys.ravel()
        out = np.full(len(keys), NONE, np.int64)
        todo = np.flatnonzero(keys >= 0)
        spot = self._spot(keys[todo])
        while len(todo):
            there = self.keys[spot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[spot[hit]]
            on = ~hit & (there != -1)
            todo, spot = todo[on], (spot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class ByteBpe:
    """Encoder and decoder over a file of ranks (base64 token, rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t))
                 if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        self.token_n = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.token_n[rank] = len(token)
        self.token_at = np.cumsum(self.token_n) - self.token_n
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def _matrix(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge the rows of ``ids`` (padded with -1); yields finished rows: their places and ids."""
        place = np.arange(len(ids))
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(ids):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            best = rank[np.arange(len(ids)), at] if rank.shape[1] else np.full(len(ids), NONE)
            on = best < NONE
            if not on.all():
                yield place[~on], ids[~on]
                ids, rank, place, at, best = ids[on], rank[on], place[on], at[on], best[on]
                if not len(ids):
                    return
            rows = np.arange(len(ids))
            ids[rows, at] = best
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            rank = np.take_along_axis(rank, column[:-1] + (column[:-1] >= at[:, None]), axis=1)
            left = np.flatnonzero(at > 0)
            if len(left):
                rank[left, at[left] - 1] = self.pairs.find(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at + 1 < ids.shape[1])
            if len(right):
                rank[right, at[right]] = self.pairs.find(ids[right, at[right]], ids[right, at[right] + 1])

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long row.  All places of the minimum rank merge in one round if
        none of the pairs that this makes ranks as low; else the leftmost."""
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) < NONE:
            at = np.flatnonzero(rank == best)
            if len(at) > 1:
                run = np.flatnonzero(np.diff(at, prepend=-9) != 1)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            for where in (at, at[:1]):
                merged = ids.copy()
                merged[where] = best
                merged = np.delete(merged, where + 1)
                after = where - np.arange(len(where))
                changed = np.unique(np.concatenate([after - 1, after]))
                changed = changed[(changed >= 0) & (changed + 1 < len(merged))]
                fresh = self.pairs.find(merged[changed], merged[changed + 1])
                between = self.pairs.find(np.array([best]), ids[where[:1]])
                if len(where) == 1 or (min(fresh.min(initial=NONE), between[0]) > best):
                    break
            rank = np.delete(rank, where)
            rank[changed] = fresh
            ids = merged
        return ids

    def encode_many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        start = np.cumsum(n) - n
        out: list[np.ndarray | None] = [None] * len(raw)
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((n > low) & (n <= width))
            low = width
            if len(rows):
                column = np.arange(width)
                inside = column < n[rows, None]
                ids = np.where(inside, flat[np.minimum(start[rows, None] + column, len(flat) - 1)], -1)
                for place, done in self._matrix(ids):
                    counts = (done >= 0).sum(axis=1)
                    for k, ids_k, c in zip(rows[place].tolist(), done, counts.tolist(), strict=True):
                        out[k] = ids_k[:c]
        for k in np.flatnonzero(n > low).tolist():
            out[k] = self._long(flat[start[k]:start[k] + n[k]])
        for k in np.flatnonzero(n == 0).tolist():
            out[k] = np.zeros(0, np.int64)
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), counts

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        n = self.token_n[ids]
        ends = np.cumsum(n)
        return self.token_bytes[np.repeat(self.token_at[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


@functools.cache
def bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(split_bytelevel, bpe(path).encode_many)


def slices(batch: pa.RecordBatch, text_col: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``size`` bytes of text, so that a worker holds little at a time."""
    column = batch.column(batch.schema.get_field_index(text_col))
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + size)))
        yield batch.slice(at, upto - at)
        at = upto


def with_columns(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` without its text, with ``n_tokens`` and ``ids``, the ids of each
    whole text as little-endian unsigned 32-bit integers; with ``decoded``, what
    :func:`decode` makes of the ids too, in the same pass.  The rank file has to
    be at ``ranks_path`` on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(ranks_path)
        for whole in batches:
            for batch in slices(whole, text_col):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                ids = [x.astype("<u4").tobytes() for x in coder.encode(texts)]
                more = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    more["decoded"] = _decoded(ids, ranks_path)
                yield with_columns(batch.select([c for c in batch.schema.names if c != text_col]), **more)

    added = {"n_tokens": F.lit(0).cast("long"), "ids": F.lit(b"")} | ({"decoded": F.lit(b"")} if decoded else {})
    return df.mapInArrow(run, df.drop(text_col).withColumns(added).schema)


def _decoded(ids: list[bytes | None], ranks_path: str) -> pa.Array:
    coder = bpe(ranks_path)
    return pa.array([coder.decode(np.frombuffer(x or b"", "<u4")) for x in ids], pa.binary())


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes that the ids of each row stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ids_col):
                ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
                yield with_columns(batch, decoded=_decoded(ids, ranks_path))

    return df.mapInArrow(run, df.withColumn("decoded", F.lit(b"")).schema)
