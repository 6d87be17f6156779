"""Document fingerprints from prefix polynomial hashes.

S[k] is the sum of (c_j + 1)·B^j over the first k code points, modulo a prime.
From an array of S any span's hash follows by one subtraction and a shift by
B^-i, so spans are compared in constant time and the longest common extension of
two places is found by binary search.

A fingerprint keeps of this array: the length, the whole text's hash by two
bases, S at every multiple of a power of two (GRID/2 to GRID of them), and S at
content-chosen cuts: the ends of those windows of WINDOW code points whose span
hash ends in most zero bits, as many bits as leave at most CUTS of them.  The
likeness of two fingerprints is the share of both texts that is found equal: the
common beginning, by binary search over the places both have kept, and after it
the spans between neighbouring cuts that both have, wherever they lie.

``neighbours`` pairs each document with the next one in descending id order.
Documents are dealt into ranges of the id, whose bounds come from a sample of
ids; each range also gets the first document of the range that follows, and is
sorted and read as a stream, so no window spans the table and a text is shuffled
once.

Defined results: a null text counts as empty; the empty text's fingerprint is
like itself (1) and unlike any other (0).  Rows with a null id come last; rows
that share an id follow each other by text.  After the last row comes the first,
so the only document of a table is its own successor.  An empty table gives no
rows; further columns are ignored.  Texts are read in pieces, so a very long one
needs memory for its characters only.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.pretokens import mix64
from panelgrid.operators.ranking import bucket_of, splitters

PRIME = (1 << 31) - 1
BASE, BASE_2 = 1_103_515_245, 1_664_525_003
GRID = 32
CUTS = 16
WINDOW = 16
#: Code points hashed at once.
PIECE = 1 << 17
#: Rows of an output batch.
ROWS = 512


@functools.lru_cache(maxsize=8)
def _powers(base: int) -> np.ndarray:
    """The first PIECE + WINDOW powers of ``base``."""
    out = np.ones(1, np.uint64)
    while len(out) < PIECE + WINDOW:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:PIECE + WINDOW]


def _shifted(base: int, offset: int, n: int) -> np.ndarray:
    """Powers ``offset`` to ``offset + n`` of ``base``."""
    table = _powers(base)[:n]
    return table if not offset else table * np.uint64(pow(base, offset, PRIME)) % np.uint64(PRIME)


INVERSE = pow(BASE, -1, PRIME)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _prefixes(cp: np.ndarray, base: int, offset: int, before: int) -> np.ndarray:
    """S after each of ``cp``, which start at ``offset`` of their text, where S is ``before``."""
    terms = (cp + np.uint64(1)) * _shifted(base, offset, len(cp)) % np.uint64(PRIME)
    return (np.cumsum(terms) + np.uint64(before)) % np.uint64(PRIME)


class Prefixes:
    """The prefix array of a text: span hashes, span equality, common extensions."""

    def __init__(self, text: str):
        parts, at = [np.zeros(1, np.uint64)], 0
        while at < len(text):
            parts.append(_prefixes(_code_points(text[at:at + PIECE]), BASE, at, int(parts[-1][-1])))
            at += PIECE
        self.s = np.concatenate(parts)

    def __len__(self) -> int:
        return len(self.s) - 1

    def span(self, i: int, j: int) -> int:
        """The hash of code points i to j, the same wherever they stand."""
        return (int(self.s[j]) - int(self.s[i])) * pow(INVERSE, i, PRIME) % PRIME

    def equal(self, i: int, j: int, other: Prefixes, k: int) -> bool:
        """Whether code points i to j equal those of ``other`` from k on."""
        return k + j - i <= len(other) and self.span(i, j) == other.span(k, k + j - i)

    def extension(self, i: int, other: Prefixes, k: int) -> int:
        """How many code points from i on equal those of ``other`` from k on."""
        low, high = 0, min(len(self) - i, len(other) - k)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, i + middle, other, k):
                low = middle
            else:
                high = middle - 1
        return low


@dataclass(frozen=True)
class Fingerprint:
    n: int
    whole: int
    stride: int
    grid: np.ndarray
    cuts: np.ndarray
    at_cuts: np.ndarray

    def __str__(self) -> str:
        grid = "".join(f"{h:08x}" for h in self.grid.tolist())
        cuts = ",".join(f"{c:x}:{h:08x}" for c, h in zip(self.cuts.tolist(), self.at_cuts.tolist(), strict=True))
        return f"{self.n:x}.{self.whole:016x}.{grid}.{cuts}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, grid, cuts = text.split(".")
        pairs = [c.split(":") for c in cuts.split(",") if c]
        return cls(int(n, 16), int(whole, 16), _stride(int(n, 16)), np.array([int(grid[k:k + 8], 16) for k in range(0, len(grid), 8)], np.uint64),
                   np.array([int(c, 16) for c, _ in pairs], np.int64), np.array([int(h, 16) for _, h in pairs], np.uint64))


def _stride(n: int) -> int:
    """The smallest power of two of which n holds at most GRID."""
    stride = 1
    while n // stride > GRID:
        stride *= 2
    return stride


def _zeros(x: np.ndarray) -> np.ndarray:
    """Zero bits at the end of 64-bit numbers that are not zero."""
    lowest = x & (~x + np.uint64(1))
    return np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64)


def fingerprint(text: str) -> Fingerprint:
    n = len(text)
    stride, level = _stride(n), 0
    grid, ends, bits, values = [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    before, second, tail = 0, 0, np.zeros(1, np.uint64)
    for at in range(0, n, PIECE):
        cp = _code_points(text[at:at + PIECE])
        s = _prefixes(cp, BASE, at, before)
        before = int(s[-1])
        second = (second + int(((cp + np.uint64(1)) * _shifted(BASE_2, at, len(cp)) % np.uint64(PRIME)).sum())) % PRIME
        first = -(at + 1) % stride  # s[k] belongs to the prefix of at + k + 1
        grid.append(s[first::stride])
        both = np.concatenate([tail, s])  # both[k] belongs to the prefix of at + 1 - len(tail) + k
        start = at + 1 - len(tail)
        if len(both) > WINDOW:
            windows = len(both) - WINDOW
            span = (both[WINDOW:] + np.uint64(PRIME) - both[:windows]) % np.uint64(PRIME) * _shifted(INVERSE, start, windows) % np.uint64(PRIME)
            zeros = _zeros(mix64(span + np.uint64(1)))
            some = np.flatnonzero(zeros >= level)
            ends, bits = np.append(ends, some + start + WINDOW), np.append(bits, zeros[some])
            values = np.append(values, both[some + WINDOW])
            while len(ends) > CUTS:
                level += 1
                stay = bits >= level
                ends, bits, values = ends[stay], bits[stay], values[stay]
        tail = both[-WINDOW:]
    return Fingerprint(n, before << 32 | second, stride, np.concatenate(grid) if grid else np.zeros(0, np.uint64), ends, values)


def _common_start(a: Fingerprint, b: Fingerprint) -> int:
    """Code points at the beginning that are known to be equal: equality of
    prefixes holds up to a place and fails from there on, so that place is found
    by binary search over the places both have kept."""
    stride = max(a.stride, b.stride)
    k = min(len(a.grid) * a.stride, len(b.grid) * b.stride) // stride
    places, in_a, in_b = np.intersect1d(a.cuts, b.cuts, assume_unique=True, return_indices=True)
    places = np.concatenate([np.arange(1, k + 1) * stride, places])
    one = np.concatenate([a.grid[stride // a.stride - 1::stride // a.stride][:k], a.at_cuts[in_a]])
    two = np.concatenate([b.grid[stride // b.stride - 1::stride // b.stride][:k], b.at_cuts[in_b]])
    order = np.argsort(places, kind="stable")
    low, high = 0, len(order)
    while low < high:
        middle = (low + high) // 2
        if one[order[middle]] == two[order[middle]]:
            low = middle + 1
        else:
            high = middle
    return int(places[order[low - 1]]) if low else 0


def _later_spans(f: Fingerprint, start: int) -> Counter:
    """Hash and length of the spans between neighbouring cuts from ``start`` on."""
    cuts, values = f.cuts.tolist(), f.at_cuts.tolist()
    return Counter(((values[k + 1] - values[k]) * pow(INVERSE, cuts[k], PRIME) % PRIME, cuts[k + 1] - cuts[k])
                   for k in range(len(cuts) - 1) if cuts[k] >= start)


def likeness(a: Fingerprint | str, b: Fingerprint | str) -> float:
    """The share of both texts, 0 to 1, that their fingerprints show to be equal."""
    a, b = (Fingerprint.parse(x) if isinstance(x, str) else x for x in (a, b))
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    if not a.n or not b.n:
        return 0.0
    start = _common_start(a, b)
    both = _later_spans(a, start) & _later_spans(b, start)
    return min(1.0, 2 * (start + sum(length * times for (_, length), times in both.items())) / (a.n + b.n))


def _edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


OUTPUT = ["doc_id long", "n_chars long", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (range, borrowed, doc_id, text), each range in order, its borrowed row last."""
    names = [f.split()[0] for f in OUTPUT]
    out: list[tuple] = []
    held = None
    for batch in batches:
        for k in range(batch.num_rows):
            part, borrowed, doc_id = (batch.column(c)[k].as_py() for c in range(3))
            text = batch.column(3)[k].as_py()
            now = (part, doc_id, text, fingerprint(text))
            if held is not None and held[0] == part:
                edited = _edited(held[2], text)
                of_edited = fingerprint(edited)
                out.append((held[1], len(held[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(held[3]), str(of_edited),
                            likeness(held[3], of_edited), likeness(held[3], now[3])))
            held = None if borrowed else now
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if not at else pa.array(c) for at, c in enumerate(zip(*out, strict=True))], names=names)


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """0 for null ids, otherwise 1 and up, by rising id."""
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(bucket_of(doc_id, F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), len(bounds)) + 1)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to
    that and to the next document."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # At most 4 n bounds and 4 n heads come to the driver, whatever the table's size.
    bounds = [b[0] for b in splitters(rows.where("doc_id IS NOT NULL"), [F.col("doc_id")], 4 * n).first()["splitters"]]
    dealt = rows.withColumn("part", _range_of(F.col("doc_id"), bounds))
    heads = {r["part"]: r["head"] for r in dealt.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    if not heads:
        return spark.createDataFrame([], ", ".join(OUTPUT))
    falling = sorted(heads, reverse=True)
    lender_of = dict(zip(falling, [*falling[1:], falling[0]], strict=True))  # the range whose first row follows a range's last
    borrower_of = F.create_map(*[F.lit(x) for borrower, lender in lender_of.items() for x in (lender, borrower)])
    head_ids = [h for h in heads.values() if h is not None]
    is_head = F.col("doc_id").isin(head_ids) if 0 not in heads else F.col("doc_id").isin(head_ids) | F.col("doc_id").isNull()
    borrowed = dealt.where(is_head).groupBy("part", "doc_id").agg(F.min("text").alias("text")).select(
        borrower_of[F.col("part")].alias("part"), F.lit(True).alias("borrowed"), "doc_id", "text")
    everything = dealt.select("part", F.lit(False).alias("borrowed"), "doc_id", "text").unionByName(borrowed)
    return everything.repartition(n, "part").sortWithinPartitions("part", "borrowed", F.desc_nulls_last("doc_id"), "text").mapInArrow(
        _compare, ", ".join(OUTPUT))
