"""Word shingles as 64-bit hashes, MinHash samples and odd sketches, for
batches of texts at once."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np

from panelgrid.llm.pretokens import mix64, powers

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

#: Bytes of text hashed at once, and shingles sampled at once.
CHUNK = 4_000_000
SAMPLED = 1 << 15


@functools.cache
def _byte_numbers() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of every word of the UTF-8 bytes ``raw``, with
    A-Z lower-cased.  Words are runs of bytes other than ASCII white space."""
    inside = ~_SPACES[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    lengths = ends - starts
    if not len(starts):
        return starts, lengths, np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    scaled = _byte_numbers()[_LOWER[raw[at]]] * powers(int(lengths.max()))[place]
    return starts, lengths, mix64(np.add.reduceat(scaled, first) + lengths.astype(np.uint64))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of spans of words that lie side by
    side with ``counts`` words each, and the span of each.  A span of fewer
    words has one shingle, its whole sequence; a span without words has none."""
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    owner = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + starts[owner]
    total = np.zeros(len(owner), np.uint64)
    size = np.minimum(counts[owner], width)
    for k in range(width):
        there = k < size
        total[there] += mix64(words[at[there] + k] + np.uint64(k + 1)) * powers(width + 1)[k + 1]
    return mix64(total + size.astype(np.uint64)), owner


def distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct hashes, in ascending order; owners stay in order."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], o[keep]


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8 in groups of about CHUNK bytes, with each group's first place."""
    at, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def text_sets(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and their owners."""
    joined = np.frombuffer(b" ".join(raw), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts, _, words = word_hashes(joined)
    counts = np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(raw))
    return distinct(*shingle_hashes(words, counts, width))


@functools.cache
def _sample_numbers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, np.uint64)


def minhash(hashes: np.ndarray, owner: np.ndarray, n_owners: int, k: int) -> np.ndarray:
    """``k`` 32-bit MinHash samples of each owner's set (rows of an empty set: the maximum)."""
    out = np.full((n_owners, k), 0xFFFFFFFF, np.uint32)
    mul, add = _sample_numbers(k)
    bounds = np.searchsorted(owner, np.arange(n_owners + 1))
    full = np.flatnonzero(np.diff(bounds))
    at = 0
    while at < len(full):  # some owners at a time, so that their shingles stay in the cache
        upto = max(at + 1, int(np.searchsorted(bounds[full + 1], bounds[full[at]] + SAMPLED, "right")))
        some = full[at:upto]
        low, high = bounds[some[0]], bounds[some[-1] + 1]
        h, starts = hashes[low:high], bounds[some] - low
        for j in range(k):
            out[some, j] = np.minimum.reduceat(((h * mul[j] + add[j]) >> np.uint64(32)).astype(np.uint32), starts)
        at = upto
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of ``rows`` samples; the band's number is part of it."""
    part = samples[:, :bands * rows].astype(np.uint64).reshape(len(samples), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(samples), 1), np.uint64)
    for r in range(rows):
        key = mix64(key ^ part[:, :, r] * powers(rows + 2)[r + 1])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps: each sample, with its number, flips one of ``bits`` bits.
    Two bitmaps differ in about as many bits as samples differ, twice over."""
    n, k = samples.shape
    spot = mix64(samples.astype(np.uint64) * np.uint64(1 << 20) + np.arange(k, dtype=np.uint64)) % np.uint64(bits)
    flat = np.bincount((np.arange(n)[:, None] * bits + spot.astype(np.int64)).ravel(), minlength=n * bits)
    return np.packbits((flat & 1).astype(np.uint8).reshape(n, bits), axis=1, bitorder="little")


def most_odd_bits(similarity: float, samples: int, bits: int, deviations: float = 6.0) -> int:
    """Differing bits that pairs of at least this similarity exceed only beyond
    ``deviations`` standard deviations of differing samples and of bits."""
    differ = samples * (1 - similarity) + deviations * np.sqrt(samples * similarity * (1 - similarity))
    p = (1 - np.exp(-4 * min(differ, samples) / bits)) / 2
    return int(np.ceil(bits * p + 2 * np.sqrt(bits * p * (1 - p))))


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` samples that miss a pair of this similarity with at most this chance."""
    return int(np.ceil(np.log(miss) / np.log(1 - similarity ** rows)))


#: Bits of a digit sketch's digit, and digits that a long holds.
DIGIT = 5
DIGITS = 12
_LOWEST = np.uint64(sum(1 << DIGIT * k for k in range(DIGITS)))


def digit_sketch(samples: np.ndarray) -> np.ndarray:
    """The lowest bits of the first DIGITS samples of each row, in one long."""
    some = samples[:, :DIGITS].astype(np.uint64) & np.uint64((1 << DIGIT) - 1)
    return np.bitwise_or.reduce(some << np.arange(0, DIGIT * some.shape[1], DIGIT, dtype=np.uint64), axis=1).view(np.int64)


def digits_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal digits of DIGITS, of pairs of sketches; digits that neither has are equal."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    for k in range(1, DIGIT):
        x = x | ((a.view(np.uint64) ^ b.view(np.uint64)) >> np.uint64(k))
    return DIGITS - np.bitwise_count(x & _LOWEST).astype(np.int64)


def least_digits(similarity: float, rows: int, bands: int, miss: float) -> int:
    """Equal digits that a pair of this similarity has at least, but for what chance the ``bands`` leave of ``miss``."""
    n = min(bands * rows, DIGITS)
    left, least = miss - (1 - similarity ** rows) ** bands, 0
    while least < n and left >= (chance := math.comb(n, least) * similarity ** least * (1 - similarity) ** (n - least)):
        left, least = left - chance, least + 1
    return least + DIGITS - n
