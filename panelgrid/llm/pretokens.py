"""Splitting of texts into the pieces that a BPE tokenizer encodes one by one,
and encoding of each distinct piece once.

A batch of texts becomes one array of code points; character classes and a few
neighbour rules give every piece boundary of the usual byte-level pattern at
once.  Pieces are told apart by a 64-bit hash of their code points, so that an
encoder sees each distinct piece of a worker's texts once, however often it
occurs; the ids of all texts are then gathered from the store of known pieces.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: Code points taken at once, and pieces remembered by a worker.
CHUNK = 500_000
REMEMBERED = 500_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xBF58476D1CE4E5B9)


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[[ord(c) for c in WHITE_SPACE]] = SPACE
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _ODD
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _scattered() -> np.ndarray:
    """A random-looking number for each code point."""
    return mix64(np.arange(0x110000, dtype=np.uint64) * _MUL + _ODD)


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd multiplier, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 256), _MUL | np.uint64(1), np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points; spans lie side by side."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(values), dtype=np.int64) - np.repeat(starts, lengths)
    scaled = _scattered()[values] * powers(int(lengths.max()))[place]
    return mix64(np.add.reduceat(scaled, starts) + lengths.astype(np.uint64) * _MUL)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of ``texts``, and each text's length."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def _sliced(cp: np.ndarray, ends: np.ndarray) -> list[str]:
    """The strings between ``ends`` in the code points ``cp``, decoded at once."""
    joined = cp.tobytes().decode("utf-32-le", "surrogatepass")
    upto = ends.tolist()
    return [joined[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]


def _starts_of(lengths: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n + 1, bool)
    ends = np.cumsum(lengths)
    first[ends - lengths] = True  # an empty text marks its successor's start, or the end
    return first[:n]


def _contractions(cp: np.ndarray, first: np.ndarray, begin: np.ndarray, cut: np.ndarray) -> None:
    """Set ``cut`` for 's 't 'm 'd 're 've 'll at the places ``begin``, where a piece starts with an apostrophe."""
    n = len(cp)
    at = begin[begin + 1 < n]
    at = at[~first[at + 1]]
    one = at[np.isin(cp[at + 1], [ord(c) for c in "stmd"])]
    two = at[at + 2 < n]
    two = two[~first[two + 2]]
    a, b = cp[two + 1], cp[two + 2]
    two = two[((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))]
    cut[one + 1] = False
    cut[two + 1] = False
    cut[one[one + 2 < n] + 2] = True
    cut[two[two + 3 < n] + 3] = True


def split_bytelevel(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Piece starts by the pattern of byte-level BPE vocabularies: contractions;
    letters, numbers or other signs with one space before them; white space."""
    kind = _classes()[cp]
    cut = first.copy()
    cut[1:] |= kind[1:] != kind[:-1]
    runs = cut.copy()
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:])
    cut[last] = True
    blank = last[cp[last] == 32]
    cut[blank + 1] = False
    quotes = np.flatnonzero((cp == ord("'")) & runs)
    _contractions(cp, first, quotes[cut[quotes]], cut)
    return np.flatnonzero(cut)


def split_words(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Piece starts where letters, single numbers and other signs part; white
    space makes pieces too, which :class:`PieceEncoder` drops."""
    kind = _classes()[cp]
    cut = first.copy()
    cut[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quotes = np.flatnonzero((cp == ord("'")) & cut)
    _contractions(cp, first, quotes, cut)
    return np.flatnonzero(cut)


def parts(text: str, limit: int = CHUNK) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut before single
    blanks, where every pattern here has a boundary; whole if it has none."""
    at = 0
    while len(text) - at > limit:
        place = text.find(" ", at + limit)
        while place > 0 and (place + 1 >= len(text) or text[place - 1].isspace() or text[place + 1].isspace()):
            place = text.find(" ", place + 1)
        if place < 0:
            break
        yield text[at:place]
        at = place
    yield text[at:]


class PieceEncoder:
    """Encodes texts piece by piece.

    ``split`` gives piece starts; ``encode_many`` takes distinct pieces and
    returns their ids, one after the other, and the number of ids of each.
    """

    def __init__(self, split: Callable, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
                 normalise: Callable[[str], str] | None = None, drop_space: bool = False):
        self.split, self.encode_many, self.normalise, self.drop_space = split, encode_many, normalise, drop_space
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and their places in the store
        self.ids, self.at, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slots(self, cp, starts, lengths, hashes) -> np.ndarray:
        codes, known = pd.factorize(hashes)
        if len(self.keys) + len(known) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.keys, known)
        slots = np.full(len(known), -1, np.int64)
        held = np.flatnonzero(place < len(self.keys))
        held = held[self.keys[place[held]] == known[held]]
        slots[held] = self.slot[place[held]]
        new = np.flatnonzero(slots < 0)
        if len(new):
            where = np.empty(len(known), np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = where[new]
            ends = np.cumsum(lengths[at])
            whole = cp[np.repeat(starts[at] - (ends - lengths[at]), lengths[at]) + np.arange(ends[-1])]
            ids, n = self.encode_many(_sliced(whole, ends))
            slots[new] = len(self.n) + np.arange(len(new))
            new = new[np.argsort(known[new])]
            self.keys, self.slot = (np.insert(kept, place[new], more[new]) for kept, more in ((self.keys, known), (self.slot, slots)))
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
            self.ids, self.n = np.concatenate([self.ids, ids.astype(np.uint32)]), np.concatenate([self.n, n])
        return slots[codes]

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.normalise:
            texts = [self.normalise(t) for t in texts]
        cp, sizes = code_points(texts)
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = self.split(cp, _starts_of(sizes, len(cp)))
        lengths = np.diff(starts, append=len(cp))
        hashes = span_hashes(cp, starts, lengths)
        if self.drop_space:
            keep = _classes()[cp[starts]] != SPACE
            starts, lengths, hashes = starts[keep], lengths[keep], hashes[keep]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        slot = self._slots(cp, starts, lengths, hashes)
        n = self.n[slot]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[slot] - (ends - n), n) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, np.cumsum(sizes))]
        return ids, np.diff(upto, prepend=0)

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty."""
        pending: list[str] = []
        owner: list[int] = []
        size, done, got = 0, 0, {}

        def flush() -> None:
            ids, counts = self._chunk(pending)
            for k, part in zip(owner, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                got.setdefault(k, []).append(part)

        for k, text in enumerate(texts):
            for part in parts(text or ""):
                pending.append(part)
                owner.append(k)
                size += len(part)
                if size >= CHUNK:
                    flush()
                    pending, owner, size = [], [], 0
                    for j in range(done, k):
                        yield np.concatenate(got.pop(j))
                    done = k
        if pending:
            flush()
        for j in range(done, len(texts)):
            yield np.concatenate(got.pop(j))


def _byte_alphabet() -> np.ndarray:
    """The code point of the printable sign that byte-level vocabulary files write
    for each byte: itself if it is printable in Latin-1, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    signs = np.arange(256, dtype=np.uint32)
    signs[rest] = 256 + np.arange(len(rest))
    return signs


def _byte_forms(pieces: list[str], alphabet: np.ndarray) -> list[str]:
    """Each piece's UTF-8 bytes as signs of ``alphabet``."""
    cp, sizes = code_points(pieces)
    n_bytes = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    upto = np.concatenate([[0], np.cumsum(n_bytes)])[np.cumsum(sizes)]
    return _sliced(alphabet[np.frombuffer("".join(pieces).encode(), np.uint8)], upto)


def _word_form(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.cache
def library_encoder(path: str, style: str) -> PieceEncoder:
    """An encoder over the tokenizers library's file ``path``; one for a worker.

    ``style`` is "bytelevel" or "words" and names the file's own way to
    normalise and split.  Strings of special tokens are ordinary text.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    model, alphabet = tokenizer.model, _byte_alphabet()

    def encode_many(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A piece is what the file's own pattern leaves whole, so only its model is needed.
        ids = [[t.id for t in model.tokenize(form)] for form in _byte_forms(pieces, alphabet)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(n.sum())), n

    if style == "bytelevel":
        return PieceEncoder(split_bytelevel, encode_many)
    return PieceEncoder(split_words, encode_many, _word_form, drop_space=True)
