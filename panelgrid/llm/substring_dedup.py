"""Removal of passages that repeat across documents, by MinHash banding of
paragraphs and by windows of words that content alone chooses.

A text falls into paragraphs where its own words say so: at line ends, behind
sentence ends and before a capital after a small letter, so that a passage is
cut alike wherever it was pasted in; a paragraph of fewer than ``LEAST_WORDS``
words stays with the one before it on its line.  Neighbouring lines that are
shorter than that are one paragraph, up to a line whose own words say that it
starts another (one in ``SHORT_LINES``); what stays short is compared as it is,
so that each word of a text lies in one paragraph.
Equal paragraphs are found by a 128-bit fingerprint of their words.  Paragraphs
of as many five-word shingles as one of two different sets at the threshold has
at least (four at 0.8) are banded by MinHash too, with
as many bands of ``ROWS`` samples as it takes to miss a pair at the threshold
with at most the chance ``MISS``; colliding ones are verified by exact Jaccard, and the
components of these links are one class (:mod:`panelgrid.llm.linking`).

What is shared word for word is found without regard to lines, stops and
capitals: of the windows of ``WINDOW`` words of a text, those are anchors whose
hash is the least of ``AMONG`` neighbouring ones (winnowing), so that every run
of ``WINDOW + AMONG - 1`` = 50 words has the same anchor wherever it lies.
Neighbouring anchors overlap or touch; from the outermost repeated ones every
window is compared, a word further each time, up to the run's true ends.

A paragraph whose class, or a window that, occurs in a document with a smaller
id is a repeat.  Repeats that touch or overlap and come to ``LEAST_RUN`` words
are removed; what is shorter stays.  So of each passage the document with the
smallest id keeps it.

Plan: one pass makes rows of paragraphs and anchors (ids, places, fingerprints,
no text), a second one the band keys of different paragraphs; occurrences are
aggregated by fingerprint before anything is joined, so that a passage that a
third of all documents share is one row from each task.  Its occurrences (one
short row each) then meet that row in a join that Spark splits where it is
skewed.  Windows beside anchors are made only where a repeat may end.  Each
intermediate table goes when its last reader is written.

Defined results: null and empty texts have no repeats; rows with a null id are never cut and cut nothing; rows that repeat an
id are one document, each cut by its own text; repeats inside one document stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.llm import shingles
from panelgrid.llm.byte_bpe import slices
from panelgrid.llm.common import discard, stored, stored_at
from panelgrid.llm.linking import linked_components
from panelgrid.llm.pretokens import mix64, powers

WIDTH = 5
LEAST_WORDS = 8
SHORT_LINES = 4
#: Two samples to a band: with one, any shared shingle would make a candidate,
#: and candidates chain.  The bands and the sketches together miss a pair at the
#: threshold with at most MISS.
ROWS = 2
MISS = 0.003
LEAST_RUN = 30
#: Words of a window, and neighbouring windows of which the least hash is an
#: anchor.  AMONG is less than WINDOW, so that neighbouring anchors leave no word out.
WINDOW = 26
AMONG = 25

#: Bytes of text that a worker splits at a time.
SLICE = 1 << 20

_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_UPPER = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))


def paragraphs(raw: list[bytes]) -> dict[str, np.ndarray]:
    """The paragraphs of some texts, which hold each of their words: owner, number
    within its text, first word in its text, words, start and end byte in its
    text; word hashes and each paragraph's first word among them."""
    return _paragraphs(_words(raw))


class _words:
    """The words of some texts: hashes, start and end byte in its text, and of
    each text the first of its words."""

    def __init__(self, raw: list[bytes]):
        self.joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.starts, self.lengths, self.hashes = shingles.word_hashes(self.joined)
        self.owner = np.searchsorted(ends, self.starts, "right")
        self.base = ends - np.array([len(r) + 1 for r in raw])
        self.first = np.searchsorted(self.owner, np.arange(len(raw) + 1))

    def spans(self, at: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
        """Places of the spans of ``size`` words from the words ``at``, in ascending order."""
        own, last = self.owner[at], at + size - 1
        return {"owner": own, "idx": np.arange(len(at)) - np.searchsorted(own, own, "left"), "at": at - self.first[own], "words": size,
                "start": self.starts[at] - self.base[own], "end": self.starts[last] + self.lengths[last] - self.base[own]}


def _paragraphs(text: _words) -> dict[str, np.ndarray]:
    joined, starts, lengths, words = text.joined, text.starts, text.lengths, text.hashes
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return dict.fromkeys(("owner", "idx", "at", "words", "start", "end", "first"), none) | {"hashes": words}
    lines = np.cumsum(joined == 10)
    hard = np.ones(n, bool)
    hard[1:] = lines[starts[1:]] != lines[starts[:-1]]
    head = joined[starts]
    follow = joined[np.minimum(starts + 1, len(joined) - 1)]
    capital = _UPPER[head] | ((head == 0xC3) & (follow >= 0x80) & (follow <= 0x9E))
    cut = hard.copy()
    cut[1:] |= _ENDS[joined[starts[:-1] + lengths[:-1] - 1]] | (capital[1:] & ~capital[:-1])
    at = np.flatnonzero(cut)
    long_enough = np.diff(at, append=n) >= LEAST_WORDS
    at = at[hard[at] | long_enough]
    short = np.diff(at, append=n) < LEAST_WORDS
    opens = mix64(np.add.reduceat(mix64(words), at)) % np.uint64(SHORT_LINES) == 0
    joins = short & ~opens
    joins[0] = False
    joins[1:] &= short[:-1] & (text.owner[at[1:]] == text.owner[at[:-1]])
    at = at[~joins]
    size = np.diff(at, append=n)
    return text.spans(at, size) | {"first": at, "hashes": words}


def _window_hashes(text: _words) -> np.ndarray:
    """A hash of the WINDOW words from each word on; where fewer are left in its text, it is of no use."""
    n = len(text.hashes)
    scale = powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(text.hashes) * scale[:n], dtype=np.uint64)])
    upto = np.minimum(np.arange(n) + WINDOW, n)
    # Scaled down to the window's own first place, so that equal windows have equal sums.
    return mix64((total[upto] - total[:n]) * _inverse_powers(n))


_INVERSE = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    """The inverses of the first ``n`` ``powers``, modulo 2^64."""
    global _INVERSE
    if len(_INVERSE) < n:
        steps = np.full(max(n, 256), pow(int(powers(2)[1]), -1, 1 << 64), np.uint64)
        steps[0] = 1
        _INVERSE = np.cumprod(steps, dtype=np.uint64)
    return _INVERSE[:n]


def _extreme(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """The least or largest of each ``width`` neighbours in ``x``, from the first of them on."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = of(x[:len(x) - step], x[step:])
        done += step
    return x


def anchors(text: _words) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the anchors, and their hashes."""
    n, run = len(text.hashes), WINDOW + AMONG - 1
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = _window_hashes(text)
    least = _extreme(hashes[:n - WINDOW + 1], AMONG, np.minimum)
    left = text.first[text.owner + 1] - np.arange(n)  # words up to the text's end
    least[left[:len(least)] < run] = 0
    around = np.concatenate([np.zeros(AMONG - 1, np.uint64), least, np.zeros(AMONG - 1, np.uint64)])
    at = np.flatnonzero((_extreme(around, AMONG, np.maximum) == hashes[:n - WINDOW + 1]) & (left[:n - WINDOW + 1] >= WINDOW))
    return at, hashes[at].view(np.int64)


def _spans(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all paragraphs side by side, and each one's number of words."""
    size = found["words"]
    at = np.repeat(found["first"] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return found["hashes"][at], size


def _fingerprints(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.cumsum(size) - size
    scale = powers(int(size.max()))[np.arange(len(words)) - np.repeat(starts, size)]
    return tuple(mix64(np.add.reduceat(mix64(words ^ np.uint64(salt)) * scale, starts)).view(np.int64) for salt in (0, 0x5DEECE66D))


PLACES = "doc_id long, text_hash long, idx int, at int, words int, start int, end int"


#: A window's place; it has WINDOW words.
WINDOW_PLACES = "doc_id long, text_hash long, at int, start int, end int"


def _placed(batch: pa.RecordBatch, found: dict[str, np.ndarray], more: list[pa.Array], columns: str = PLACES) -> pa.RecordBatch:
    rows = batch.select(["doc_id", "text_hash"]).take(pa.array(found["owner"]))
    names = [c.split()[0] for c in columns.split(", ")]
    places = [pa.array(found[c].astype(np.int32)) for c in names[2:]]
    return pa.RecordBatch.from_arrays([*rows.columns, *places, *more], names=[*names, *("h1", "h2", "large")[:len(more)]])


def least_near(percent: int) -> int:
    """Shingles that the smaller of two different sets at ``percent`` has at least: all of them lie in the
    other, which has one more."""
    return -(-percent // (100 - percent))


def paragraph_rows(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, idx, at, words, start, end, h1, h2 and large (has ``least`` shingles); anchors have no h2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                text = _words(_raw(batch.column(2)))
                found = _paragraphs(text)
                words, size = _spans(found)
                h1, h2 = _fingerprints(words, size)
                yield _placed(batch, found, [pa.array(h1), pa.array(h2), pa.array(_large(size, least))])
                at, h = anchors(text)
                yield _placed(batch, text.spans(at, np.full(len(at), WINDOW)), [
                    pa.array(h), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.bool_())])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"{PLACES}, h1 long, h2 long, large boolean")


def _raw(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where(
        "doc_id IS NOT NULL")


def _large(size: np.ndarray, least: int) -> np.ndarray:
    """Which paragraphs of ``size`` words have ``least`` shingles."""
    return np.maximum(size - WIDTH + 1, 1) >= least


def _sketched(h: np.ndarray, of: np.ndarray, n: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """The band keys and the digit sketches of ``n`` sets: the same for a set wherever it is sketched."""
    samples = shingles.minhash(h, of, n, bands * ROWS)
    return shingles.band_keys(samples, bands, ROWS), shingles.digit_sketch(samples)


def paragraph_keys(docs: DataFrame, bands: int, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, key, sketch): the band keys of each different paragraph of ``least`` shingles, with a sketch of its samples,
    made anew from the texts, so that no table holds keys for each occurrence."""
    names = ["sketch", *(f"k{j}" for j in range(bands))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                words, size = _spans(_paragraphs(_words(_raw(batch.column(2)))))
                h1, _ = _fingerprints(words, size)
                near = np.zeros(len(h1), bool)
                near[np.unique(h1, return_index=True)[1]] = True  # what the slice holds more than once is sketched once
                near &= _large(size, least)
                h, of = shingles.shingle_hashes(words[np.repeat(near, size)], size[near], WIDTH)
                keys, sketch = _sketched(h, of, int(near.sum()), bands)
                yield pa.RecordBatch.from_arrays([pa.array(h1[near]), pa.array(sketch), *[pa.array(keys[:, j]) for j in range(bands)]],
                                                 names=["node", *names])

    rows = _texts(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{c} long" for c in ("node", *names)))
    return rows.dropDuplicates(["node"]).select("node", "sketch", F.explode(F.array(*names[1:])).alias("key"))


def _windows_beside(rows: DataFrame) -> DataFrame:
    """The windows up to AMONG - 1 words before the words ``lefts`` and behind
    the words ``rights`` of ``text``: their places and h1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                text = _words(_raw(batch.column(2)))
                wanted = np.zeros(len(text.hashes) + 1, bool)
                for column, steps in ((3, np.arange(1 - AMONG, 0)), (4, np.arange(1, AMONG))):
                    for k, places in enumerate(batch.column(column).to_pylist()):
                        at = (text.first[k] + np.array(places, np.int64)[:, None] + steps).ravel()
                        wanted[at[(at >= text.first[k]) & (at + WINDOW <= text.first[k + 1])]] = True
                at = np.flatnonzero(wanted)
                yield _placed(batch, text.spans(at, np.full(len(at), WINDOW)), [pa.array(_window_hashes(text)[at].view(np.int64))],
                              WINDOW_PLACES)

    return rows.select("doc_id", "text_hash", "text", "lefts", "rights").mapInArrow(run, f"{WINDOW_PLACES}, h1 long")


def _members(rows: DataFrame, bands: int) -> DataFrame:
    """``rows`` with the distinct shingles of their paragraph (the bytes ``part``), and their keys, in place of it."""
    kept = [c for c in rows.columns if c != "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "part", SLICE):
                parts = batch.column(batch.schema.get_field_index("part")).to_pylist()
                h, owner = shingles.text_sets(parts, WIDTH)
                keys, _ = _sketched(h, owner, len(parts), bands)
                sets = np.split(h, np.cumsum(np.bincount(owner, minlength=len(parts)))[:-1])
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(kept).columns, pa.array(list(keys), pa.list_(pa.int64())), pa.nulls(len(parts), pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=[*kept, "keys", "bitmap", "members"])

    return rows.mapInArrow(run, "cluster long, node long, keys array<long>, bitmap binary, members binary")


def _shared(windows: DataFrame) -> DataFrame:
    """Those of ``windows`` that occur in two documents, with the smallest id as first_doc."""
    first = windows.groupBy("h1").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    return windows.join(first.drop("last_doc"), "h1")


def run_ends(inner: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id and text_hash of the texts in which a run of repeated anchors (``inner``; ``shared`` with those of the
    documents that keep them) may end, with the words ``lefts`` and ``rights`` before and behind which the windows up
    to its true ends lie."""
    one_text = Window.partitionBy("doc_id", "text_hash").orderBy("idx")

    def apart(other) -> F.Column:
        """Whether the next anchor on that side is none of the same document's."""
        return ~F.coalesce((F.abs(other("idx") - F.col("idx")) == 1) & (other("first_doc") == F.col("first_doc")), F.lit(False))

    ends = inner.select("h1", apart(lambda c: F.lag(c).over(one_text)).alias("left"), apart(lambda c: F.lead(c).over(one_text)).alias("right"))
    ends = ends.where("left OR right").groupBy("h1").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    # The document that keeps the run shows its windows there too.
    return shared.join(ends, "h1").groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.when(F.col("left"), F.col("at"))).alias("lefts"), F.collect_set(F.when(F.col("right"), F.col("at"))).alias("rights"))


def find_repeats(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text with repeats: doc_id, text_hash, spans (array of
    start and end byte, words, and first_doc, the document that keeps the
    class of the span's first paragraph or window), in order of place."""
    spark = docs.sparkSession
    bands, least = shingles.bands_for(percent / 100, ROWS, MISS), least_near(percent)
    texts = _texts(docs, id_col, text_col)
    tables: dict[str, str] = {}

    def put(df: DataFrame, name: str) -> DataFrame:
        table, tables[name] = stored_at(df, name)
        return table

    def drop(*names: str) -> None:
        for name in names:
            discard(spark, tables.pop(name))

    def with_members(clusters: DataFrame) -> DataFrame:
        # Made here, when the band keys are gone.
        large = put(paragraph_rows(docs, least, id_col, text_col), "paragraphs").where("large")
        place = large.join(clusters.select(F.col("node").alias("h1")), "h1", "left_semi").groupBy(F.col("h1").alias("node")).agg(
            F.min(F.struct("doc_id", "text_hash", "start", "end")).alias("p")).select("node", "p.*")
        located = put(clusters.join(place, "node"), "located")
        # One text stands for all rows with its id and hash; only the paragraph's bytes leave the join.
        part = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("end") - F.col("start"))
        parts = located.join(texts, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "cluster", "node", part.alias("part")).distinct()
        return _members(parts.select("cluster", "node", "part"), bands)

    linked = linked_components(paragraph_keys(docs, bands, least, id_col, text_col), with_members,
                               lambda common, a, b: 100 * common >= percent * (a + b - common), None,
                               shingles.least_digits(percent / 100, ROWS, bands, MISS))
    drop("located")
    everything = spark.read.schema(f"{PLACES}, h1 long, h2 long, large boolean").parquet(tables["paragraphs"])
    rows, marks = everything.where("h2 IS NOT NULL"), everything.where("h2 IS NULL").drop("h2", "large")
    equal = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # Only what occurs in two documents or is like another paragraph goes on.
    classes = put(equal.join(linked.withColumnRenamed("node", "h1"), "h1", "left").where(
        "first < last OR component IS NOT NULL"), "classes")
    near = classes.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("near_first"), F.max("last").alias("near_last"))
    repeated = put(classes.join(near, "component", "left").select(
        "h1", "h2", F.coalesce("near_first", "first").alias("first_doc"), F.coalesce("near_last", "last").alias("last_doc")
    ).where("first_doc < last_doc").drop("last_doc"), "repeated")
    drop("classes")
    columns = ["doc_id", "text_hash", "at", "words", "start", "end", "first_doc"]
    # Each step is written before the next one begins, and with it go its shuffles and the tables that it read last.
    found = put(rows.join(repeated, ["h1", "h2"]).where("doc_id > first_doc").select(*columns), "equal")
    drop("repeated")
    shared = put(_shared(marks), "anchors")
    drop("paragraphs")
    inner = shared.where("doc_id > first_doc")
    ends = put(run_ends(inner, shared), "ends")
    outer = put(_windows_beside(ends.join(texts, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])), "windows")
    drop("ends")
    beside = put(_shared(outer).where("doc_id > first_doc").withColumn("words", F.lit(WINDOW)).select(*columns), "beside")
    drop("windows")
    found = found.unionByName(inner.select(*columns)).unionByName(beside).withColumn("upto", F.col("at") + F.col("words"))
    one_text = Window.partitionBy("doc_id", "text_hash").orderBy("at", "upto", "first_doc")
    before = F.max("upto").over(one_text.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.coalesce(F.col("at") > before, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("new").over(one_text.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "text_hash", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("upto") - F.min("at")).cast("int").alias("words"),
        F.min_by("first_doc", F.struct("at", "upto", "first_doc")).alias("first_doc")).where(F.col("words") >= LEAST_RUN)
    spans = stored(runs.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "words", "first_doc"))).alias("spans")), "spans")
    drop(*list(tables))
    return spans


def remove_repeats(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without the repeated
    passages; a text that this leaves without a word goes.  Blanks around a
    removed span become one blank or line end; a column n_chars is counted anew."""
    columns = docs.columns
    spans = find_repeats(docs, percent).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"),
                         F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    joined = packed.join(spans, ["_id", "_hash"], "left").select("_row", F.col("_row.text").cast("string").alias("_text"), "_spans")

    def cut(text: str, found: list[dict]) -> str:
        raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
        for s in found:
            out.append(raw[at:s["start"]])
            at = s["end"]
        out.append(raw[at:])
        pieces = [p.decode("utf-8", "surrogatepass") for p in out]
        left = pieces[0]
        for p in pieces[1:]:
            gap = "\n" if left.endswith("\n") or p.startswith("\n") else " "
            left, p = left.rstrip(" \n"), p.lstrip(" \n")
            left = left + (gap if left and p else "") + p
        return left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                new = [t if not s else cut(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array(
                    [bool(s) for s in batch.column(2).to_pylist()])], names=["_row", "_new", "_cut"])

    done = joined.mapInArrow(run, joined.select("_row").withColumns({"_new": F.lit(None).cast("string"), "_cut": F.lit(True)}).schema)
    done = done.where(F.expr(r"NOT _cut OR _new RLIKE '[^\\x20\\x09-\\x0D]'"))

    def column(c: str):
        if c == "text":
            return F.col("_new").alias(c)
        if c == "n_chars":
            kind = dict(docs.dtypes)[c]
            return F.when(F.col("_cut"), F.length("_new").cast(kind)).otherwise(F.col("_row.n_chars")).alias(c)
        return F.col(f"_row.`{c}`").alias(c)

    return done.select(*[column(c) for c in columns])


def repeats_by_document(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_spans, n_words_removed, n_bytes_removed, first_docs, kept (nothing to remove)."""
    spans = find_repeats(docs, percent)
    # By hand, so that the texts don't move with the ids.
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    total = lambda f: F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + f(s))
    return ids.join(spans, ["doc_id", "text_hash"], "left").select(
        "doc_id", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(total(lambda s: s["words"].cast("long")), F.lit(0)).alias("n_words_removed"),
        F.coalesce(total(lambda s: (s["end"] - s["start"]).cast("long")), F.lit(0)).alias("n_bytes_removed"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["first_doc"]))),
                   F.array().cast("array<bigint>")).alias("first_docs"),
        F.col("spans").isNull().alias("kept"))
