"""Near-duplicate documents by MinHash, banded, with odd sketches.

Each text's distinct shingles are sampled by MinHash; the samples give band
keys and, folded by parity, a bitmap.  Texts with equal shingle sets are one
node.  Nodes that share a band key are compared by their bitmaps' XOR: its
population count estimates high similarities closely, so that only pairs near
or above the threshold are confirmed on their full sets
(:mod:`panelgrid.llm.linking`).

Texts are read twice, and only their signatures shuffle, but for the texts of
candidates.  The bands miss a pair at the threshold with a chance below
``MISS``; the bitmaps' limit lies six deviations out.

Defined results: words are runs of characters other than ASCII white space,
with A-Z lower-cased; a text with fewer words than a shingle is one shingle;
null and empty texts have no shingles and link with nothing; rows with a null
id link with nothing, have a null component and are kept; a row that repeats an
id and a text is a copy like any other, and rows with one id and different
texts get the component of their own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm import shingles
from panelgrid.llm.common import discard, stored, stored_at
from panelgrid.llm.linking import linked_components

WIDTH = 5
SAMPLES = 128
ROWS = 4
BITS = 512
#: Chance that no band of a pair at the threshold agrees.
MISS = 1e-5


def signatures(docs: DataFrame, bands: int, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set1 and set2 (a 128-bit fingerprint of the set), keys, bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, raw in shingles.chunks(texts):
                h, owner = shingles.text_sets(raw, width)
                n = np.bincount(owner, minlength=len(raw))
                one, two = np.zeros(len(raw), np.uint64), np.zeros(len(raw), np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    starts = (np.cumsum(n) - n)[some]
                    one[some] = np.add.reduceat(shingles.mix64(h + np.uint64(1)), starts)
                    two[some] = np.add.reduceat(shingles.mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                samples = shingles.minhash(h, owner, len(raw), SAMPLES)
                keys = shingles.band_keys(samples, bands, ROWS)
                bitmaps = shingles.odd_sketch(samples, BITS)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(raw)), pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel())),
                    pa.array([x.tobytes() for x in bitmaps], pa.binary()),
                ], names=["doc_id", "n_shingles", "set1", "set2", "keys", "bitmap"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set1 long, set2 long, keys array<long>, bitmap binary")


def shingle_members(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``members``, the distinct shingles of ``text`` as ascending 64-bit hashes, in place of it."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(kept)
            for at, raw in shingles.chunks(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                h, owner = shingles.text_sets(raw, width)
                parts = np.split(h, np.cumsum(np.bincount(owner, minlength=len(raw)))[:-1])
                some = rest.slice(at, len(raw))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([p.tobytes() for p in parts], pa.binary())],
                                                 names=[*kept, "members"])

    return rows.mapInArrow(run, rows.drop("text").withColumn("members", F.lit(b"")).schema)


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest id
    reachable by links, its own included) and kept (its id is that one).  Links
    join texts with 100 * common >= ``percent`` * united shingles."""
    bands = shingles.bands_for(percent / 100, ROWS, MISS)
    most_bits = shingles.most_odd_bits(percent / 100, SAMPLES, BITS)
    if bands * ROWS > SAMPLES:
        raise ValueError(f"{bands} bands of {ROWS} need more than {SAMPLES} samples")
    spark = docs.sparkSession
    found, found_path = stored_at(signatures(docs, bands, width, id_col, text_col), "signatures")
    sets, sets_path = stored_at(found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("set1", "set2").agg(
        F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("bitmap").alias("bitmap")), "sets")
    # One text for each id: that of the set the id stands for.
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))

    def with_members(clusters: DataFrame) -> DataFrame:
        rows = sets.select("node", "keys", "bitmap").join(clusters, "node").select("cluster", "node", "keys", "bitmap")
        return shingle_members(rows.join(texts, "node"), width)

    linked = linked_components(sets.select("node", F.explode(F.array_distinct("keys")).alias("key")), with_members,
                               lambda common, a, b: 100 * common >= percent * (a + b - common), most_bits)
    of_set = sets.select("set1", "set2", "node").join(linked, "node", "left").select(
        "set1", "set2", F.coalesce("component", "node").alias("component_id"))
    judged = found.select("doc_id", "n_shingles", "set1", "set2").join(of_set, ["set1", "set2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    judged = stored(judged, "judged")
    for path in (found_path, sets_path):
        discard(spark, path)
    return judged
