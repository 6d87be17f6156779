"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller
writes as Parquet and reads again as the next stage's docs; all but the last
return the columns of documents.  A row that a stage rejects is not seen again.
Nulls, empty texts, ties, repeated rows, empty tables and further columns are
handled as the operators' own docstrings say; a row with a null id is judged by
the filters like any other, and no duplicate stage drops it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.llm import minhash, packing, quality, substring_dedup, toxicity
from panelgrid.llm.common import read_table, stored
from panelgrid.llm.pretokens import library_encoder


#: Rows that go to a Python worker at a time.  The stages follow one another in the same
#: executors, whose workers keep what their largest batch took.
BATCH_ROWS = "2000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality.filter_quality(docs)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the scorer learns from the
    labelled documents that are still there."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.filter_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id.  Of rows that
    repeat this id in the group, one stays."""
    found = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    with_id = docs.where("doc_id IS NOT NULL").join(found, docs["doc_id"] == found["_id"], "left_semi")
    return with_id.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id IS NULL"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has."""
    return substring_dedup.remove_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids, and the sequence and place of each."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, lambda: library_encoder(vocabulary, "words"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", remove_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", remove_repeated_passages),
    ("packing", pack_sequences),
]

#: The learned scorer and the sketches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = spark.conf.get(_BATCH)
    try:
        for name, stage in STAGES:
            spark.conf.set(_BATCH, BATCH_ROWS)
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    finally:
        spark.conf.set(_BATCH, before)
    return docs
