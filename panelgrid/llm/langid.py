"""Language identification by compression.

Each language's dictionary is raw text of that language.  A text, letters only
and lower-cased, is compressed with every dictionary; the smallest result names
the language.  A narrow margin over the next one makes the answer unreliable.

Learning reads a bounded sample: of at most ``MAX_LANGUAGES`` languages (the
most frequent) ``SAMPLE_DOCS`` documents each, chosen by a hash of the id, of
which each gives at most its share of a dictionary.  Scoring is one pass over
whole texts without a shuffle; the dictionaries (at most MAX_LANGUAGES *
DICTIONARY bytes) travel with the task.

Defined results: null, empty and letterless texts are ``und`` with score 0; if
there is nothing to learn from, every text is.  Equal sizes go to the language
with more documents, then to the first by name.  Repeated rows are scored each.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.llm.byte_bpe import slices
from panelgrid.llm.pretokens import LETTER, _classes, code_points

UNKNOWN = "und"
MAX_LANGUAGES = 100
SAMPLE_DOCS = 256
DICTIONARY = 1 << 17
#: Part of a dictionary that one document may fill, and bytes compressed at a time.
DOC_SHARE = 1 << 12
CHUNK = 1 << 12
#: Relative margins: from RELIABLE on an answer counts, at CERTAIN the score is 1.
RELIABLE = 0.01
CERTAIN = 0.10


def letters_only(texts: Sequence[str | None]) -> list[bytes]:
    """Each text lower-cased with every run of other signs as one blank, in UTF-8; empty without letters."""
    texts = [t or "" for t in texts]
    cp, sizes = code_points(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = _classes()[cp] == LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])  # the first other sign after a word
    plain = np.where(letter, cp, np.uint32(32))[keep].tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(np.bincount(owner[keep], minlength=len(texts))).tolist()
    return [plain[a:b].lower().encode("utf-8", "surrogatepass") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@functools.lru_cache(maxsize=4)
def _compressors(key: str, dictionaries: tuple[bytes, ...]) -> list:
    import zstandard

    params = zstandard.ZstdCompressionParameters(
        window_log=19, chain_log=17, hash_log=17, search_log=5, min_match=4, target_length=8,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False)
    out = []
    for raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
    return out


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of documents, from all rows of ``docs`` that have a language."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).where(
        "_lang IS NOT NULL AND _id IS NOT NULL AND _text IS NOT NULL")
    counts = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(MAX_LANGUAGES).collect()
    langs = [r["_lang"] for r in counts]
    if not langs:
        return []
    # Ids alone are ranked; at most MAX_LANGUAGES * SAMPLE_DOCS of them come out.
    by_hash = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = rows.where(F.col("_lang").isin(langs)).select("_id", "_lang").withColumn(
        "_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                [x[:DOC_SHARE] for x in letters_only(batch.column(2).to_pylist())], pa.binary())],
                names=["lang", "rank", "plain"])

    sample = rows.join(F.broadcast(chosen), ["_id", "_lang"]).select("_lang", "_rank", "_text").mapInArrow(
        run, "lang string, rank int, plain binary").orderBy("lang", "rank", "plain").collect()
    out = []
    for lang in langs:
        raw = b"".join(bytes(r["plain"]) for r in sample if r["lang"] == lang and r["plain"])[:DICTIONARY]
        if len(raw) >= 8:  # shorter ones are no dictionaries
            out.append((lang, raw))
    return out


def identify(docs: DataFrame, model: list[tuple[str, bytes]], text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred, score (0 to 1), margin and reliable."""
    langs, dictionaries = [m[0] for m in model], tuple(m[1] for m in model)
    key = hashlib.sha256(b"".join(dictionaries)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = [c.compress for c in _compressors(key, dictionaries)]
        for whole in batches:
            for batch in slices(whole, "_text"):
                pred, score, margins = [], [], []
                for raw in letters_only(batch.column(batch.num_columns - 1).to_pylist()):
                    if not raw or not langs:
                        pred.append(UNKNOWN), score.append(0.0), margins.append(0.0)
                        continue
                    parts = [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)]
                    sizes = [sum(len(c(p)) for p in parts) for c in compress]
                    best = min(range(len(sizes)), key=sizes.__getitem__)
                    next_best = min((s for k, s in enumerate(sizes) if k != best), default=None)
                    margin = 1.0 if next_best is None else (next_best - sizes[best]) / next_best
                    pred.append(langs[best]), score.append(min(1.0, margin / CERTAIN)), margins.append(margin)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                     pa.array(margins, pa.float64()), pa.array([m >= RELIABLE for m in margins], pa.bool_())],
                    names=[*batch.schema.names[:-1], "lang_pred", "score", "margin", "reliable"])

    kept = docs.select(*keep)
    schema = kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "margin": F.lit(0.0), "reliable": F.lit(True)}).schema
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
