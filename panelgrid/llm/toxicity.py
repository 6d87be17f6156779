"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; a sample of documents, toxic ones
among them, is the unlabelled side.  With the class prior ``p`` the risk of a
linear scorer is estimated as

    p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))

and minimised in numpy; where the second term falls below zero, its gradient is
reversed, so that the scorer cannot memorise its positives.

Features are words and beginnings of words, lower-cased, each on some levels:
whether it occurs at all, often, or as a share of the text.  Their counts in all
positives and in all documents are gathered over the cluster, and the ``FEATURES`` that raise the share
among positives most are kept.  The fit takes at most
MAX_POSITIVE and MAX_UNLABELLED documents, chosen by a hash of their ids (of rows
that repeat an id the one whose text has the least hash), and
sees only which features each one has.  Scoring is one pass over whole texts.

Defined results: null and empty texts get the score of a text without any
feature; without a toxic example, or anything unlabelled, every score is 0; a
label that repeats counts once for each of its rows; null labels and ids teach
nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.byte_bpe import slices
from panelgrid.llm.common import stored
from panelgrid.llm.pretokens import mix64, span_hashes
from panelgrid.llm.shingles import _LOWER

#: Bytes of a word's beginning that make a gram, beside the whole word.
PREFIXES = (4, 6)
SLOTS = 1 << 21
#: (least occurrences, least share of the text's words) of each level.
LEVELS = ((1, 0.0), (2, 0.0), (3, 0.0), (2, 0.005), (2, 0.02))
FEATURES = 1024
#: Least estimated chance that a text with the feature is toxic.
LEAST_PURITY = 0.15
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 16_000
#: A feature has to be in so many positives.
LEAST_POSITIVE = 5
#: Hash buckets of the positives' ids.
BUCKETS = 1 << 18
STEPS = 400
RATE = 0.05
DECAY = 1e-4
THRESHOLD = 0.7
#: Bytes of text whose grams a worker holds at a time, and rows that it sends on at a time.
SLICE = 1 << 20
ROWS_OUT = 1 << 16


#: Bytes inside words: ASCII letters and digits, and all of other scripts' signs.
_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


@dataclass(frozen=True)
class Model:
    features: tuple[int, ...]
    weights: tuple[float, ...]
    bias: float
    prior: float


def gram_slots(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash slots of the grams of each text's words (the whole word and its
    first bytes, A-Z lower-cased), their owners, and each text's words."""
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    edge = np.flatnonzero(np.diff(_WORD[joined], prepend=False, append=False))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
    text = np.searchsorted(ends, starts, "right")
    low = _LOWER[joined]
    at = np.flatnonzero(_WORD[joined])
    whole = span_hashes(low[at], np.cumsum(lengths) - lengths, lengths)
    out, owner = [whole % np.uint64(SLOTS)], [text]
    for n in PREFIXES:
        some = lengths > n
        code = np.full(int(some.sum()), np.uint64(n))
        for k in range(n):
            code = code << np.uint64(8) | low[starts[some] + k]
        out.append(mix64(code) % np.uint64(SLOTS))
        owner.append(text[some])
    return np.concatenate(out).astype(np.int64), np.concatenate(owner), np.bincount(text, minlength=len(raw))


def _levels(slot: np.ndarray, owner: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each level, the slots and owners that reach it: a gram counts when it
    occurs so often, or is such a share of the text's words and occurs twice."""
    both, n = np.unique(slot * np.int64(1 << 32) + owner, return_counts=True)
    slot, owner = both >> 32, both & ((1 << 32) - 1)
    for level, (least, share) in enumerate(LEVELS):
        there = (n >= least) & (n >= share * words[owner])
        yield level, slot[there], owner[there]


def _present(raw: list[bytes], column_of: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of each feature that a text has, each once, by owner."""
    slot, owner, words = gram_slots(raw)
    hit = known[slot]
    got = [(o, column_of[s, level]) for level, s, o in _levels(slot[hit], owner[hit], words)]
    owner, feature = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(owner[feature >= 0], kind="stable")
    return owner[feature >= 0][order], feature[feature >= 0][order]


@functools.lru_cache(maxsize=4)
def _columns(features: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each (slot, level) that is a feature, else -1; which slots have one."""
    table = np.full((SLOTS, len(LEVELS)), -1, np.int16)
    table.reshape(-1)[list(features)] = np.arange(len(features))
    return table, (table >= 0).any(axis=1)


def _raw(texts: Sequence[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ids, those with the smallest hash; ids alone are sorted."""
    return rows.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)


def _fit(rows: tuple[np.ndarray, np.ndarray], positive: np.ndarray, n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias under the logistic loss, by full gradient steps with
    momentum and adaptive rates.  ``rows`` are the (row, feature) pairs that are
    present; ``positive`` tells each row's side."""
    row, feature = rows
    n_p, n_u = positive.sum(), (~positive).sum()
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        f = w[-1] + np.bincount(row, weights=w[feature], minlength=len(positive))
        up, loss = 1 / (1 + np.exp(-f)), np.logaddexp(0, f)
        negative = loss[~positive].mean() - prior * loss[positive].mean()
        by_row = np.where(positive, -prior / n_p, 1 / n_u) * up
        if negative >= 0:
            by_row += np.where(positive, prior / n_p, 0) * (up - 1)
        else:
            by_row = -by_row
        g = np.append(np.bincount(feature, weights=by_row[row], minlength=n_features) + DECAY * w[:-1], by_row.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from ``docs`` (unlabelled texts) and ``labels``, whose 1s are the
    confirmed examples; the share of 1s among all labels is the class prior.
    Give only rows that may be learned from."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_id IS NOT NULL AND _text IS NOT NULL")
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(
        "_id IS NOT NULL AND _label IN (0, 1)")
    seen = marks.join(rows.select("_id"), "_id", "left_semi")
    share = seen.agg(F.avg("_label")).first()[0]
    if not share:
        return Model((), (), -np.inf, 0.0)
    prior = min(max(float(share), 1e-3), 0.5)
    positive = _bounded(seen.where("_label = 1"), MAX_POSITIVE).withColumn("_side", F.lit(1))
    unlabelled = _bounded(rows, MAX_UNLABELLED).withColumn("_side", F.lit(0))
    # At most MAX_POSITIVE + MAX_UNLABELLED ids, and one row of each on each side however often it is repeated.
    text_hash = F.xxhash64("_text")
    sample = stored(rows.join(F.broadcast(positive.unionAll(unlabelled)), "_id").groupBy("_id", "_side").agg(
        F.min_by("_text", F.struct(text_hash, "_text")).alias("_text")).select("_id", "_text", "_side"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each feature's texts, added up over the task in one number for each slot and level."""
        total = np.zeros(SLOTS * len(LEVELS), np.int32)
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                for level, s, _ in _levels(*gram_slots(_raw(batch.column(1).to_pylist()))):
                    some, n = np.unique(s, return_counts=True)
                    total[some * len(LEVELS) + level] += n.astype(np.int32)
        found = np.flatnonzero(total)
        for at in range(0, len(found), ROWS_OUT):
            some = found[at:at + ROWS_OUT]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], names=["feature", "n"])

    def counted(texts: DataFrame, name: str) -> DataFrame:
        return texts.select("_id", "_text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias(name))

    every = seen.where("_label = 1").select("_id").distinct()
    # At most BUCKETS numbers: they leave out most texts that are no positives before any text moves.
    bucket = F.pmod(F.xxhash64("_id"), F.lit(BUCKETS)).alias("_bucket")
    near = rows.withColumn("_bucket", bucket).join(F.broadcast(every.select(bucket).distinct()), "_bucket", "left_semi").drop("_bucket")
    positives = near.join(every, "_id", "left_semi")
    n_p, n_u = positives.count(), rows.count()
    if not n_p or not n_u:
        return Model((), (), -np.inf, 0.0)
    p, u = F.col("p") / n_p, F.col("u") / n_u
    sure = (F.col("p") - 2 * F.sqrt("p")) / n_p  # what is left of the share after two standard deviations
    chosen = (counted(positives, "p").where(F.col("p") >= LEAST_POSITIVE).join(counted(rows, "u"), "feature")
        .where(prior * sure >= LEAST_PURITY * u).withColumn("gain", p * F.log((p + 1e-4) / (u + 1e-4)))
        .orderBy(F.desc("gain"), "feature").limit(FEATURES).collect())
    slots = tuple(int(r["feature"]) for r in chosen)
    if not slots:
        return Model((), (), float(np.log(prior / (1 - prior))), prior)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                owner, feature = _present(_raw(batch.column(1).to_pylist()), *_columns(slots))
                has = [x.tolist() for x in np.split(feature, np.cumsum(np.bincount(owner, minlength=batch.num_rows))[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(has, pa.list_(pa.int32()))],
                                                 names=["id", "side", "has"])

    got = sample.select(F.col("_id").cast("string").alias("_id"), "_text", "_side").mapInArrow(
        features, "id string, side int, has array<int>").collect()
    got.sort(key=lambda r: (r["side"], r["id"], r["has"]))
    row = np.repeat(np.arange(len(got)), [len(r["has"]) for r in got])
    feature = np.fromiter((f for r in got for f in r["has"]), np.int64, len(row))
    weights, bias = _fit((row, feature), np.array([r["side"] == 1 for r in got]), len(slots), prior)
    return Model(slots, tuple(float(w) for w in weights), bias, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``score``, the estimated chance that a text is toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, weights = _columns(model.features), np.array(model.weights)
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                total = np.full(batch.num_rows, model.bias)
                if len(weights):
                    owner, feature = _present(_raw(batch.column(batch.num_columns - 1).to_pylist()), *columns)
                    total = total + np.bincount(owner, weights=weights[feature], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))],
                    names=[*batch.schema.names[:-1], "score"])

    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def filter_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_body"))
    return score(packed, model, "_body", ("_row",)).where(F.col("score") < threshold).select("_row.*")
