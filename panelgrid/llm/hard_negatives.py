"""Hard negatives by angular triangle filtering and integer scores.

Every row keeps its angles to a few reference directions and its norm.  For an
anchor a and a row v, the angle between them is at least the largest
|angle(a, r) - angle(v, r)| over the references r and at most the smallest
min(s, 2π - s) with s = angle(a, r) + angle(v, r).  The cosines of these ends
times both norms, widened by a margin that covers all rounding, bound the score
from both sides.  Only rows whose interval overlaps the window an anchor still
looks for get their integer score: first at or above the fifth best lower bound
of the anchor's own label (its positives), then within the windows below its
positives' scores (its negatives).

Plan: rows and anchors are dealt by a hash of their id into stripes of bounded
size; each (row stripe, anchor stripe) is one group of a cogroup, so no task
holds more than two stripes, and a label that a third of all rows bear is no key.
A group sends an anchor's own best few; a window per anchor (or anchor and
positive) keeps the best of these.  Scores are exact: products are made in
double precision where every partial sum is an integer below 2^53, otherwise in
longs.

Defined results: rows with a null id or label, or whose vector is null, empty,
or holds null or non-finite entries, take no part; nor do rows whose scaled norm
reaches 2^28, as a hundredfold score could leave a long.  Of rows that repeat an
id the one with the smallest label, then the smallest vector, takes part.
Vectors of unlike lengths are not compared.  Zero vectors score 0 with all.  An
anchor without another row of its label has no rows in the result, a positive
without a fitting negative neither.  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.llm.common import stored_at

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 80, 100
REFERENCES = 16
#: Rows and anchors of a group; anchors bounded at a time.
STRIPE = 8192
TOGETHER = 32
LARGEST_NORM = float(2 ** 28)
#: Covers the rounding of an angle (arc cosine near 1 included) and, as a share of both norms, of a bound.
ANGLE_MARGIN, SHARE_MARGIN = 1e-7, 1e-9

ROW = "vec_id long, label string, dim int, x binary, norm double, angles binary"


def _angles(x: np.ndarray, norm: np.ndarray, references: np.ndarray) -> np.ndarray:
    cosine = (x @ references.T) / np.where(norm > 0, norm, 1)[:, None]
    return np.arccos(np.clip(cosine, -1, 1))


def _measured(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """Each row's integer vector, norm and angles to the references of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            dims = lists.value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                x = some.column(2).flatten().to_numpy().astype(np.int64).reshape(-1, dim)
                norm = np.linalg.norm(x.astype(np.float64), axis=1)
                angles = _angles(x.astype(np.float64), norm, references.get(dim, np.zeros((0, dim))))
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array(np.full(len(x), dim, np.int32)), pa.array([r.tobytes() for r in x], pa.binary()),
                    pa.array(norm), pa.array([r.tobytes() for r in angles], pa.binary()),
                ], names=[f.split()[0] for f in ROW.split(", ")])

    return rows.mapInArrow(run, ROW)


def _references(rows: DataFrame, per_length: int = REFERENCES) -> dict[int, np.ndarray]:
    """Reference directions: for each of the few most frequent lengths, that many
    rows with distinct vectors, in the order of a hash.  Lengths without references have no
    bounds, and all their rows are scored."""
    out = {}
    for r in rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(4).collect():
        dim = r["dim"]
        got = rows.where((F.size("x") == dim) & F.exists("x", lambda c: c != 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * per_length).select("x").collect()
        vectors = np.array(list(dict.fromkeys(tuple(g["x"]) for g in got)), np.float64).reshape(-1, dim)[:per_length]
        out[dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return out


class Side:
    """One side of a group: ids, label codes, integer vectors, norms and angles."""

    def __init__(self, table: pa.Table, dim: int):
        self.id = table["vec_id"].to_numpy()
        self.label = table["label"].to_numpy()
        self.x = np.frombuffer(b"".join(table["x"].to_pylist()), np.int64).reshape(len(self.id), dim)
        self.norm = table["norm"].to_numpy()
        self.angles = np.frombuffer(b"".join(table["angles"].to_pylist()), np.float64).reshape(len(self.id), -1)


def bounds(a_norm: np.ndarray, a_angles: np.ndarray, v_norm: np.ndarray, v_angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above the scores of every anchor with every row."""
    least = np.zeros((len(a_norm), len(v_norm)))
    most = np.full_like(least, math.pi)
    for r in range(a_angles.shape[1]):
        a, v = a_angles[:, r, None], v_angles[None, :, r]
        np.maximum(least, np.abs(a - v), out=least)
        s = a + v
        np.minimum(most, np.minimum(s, 2 * math.pi - s), out=most)
    both = np.outer(a_norm, v_norm)
    spare = both * SHARE_MARGIN
    low = np.floor(both * np.cos(np.minimum(most + ANGLE_MARGIN, math.pi)) - spare)
    high = np.ceil(both * np.cos(np.maximum(least - ANGLE_MARGIN, 0)) + spare)
    return low, high


def exact_scores(a: np.ndarray, a_norm: np.ndarray, v: np.ndarray, v_norm: np.ndarray) -> np.ndarray:
    if a_norm.max(initial=0) * v_norm.max(initial=0) < 2.0 ** 52:
        return (a.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return a @ v.T


def _best(score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` best: higher scores, then smaller ids."""
    if len(score) > 8 * count:
        cut = np.partition(score, len(score) - count)[len(score) - count]
        near = np.flatnonzero(score >= cut)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:count]]


def _chunks(anchors: Side) -> Iterator[np.ndarray]:
    """Anchors that lie near the same reference together, as they share windows."""
    order = np.lexsort((anchors.angles.min(axis=1), anchors.angles.argmin(axis=1))) if anchors.angles.shape[1] else np.arange(len(anchors.id))
    for at in range(0, len(order), TOGETHER):
        yield order[at:at + TOGETHER]


def _find_positives(count: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            rows, anchors = Side(left, dim), Side(right, dim)
            for some in _chunks(anchors):
                low, high = bounds(anchors.norm[some], anchors.angles[some], rows.norm, rows.angles)
                same = (anchors.label[some][:, None] == rows.label[None, :]) & (anchors.id[some][:, None] != rows.id[None, :])
                enough = same.sum(axis=1) >= count
                least = np.full(len(some), -np.inf)
                if enough.any():
                    reached = np.where(same[enough], low[enough], -np.inf)
                    least[enough] = np.partition(reached, reached.shape[1] - count, axis=1)[:, reached.shape[1] - count]
                overlaps = same & (high >= least[:, None])
                needed = np.flatnonzero(overlaps.any(axis=0))
                scores = exact_scores(anchors.x[some], anchors.norm[some], rows.x[needed], rows.norm[needed])
                for k, a in enumerate(some):
                    mine = np.flatnonzero(overlaps[k, needed])
                    for p in mine[_best(scores[k, mine], rows.id[needed[mine]], count)]:
                        out.append((anchors.id[a], rows.id[needed[p]], scores[k, p]))
        cols = np.array(out, np.int64).reshape(-1, 3)
        return pa.table({c: cols[:, k] for k, c in enumerate(("anchor_id", "positive_id", "positive_score"))})

    return run


def _find_negatives(count: int, low_share: int, high_share: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            rows, anchors = Side(left, dim), Side(right, dim)
            positives = right["positives"].to_pylist()
            for some in _chunks(anchors):
                # Windows in hundredths of a score, as whole numbers.
                from_ = np.array([min(low_share * p["positive_score"] for p in positives[a]) for a in some])
                to = np.array([max(high_share * p["positive_score"] for p in positives[a]) for a in some])
                low, high = bounds(anchors.norm[some], anchors.angles[some], rows.norm, rows.angles)
                overlaps = (anchors.label[some][:, None] != rows.label[None, :]) & (100 * high >= from_[:, None]) & (100 * low <= to[:, None])
                needed = np.flatnonzero(overlaps.any(axis=0))
                if not len(needed):
                    continue
                scores = exact_scores(anchors.x[some], anchors.norm[some], rows.x[needed], rows.norm[needed])
                overlaps = overlaps[:, needed] & (100 * scores >= from_[:, None]) & (100 * scores <= to[:, None])
                for k, a in enumerate(some):
                    mine = np.flatnonzero(overlaps[k])
                    s, ids = scores[k, mine], rows.id[needed[mine]]
                    for p in positives[a]:
                        value = p["positive_score"]
                        fits = np.flatnonzero((100 * s >= low_share * value) & (100 * s <= high_share * value))
                        for b in fits[_best(s[fits], ids[fits], count)]:
                            out.append((anchors.id[a], p["positive_id"], value, ids[b], s[b]))
        cols = np.array(out, np.int64).reshape(-1, 5)
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table({c: cols[:, k] for k, c in enumerate(names)})

    return run


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)
    for the rows where ``is_anchor``, an expression over vec_id and label, holds."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("v"))
    limit = F.lit(LARGEST_NORM)
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
                & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < limit)))
    v = v.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))
    v = v.where(F.aggregate("x", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double")) < limit * limit)
    unique = v.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.label", "row.x")
    rows, path = stored_at(_measured(unique, _references(v)), "measured")
    # Read anew for every side of a cogroup: each has columns of its own.
    anchors, again = (spark.read.schema(rows.schema).parquet(path) for _ in range(2))
    anchors = anchors.where(is_anchor)

    per_length = {r["dim"]: (r["n"], r["a"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("a")).collect()}
    n, a = max((x[0] for x in per_length.values()), default=0), max((x[1] for x in per_length.values()), default=0)
    row_stripes = max(math.ceil(n / STRIPE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    anchor_stripes = max(1, math.ceil(a / STRIPE))
    key = ["i", "j", "dim"]

    def dealt(df: DataFrame, own: str, stripes: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(stripes)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def row_side(df: DataFrame):
        return dealt(df, "i", row_stripes, "j", anchor_stripes).groupBy(*key)

    def anchor_side(df: DataFrame):
        return dealt(df, "j", anchor_stripes, "i", row_stripes).groupBy(*key)

    near = row_side(rows).cogroup(anchor_side(anchors)).applyInArrow(_find_positives(positives), "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    kept = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    listed = kept.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    found = row_side(again).cogroup(anchor_side(anchors.join(listed, "vec_id"))).applyInArrow(
        _find_negatives(negatives, low, high),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
