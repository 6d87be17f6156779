"""Panel matching (J10, U3), top-N scores (A10), top-N per subgroup.

Scores are computed from the aggregated view; the top-N pick is a
``row_number`` window with ``<= n``, which Spark plans with a partial
``WindowGroupLimit`` before the shuffle, so a hot subgroup only ships its
local top n rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TOP_N, Rules
from ..functions.exact import sum_parts, total
from .classify import classify
from .ranking import ordered_rank

C, T = "Construct_Description", "PSV"


def match_panel(targets: DataFrame, panel: Sequence[str], target_col: str = T) -> DataFrame:
    """J10 + U3: panel entries matched against the target domain.

    An entry matches exactly if that target exists, else every target that
    contains it case-insensitively.  Several hits of one entry are ordered by
    target name (the dashboard's order there is hash-set order).  Duplicates
    keep their first position.  Returns (PSV, col_rank) with ranks 1..n.

    The panel is a configuration list: a scalar subquery tells, per entry,
    whether an exact hit exists; each distinct target then gets the first
    panel position it matches (a generated expression, no join).
    """
    names = list(panel)
    tg = targets.select(F.col(target_col).alias(T)).distinct()
    if not names:
        return tg.limit(0).select(T, F.lit(1).cast("bigint").alias("col_rank"))
    exact = tg.agg(F.array(*[F.coalesce(F.max(F.col(T) == F.lit(nm)), F.lit(False)) for nm in names]).alias("exact")).scalar()
    hits = F.array(*[F.when(exact[i], F.col(T) == F.lit(nm)).otherwise(F.lower(F.col(T)).contains(nm.lower()))
                     for i, nm in enumerate(names)])
    first = F.nullif(F.array_position(hits, F.lit(True)), F.lit(0))
    matched = tg.withColumn("_ord", first).filter(F.col("_ord").isNotNull())
    ranked = ordered_rank(matched, [], [F.col("_ord"), F.col(T)], rank_col="col_rank")
    return ranked.select(T, F.col("col_rank").cast("bigint"))


def construct_scores(view: DataFrame) -> DataFrame:
    """A10: per construct, (count of view rows with value > 0, their sum)."""
    pos = F.col("value") > 0
    summed = view.groupBy(C).agg(*sum_parts(F.when(pos, F.col("value")), "v"))
    return summed.select(C, F.col("v_n").alias("n_positive"), F.coalesce(total("v"), F.lit(0.0)).alias("total"))


def top_constructs(tidy: DataFrame, view: DataFrame, rules: Rules, n: int = TOP_N) -> DataFrame:
    """Top ``n`` constructs per subgroup by (n_positive, total) descending,
    name ascending on ties.  Candidates are all constructs of the (filtered)
    tidy rows, including those absent from the view (score (0, 0.0))."""
    cands = classify(tidy.select(C).distinct(), rules)
    scored = cands.join(construct_scores(view), C, "left").select(
        "Subgroup", C, F.coalesce("n_positive", F.lit(0)).alias("n_positive"),
        F.coalesce("total", F.lit(0.0)).alias("total"))
    w = Window.partitionBy("Subgroup").orderBy(F.desc("n_positive"), F.desc("total"), F.asc(C))
    return scored.withColumn("top_rank", F.row_number().over(w)).filter(F.col("top_rank") <= n)
