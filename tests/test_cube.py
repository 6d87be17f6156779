"""The cell × dose cube, exact means, lazy plans and stored tables."""

import json
import os
import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from panelgrid.config import Rules, ViewSpec
from panelgrid.functions.exact import mean, sum_parts
from panelgrid.operators import grid as G
from panelgrid.operators.cube import build_cube, cube_curves, cube_view, default_dose
from panelgrid.operators.curve import curves
from panelgrid.operators.view import compute_view, view_filter
from panelgrid.plans import catalog
from panelgrid.session import ensure_checkpoint_dir
from panelgrid.sources.store import TableStore, listing_hash, rules_hash
from tests.conftest import SF_SMALL

TIDY = ("Experiment string, Group string, Bucket_Type string, Construct_Description string, PSV string, Is_NN boolean, "
        "Log10_IC50 double, DilutionArray array<double>, NeutArray array<double>")


def tidy_rows(n=600, seed=4):
    """Rows with unequal, empty and repeating arrays, and doses so near that one request may meet two of them."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        doses = [rng.choice([10.0, 30.0, 30.005, 30.015, 29.995, 90.0, 270.0]) for _ in range(rng.randrange(0, 7))]
        if k % 3:
            doses = sorted(set(round(d) * 1.0 for d in doses))
        responses = [rng.choice([0.1 * rng.randrange(-50, 1100), 50.0, 1e17 if k % 97 == 0 else 33.3]) for _ in doses]
        if k % 11 == 0:
            responses = responses[:-1]
        if k % 13 == 0:
            responses = [*responses, 5.0]
        nn = rng.random() < 0.3
        out.append((rng.choice("EFG"), rng.choice(["", "G1", "G2"]), rng.choice(["Prime", "Boost1", "Boost2", "Unknown"]),
                    "hot" if k % 3 == 0 else f"c{rng.randrange(5)}", f"T{rng.randrange(4)}", nn, None if nn else rng.random() * 4, doses, responses))
    return out


@pytest.fixture(scope="module")
def tidy(spark):
    return spark.createDataFrame(tidy_rows(), TIDY).persist()


def bits(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("dose", [10.0, 30.0, 30.0075, 30.009, 30.0049, 30.02, 29.99, 90.004, 7.0, "all", None])
def test_cube_equals_rows_bit_for_bit(tidy, dose):
    cube = build_cube(tidy)
    metric = "log10_ic50" if dose is None else "pct_neut"
    assert bits(cube_view(cube, metric, dose)) == bits(compute_view(tidy, metric, dose))
    spec = ViewSpec(metric, dose, experiments=("E", "F"), groups=("G1",), targets=("T0", "T2", "T3"))
    for s in (spec, replace(spec, groups=None), replace(spec, groups=None, default_group_filter=False)):
        got, want = (bits(compute(view_filter(rows, s), metric, dose)) for compute, rows in ((cube_view, cube), (compute_view, tidy)))
        assert got == want
    assert dose == 7.0 or len(bits(cube_view(cube, metric, dose))) > 5


def test_curves_and_counts_from_the_cube(tidy):
    cube = build_cube(tidy)
    assert bits(cube_curves(cube)) == bits(curves(tidy))
    assert bits(cube_curves(cube.where("Bucket_Type = 'Boost1' AND PSV = 'T1'"))) == bits(curves(tidy, target="T1", buckets=["Boost1"]))
    assert cube.agg(F.sum("n_rows")).first()[0] == tidy.count()
    doses = {d for r in tidy.collect() for d in r["DilutionArray"]}
    assert {r[0] for r in cube.where("dose IS NOT NULL").select("dose").distinct().collect()} == doses


@pytest.mark.parametrize(("doses", "want"), [([[90.0, 5.0], [30.0]], 90.0), ([[30.0, 5.0], [7.0]], 30.0), ([[12.0], [8.0, 400.0]], 8.0), ([[], []], 30.0), ([], 30.0)])
def test_default_dose(spark, doses, want):
    rows = [("E", "G", "Prime", "c", "t", False, 1.0, d, [1.0] * len(d)) for d in doses]
    cube = build_cube(spark.createDataFrame(rows, TIDY))
    assert spark.range(1).select(default_dose(cube)).first()[0] == want
    view = cube_view(cube, "pct_neut", default_dose(cube)).collect()
    assert [r["n_tested"] for r in view] == ([sum(want in d for d in doses)] if any(want in d for d in doses) else [])


def test_views_do_not_depend_on_partitions(tidy):
    rows = tidy.collect()
    seen = set()
    for n in (1, 16, 64):
        random.Random(n).shuffle(rows)
        cube = build_cube(tidy.sparkSession.createDataFrame(rows, TIDY).repartition(n))
        seen.add("|".join(bits(cube_view(cube, "log10_ic50")) + bits(cube_view(cube, "pct_neut", "all"))))
    assert len(seen) == 1


@pytest.mark.parametrize("values", [[0.1] * 10, [1e-18, 1.0, -1.0], [2.0 ** 52, 0.5, -0.25], [1e300, 1.0], [-0.3, 0.3], [3.0, None], [None, None], []])
def test_exact_mean(spark, values):
    from fractions import Fraction
    some = [v for v in values if v is not None]
    got = spark.createDataFrame([(v,) for v in values], "x double").agg(*sum_parts("x", "v")).select(mean("v").alias("m")).first()["m"]
    if not some:
        assert got is None
    else:
        want = float(sum(map(Fraction, some)) / len(some))
        assert abs(got - want) <= 1e-17 + 4e-16 * max(map(abs, some))


def test_means_that_differ_by_little_rank_alike(spark):
    """Row means 1e-12 apart are told apart, equal ones tie, whatever the partitions."""
    n = 3000
    rows = spark.range(n * 3).select(
        F.lit("Prime").alias("Bucket_Type"), F.concat(F.lit("c"), F.col("id") % n).alias(G.C), F.concat(F.lit("t"), F.floor(F.col("id") / n)).alias(G.T),
        (F.lit(10.1) * (F.floor(F.col("id") / n) + 1) + (F.col("id") % n % 50) * 1e-12).alias("value"), F.lit(1).cast("long").alias("n_tested"), F.lit(False).alias("all_nn"))
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (1, 16, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            g = G.build_grid(rows.repartition(parts, F.rand(parts)), "pct_neut", "gradient", sort_by="mean_value").where("col_rank = 1")
            seen.append([r[G.C] for r in g.orderBy("export_rank").select(G.C).collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] == sorted(seen[0], key=lambda c: (int(c[1:]) % 50, c))


def jobs(spark):
    at = spark._jsc.sc().dagScheduler().nextJobId()
    return at.get() if hasattr(at, "get") else at


def test_no_job_while_a_view_is_built(spark):
    catalog.prepared(spark, SF_SMALL)
    before = jobs(spark)
    built = {n: q(spark, SF_SMALL) for n, q in catalog.QUERIES.items() if "10" <= n[1:3] <= "24" and n != "q24b_export_file"}
    assert jobs(spark) == before and len(built) >= 16


def folders(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {d for d in os.listdir(root) if not d.startswith(("rdd-", "."))}


def test_queries_leave_no_tables(spark):
    catalog.release(spark)
    before = folders(spark)
    for name in ("q01_scan_resolve", "q15_grid", "q17_small_multiples", "q20_top_summary", "q23_domains", "q24b_export_file"):
        catalog.QUERIES[name](spark, SF_SMALL).collect()
    catalog.release(spark)
    assert folders(spark) - before <= {"tables"}
    assert not [f for _, _, files in os.walk(ensure_checkpoint_dir(spark).removeprefix("file:") + "/tables") for f in files]


def test_stored_tables_notice_change(spark, tmp_path):
    data, store = tmp_path / "in", TableStore(spark, str(tmp_path / "store"))
    made = []

    def fetch(rules):
        manifest = {"inputs": listing_hash(spark, [str(data), str(tmp_path / "absent")]), "rules": rules_hash(rules)}

        def make(_):
            made.append(manifest)
            return spark.read.parquet(str(data))

        return store.fetch("t", manifest, {"tidy": make, "more": lambda tables: tables["tidy"].groupBy().count()})

    spark.range(5).write.parquet(str(data))
    for _ in range(3):
        assert fetch(Rules())["tidy"].count() == 5
    assert len(made) == 1
    old = fetch(Rules())
    time.sleep(1.1)
    spark.range(9).write.mode("overwrite").parquet(str(data))
    assert fetch(Rules())["more"].first()[0] == 9 and len(made) == 2
    assert old["tidy"].count() == 5  # a plan on the old version still reads it
    fetch(Rules(buckets=("Prime",)))
    assert len(made) == 3
    manifests = [json.loads(spark.read.text(str(p)).first()[0]) for p in (tmp_path / "store" / "t").glob("*/manifest")]
    assert len(manifests) == 3 and all(set(m) == {"inputs", "rules"} for m in manifests)
    store.clear("t")
    fetch(Rules())
    assert len(made) == 4
    assert rules_hash(Rules()) != rules_hash(Rules(target_groups={"a": "b"}))
