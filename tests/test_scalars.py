"""Worked examples of the scalar functions (FIXTURES.md §3)."""

import math

import pytest
from pyspark.sql import functions as F

from panelgrid.functions import (cell_label, cell_status, cohort_id, cohort_key, is_nn, log10_pos,
                                 norm_name, pairs_shortest, parse_array, parse_potency_variant,
                                 to_float, value_at_dose)


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("text,nn,ic50,log,variant", [
    ("NN", True, None, None, (0.0, True)),
    (" nn ", True, None, None, (0.0, True)),
    ("", True, None, None, (0.0, True)),
    ("-", True, None, None, (0.0, True)),
    ("N/A", True, None, None, (0.0, True)),
    ("0", True, 0.0, None, (0.0, True)),
    ("0.000", True, 0.0, None, (0.0, True)),
    ("2,000.0", False, 2000.0, math.log10(2000.0), (math.log10(2000.0), False)),
    (">1000", False, None, None, (0.0, True)),
    ("-5", False, -5.0, None, (0.0, True)),
    ("no neut", True, None, None, (0.0, True)),
])
def test_potency_text(spark, text, nn, ic50, log, variant):
    x = F.col("x")
    assert one(spark, is_nn(x), text) is nn
    got = one(spark, to_float(x), text)
    assert got == ic50
    got_log = one(spark, log10_pos(to_float(x)), text)
    assert (got_log is None and log is None) or abs(got_log - log) < 1e-12
    v = one(spark, parse_potency_variant(x), text)
    assert v["is_nn"] is variant[1] and abs(v["log10"] - variant[0]) < 1e-12


@pytest.mark.parametrize("text,expected", [
    ("[10.0, 30.0]", [10.0, 30.0]), (" [10, 30,] ", [10.0, 30.0]), ("(10, 30)", [10.0, 30.0]),
    ("10, 30", [10.0, 30.0]), ("[np.float64(10.0), np.float64(3e1)]", [10.0, 30.0]),
    ("(1,)", [1.0]), ("[-1.5, +2, .5, 5.]", [-1.5, 2.0, 0.5, 5.0]),
    ("", []), ("nan", []), ("[]", []), ("5", []), ("(1)", []), ("[1 2]", []), ("[1,,2]", []),
    ("[1, None]", []), ("[01]", []), ("[1.0d]", []), ("[[1],[2]]", []), ("[np.float64(nan), 1]", []),
])
def test_parse_array(spark, text, expected):
    assert one(spark, parse_array(F.col("x")), text) == expected


def test_value_at_dose(spark):
    df = spark.createDataFrame([([10.0, 30.0, 30.0], [5.0, 6.0, 7.0]), ([10.0, 30.0], [5.0])],
                               "d array<double>, n array<double>")
    r = df.select(value_at_dose("d", "n", 30.0).alias("a"), value_at_dose("d", "n", 30.009).alias("b"),
                  value_at_dose("d", "n", 30.02).alias("c")).collect()
    assert (r[0]["a"], r[0]["b"], r[0]["c"]) == (6.0, 6.0, None)
    assert r[1]["a"] is None  # unequal lengths
    pairs = df.select(pairs_shortest("d", "n").alias("p")).collect()[1]["p"]
    assert [(p["d"], p["n"]) for p in pairs] == [(10.0, 5.0)]


def test_text_helpers(spark):
    assert one(spark, cohort_id(F.col("x")), " PSVX-180 (R) ") == "180"
    assert one(spark, cohort_id(F.col("x")), "psvx181(c)") == "181"
    assert one(spark, cohort_key(F.col("x")), "psvx-12a (C)") == "12A"
    assert one(spark, norm_name(F.col("x")), "  E2 _TMD   Foo ") == "e2_tmd foo"
    assert one(spark, norm_name(F.col("x")), "E2_ tmd") == "e2_tmd"


@pytest.mark.parametrize("metric,mode,value,all_nn,thr,ge,status", [
    ("log10_ic50", "threshold", None, True, 3.0, True, "nn"),
    ("log10_ic50", "gradient", None, False, 3.0, True, "nn"),
    ("pct_neut", "gradient", None, False, 50.0, True, "not_tested"),
    ("pct_neut", "threshold", 0.0, False, 50.0, True, "nn"),
    ("pct_neut", "threshold", -3.0, False, 50.0, True, "nn"),
    ("pct_neut", "threshold", 50.0, False, 50.0, True, "hit"),
    ("pct_neut", "threshold", 50.0, False, 50.0, False, "miss"),
    ("pct_neut", "gradient", 12.0, False, 50.0, True, "hit"),
])
def test_cell_status(spark, metric, mode, value, all_nn, thr, ge, status):
    df = spark.createDataFrame([(value, all_nn)], "v double, a boolean")
    got = df.select(cell_status(F.col("v"), F.lit(True), F.col("a"), metric, mode, thr, ge).alias("s"))
    assert got.collect()[0]["s"] == status
    nt = df.select(cell_status(F.col("v"), F.lit(False), F.col("a"), metric, mode, thr, ge).alias("s"))
    assert nt.collect()[0]["s"] == "not_tested"


def test_cell_label(spark):
    df = spark.createDataFrame([(52.46, "hit"), (0.0, "nn"), (None, "not_tested")], "v double, s string")
    got = [r["l"] for r in df.select(cell_label("v", "s", "gradient").alias("l")).collect()]
    assert got == ["52.5", "0.00", None]
