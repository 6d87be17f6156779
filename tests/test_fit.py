"""4PL fit: planted curves, too few points, infeasible start, bounds."""

import numpy as np
import pandas as pd

from panelgrid.operators.fit import _fit_group, fit_curves, fit_hill, fit_lines, grid_errors


def hill(x, top, bottom, ic50, slope):
    return bottom + (top - bottom) / (1 + (x / ic50) ** slope)


def test_planted_recovery():
    x = np.array([10, 30, 90, 270, 810, 2430.0])
    top, bottom, ic50, slope, sse, status = fit_hill(x, hill(x, 95, 5, 200, 1.2))
    assert status == "ok"
    for got, want in ((top, 95), (bottom, 5), (ic50, 200), (slope, 1.2)):
        assert abs(got - want) <= 0.01 * abs(want)


def test_many_planted_within_one_percent():
    rng = np.random.default_rng(7)
    x = np.array([10, 30, 90, 270, 810, 2430, 7290.0])
    for _ in range(50):
        p = (rng.uniform(60, 110), rng.uniform(-5, 20), rng.uniform(30, 3000), rng.uniform(0.5, 3))
        top, bottom, ic50, slope, _, status = fit_hill(x, hill(x, *p))
        assert status == "ok"
        assert abs(ic50 - p[2]) <= 0.01 * p[2] and abs(slope - p[3]) <= 0.01 * p[3]


def test_status_rules():
    few = pd.DataFrame({"Construct_Description": ["c"] * 3, "PSV": ["t"] * 3,
                        "dilution": [10.0, 30.0, 90.0], "pct_neut": [90.0, 50.0, 10.0]})
    assert _fit_group(few)["fit_status"].iloc[0] == "too_few_points"
    hi = pd.DataFrame({"Construct_Description": ["c"] * 4, "PSV": ["t"] * 4,
                       "dilution": [10.0, 30.0, 90.0, 270.0], "pct_neut": [130.0, 50.0, 10.0, 5.0]})
    assert _fit_group(hi)["fit_status"].iloc[0] == "failed"


def test_bounds_respected_on_noise():
    rng = np.random.default_rng(3)
    x = np.array([10, 30, 90, 270, 810, 2430.0])
    for _ in range(30):
        y = rng.uniform(-5, 100, x.size)
        top, bottom, ic50, slope, _, status = fit_hill(x, y)
        if status == "ok":
            assert 0 <= top <= 120 and -10 <= bottom <= 100 and 0.1 <= slope <= 10
            assert x.min() * 0.01 * (1 - 1e-9) <= ic50 <= x.max() * 100 * (1 + 1e-9)


def test_fit_on_spark(spark):
    x = [10.0, 30.0, 90.0, 270.0, 810.0, 2430.0]
    rows = [("A", "T", d, float(hill(d, 95, 5, 200, 1.2))) for d in x] + [("B", "T", 10.0, 50.0)]
    curve = spark.createDataFrame(rows, "Construct_Description string, PSV string, dilution double, pct_neut double")
    fits = {r["Construct_Description"]: r for r in fit_curves(curve).collect()}
    assert fits["A"]["fit_status"] == "ok" and abs(fits["A"]["ic50"] - 200) < 2
    assert fits["B"]["fit_status"] == "too_few_points"
    lines = fit_lines(fit_curves(curve))
    assert lines.filter("kind = 'line'").count() == 300
    marker = lines.filter("kind = 'ic50'").collect()[0]
    assert abs(marker["y"] - 50.0) < 0.5


def test_grid_finds_planted_nodes_and_bounds_the_fit(spark):
    rng = np.random.default_rng(5)
    x = np.array([10, 30, 90, 270, 810, 2430.0])
    node = 10.0 ** (1 + 7 * np.log10(243) / 15)  # the eighth of 16 log-spaced doses
    rows = [("planted", "t", d, v) for d, v in zip(x.tolist(), hill(x, 95, 5, node, 2.0).tolist())]
    rows += [(f"noise{k}", "t", d, v) for k in range(40) for d, v in zip(x.tolist(), rng.uniform(0, 100, 6).tolist())]
    rows += [("few", "t", d, 50.0) for d in x[:3].tolist()] + [("zero", "t", d, 50.0) for d in [0.0, *x[:4].tolist()]]
    curve = spark.createDataFrame(rows, "Construct_Description string, PSV string, dilution double, pct_neut double")
    nodes = grid_errors(curve)
    got = {r[0]: r for r in nodes.collect()}
    assert "few" not in got and "zero" not in got and len(got) == 41
    p = got["planted"]
    assert p.grid_sse < 1e-12 and abs(p.grid_top - 95) < 1e-6 and abs(p.grid_bottom - 5) < 1e-6 and abs(p.grid_ic50 - node) < 1e-6
    fits = {r.Construct_Description: r for r in fit_curves(curve, nodes=nodes).collect()}
    alone = {r.Construct_Description: r for r in fit_curves(curve).collect()}
    assert fits["few"].fit_status == "too_few_points" and fits["zero"].fit_status == "failed"
    for k in got:
        assert fits[k].fit_status == "ok" and fits[k].sse <= got[k].grid_sse * (1 + 1e-9) + 1e-9
        assert alone[k].fit_status == "failed" or fits[k].sse <= alone[k].sse
