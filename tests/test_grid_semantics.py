"""Grid, lookup and top-N semantics on small hand-made views (FIXTURES.md §3)."""

from pyspark.sql import functions as F

from panelgrid.config import Rules
from panelgrid.operators.grid import build_grid, pivot_wide, unpivot_long
from panelgrid.operators.prepare import build_lookup
from panelgrid.operators.ranking import ordered_rank
from panelgrid.operators.topn import construct_scores, match_panel

VIEW = "Bucket_Type string, Construct_Description string, PSV string, value double, n_tested long, all_nn boolean"


def grid_rows(g):
    return {(r["Construct_Description"], r["PSV"]): r for r in g.collect()}


def test_pooled_cell_mean_of_bucket_means(spark):
    v = spark.createDataFrame([("Boost1", "A", "T1", 15.0, 2, False), ("Prime", "A", "T1", 90.0, 1, False)], VIEW)
    hit = grid_rows(build_grid(v, "pct_neut", "threshold", 50.0, True))[("A", "T1")]
    assert hit["value"] == 52.5 and hit["status"] == "hit" and hit["n_tested"] == 3
    miss = grid_rows(build_grid(v, "pct_neut", "threshold", 95.0, True))[("A", "T1")]
    assert miss["status"] == "miss"


def test_pooled_status_first_bucket(spark):
    v = spark.createDataFrame([("Boost1", "A", "T1", -5.0, 1, False), ("Prime", "A", "T1", 40.0, 1, False)], VIEW)
    c = grid_rows(build_grid(v, "pct_neut", "threshold", 50.0, True))[("A", "T1")]
    assert c["value"] == 17.5 and c["status"] == "nn"


def test_dense_grid_and_row_order(spark):
    # breadth A = 1.0, B = C = 0.5
    rows = [("Prime", "A", "T1", 60.0, 1, False), ("Prime", "A", "T2", 60.0, 1, False),
            ("Prime", "B", "T1", 60.0, 1, False), ("Prime", "B", "T2", -1.0, 1, False),
            ("Prime", "C", "T1", 60.0, 1, False), ("Prime", "C", "T2", 0.0, 1, False),
            ("Prime", "D", "T3", 10.0, 1, False)]
    v = spark.createDataFrame(rows[:-1], VIEW)
    g = build_grid(v, "pct_neut", "threshold", 50.0, True, sort_descending=True)
    order = sorted({(r["export_rank"], r["Construct_Description"]) for r in g.collect()})
    assert [c for _, c in order] == ["B", "C", "A"]
    screen = sorted({(r["row_rank"], r["Construct_Description"]) for r in g.collect()})
    assert [c for _, c in screen] == ["A", "C", "B"]
    g2 = build_grid(v, "pct_neut", "threshold", 50.0, True, sort_descending=False)
    order2 = sorted({(r["export_rank"], r["Construct_Description"]) for r in g2.collect()})
    assert [c for _, c in order2] == ["A", "B", "C"]
    # densify: D only has T3 → every construct gets T1..T3
    g3 = build_grid(spark.createDataFrame(rows, VIEW), "pct_neut", "threshold", 50.0, True)
    cells = grid_rows(g3)
    assert len(cells) == 4 * 3
    assert cells[("D", "T1")]["status"] == "not_tested" and cells[("D", "T1")]["value"] is None
    assert {r["status"] for r in cells.values()} <= {"hit", "miss", "nn", "not_tested"}
    assert all(0.0 <= r["row_breadth"] <= 1.0 for r in cells.values())


def test_pivot_unpivot_roundtrip(spark):
    rows = [("Prime", c, t, float(i * 3 + j), 1, False) for i, c in enumerate("ABC") for j, t in enumerate(["T1", "T2"])]
    g = build_grid(spark.createDataFrame(rows, VIEW), "pct_neut", "gradient", 0.0, True)
    wide = pivot_wide(g)
    assert set(wide.columns) == {"Construct_Description", "export_rank", "T1", "T2"}
    back = unpivot_long(wide, ["Construct_Description", "export_rank"])
    a = {(r["Construct_Description"], r["PSV"], r["value"]) for r in back.collect()}
    b = {(r["Construct_Description"], r["PSV"], r["value"]) for r in g.collect()}
    assert a == b


def test_lookup_first_last_wins(spark):
    cs = spark.createDataFrame([(1, "PSVX-180", "G1", "x"), (2, "PSVX-180", "G2", "y"), (3, "180", "G1", "z")],
                               "row_id long, PSVX_ID string, Group string, Construct_Description string")
    pair, fb = build_lookup(cs, Rules())
    assert {(r["lk_psvx"], r["lk_grp"], r["pair_desc"]) for r in pair.collect()} == {("180", "G1", "z"), ("180", "G2", "y")}
    assert [r["fb_desc"] for r in fb.collect()] == ["x"]
    cs2 = cs.unionByName(spark.createDataFrame([(4, "180", "", "w")], cs.schema))
    _, fb2 = build_lookup(cs2, Rules())
    assert [r["fb_desc"] for r in fb2.collect()] == ["w"]


def test_top_scores(spark):
    v = spark.createDataFrame([("Prime", "A", "T1", 50.0, 1, False), ("Boost1", "A", "T1", 10.0, 1, False),
                               ("Prime", "B", "T1", 99.0, 1, False)], VIEW)
    s = {r["Construct_Description"]: (r["n_positive"], r["total"]) for r in construct_scores(v).collect()}
    assert s == {"A": (2, 60.0), "B": (1, 99.0)}


def test_panel_match(spark):
    t = spark.createDataFrame([("UNITED STATES",), ("UNITED KINGDOM",), ("JAPAN",), ("CHINA",)], "PSV string")
    got = [r["PSV"] for r in match_panel(t, ["japan", "UNITED", "CHINA", "JAPAN"]).orderBy("col_rank").collect()]
    assert got == ["JAPAN", "UNITED KINGDOM", "UNITED STATES", "CHINA"]


def test_ordered_rank_matches_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 2000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1009).alias("v"), "id")
    a = ordered_rank(df, ["k"], [-F.col("v"), F.col("id")], "r", num_partitions=7)
    b = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(-F.col("v"), F.col("id"))))
    assert sorted(map(tuple, a.select("id", "r").collect())) == sorted(map(tuple, b.select("id", "r").collect()))
