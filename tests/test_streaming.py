"""Live cell aggregates from a stream of sheet files equal the batch view."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from panelgrid.operators.prepare import prepare
from panelgrid.operators.view import compute_view
from panelgrid.sources.assay import demo_rules, measurement_sheet
from panelgrid.sources.sheets import write_sheet
from panelgrid.streaming import sheet_stream, start_live_cells, view_from_cells


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="pg-stream-")
    raw = measurement_sheet(spark, SF_SMALL).withColumn("row_id", F.col("row_id").cast("string"))
    # two files landing one after the other
    write_sheet(raw.filter(F.col("row_id").cast("long") % 2 == 0), f"{base}/in/a")
    write_sheet(raw.filter(F.col("row_id").cast("long") % 2 == 1), f"{base}/in/b")
    rules = demo_rules()
    stream = sheet_stream(spark, f"{base}/in/*", raw.columns)
    q = start_live_cells(stream, rules, 90.0, f"{base}/cells", f"{base}/ckpt")
    q.awaitTermination(300)
    cells = spark.read.parquet(f"{base}/cells")
    batch_raw = measurement_sheet(spark, SF_SMALL)
    tidy = prepare(batch_raw, rules).tidy
    for metric, dose in (("pct_neut", 90.0), ("log10_ic50", None)):
        live = view_from_cells(cells, metric)
        batch = compute_view(tidy, metric, dose, rules.buckets)
        key = lambda r: (r["Bucket_Type"], r["Construct_Description"], r["PSV"])
        a = {key(r): (None if r["value"] is None else round(r["value"], 6), r["n_tested"], r["all_nn"])
             for r in live.collect()}
        b = {key(r): (None if r["value"] is None else round(r["value"], 6), r["n_tested"], r["all_nn"])
             for r in batch.collect()}
        assert a == b and len(a) > 0
