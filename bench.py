"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

``prepare`` times building and persisting the tidy frame from the driver
tables (adapter + cohort filters + parsing + lookups); every other entry is
one registered query forced through a ``noop`` sink (full evaluation, no
collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from panelgrid.plans import catalog  # noqa: E402
from panelgrid.session import local_session  # noqa: E402

HEADLINE = [
    "q03_tidy", "q04_parse_arrays", "q10_view_single_dose", "q11_view_all_doses", "q12_view_log10",
    "q15_grid", "q16_grid_rows_ranked", "q17_small_multiples", "q19_top_n", "q20_top_summary",
    "q21_curve", "q23_domains", "q24_export_long", "q25_pivot_wide", "q27_fit_4pl", "q29_hill_fixed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    n_cpu = int(cpus) if cpus.isdigit() else os.cpu_count() or 4
    spark = local_session(cpus, shuffle_partitions=max(4, 2 * n_cpu), app="panelgrid-bench")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    times: dict[str, float] = {}
    t0 = time.time()
    p = catalog.prepared(spark, sf_dir)
    p.tidy.select(F.count(F.lit(1))).collect()
    times["prepare"] = round(time.time() - t0, 3)

    for name in HEADLINE:
        fn = catalog.QUERIES[name]
        t = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": cpus}))
    catalog.release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
