"""Assay-shaped sheets derived from the driver's TPC-H style tables.

The engine works on measurement sheets (one row per sample × target with
dose / response arrays as text) and an optional constructs sheet.  The
queries, tests and the bench derive both from the given parquet tables so
that the work grows with them:

* one measurement row per order: ``row_id = o_orderkey``; experiment =
  order priority, group = order status, cohort id from the customer key,
  target = customer nation name, day = order year, construct = name of the
  order's lowest part key;
* dose / response arrays from the order's lines, ordered by
  (linenumber, partkey, suppkey, quantity, extendedprice):
  dose = 10·3^(linenumber-1), response = round(100 - 2.2·quantity, 1)
  (raw response: round(100 - 2·quantity, 1));
* constructs sheet: one row per supplier (cohort from the supplier nation).

Lines are gathered per order (bounded by the lines of one order); the
big joins are shuffle joins on their keys, only ``nation`` (25 rows, size
checked) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Rules
from ..session import bounded_broadcast

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


#: The tables that the sheets are derived from.
ASSAY_TABLES = ("orders", "lineitem", "customer", "nation", "part", "supplier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _num_text(x):
    return x.cast("string")


def _array_text(arr, wrap_np=None, as_tuple=None):
    """Render array<double> as sheet text: ``[a, b]``; optionally each element
    as ``np.float64(a)`` or the whole as a tuple ``(a, b,)``."""
    elems = F.transform(arr, lambda x: _num_text(x))
    if wrap_np is not None:
        elems = F.when(wrap_np, F.transform(elems, lambda s: F.concat(F.lit("np.float64("), s, F.lit(")")))
                       ).otherwise(elems)
    body = F.array_join(elems, ", ")
    listed = F.concat(F.lit("["), body, F.lit("]"))
    if as_tuple is None:
        return listed
    return F.when(as_tuple, F.concat(F.lit("("), body, F.lit(",)"))).otherwise(listed)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: sorted dose / response arrays and the lowest part key."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    # What follows from a line's own columns is worked out after the lines have met.
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    agg = li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(line)).alias("lines"),
        F.min("l_partkey").alias("min_partkey"))

    def response(slope):
        return F.transform("lines", lambda s: F.round(F.lit(100.0) - F.lit(slope) * s["l_quantity"], 1))

    return agg.select(
        "l_orderkey", "min_partkey",
        F.transform("lines", lambda s: F.lit(10.0) * F.pow(F.lit(3.0), (s["l_linenumber"] - 1).cast("double"))).alias("doses"),
        response(2.2).alias("neuts"), response(2.0).alias("neuts_raw"))


def measurement_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw measurement sheet: ``row_id`` plus text columns."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = bounded_broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 10_000)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = order_lines(spark, sf_dir)

    # Customers first: the orders are narrow until their lines come.
    df = (o.join(c, o.o_custkey == c.c_custkey, "left")
          .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
          .join(lines, o.o_orderkey == lines.l_orderkey, "left")
          .join(p, F.col("min_partkey") == p.p_partkey, "left"))

    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    suffix = F.when(status == "F", F.lit(" (R)")).when(status == "O", F.lit("(c)")).otherwise(F.lit(""))
    cohort = F.concat(F.lit("PSVX-"), (F.lit(100) + F.col("o_custkey") % 30).cast("string"), suffix)
    day = F.when(key % 17 == 0, F.lit("n/a")).otherwise(F.year("o_orderdate").cast("string"))
    has_lines = F.col("doses").isNotNull()
    potency = (F.when(key % 7 == 0, F.lit("NN"))
               .when(key % 11 == 0, F.lit(""))
               .when(key % 13 == 0, F.lit(">1000"))
               .otherwise(F.format_number(F.col("o_totalprice"), 2)))
    potency_raw = F.format_number(F.col("o_totalprice") + F.lit(1000.0), 2)
    dil_text = F.when(has_lines, _array_text(F.col("doses"), as_tuple=(key % 6 == 0))).otherwise(F.lit(""))
    neut_text = F.when(has_lines, _array_text(F.col("neuts"), wrap_np=(key % 4 == 0))).otherwise(F.lit(""))
    neut_raw_text = F.when(has_lines, _array_text(F.col("neuts_raw"))).otherwise(F.lit(""))
    return df.select(
        key.alias("row_id"),
        F.coalesce(F.col("c_mktsegment"), F.lit("")).alias("Sample_Type"),
        status.alias("Group"),
        cohort.alias("PSVX_No"),
        F.coalesce(F.col("n_name"), F.lit("")).alias("PSV"),
        day.alias("Day"),
        F.col("o_orderpriority").alias("Experiment"),
        F.coalesce(F.col("p_name"), F.lit("")).alias("Construct_Description"),
        dil_text.alias("Dilution"),
        neut_text.alias("Avg_Neut_percent_corrected"),
        potency.alias("IC50_corrected"),
        potency_raw.alias("IC50"),
        neut_raw_text.alias("Avg_Neut_percent"),
    )


def constructs_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constructs sheet: one row per supplier."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = bounded_broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 10_000)
    df = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    k = F.col("s_suppkey")
    program = (F.when(F.col("s_acctbal") >= 0,
                      F.when(k % 2 == 0, F.lit("ASSAY")).otherwise(F.lit(" assay ")))
               .otherwise(F.lit("OTHER")))
    cohort = F.concat(F.lit("PSVX-"), (F.lit(120) + F.col("s_nationkey")).cast("string"),
                      F.when(k % 5 == 0, F.lit(" (C)")).otherwise(F.lit("")))
    grp = (F.when(k % 4 == 0, F.lit("F")).when(k % 4 == 1, F.lit("O"))
           .when(k % 4 == 2, F.lit("P")).otherwise(F.lit("")))
    adj = F.when(k % 3 == 0, F.lit("hot")).when(k % 3 == 1, F.lit("cold")).otherwise(F.lit("new"))
    desc = F.when(k % 10 == 7, F.lit("")).otherwise(F.concat(adj, F.lit(" "), F.lower(F.col("n_name"))))
    return df.select(k.alias("row_id"), program.alias("Program"), cohort.alias("PSVX_ID"),
                     grp.alias("Group"), desc.alias("Construct_Description"))


# ---------------------------------------------------------------------------
# Rule tables for the derived sheets (study configuration, not engine logic).
# ---------------------------------------------------------------------------

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
YEAR_BUCKETS = {1995: "Prime", 1996: "Prime", 1997: "Boost1", 1998: "Boost1", 1999: "Boost2"}
MAPPED_COHORTS = range(100, 125)


def demo_bucket_map() -> list[tuple]:
    """Dose-window map built by rule: every priority × cohort 100..124 × year."""
    return [(e, str(c), y, b) for e in PRIORITIES for c in MAPPED_COHORTS
            for y, b in sorted(YEAR_BUCKETS.items())]


DEMO_SUBGROUPS = ("1. Hot and cold", "2. Widgets", "3. Plates", "4. Cumulative",
                  "5. Gizmos", "6. New", "7. Unused", "Uncategorized")

DEMO_EXACT = (
    ("Cold  Widget", "2. Widgets"),
    ("RED PLATE", "3. Plates"),
    ("small widget", "2. Widgets"),
    ("blue _gear", "2. Widgets"),
    ("Hot  NATION_3", "6. New"),
    ("large  gizmo ", "5. Gizmos"),
)

DEMO_PATTERNS = (
    (r"\n.*\+", "4. Cumulative"),
    (r"^(hot|cold)\b", "1. Hot and cold"),
    (r"gizmo$", "5. Gizmos"),
    (r"widget|gear", "2. Widgets"),
    (r"plate|ring", "3. Plates"),
    (r"^new ", "6. New"),
)

DEMO_OVERRIDES = (
    ("1-URGENT", "F", "Boost1", "hot ring + cold rod\n+ red anvil"),
    ("1-URGENT", "F", "Boost2", "hot ring + cold rod\n+ red anvil\n+ blue bolt"),
    ("2-HIGH", "O", "Prime", "small gear + large rod"),
)

DEMO_GENOTYPES = {"NATION_0": "1a", "NATION_5": "1a", "NATION_10": "1b", "NATION_3": "1b", "NATION_7": "2"}

# exact, case-insensitive substring, several substring hits, exact, duplicate
DEMO_PANEL = ("NATION_3", "nation_12", "ATION_2", "NATION_7", "NATION_20")


def demo_rules() -> Rules:
    return Rules(
        drop_sample_types=("machinery",),
        drop_groups=("P",),
        keep_experiments=PRIORITIES[:4],
        buckets=("Prime", "Boost1", "Boost2"),
        uncategorized="Uncategorized",
        subgroup_order=DEMO_SUBGROUPS,
        bucket_map=demo_bucket_map(),
        exact_map=DEMO_EXACT,
        pattern_rules=DEMO_PATTERNS,
        label_overrides=DEMO_OVERRIDES,
        target_groups=dict(DEMO_GENOTYPES),
        program="ASSAY",
    )


#: SQL of a part's pattern: most match no construct, some do, and some spell out no letters.
PART_PATTERN = r"""CASE
  WHEN p_partkey % 97 = 5 THEN concat('^.{', CAST(20 + p_size AS STRING), '}$')
  WHEN p_partkey % 4 = 0 THEN concat('^', p_name, ' ', p_brand)
  WHEN p_partkey % 4 = 1 THEN concat(split_part(p_name, ' ', 1), '.+(', split_part(p_name, ' ', 2), '|', lower(p_type), ')x')
  WHEN p_partkey % 40 = 2 THEN concat('(^|[+] )', p_name)
  WHEN p_partkey % 4 = 2 THEN concat(p_name, '.{', CAST(p_size AS STRING), ',}')
  ELSE concat('^(hot|new|red) ?nation_', CAST(p_partkey % 25 AS STRING), '$') END"""


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table of one ordered pattern for each part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"), F.expr(PART_PATTERN).alias("pattern"), F.col("p_brand").alias("subgroup"))
