"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on many random directions.  A table groups its
vectors by the cells of a few projections and sorts each group by one more;
a pair collides in a table when both share its cells and one lies in the window
centred at the other.  Near pairs differ by a small normal amount in every
projection, so the chance of a collision at the similarity sought is known, and
the count of collisions that such pairs miss only with chance ``MISS`` is
calibrated from it.  Pairs with that count are verified by cosine in double
precision.

Plan: equal vectors are one node with a weight.  A node goes to each table's
group with its vector; groups beyond BLOCK nodes are dealt into blocks, one task
for each pair of blocks.  A task projects its vectors again, so it knows its
pairs' collisions in all tables: the first table in which a pair collides
handles it.  Tasks emit sums of links and the links that join components,
never pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of unlike
lengths don't link; a row with a null id has a null component and is kept.  Ids are taken
as names of rows: unlike vectors under one id count as one node, whose rows share
links and component.  Only directions count, from the smallest to the largest
finite components.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.common import stored
from panelgrid.llm.components import components
from panelgrid.llm.linking import _Union

TABLES = 16
CELLS = 3
#: Widths in standard deviations of a near pair's difference in a projection.
CELL_WIDTH = 6.0
WINDOW = 2.5
MISS = 1e-4
#: Nodes of a block, and pairs counted at a time.
BLOCK = 2048
PAIRS = 200_000


def collision_chance() -> float:
    """That a pair at the similarity sought collides in a table."""
    share_cell = 1 - math.sqrt(2 / math.pi) / CELL_WIDTH
    return share_cell ** CELLS * math.erf(WINDOW / math.sqrt(2))


def calibrated_count(tables: int = TABLES, miss: float = MISS) -> int:
    """The largest count that pairs at the similarity sought fall short of with at most the chance ``miss``."""
    p, below, count = collision_chance(), 0.0, 0
    while True:
        below += math.comb(tables, count) * p ** count * (1 - p) ** (tables - count)
        if below > miss:
            return max(count, 1)
        count += 1


@functools.lru_cache(maxsize=8)
def _directions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([77, dim])
    a = rng.standard_normal((dim, TABLES * (CELLS + 1)))
    return a / np.linalg.norm(a, axis=0), rng.random(TABLES * CELLS)


def project(unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's cell hash and sorted projection, in window widths, in every table."""
    a, shift = _directions(unit.shape[1])
    sigma = math.sqrt(2 - 2 * cosine) / math.sqrt(unit.shape[1])
    out = unit @ a
    cells = np.floor(out[:, :TABLES * CELLS] / (CELL_WIDTH * sigma) + shift).astype(np.int64).reshape(-1, TABLES, CELLS)
    key = np.zeros(cells.shape[:2], np.int64)
    for k in range(CELLS):
        key = key * 1_000_003 + cells[:, :, k]
    return key, out[:, TABLES * CELLS:] / (WINDOW * sigma)


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dim)
    # by a power of two, which is exact: squares of very large or small entries leave the double range
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _with_cells(nodes: DataFrame, cosine: float) -> DataFrame:
    """A row for each node and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 4096):
                    some = part.slice(at, 4096)
                    key, _ = project(_units(some.column(4).to_pylist(), dim), cosine)
                    for t in range(TABLES):
                        yield pa.RecordBatch.from_arrays(
                            [*some.columns, pa.array(np.full(some.num_rows, t, np.int32)), pa.array(key[:, t].copy())],
                            names=[*some.schema.names, "t", "cell"])

    return nodes.mapInArrow(run, "node long, weight long, label string, dim int, vector binary, t int, cell long")


def _linker(cosine: float, least: int):
    def link(table: pa.Table) -> pa.RecordBatch:
        t, dim = table["t"][0].as_py(), table["dim"][0].as_py()
        within = table["i"][0].as_py() == table["j"][0].as_py()
        unit = _units(table["vector"].to_pylist(), dim)
        key, at = project(unit, cosine)
        order = np.argsort(at[:, t], kind="stable")
        unit, key, at = unit[order], key[order], at[order]
        node, weight = table["node"].to_numpy()[order], table["weight"].to_numpy()[order]
        first = table["first"].to_numpy(zero_copy_only=False).astype(bool)[order]
        n = len(node)
        until = np.searchsorted(at[:, t], at[:, t] + 1, "right")  # windows of width 1 on either side
        links, union, joins = np.zeros(n, np.int64), _Union(n), []
        ends = np.cumsum(until - np.arange(n) - 1)
        row = 0
        while row < n:
            upto = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS, "right")))
            count = until[row:upto] - np.arange(row, upto) - 1
            i = np.repeat(np.arange(row, upto), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
            row = upto
            if not within:
                i, j = (x[first[i] != first[j]] for x in (i, j))
            collide = (key[i] == key[j]) & (np.abs(at[i] - at[j]) <= 1)
            mine = (collide.sum(axis=1) >= least) & (collide.argmax(axis=1) == t)
            i, j = i[mine], j[mine]
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            i, j = i[near], j[near]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if union.join(a, b):
                    joins.append((a, b))
        some = np.flatnonzero(links)
        a, b = np.array([x for x, _ in joins], np.int64), np.array([x for _, x in joins], np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([node[some], node[a]])),
            pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)])),
            pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[b])]),
        ], names=["node", "n_links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups lie side by side in the sorted rows; one is held at a time."""
        held: list[pa.Table] = []
        group = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            g = batch.column(batch.schema.get_field_index("grp")).to_numpy()
            cut = np.flatnonzero(g[1:] != g[:-1]) + 1
            for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(g)], strict=True):
                if g[low] != group and held:
                    yield link(pa.concat_tables(held).combine_chunks())
                    held = []
                group = g[low]
                held.append(whole.slice(low, high - low))
        if held:
            yield link(pa.concat_tables(held).combine_chunks())

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each vector: vec_id, n_links (other vectors of its label at
    ``cosine`` or more), component_id (smallest id reachable) and kept."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
                        & F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("ok", finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    v = stored(v.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("label", "v")),
                              "h2": F.when(F.col("ok"), F.hash("v", "label"))}), "vectors")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x, np.float64) for x in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:5], pa.array([len(x) for x in rows], pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary()),
            ], names=["h1", "h2", "node", "weight", "label", "dim", "vector"])

    equal = v.where("ok").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = stored(equal.mapInArrow(packed, "h1 long, h2 int, node long, weight long, label string, dim int, vector binary"), "nodes")
    dealt = _with_cells(nodes.select("node", "weight", "label", "dim", "vector"), cosine)
    cell = ["label", "dim", "t", "cell"]
    crowded = (_with_cells(nodes.select("node", "weight", "label", "dim", "vector"), cosine).groupBy(*cell).count()
               .where(F.col("count") > BLOCK).select(*cell, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = dealt.join(crowded, cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    dealt = dealt.withColumn("pair", F.explode(others)).select(
        "node", "weight", "dim", "vector", "t", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"),
        (F.col("own") == F.col("pair.i")).alias("first"), F.xxhash64(*cell, "pair.i", "pair.j").alias("grp"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(dealt.repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(
        _linker(cosine, calibrated_count()), "node long, n_links long, other long"), "links")
    linked = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    sums = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    of_node = (nodes.select("h1", "h2", "node", "weight").join(sums, "node", "left").join(linked, "node", "left").select(
        "h1", "h2", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id")))
    return v.select("vec_id", "h1", "h2").join(of_node, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
