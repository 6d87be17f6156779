"""Links between sets that share a band key, found in bounded blocks.

Nodes (distinct sets) that share a band key are candidates.  Emitting all pairs
of a bucket would grow with its square; instead

1. each key's nodes are tied to the smallest of them, found as neighbours in one
   sorting of all keys, and the components of these ties give every node
   one cluster: candidates never lie in two;
2. a cluster is dealt into blocks by a hash of the node, as many as its sets'
   bytes ask for, and each pair of blocks is one task's work: bitmaps are
   compared in numpy, pairs that share a key and may be similar enough are
   verified on their full sets, unless links found already join them.
   A cluster of several blocks that only chains of keys hold together is
   dealt by its keys instead, where that moves fewer rows: the more sets there
   are, the longer such chains, but a key's own nodes stay few;
3. a task emits only the links that join its nodes into components, fewer than
   it has nodes.

No link that joins different components is lost, and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Optional

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm import shingles
from panelgrid.llm.common import discard, stored_at
from panelgrid.llm.components import components

#: Most bytes of sets, and most nodes, that a block is made for.
BLOCK_BYTES = 8 << 20
BLOCK_NODES = 1024
#: Most nodes of a key whose sketches are compared pair by pair before anything is read.
SKETCHED = 256
#: Bits onto which sets without a bitmap are laid, to bound what two of them have in common.
LAID = 512
#: Clusters of several blocks that are sent to every task.
MOST_BROADCAST = 100_000
#: Rows of a block compared with the other block at a time.
STRIPE = 128
#: Rows of small groups that are compared in one go.
TOGETHER = 512


def _alike(first: np.ndarray, node: np.ndarray, sketch: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of the rows that its key's sketches, with ``least`` equal digits, join it to; whether it is
    so for its key.  ``first``: the first row of each row's key.  The batch's first and last key may go on
    elsewhere; their rows and those of a key of more than SKETCHED rows are joined to the first one of the key."""
    n = len(node)
    size = np.bincount(first, minlength=n)[first]
    narrow = (size > 1) & (size <= SKETCHED) & (first != 0) & (first != first[-1])
    rows = np.flatnonzero(narrow)
    # Every pair of rows of a key, by how far apart they are.
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = 1
    while len(rows):
        rows = rows[rows + step < first[rows] + size[rows]]
        near = shingles.digits_alike(sketch[rows], sketch[rows + step]) >= least
        left.append(rows[near])
        right.append(rows[near] + step)
        step += 1
    a, b = np.concatenate(left), np.concatenate(right)
    to = np.where(narrow, np.arange(n), first)
    while len(a):
        low = np.minimum(to[a], to[b])
        if (to[a] == low).all() and (to[b] == low).all():
            break
        np.minimum.at(to, a, low)
        np.minimum.at(to, b, low)
    return to, narrow


def _ties(batches: Iterator[pa.RecordBatch], least: int = 0) -> Iterator[pa.RecordBatch]:
    """Of (key, node, sketch) rows sorted by key: ties of each node with the first one of its key here that it can be like,
    and as (hub, null, key) the first and last key of the task, which may go on in a neighbouring one."""
    key = hub = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, node = (batch.column(c).to_numpy() for c in (0, 1))
        new = np.append(True, k[1:] != k[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        hubs = node[first]
        if least:
            to, narrow = _alike(first, node, batch.column(2).to_numpy(), least)
            hubs = np.where(narrow, node[to], hubs)
        if key is None:
            yield _tie_batch(hubs[:1], None, k[:1])
        elif key == k[0]:
            hubs[first == 0] = hub
        tied = hubs != node
        yield _tie_batch(hubs[tied], node[tied], None)
        key, hub = k[-1], hubs[-1]
    if key is not None:
        yield _tie_batch(np.array([hub]), None, np.array([key]))


def _tie_batch(a: np.ndarray, b: Optional[np.ndarray], key: Optional[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.nulls(len(a), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (a, b, key)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key"])


def candidate_clusters(keys: DataFrame, least: int = 0) -> DataFrame:
    """(node, cluster) of every node that shares a key with another.

    ``keys`` has (node, key), each pair once, and with ``least`` a digit sketch:
    nodes of fewer equal digits are not tied by their key (but for the first and
    last key of a batch, and keys of more than SKETCHED nodes).  They are dealt over the cluster
    by ranges of (key, node), so that a key of any number of nodes lies in as many tasks
    as it needs; each task ties its nodes of a key to the first of them, and the
    hubs of a key that goes on in other tasks (two rows of each task at most)
    are tied to the smallest one.  No pair is moved twice.
    """
    spark = keys.sparkSession
    ordered = keys.select(F.col("key").cast("long"), F.col("node").cast("long"), *(["sketch"] if least else [])).where("key IS NOT NULL").repartitionByRange(
        "key", "node").sortWithinPartitions("key")
    tied, path = stored_at(ordered.mapInArrow(lambda batches: _ties(batches, least), "a long, b long, key long"), "ties")
    parts = tied.where("key IS NOT NULL").select("key", "a")
    least = parts.groupBy("key").agg(F.min("a").alias("least"))
    across = parts.join(least, "key").where("a > least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    clusters = components(tied.where("key IS NULL").select("a", "b").union(across))
    discard(spark, path)
    return clusters.withColumnRenamed("component", "cluster")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _candidates(keys: np.ndarray, bitmaps: Optional[np.ndarray], most_bits: int, row: int, upto: int,
                across: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places (i, j) with i in [row, upto) of one group that share a key and whose bitmaps are close enough."""
    close = (across[None, :] > np.arange(row, upto)[:, None]) & (group[row:upto, None] == group[across][None, :])
    if bitmaps is not None and close.any():
        differ = np.zeros((upto - row, len(across)), np.uint16)
        for w in range(bitmaps.shape[1]):
            differ += np.bitwise_count(bitmaps[row:upto, None, w] ^ bitmaps[across, w][None, :]).astype(np.uint16)
        close &= differ <= most_bits
    i, j = np.nonzero(close)
    i, j = i + row, across[j]
    share = (keys[i] == keys[j]).any(axis=1)
    return np.stack([i[share], j[share]], axis=1)


def _laid(members: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of LAID that each set's members fall on, and how many members fall on one of an earlier member."""
    bits = np.zeros((len(members), LAID), bool)
    bits[np.repeat(np.arange(len(members)), size), np.concatenate(members) % np.uint64(LAID)] = True
    laid = np.packbits(bits, axis=1).view(np.uint64)
    return laid, size - bits.sum(axis=1)


def _dealt(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The ``rows`` of :func:`verified_links` once for each pair of blocks (cluster, i, j) that compares them, ``first``
    if they are of block i; the paths of tables to discard then.  A key takes its cluster's place where that moves fewer rows."""
    spark = rows.sparkSession
    light = rows.select("cluster", "node", "keys", (F.length("members") + F.lit(256)).alias("_weight"))

    def blocks_of(nodes: DataFrame, *group: str) -> DataFrame:
        sizes = nodes.groupBy(*group).agg(F.sum("_weight").alias("_bytes"), F.count("*").alias("_n"))
        return sizes.where("_n > 1").select(*group, "_n", F.greatest(
            F.ceil(F.col("_bytes") / BLOCK_BYTES), F.ceil(F.col("_n") / BLOCK_NODES), F.lit(1)).cast("int").alias("_blocks"))

    moved = F.col("_n") * F.col("_blocks")
    blocks, blocks_path = stored_at(blocks_of(light, "cluster"), "blocks")
    large = blocks.where("_blocks > 1")
    count = large.count()
    by_key, paths = None, [blocks_path]
    if count:
        some = F.broadcast(large.select("cluster")) if count <= MOST_BROADCAST else large.select("cluster")
        keyed = light.join(some, "cluster").withColumn("key", F.explode(F.array_distinct("keys")))
        buckets, path = stored_at(blocks_of(keyed, "cluster", "key"), "buckets")
        paths.append(path)
        fewer = buckets.groupBy("cluster").agg(F.sum(moved).alias("_moved")).join(
            large.select("cluster", moved.alias("_most")), "cluster").where("_moved < _most").select("cluster")
        fewer, path = stored_at(fewer, "chained")
        paths.append(path)
        if count := fewer.count():
            some = F.broadcast(fewer) if count <= MOST_BROADCAST else fewer
            # Clusters share no key, so that a key can stand for its cluster.
            by_key = rows.join(some, "cluster").withColumn("key", F.explode(F.array_distinct("keys"))).join(
                buckets.drop("_n"), ["cluster", "key"]).drop("cluster").withColumnRenamed("key", "cluster")
            blocks = blocks.join(some, "cluster", "left_anti")
    grouped = rows.join(blocks.drop("_n"), "cluster")
    if by_key is not None:
        grouped = grouped.unionByName(by_key)
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("_own")).alias("i"), F.greatest(k, F.col("_own")).alias("j")))
    dealt = (grouped.withColumn("_own", own).withColumn("_pair", F.explode(others))
             .select("cluster", F.col("_pair.i").alias("i"), F.col("_pair.j").alias("j"),
                     (F.col("_own") == F.col("_pair.i")).alias("first"), "node", "keys", "bitmap", "members"))
    return dealt, paths


def verified_links(rows: DataFrame, links_enough: Callable[[int, int, int], bool], most_bits: Optional[int]) -> tuple[DataFrame, str]:
    """(a, b) links that join the nodes of ``rows`` into their components, and the path of the table they are in.

    ``rows``: cluster, node, keys (array<long>), bitmap (binary; ignored if
    ``most_bits`` is None) and members (binary: ascending 64-bit hashes).
    ``links_enough(common, size, size)`` says whether two sets link.
    """
    spark = rows.sparkSession
    dealt, paths = _dealt(rows)

    def link(table: pa.Table, group: np.ndarray) -> Iterator[tuple[int, int]]:
        node = table["node"].to_numpy()
        order = np.lexsort((node, group))
        table, node, group = table.take(pa.array(order)), node[order], group[order]
        keys = table["keys"].combine_chunks()
        keys = keys.values.to_numpy(zero_copy_only=False).reshape(len(node), -1)
        bitmaps = None
        if most_bits is not None:
            bitmaps = np.frombuffer(b"".join(table["bitmap"].to_pylist()), np.uint64).reshape(len(node), -1)
        members = [np.frombuffer(m, np.uint64) for m in table["members"].to_pylist()]
        size = np.array([len(m) for m in members], np.int64)
        laid, doubled = (None, None) if bitmaps is not None else _laid(members, size)
        first = table["first"].to_numpy(zero_copy_only=False).astype(bool)
        within = table["i"].to_numpy() == table["j"].to_numpy()
        everything = np.arange(len(node))
        union = _Union(len(node))
        for row in range(0, len(node), STRIPE):
            upto = min(row + STRIPE, len(node))
            last = int(np.searchsorted(group, group[upto - 1], "right"))
            pairs = _candidates(keys, bitmaps, most_bits or 0, row, upto, everything[row:last], group)
            i, j = pairs[:, 0], pairs[:, 1]
            # Even if the smaller set lay in the other one, they would have to be enough alike.
            may = (within[i] | (first[i] != first[j])) & links_enough(np.minimum(size[i], size[j]), size[i], size[j])
            pairs = pairs[may]
            if laid is not None and len(pairs):
                # No more in common than bits in common and members that share a bit of their own set.
                i, j = pairs[:, 0], pairs[:, 1]
                most = np.bitwise_count(laid[i] & laid[j]).sum(axis=1, dtype=np.int64) + np.minimum(doubled[i], doubled[j])
                pairs = pairs[links_enough(np.minimum(most, np.minimum(size[i], size[j])), size[i], size[j])]
            for i, j in pairs.tolist():
                if union.root(i) != union.root(j):
                    common = len(np.intersect1d(members[i], members[j], assume_unique=True))
                    if links_enough(common, len(members[i]), len(members[j])):
                        union.join(i, j)
                        yield int(node[i]), int(node[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups lie side by side in the sorted rows; small ones are held together, a large one alone."""
        held: list[pa.Table] = []
        numbers: list[np.ndarray] = []
        group, number, rows_held = None, 0, 0

        def emit() -> pa.RecordBatch:
            found = list(link(pa.concat_tables(held).combine_chunks(), np.concatenate(numbers)))
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c, i, j = (batch.column(k).to_numpy() for k in range(3))
            new = np.append((c[0], i[0], j[0]) != group, (c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            of = number + np.cumsum(new)
            group, number = (c[-1], i[-1], j[-1]), int(of[-1])
            starts, at = np.flatnonzero(new), 0
            while at < batch.num_rows:
                # Up to the last start of a group within reach, or the next one.
                reach = at + max(TOGETHER - rows_held, 0)
                k = int(np.searchsorted(starts, reach, "right")) - 1
                if k >= 0 and (starts[k] > at or (starts[k] == at and rows_held)):
                    upto, done = int(starts[k]), True
                else:
                    later = starts[np.searchsorted(starts, at, "left" if rows_held else "right"):]
                    upto, done = (int(later[0]), True) if len(later) else (batch.num_rows, False)
                if reach >= batch.num_rows:
                    upto, done = batch.num_rows, False
                if upto > at:
                    held.append(pa.Table.from_batches([batch.slice(at, upto - at)]))
                    numbers.append(of[at:upto])
                    rows_held += upto - at
                    at = upto
                if done and held:
                    yield emit()
                    held, numbers, rows_held = [], [], 0
        if held:
            yield emit()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = dealt.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links, links_path = stored_at(together.mapInArrow(run, "a long, b long"), "links")
    for path in paths:
        discard(spark, path)
    return links, links_path


def linked_components(pairs: DataFrame, with_members: Callable[[DataFrame], DataFrame],
                      links_enough: Callable[[int, int, int], bool], most_bits: Optional[int], least: int = 0) -> DataFrame:
    """(node, component) of the nodes that link with another.

    ``pairs``: node, key, and with ``least`` a sketch (:func:`candidate_clusters`).  ``with_members`` turns the candidates (node, cluster)
    into the rows of :func:`verified_links`.
    """
    spark = pairs.sparkSession
    rows, rows_path = stored_at(with_members(candidate_clusters(pairs, least)), "candidates")
    links, links_path = verified_links(rows, links_enough, most_bits)
    discard(spark, rows_path)
    found = components(links)
    discard(spark, links_path)
    return found
