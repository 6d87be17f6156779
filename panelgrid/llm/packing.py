"""Best-fit packing of tokenised documents into sequences, by hierarchical
residual packing.

Documents are tokenised once and cut into pieces of at most a sequence.  In the
first round each partition packs its own pieces, largest first, each into the
fullest bin that still takes it.  Nearly full bins are done.  The others travel
up a tree as single items: some partitions' underfull bins meet in one task and
are packed best-fit again, until one task holds the rest.  A task packs a
bounded number of items at a time, and hands on a bounded number of bins, the
emptiest ones, so that no round sees more than its share however many pieces there
are.  The fuller bins beyond that number wait.

Where any bin waits, best fit is made good over the pieces of all bins that are
not nearly full, whatever task they came from: it depends only on how many pieces
there are of each length, so it is planned on those counts (at most one for each
length up to a sequence), and every piece finds its place by its rank among the
pieces of its length.

Only (document, piece, length, checksum) rows move, never ids or texts.

Defined results: null and empty texts are one piece with the end id alone;
repeated rows are packed each for itself; a null id stays null; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.byte_bpe import slices
from panelgrid.llm.common import stored
from panelgrid.operators.ranking import ordered_rank
from panelgrid.session import rows_df

#: Share of a sequence from which a bin is done.
NEARLY_FULL = 0.995
#: Items packed at a time, bins that a task hands on (fuller ones wait), and partitions that meet in a task of the next round.
WINDOW_ITEMS = 200_000
HANDED_ON = 20_000
FAN_IN = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = PIECES + ", sequence_id long, offset long, load long, done boolean"
_NAMES = [c.split()[0] for c in BINS.split(", ")]
_ARROW = pa.schema([(c, {"piece": pa.int32(), "done": pa.bool_()}.get(c, pa.int64())) for c in _NAMES])


def cut_pieces(docs: DataFrame, encoder: Callable, capacity: int, end_id: int = 0,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut after every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        for batch in (part for whole in batches for part in slices(whole, whole.schema.names[1])):
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    out.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def best_fit(loads: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest items first, each into the fullest bin that still takes it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set where a bin with room r is open
    bins = np.empty(len(loads), np.int64)
    count = 0
    for k in np.argsort(-loads, kind="stable").tolist():
        load = int(loads[k])
        fits = some >> load
        if fits:
            r = load + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, b, count = capacity, count, count + 1
        bins[k] = b
        if r > load:
            if not room[r - load]:
                some |= 1 << (r - load)
            room[r - load].append(b)
    return bins


def best_fit_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """:func:`best_fit` of ``counts[length]`` items of each length, and the number of its bins.

    Of the items of a length, those of rank (from 1) ``first`` to ``last`` go into the bins from
    ``bin`` on, ``each`` of them side by side into every bin from ``place`` on: rows (length,
    first, last, bin, each, place)."""
    room: dict[int, list[tuple[int, int]]] = {}  # runs (first bin, bins) of the bins with some room
    runs, bins = [], 0
    for load in sorted(counts, reverse=True):
        placed, n = 0, counts[load]
        while placed < n:
            r = min((r for r in room if r >= load), default=None)
            if r is None:
                r, bin_, most = capacity, bins, n - placed
            else:
                bin_, most = room[r].pop()
                if not room[r]:
                    del room[r]
            each = min(r // load, n - placed)
            used = min(most, (n - placed) // each)
            runs.append((load, placed + 1, placed + used * each, bin_, each, capacity - r))
            placed += used * each
            if bin_ == bins:
                bins += used
            elif used < most:
                room.setdefault(r, []).append((bin_ + used, most - used))
            if r - each * load:
                room.setdefault(r - each * load, []).append((bin_, used))
    return runs, bins


def _packer(round_no: int, capacity: int, last: bool) -> Callable:
    """A task of one round: packs its bins (rows side by side with one sequence_id) into new ones.
    Of those, ``done`` is true for nearly full ones, false for ones handed on, null for ones that wait."""
    full = int(np.ceil(NEARLY_FULL * capacity))

    def pack(table: pa.Table, first_id: int) -> tuple[pa.Table, pa.Table, int]:
        ids = table["sequence_id"].to_numpy()
        starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        rows_in = np.diff(starts, append=len(ids))
        loads = table["load"].to_numpy()[starts]
        bins = best_fit(loads, capacity)
        order = np.argsort(bins, kind="stable")
        total = np.bincount(bins, weights=loads).astype(np.int64)
        ends = np.cumsum(loads[order])
        first_in_bin = np.diff(bins[order], prepend=-1) != 0
        base = ends - loads[order]
        shift = base - np.repeat(base[first_in_bin], np.diff(np.flatnonzero(first_in_bin), append=len(order)))
        item_shift, item_bin = np.empty(len(loads), np.int64), bins
        item_shift[order] = shift
        of_row = np.repeat(np.arange(len(loads)), rows_in)
        by_bin = np.argsort(item_bin[of_row], kind="stable")
        row_bin = item_bin[of_row]
        done = total >= full
        columns = [table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [
            pa.array(first_id + row_bin), pa.array(table["offset"].to_numpy() + item_shift[of_row]),
            pa.array(total[row_bin]), pa.array(done[row_bin])]
        out = pa.table(columns, schema=_ARROW).take(pa.array(by_bin))
        flag = done[row_bin][by_bin]
        return out.filter(pa.array(flag)), out.filter(pa.array(~flag)), first_id + len(total)

    def hand_on(rest: pa.Table, most: int) -> tuple[pa.Table, pa.Table]:
        """The rows of the ``most`` emptiest bins, and those of the others."""
        ids, load = rest["sequence_id"].to_numpy(), rest["load"].to_numpy()
        first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        on = np.zeros(len(first), bool)
        on[np.argsort(load[first], kind="stable")[:most]] = True
        flag = np.repeat(on, np.diff(first, append=len(ids)))
        return rest.filter(pa.array(flag)), rest.filter(pa.array(~flag))

    def finished(table: pa.Table, done: bool | None) -> list[pa.RecordBatch]:
        flags = pa.array([done] * table.num_rows, pa.bool_())
        return table.set_column(_NAMES.index("done"), "done", flags).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = (round_no << 48) + (TaskContext.get().partitionId() << 26)
        held: list[pa.Table] = []
        rows, limit = 0, WINDOW_ITEMS
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]).select(_NAMES).cast(_ARROW))
            rows += batch.num_rows
            if rows < limit:
                continue
            table = pa.concat_tables(held).combine_chunks()
            ids = table["sequence_id"].to_numpy()
            earlier = np.flatnonzero(ids != ids[-1])  # the last bin may go on in the next batch
            cut = int(earlier[-1]) + 1 if len(earlier) else 0
            if cut:
                done, rest, next_id = pack(table.slice(0, cut), next_id)
                yield from finished(done, True)
                held = [table.slice(cut)]
                if rest.num_rows:
                    rest, fuller = hand_on(rest, HANDED_ON)
                    yield from finished(fuller, None)
                    held.insert(0, rest)
                rows = sum(t.num_rows for t in held)
            limit = rows + WINDOW_ITEMS
        if rows:
            done, rest, next_id = pack(pa.concat_tables(held).combine_chunks(), next_id)
            yield from finished(done, True)
            if rest.num_rows:
                on, fuller = hand_on(rest, rest.num_rows if last else HANDED_ON)
                yield from finished(on, False)
                yield from finished(fuller, None)

    return run


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` (any numbers) and ``offset``."""
    spark = pieces.sparkSession
    as_bins = pieces.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.col("length").alias("load"), F.lit(False).alias("done"))
    tasks = max(1, as_bins.rdd.getNumPartitions())
    round_no = 1
    current = stored(as_bins.mapInArrow(_packer(round_no, capacity, tasks == 1), BINS), "packing")
    finished, waiting = [current.where("done")], [current.where("done IS NULL")]
    while tasks > 1:
        tasks, round_no = -(-tasks // FAN_IN), round_no + 1
        # Bits 26 to 47 of a bin's number are the task that made it: neighbours meet.
        maker = F.shiftright("sequence_id", 26).bitwiseAND(F.lit((1 << 22) - 1))
        met = (current.where("NOT done").withColumn("_group", F.floor(maker / FAN_IN))
               .repartition(tasks, "_group").sortWithinPartitions("_group", "sequence_id", "offset").drop("_group"))
        current = stored(met.mapInArrow(_packer(round_no, capacity, tasks == 1), BINS), "packing")
        finished.append(current.where("done"))
        waiting.append(current.where("done IS NULL"))
    rest = reduce(DataFrame.unionAll, waiting, current.where("NOT done"))
    finished.append(_pack_together(rest, capacity, round_no + 1))
    return reduce(DataFrame.unionAll, finished).drop("load", "done")


def _pack_together(bins: DataFrame, capacity: int, round_no: int) -> DataFrame:
    """Where one of ``bins`` waits, best fit of all their pieces; ``bins`` as they are where none does or none is saved."""
    # One row for each length, at most ``capacity`` of them.
    counts = bins.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("offset") == 0).alias("bins"),
                                        F.count_if(F.col("done").isNull()).alias("waiting")).collect()
    if not any(c.waiting for c in counts):
        return bins
    runs, needed = best_fit_counts({c.length: c.n for c in counts}, capacity)
    if needed >= sum(c.bins for c in counts):
        return bins
    plan = F.broadcast(rows_df(bins.sparkSession, runs, "_length long, _first long, _last long, _bin long, _each long, _place long"))
    ranked = ordered_rank(bins, ["length"], [F.col("sequence_id"), F.col("offset")], "_rank")
    placed = ranked.join(plan, (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last")))
    nth = F.col("_rank") - F.col("_first")
    return placed.withColumns({
        "sequence_id": F.lit(round_no << 48) + F.col("_bin") + F.floor(nth / F.col("_each")),
        "offset": F.col("_place") + nth % F.col("_each") * F.col("length")}).select(bins.columns)


def pack_documents(docs: DataFrame, encoder: Callable, capacity: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(cut_pieces(docs, encoder, capacity, end_id, id_col, text_col), "pieces")
    return pack_pieces(pieces, capacity)
