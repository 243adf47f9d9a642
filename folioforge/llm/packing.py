"""Best-fit packing of documents into sequences of several permitted lengths.

Best-fit decreasing needs only the lengths, and documents of equal length are
interchangeable. So the plan is made on the histogram of lengths, which has at
most as many entries as the longest permitted sequence has tokens, however many
documents there are: bins in the same state are one entry with a count, and one
step places equal pieces into any number of equal bins. The result is the one
that piece-by-piece best fit gives.

Opening a bin. If no open bin takes a piece, each permitted size that holds it
is priced: its cost (its length plus a fixed cost per sequence) over the tokens
that it can be expected to hold (at most what is left to place). The least cost
per token wins, the smaller size among equals. Downsizing. When all is placed,
every bin shrinks to the least permitted size that holds its contents.

A document longer than the longest sequence is cut into full sequences and a
rest; nothing is dropped. Pieces get their rank among those of their length by a
window over (length, salt), with a salt for every ``GROUP`` pieces of a length, so a
length shared by many documents is spread over as many sorts of bounded size; rank
and plan give bin and offset. Salts come from numbers that the pieces are given as
they are written, not from ids, so repeated and null ids spread as well; which of
several pieces of one length goes to which bin is of no account.

Defined results: null lengths count as 0; a piece has at least one token, so a
document of length 0 has no piece unless ``extra`` tokens are added to each
document; null ids pass through; repeated rows are packed each for itself; an
empty table has no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.columns import giving_back
from folioforge.llm.workspace import Workspace

GROUP = 100_000


@dataclass(frozen=True)
class Plan:
    """Placements (by length, then rank) and bins (by number) as sorted columns."""

    length: np.ndarray  # of the pieces placed
    rank: np.ndarray  # of the first of them among their length
    each: np.ndarray  # pieces per bin
    bin: np.ndarray  # first bin
    offset: np.ndarray  # of the first piece in its bin
    bins: np.ndarray  # first bin of each run of equal bins
    size: np.ndarray  # final size of each run
    n_bins: int


class _Open:
    """Open bins by free space: runs (first bin, count, size, used)."""

    def __init__(self) -> None:
        self.free: list[int] = []
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}

    def put(self, first: int, count: int, size: int, used: int) -> None:
        room = size - used
        if room not in self.runs:
            self.runs[room] = []
            insort(self.free, room)
        heappush(self.runs[room], (first, count, size, used))

    def take(self, length: int) -> tuple[int, int, int, int] | None:
        """The run with the least room of at least ``length`` that was opened first."""
        k = bisect_left(self.free, length)
        if k == len(self.free):
            return None
        room = self.free[k]
        run = heappop(self.runs[room])
        if not self.runs[room]:
            del self.runs[room]
            del self.free[k]
        return run


def make_plan(histogram: dict[int, int], sizes: tuple[int, ...], overhead: int) -> Plan:
    """Best-fit decreasing over {length: pieces}; lengths are within the largest size."""
    sizes = tuple(sorted(sizes))
    bins, placed, n_bins = _Open(), [], 0
    left = sum(length * n for length, n in histogram.items())
    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while n:
            run = bins.take(length)
            if run is None:
                # all pieces that are left are this long or shorter
                size = min((s for s in sizes if s >= length), key=lambda s: ((s + overhead) / min(s, left), s))
                each = size // length
                # the price of a later bin is the same while the largest size can still be filled
                same = (left - sizes[-1]) // (each * length) + 1 if left >= sizes[-1] else 1
                count = min(-(-n // each), same)
                run = (n_bins, count, size, 0)
                n_bins += count
            first, count, size, used = run
            each = (size - used) // length
            full = min(count, n // each)
            if full:
                placed.append((length, rank, each, first, used))
                bins.put(first, full, size, used + each * length)
                rank, n, left = rank + full * each, n - full * each, left - full * each * length
                first, count = first + full, count - full
            if count and n and n < each:
                placed.append((length, rank, n, first, used))
                bins.put(first, 1, size, used + n * length)
                left -= n * length
                rank, n, first, count = rank + n, 0, first + 1, count - 1
            if count:
                bins.put(first, count, size, used)
    runs = sorted((first, next(s for s in sizes if s >= used)) for rs in bins.runs.values() for first, count, _, used in rs)
    placed.sort()
    p = np.array(placed, np.int64).reshape(-1, 5)
    r = np.array(runs, np.int64).reshape(-1, 2)
    return Plan(*(np.ascontiguousarray(p[:, k]) for k in range(5)), r[:, 0], r[:, 1], n_bins)


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, final size of the bin, offset in the bin) of pieces given by length and rank."""
    if not len(length):
        return (np.zeros(0, np.int64),) * 3
    k = np.empty(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    values, first = np.unique(length[order], return_index=True)
    for value, own in zip(values, np.split(order, first[1:]), strict=True):
        a, b = np.searchsorted(plan.length, [value, value + 1])
        k[own] = a + np.searchsorted(plan.rank[a:b], rank[own], "right") - 1
    ahead = rank - plan.rank[k]
    number = plan.bin[k] + ahead // plan.each[k]
    offset = plan.offset[k] + ahead % plan.each[k] * length
    return number, plan.size[np.searchsorted(plan.bins, number, "right") - 1], offset


def pack(lengths: DataFrame, ws: Workspace, sizes: tuple[int, ...] = (512, 1024, 2048, 4096), overhead: int = 64, extra: int = 1, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """(doc_id, piece, piece_start, length, bin_id, bin_size, bin_offset) of every piece."""
    top = max(sizes)
    rows = lengths.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.col(length_col), F.lit(0)).cast("bigint") + extra).alias("whole")).filter("whole > 0")
    pieces = rows.select("doc_id", "whole", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(whole - 1) div {top}"))).alias("piece"))
    number = F.xxhash64(F.monotonically_increasing_id())
    pieces = ws.save(pieces.select("doc_id", "piece", F.least(F.lit(top), F.col("whole") - F.col("piece") * top).cast("int").alias("length"), number.alias("number")), "pieces")
    # one row for each of at most `top` lengths
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spark = lengths.sparkSession
    plan = spark.sparkContext.broadcast(make_plan(histogram, sizes, overhead))
    salts = spark.createDataFrame([(k, -(-n // GROUP)) for k, n in histogram.items()], "length int, salts bigint")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod("number", "salts"))
    # one row for each salt: a row for GROUP pieces, and one for each length
    counts = ws.save(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "salts")
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = salted.withColumn("row", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "number")))
    ranked = ranked.join(F.broadcast(before.select("length", "salt", "before")), ["length", "salt"]).select("doc_id", "piece", (F.col("piece") * top).alias("piece_start"), "length", (F.col("before") + F.col("row") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            number, size, offset = place(plan.value, length.astype(np.int64), rank.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "piece_start", "length")), pa.array(number), pa.array(size.astype(np.int32)), pa.array(offset.astype(np.int32))], ["doc_id", "piece", "piece_start", "length", "bin_id", "bin_size", "bin_offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(giving_back(run), f"doc_id {kind}, piece bigint, piece_start bigint, length int, bin_id bigint, bin_size int, bin_offset int")
