"""Best-two-fit packing of tokenised documents into fixed-size sequences.

A bin is filled greedily, the largest piece that fits first; then its smallest piece gives way to two
unpacked pieces that fill the widened gap more tightly, if there are two. Which pieces a bin takes
depends on their lengths alone, so bins are planned on the histogram of lengths: at most ``capacity``
numbers, whatever the input. A plan is repeated while the counts allow it, and each repetition uses
up a length, so plans stay within a small multiple of ``capacity`` too. Pieces find their place by
their rank among pieces of their length.

Plan: one scan tokenises and saves a narrow table of pieces, keyed by blocks of 512 rows and lots of 512
blocks. Ranks come from the counts of a length in blocks and in lots: a block bounds every group of rows,
a lot every group of blocks, and a length, however frequent, has a row for each 262,144 rows. No text or
ids are shuffled.

Defined results: a null text is the end id alone; equal rows are packed each for itself; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTables, byte_slices, lean
from .tokenizing import WordCoder, coder

_BLOCK_BITS = 9


def best_two(free: np.ndarray, spare: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two lengths of ``free`` (rising) with the largest sum within ``room``; ``spare`` counts each length."""
    first = free[free < room]
    if not len(first):
        return None
    at = np.searchsorted(free, room - first, side="right") - 1
    alone = (at >= 0) & (free[at] == first) & (spare[at] < 2)
    at = at - alone
    total = np.where(at >= 0, first + free[at], -1)
    best = int(np.argmax(total))
    return None if total[best] < 0 else (int(max(first[best], free[at[best]])), int(min(first[best], free[at[best]])))


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, repetitions) until all pieces are packed."""
    left = {n: k for n, k in counts.items() if k > 0}
    lengths = sorted(left)
    plans = []
    while lengths:
        used: dict[int, int] = {}

        def take(n: int, used=used) -> int:
            used[n] = used.get(n, 0) + 1
            return n

        lot = [take(lengths[-1])]
        gap = capacity - lot[0]
        while gap > 0:
            at = bisect_right(lengths, gap) - 1
            while at >= 0 and left[lengths[at]] <= used.get(lengths[at], 0):
                at -= 1
            if at < 0:
                break
            gap -= take(lengths[at])
            lot.append(lengths[at])
        if gap > 0 and len(lot) > 1:
            smallest = min(lot)
            free = np.array([n for n in lengths if left[n] > used.get(n, 0) and n < gap + smallest], dtype=np.int64)
            spare = np.array([left[n] - used.get(n, 0) for n in free.tolist()], dtype=np.int64)
            pair = best_two(free, spare, gap + smallest) if len(free) else None
            if pair and sum(pair) > smallest:
                used[smallest] -= 1
                lot.remove(smallest)
                lot += [take(n) for n in pair]
        times = min(left[n] // k for n, k in used.items() if k)
        plans.append((lot, times))
        for n, k in used.items():
            left[n] -= k * times
            if k and not left[n]:
                lengths.remove(n)
    return plans


class Places:
    """(sequence, offset) of the piece with rank r among those of its length."""

    def __init__(self, plans: list[tuple[list[int], int]], capacity: int):
        rows, done, base = [], {}, 0
        for lot, times in plans:
            offset = 0
            for n in sorted(set(lot), reverse=True):
                k = lot.count(n)
                rows.append((n, done.get(n, 0), k, base, offset))
                done[n] = done.get(n, 0) + k * times
                offset += k * n
            base += times
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.span = int(max(done.values(), default=0)) + 1
        self.table = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.keys = self.table[:, 0].astype(object) * self.span + self.table[:, 1] if capacity * self.span >= 1 << 62 else self.table[:, 0] * self.span + self.table[:, 1]

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.table[np.searchsorted(self.keys, lengths * self.span + ranks, side="right") - 1]
        within = ranks - row[:, 1]
        return row[:, 3] + within // row[:, 2], row[:, 4] + within % row[:, 2] * lengths


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents longer than ``capacity`` in pieces of it, others whole."""

    @lean
    def run(batches):
        with coder(WordCoder, path) as words:
            for whole in batches:
                for batch in byte_slices(whole, "text"):
                    ids, bounds = words.encode(batch.column("text"), end_id)
                    raw, sizes = memoryview(ids.astype("<u4", copy=False).tobytes()), np.diff(bounds)
                    pieces = -(-sizes // capacity)
                    owner = np.repeat(np.arange(len(sizes)), pieces)
                    piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    start = piece * capacity
                    length = np.minimum(capacity, sizes[owner] - start)
                    first = bounds[owner] + start
                    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())],
                        ["doc_id", "piece", "start", "length", "ids_crc32"],
                    )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to ``capacity``."""
    tables = SharedTables(pieces.sparkSession)
    names = list(pieces.columns)
    rows = tables.save(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces").withColumn("__block", F.shiftright("__row", _BLOCK_BITS))
    # At most `capacity` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(plan_bins(histogram, capacity), capacity)
    blocks = rows.groupBy("length", "__block").agg(F.count(F.lit(1)).alias("n")).withColumn("__lot", F.shiftright("__block", _BLOCK_BITS))
    past = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = blocks.groupBy("length", "__lot").agg(F.sum("n").alias("n")).select("length", "__lot", past(["length"], "__lot").alias("__before"))
    base = blocks.select("length", "__lot", "__block", past(["length", "__lot"], "__block").alias("__past")).join(lots, ["length", "__lot"]).select("length", "__block", (F.col("__before") + F.col("__past")).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__block", "length").orderBy("__row")) - 1
    ranked = rows.withColumn("__in", within).join(base, ["__block", "length"]).withColumn("__rank", F.col("__base") + F.col("__in"))

    @lean
    def place(batches):
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "__rank"))
            sequence, offset = places.find(lengths, ranks)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, "__rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return place_pieces(cut_pieces(docs, path, end_id, capacity, id_col, text_col), capacity)
