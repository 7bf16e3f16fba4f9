"""Sums over the lists of a table's rows, a block of rows against another.

The common neighbours of all pairs of nodes are as many as a graph has paths of two arcs. None of them becomes
a row here: a task holds the lists of one block of right rows, and left rows pass it one by one.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: List entries of right rows that a task holds, of left rows that pass it, and rows of a batch that it returns.
HELD = 4_000_000
PASSING = 16_000_000
RETURNED = 1 << 18
#: Entries that a task sorts before it sends them as pieces of lists, and packed ones that it opens at once.
PIECE = 2_000_000
OPENED = 1_000_000
#: Bytes of packed lists up to which each task of walked() holds all, and numbers of its dense rows.
WHOLE = 256_000_000
DENSE = 12_000_000


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that end where the id changes."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if rest[0].column("id")[0] == batch.column("id")[-1]:
            continue
        rows = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
        ids = rows.column("id").to_numpy()
        last = int(np.searchsorted(ids, ids[-1]))
        yield rows.slice(0, last)
        rest = [rows.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def lists(entries: DataFrame, key: str, at: str, value: str | None = None) -> DataFrame:
    """(id, m, x): the column ``at`` of each key's rows as one list, with the values beside it (x is null without one)."""
    columns = [F.col(key).cast("long").alias("id"), F.col(at).cast("long").alias("m"), *([F.col(value).cast("double").alias("x")] if value else [])]

    def gather(batches):
        return map(listed, _whole_keys(batches))

    def listed(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids = rows.column("id").to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1))
        bounds = pa.array(np.append(starts, len(ids)), pa.int32())
        x = pa.ListArray.from_arrays(bounds, rows.column("x")) if value else pa.nulls(len(starts), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.ListArray.from_arrays(bounds, rows.column("m")), x], ["id", "m", "x"])

    # equal keys follow each other; the rows of one are all that a task holds beside a batch
    return entries.select(*columns).repartition("id").sortWithinPartitions("id").mapInArrow(gather, "id long, m array<long>, x array<double>")


def facing(left: DataFrame, right: DataFrame, hold: Callable[[pa.Table], object], meet: Callable[[object, pa.RecordBatch], Iterator], schema: str, *more: str, size: str | None = None, wide: int = 1, whole: bool = False) -> DataFrame:
    """``meet`` of each block of right rows, as ``hold`` keeps it, and each batch of left rows. Both have the columns (id, m, x) and ``more``; ``size``: the one with a row's entries, if not those of m and x.

    ``wide``: how many times the usual entries a task takes; ``whole``: each holds all right rows.
    """
    spark = left.sparkSession
    entries = F.col(size) if size else F.greatest(F.size("m"), F.size("x"), F.lit(0))
    total = lambda side: side.agg(F.sum(entries)).first()[0] or 0
    blocks = 1 if whole else max(1, -(-total(right) // (HELD * wide)))
    streams = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks), -(-total(left) // (PASSING * wide)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = right.select("id", "m", "x", *more, F.lit(0).alias("side"), own(blocks).alias("block"), each(streams).alias("stream"))
    passing = left.select("id", "m", "x", *more, F.lit(1).alias("side"), each(blocks).alias("block"), own(streams).alias("stream"))
    dealt = held.unionByName(passing).repartitionById(blocks * streams, F.col("block") * streams + F.col("stream")).sortWithinPartitions("side").select("side", "id", "m", "x", *more)

    def run(batches):
        first, kept = [], None
        for batch in batches:
            cut = int(np.searchsorted(batch.column("side").to_numpy(), 1))
            if cut:
                first.append(batch.slice(0, cut))
            if cut < batch.num_rows and (first or kept is not None):
                if kept is None:
                    kept, first = hold(pa.Table.from_batches(first)), []
                yield from meet(kept, batch.slice(cut))

    return dealt.mapInArrow(run, schema)


def _flat(rows: pa.Table | pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(the lists' entries in one array, bounds of each row's)."""
    chunks = [rows.column(column)] if isinstance(rows, pa.RecordBatch) else rows.column(column).chunks
    lengths = [np.asarray(x.value_lengths().fill_null(0), dtype=np.int64) for x in chunks]
    return np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in chunks]), np.concatenate(([0], np.cumsum(np.concatenate(lengths))))


def _coded(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct entries, places of the packed rows' entries among these, bounds of each row's), opened some rows at a time."""
    bounds = np.concatenate(([0], np.cumsum(np.asarray(rows.column("n"), dtype=np.int64))))
    names, code, at = np.zeros(0, np.int64), np.empty(bounds[-1], np.int32), 0
    for few in _opened(rows):
        names = np.union1d(names, few.column("m").flatten().to_numpy())
    for few in _opened(rows):
        m = few.column("m").flatten().to_numpy()
        code[at : at + len(m)] = np.searchsorted(names, m)
        at += len(m)
    return names, code, bounds


class Turned:
    """A block of packed right rows by the entries of their lists: the rows that have each entry."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(np.argsort(np.asarray(rows.column("id")), kind="stable"))
        self.ids = np.asarray(rows.column("id"), dtype=np.int64)
        self.names, code, bounds = _coded(rows)
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(self.names)))))
        order = np.argsort(code, kind="stable")
        self.rows = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(bounds))[order]
        x = [few.column("x").flatten().to_numpy() for few in _opened(rows)]
        self.x = np.concatenate(x)[order] if sum(map(len, x)) else None

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the entries among the names, whether they are there)."""
        code = np.minimum(np.searchsorted(self.names, entries), max(0, len(self.names) - 1))
        return code, self.names[code] == entries if len(self.names) else np.zeros(len(entries), bool)


def _gathered(batches: Iterator[tuple[int, np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, others, values)."""
    ids, others, values, n = [], [], [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in others]).astype(np.int64)), pa.array(np.concatenate(others)), pa.array(np.concatenate(values))], names)

    for i, other, value in batches:
        ids.append(i)
        others.append(other)
        values.append(value)
        n += len(other)
        if n >= RETURNED:
            yield out()
            ids, others, values, n = [], [], [], 0
    if ids:
        yield out()


def _width(largest: int) -> np.dtype:
    return np.dtype(next(t for t in ("u1", "u2", "u4", "u8") if largest <= np.iinfo(t).max))


def _pack(m: np.ndarray, x: np.ndarray | None = None) -> bytes:
    """A list in the order of its entries: the first, steps to the next ones, distinct values and each entry's place among them."""
    order = np.argsort(m, kind="stable")
    m = m[order]
    steps = np.diff(m).view(np.uint64)
    wide = _width(int(steps.max(initial=0)))
    if x is None:
        return np.array([m[0], wide.itemsize, -1], np.int64).tobytes() + steps.astype(wide).tobytes()
    values, places = np.unique(x[order].view(np.int64), return_inverse=True)
    code = _width(len(values) - 1)
    coded = len(values) * 8 + len(m) * code.itemsize < len(m) * 8 or len(values) == 1
    head = np.array([m[0], wide.itemsize, len(values) if coded else 0], np.int64).tobytes()
    kept = (values.tobytes() + (places.astype(code).tobytes() if len(values) > 1 else b"")) if coded else x[order].tobytes()
    return head + steps.astype(wide).tobytes() + kept


def _unpack(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    first, wide, distinct = np.frombuffer(packed, np.int64, 3).tolist()
    m = np.empty(n, np.int64)
    m[0], at = first, 24 + wide * (n - 1)
    m[1:] = np.frombuffer(packed, f"u{wide}", n - 1, 24).astype(np.int64)
    np.cumsum(m, out=m)
    if distinct < 0:
        return m, None
    if not distinct:
        return m, np.frombuffer(packed, np.float64, n, at)
    values = np.frombuffer(packed, np.float64, distinct, at)
    return m, np.repeat(values, n) if distinct == 1 else values[np.frombuffer(packed, _width(distinct - 1), n, at + 8 * distinct)]


def _unpacked(rows: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
    """(id, m, x) of packed rows; lists without values have none in x."""
    n = np.asarray(rows.column("n"), dtype=np.int64)
    both = [_unpack(*x) for x in zip(n.tolist(), rows.column("packed").to_pylist())]
    ends = np.concatenate(([0], np.cumsum(n)))
    some = bool(both) and both[0][1] is not None
    m = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), np.concatenate([x[0] for x in both] or [np.zeros(0, np.int64)]))
    x = pa.ListArray.from_arrays(pa.array(ends if some else 0 * ends, pa.int32()), np.concatenate([x[1] for x in both]) if some else np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(rows.column("id"), dtype=np.int64)), m, x], ["id", "m", "x"])


def _opened(rows: pa.Table | pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Packed rows as _unpacked(), and their other columns, some at a time."""
    ends = np.cumsum(np.asarray(rows.column("n"), dtype=np.int64))
    at = 0
    while at < len(ends):
        after = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + OPENED, "right")))
        few = rows.slice(at, after - at)
        found, at = _unpacked(few), after
        for name in few.schema.names:
            if name not in ("id", "n", "packed", "m", "x"):
                column = few.column(name)
                found = found.append_column(name, column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
        yield found


def packed_lists(entries: DataFrame, key: str, at: str, value: str | None = None, once: bool = False) -> DataFrame:
    """(id, n, packed): the n entries ``at`` of each key's rows and their values, if any, as bytes, some 1 to 5 for an entry; they are packed before they are sent.

    ``once``: an entry that stands again is left out.
    """
    columns = [F.col(key).cast("long").alias("id"), F.col(at).cast("long").alias("m"), *([F.col(value).cast("double").alias("x")] if value else [])]

    def pieces(batches):
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += batch.num_rows
            if n >= PIECE:
                yield from piece(pa.Table.from_batches(kept))
                kept, n = [], 0
        if n:
            yield from piece(pa.Table.from_batches(kept))

    def piece(rows: pa.Table):
        ids, m = np.asarray(rows.column("id"), dtype=np.int64), np.asarray(rows.column("m"), dtype=np.int64)
        order = np.lexsort((m, ids))
        ids, m, x = ids[order], m[order], np.asarray(rows.column("x"))[order] if value else None
        ends = np.append(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))), len(ids))
        for first in range(0, len(ends) - 1, 10_000):
            cuts = ends[first : first + 10_001].tolist()
            bytes_ = [_pack(m[a:b], x[a:b] if value else None) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[cuts[:-1]]), pa.array(np.diff(cuts)), pa.array(bytes_, pa.binary())], ["id", "n", "packed"])

    def merge(batches):
        for rows in _whole_keys(batches):
            ids = rows.column("id").to_numpy()
            ends = np.append(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))), len(ids)).tolist()
            n, bytes_ = rows.column("n").to_pylist(), rows.column("packed").to_pylist()
            out = [joined(n[a:b], bytes_[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[ends[:-1]]), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["id", "n", "packed"])

    def joined(n: list, bytes_: list) -> tuple[int, bytes]:
        if len(n) == 1 and not once:
            return n[0], bytes_[0]
        both = [_unpack(*x) for x in zip(n, bytes_)]
        m, x = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]) if value else None
        if once:
            m, first = np.unique(m, return_index=True)
            x = x[first] if value else None
        return len(m), _pack(m, x)

    schema = "id long, n long, packed binary"
    return entries.select(*columns).mapInArrow(pieces, schema).repartition("id").sortWithinPartitions("id").mapInArrow(merge, schema)


def _bare(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("id", "n", "packed", *more, F.lit(None).cast("array<long>").alias("m"), F.lit(None).cast("array<double>").alias("x"))


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, z): the sum of x y over the common entries of left row i and right row j, both packed; pairs without one are left out."""

    def meet(block: Turned, whole: pa.RecordBatch):
        return itertools.chain.from_iterable(met(block, few) for few in _opened(whole))

    def met(block: Turned, batch: pa.RecordBatch):
        entries, ends = _flat(batch, "m")
        x, (code, there) = _flat(batch, "x")[0], block.codes(entries)

        def rows():
            for i, a, b in zip(batch.column("id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                c, u = code[a:b][there[a:b]], x[a:b][there[a:b]]
                if len(c):
                    spans = [slice(s, e) for s, e in zip(block.bounds[c].tolist(), block.bounds[c + 1].tolist())]
                    at = np.concatenate([block.rows[s] for s in spans])
                    y = np.concatenate([block.x[s] for s in spans]) * np.repeat(u, block.bounds[c + 1] - block.bounds[c])
                    z, found = np.bincount(at, y, len(block.ids)), np.zeros(len(block.ids), bool)
                    found[at] = True
                    yield i, block.ids[found], z[found]

        return _gathered(rows(), ["i", "j", "z"])

    return facing(_bare(left), _bare(right), Turned, meet, "i long, j long, z double", "n", "packed", size="n")


def walked(rows: DataFrame, back: DataFrame, steps: int) -> DataFrame:
    """(i, j, z): where walks from row i are after ``steps`` steps more, pairs without one left out.

    ``rows`` has the arcs of each node by target and ``back`` those by source, packed with weights, all positive. Each task
    holds all of ``back`` packed and takes some rows at a time through all steps, so nothing between them is kept.
    """

    def hold(table: pa.Table):
        ids, (names, codes, bounds) = np.asarray(table.column("id"), dtype=np.int64), _coded(table)
        every = np.union1d(names, ids)
        code, out, lists_ = np.searchsorted(every, names), np.zeros(len(every)), []
        for n, packed_, a, b in zip(table.column("n").to_pylist(), table.column("packed").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            m, (_, w) = code[codes[a:b]], _unpack(n, packed_)
            np.add.at(out, m, w)
            lists_.append((n, _pack(m, w)))
        return every, np.searchsorted(every, ids).tolist(), lists_, np.where(out > 0, 1 / np.where(out > 0, out, 1), 0.0)[:, None]

    def meet(block, batch: pa.RecordBatch):
        every, targets, lists_, share = block
        width = max(1, min(128, DENSE // len(every)))

        def found():
            for at in range(0, batch.num_rows, width):
                few = batch.slice(at, width)
                here = np.zeros((few.num_rows, len(every)))
                for r, (n, packed_) in enumerate(zip(few.column("n").to_pylist(), few.column("packed").to_pylist())):
                    m, w = _unpack(n, packed_)
                    here[r] = np.bincount(np.searchsorted(every, m), w / w.sum(), len(every))
                here = np.ascontiguousarray(here.T)
                for _ in range(steps):
                    here *= share
                    after = np.zeros_like(here)
                    for j, (n, packed_) in zip(targets, lists_):
                        m, w = _unpack(n, packed_)
                        after[j] = w @ here.take(m, axis=0)
                    here = after
                here = np.ascontiguousarray(here.T)
                for i, z in zip(few.column("id").to_pylist(), here):
                    hit = np.flatnonzero(z)
                    if len(hit):
                        yield i, every[hit], z[hit]

        return _gathered(found(), ["i", "j", "z"])

    return facing(_bare(rows), _bare(back), hold, meet, "i long, j long, z double", "n", "packed", size="n", whole=True)


def common_entries(rows: DataFrame) -> DataFrame:
    """(a, b, n): pairs of packed rows a < b with common entries, each pair of equal entries counted."""

    def meet(block: Turned, batch: pa.RecordBatch):
        def found():
            for few in _opened(batch):
                entries, ends = _flat(few, "m")
                code, there = block.codes(entries)
                for i, a, b in zip(few.column("id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    c, after = code[a:b][there[a:b]], int(np.searchsorted(block.ids, i, "right"))
                    if len(c) and after < len(block.ids):
                        at = np.concatenate([block.rows[s:e] for s, e in zip(block.bounds[c].tolist(), block.bounds[c + 1].tolist())])
                        n = np.bincount(at, minlength=len(block.ids))[after:]
                        hit = np.flatnonzero(n)
                        yield i, block.ids[after:][hit], n[hit]

        return _gathered(found(), ["a", "b", "n"])

    return facing(_bare(rows), _bare(rows), Turned, meet, "a long, b long, n long", "n", "packed", size="n", wide=2)


def closed(rows: DataFrame) -> DataFrame:
    """(id, tv, tc, vv, vc) of a graph's packed rows (neighbours with their clusters, own: the node's), no neighbour twice.

    tv: triangles of the node, tc: those inside its cluster, vv and vc: neighbours that close one, and those of its
    cluster. A cluster that is NaN is like no other. Partial rows of a node add up.
    """

    def hold(block: pa.Table):
        names, code, ends = _coded(block)
        order = np.argsort(np.asarray(block.column("id")), kind="stable")
        return np.asarray(block.column("id"))[order], order, names, code, ends

    def meet(block, whole: pa.RecordBatch):
        return itertools.chain.from_iterable(met(block, few) for few in _opened(whole))

    def met(block, batch: pa.RecordBatch):
        ids, order, names, code, bounds = block
        entries, ends = _flat(batch, "m")
        near, own = _flat(batch, "x")[0], batch.column("own").to_numpy(zero_copy_only=False)
        mark = np.zeros(len(names), np.int64)
        at, row = np.searchsorted(names, entries), np.searchsorted(ids, entries)
        there, held = names[np.minimum(at, len(names) - 1)] == entries, ids[np.minimum(row, len(ids) - 1)] == entries
        out = []
        for i, a, b in zip(range(batch.num_rows), ends[:-1].tolist(), ends[1:].tolist()):
            inner = near[a:b] == own[i]
            places, mine = at[a:b][there[a:b]], np.flatnonzero(held[a:b])
            lines = order[row[a:b][mine]]
            if not len(mine):
                continue
            # one in the low half for a common neighbour, one in the high half for one inside the cluster
            mark[places] = 1 + (inner[there[a:b]].astype(np.int64) << 32)
            ones = np.concatenate(([0], np.cumsum(mark[np.concatenate([code[s:e] for s, e in zip(bounds[lines].tolist(), bounds[lines + 1].tolist())])])))
            cuts = np.concatenate(([0], np.cumsum(bounds[lines + 1] - bounds[lines])))
            sums = ones[cuts[1:]] - ones[cuts[:-1]]
            mark[places] = 0
            every, inside = sums & 0xFFFFFFFF, np.where(inner[mine], sums >> 32, 0)
            out.append((batch.column("id")[i].as_py(), int(every.sum()), int(inside.sum()), int((every > 0).sum()), int(((every > 0) & inner[mine]).sum())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["id", "tv", "tc", "vv", "vc"])

    side = _bare(rows, "own")
    parts = facing(side, side, hold, meet, "id long, tv long, tc long, vv long, vc long", "n", "packed", "own", size="n", wide=3)
    # a triangle is found from both of its other corners
    return parts.groupBy("id").agg(*[F.expr(f"sum({x}) div {n}").alias(x) for x, n in (("tv", 2), ("tc", 2), ("vv", 1), ("vc", 1))]).where("tv > 0")


def neighbour_means(rows: DataFrame, features: DataFrame) -> DataFrame:
    """(id, f): the mean of the vectors (id, f) of each row's entries (id, m), position by position, nulls left out."""
    vectors = features.where("f is not null").select("id", F.lit(None).cast("array<long>").alias("m"), F.col("f").cast("array<double>").alias("x"))

    def hold(block: pa.Table):
        ids, (values, bounds) = np.asarray(block.column("id")), _flat(block, "x")
        sizes, missing = np.diff(bounds), np.concatenate([np.asarray(x.flatten().is_null()) for x in block.column("x").chunks])
        full, known = np.zeros((len(ids), max(1, sizes.max()))), np.zeros((len(ids), max(1, sizes.max())), bool)
        places = np.arange(full.shape[1])[None, :] < sizes[:, None]
        full[places], known[places] = np.where(missing, 0.0, values), ~missing
        order = np.argsort(ids, kind="stable")
        return ids[order], full[order], None if known.all() else known[order], sizes[order]

    def meet(block, batch: pa.RecordBatch):
        ids, full, known, sizes = block
        entries, ends = _flat(batch, "m")
        row = np.minimum(np.searchsorted(ids, entries), len(ids) - 1)
        there, names, sums, counts = ids[row] == entries, [], [], []
        for i, a, b in zip(batch.column("id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
            lines = row[a:b][there[a:b]]
            if len(lines):
                width = int(sizes[lines].max())
                cuts = [lines[at : at + 65_536] for at in range(0, len(lines), 65_536)]
                names.append(i)
                sums.append(sum(full[x].sum(axis=0) for x in cuts)[:width])
                counts.append(np.full(width, len(lines)) if known is None else sum(known[x].sum(axis=0) for x in cuts)[:width])
        if names:
            bounds = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sums]))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(bounds, np.concatenate(sums)), pa.ListArray.from_arrays(bounds, np.concatenate(counts))], ["id", "s", "k"])

    parts = facing(rows.select("id", "m", F.lit(None).cast("array<double>").alias("x")), vectors, hold, meet, "id long, s array<double>, k array<long>")
    each = parts.select("id", F.posexplode(F.arrays_zip("s", "k")).alias("i", "e")).groupBy("id", "i").agg(F.try_divide(F.sum("e.s"), F.sum("e.k")).alias("x"))
    return each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l")).select("id", F.transform("l", lambda p: p["x"]).alias("f"))


def nearer(points: DataFrame, threshold: float) -> DataFrame:
    """(id, j): pairs j < id of points (id, f), all of one length, that are less than ``threshold`` apart."""
    rows = points.select("id", F.lit(None).cast("array<long>").alias("m"), F.col("f").cast("array<double>").alias("x"))

    def hold(block: pa.Table):
        order, f = np.argsort(np.asarray(block.column("id")), kind="stable"), _flat(block, "x")[0].reshape(block.num_rows, -1)
        return np.asarray(block.column("id"))[order], np.column_stack((f, -(f**2).sum(axis=1) / 2))[order]

    def meet(block, batch: pa.RecordBatch):
        ids, held = block
        own, f = np.asarray(batch.column("id")), _flat(batch, "x")[0].reshape(batch.num_rows, -1)
        # f is near v if f v - v v / 2 > (f f - t t) / 2
        ones, least = np.column_stack((f, np.ones(len(own)))), ((f**2).sum(axis=1) - threshold**2) / 2
        for at in range(0, len(own), 256):
            few, i, j = slice(at, at + 256), [], []
            for first in range(0, int(np.searchsorted(ids, own[few].max())), 2048):
                near = ones[few] @ held[first : first + 2048].T > least[few][:, None]
                near &= ids[first : first + 2048][None, :] < own[few][:, None]
                a, b = np.nonzero(near)
                i.append(own[few][a])
                j.append(ids[first + b])
            if i:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(i)), pa.array(np.concatenate(j))], ["id", "j"])

    return facing(rows, rows, hold, meet, "id long, j long")


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, c): the centre (c, f) at the least squared distance from each point (id, f) over the positions that both have, the smallest c of equal ones."""
    side = lambda rows, name: rows.where("f is not null").select(F.col(name).cast("long").alias("id"), F.lit(None).cast("array<long>").alias("m"), F.col("f").cast("array<double>").alias("x"))

    def dense(rows: pa.Table | pa.RecordBatch):
        values, bounds = _flat(rows, "x")
        sizes = np.diff(bounds)
        full = np.full((len(sizes), max(1, sizes.max(initial=0))), np.nan)
        full[np.arange(full.shape[1])[None, :] < sizes[:, None]] = values
        known = ~np.isnan(full)
        return np.where(known, full, 0.0), known.astype(float)

    def hold(block: pa.Table):
        block = block.take(np.argsort(np.asarray(block.column("id")), kind="stable"))
        return np.asarray(block.column("id")), *dense(block)

    def meet(block, batch: pa.RecordBatch):
        names, centre, there = block
        f, known = dense(batch)
        width = min(f.shape[1], centre.shape[1])
        f, known, centre, there = f[:, :width], known[:, :width], centre[:, :width], there[:, :width]
        best, found = np.full(len(f), np.inf), np.zeros(len(f), np.int64)
        for at in range(0, len(f), 256):
            few = slice(at, at + 256)
            for first in range(0, len(names), 2048):
                some = slice(first, first + 2048)
                d = f[few] ** 2 @ there[some].T + known[few] @ (centre[some] ** 2).T - 2 * f[few] @ centre[some].T
                d = np.where(known[few] @ there[some].T > 0, d, np.inf)
                least = d.argmin(axis=1)
                d = d[np.arange(len(d)), least]
                nearer = d < best[few]
                best[few], found[few] = np.where(nearer, d, best[few]), np.where(nearer, names[some][least], found[few])
        hit = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column("id"))[hit]), pa.array(best[hit]), pa.array(found[hit])], ["id", "d", "c"])

    parts = facing(side(points, "id"), side(centres, "c"), hold, meet, "id long, d double, c long")
    return parts.groupBy("id").agg(F.min(F.struct("d", "c"))["c"].alias("c"))
