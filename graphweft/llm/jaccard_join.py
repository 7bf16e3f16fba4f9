"""N-gram Jaccard join with prefixes of token combinations.

Documents are sets of word shingles; two link when their Jaccard similarity reaches a percentage.
Shingles are ordered by document frequency, rare ones first. A document's prefix is extended until more
shingles would have to go than a linked partner can lack before all its signatures are gone: a rare
shingle is a signature by itself; frequent ones fall into classes by their hash, and in a class every
pair is one, so a class of n frequent shingles survives n - 2 losses. Linked documents then share a
signature. The number of classes follows the size of the sets, in steps of two; a document also takes
the step of its largest possible partner.

Plan:
1. One scan hashes the shingles. They go to ranges of the hash as packed columns (about 6 bytes each),
   where their document frequencies are counted; only shingles of two documents or more come back,
   grouped as they were sent, as no other can be shared. A document with fewer shared shingles than a
   partner must have in common is done with. A task counts one range after the other; where the input
   would need more ranges than RANGE_TASKS, a task takes several, sorted by the shuffle.
2. Equal sets are one class, known by a 128-bit sum over the set; the rest is about one set a class.
3. Signatures meet in a hash shuffle. The home of a class is the smallest class with which it shares a
   signature. Classes of one home are compared with each other, those of two homes only if they have a
   signature that is in both; a signature in more than HOMES homes makes these one, so a list of n classes
   gives at most n * HOMES rows. Linked documents share a signature, so no link is missed.
4. Groups are verified in blocks of bounded size, block against block: exact intersection sizes come from
   a matrix product over shingles frequent in the block and from posting lists over the others. A task
   returns a spanning forest of its links, at most one edge a class, and these give the components.

Defined results: null, empty and blank texts have no shingles and link with nothing; rows with the
same doc_id are one document, linked with what any of its texts is linked with; a null doc_id has no
component; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import pack, pack_many, pack_rising, unpack, unpack_many, unpack_rising
from .common import SharedTables, byte_slices, input_bytes, lean, shuffle_partitions, utf8_values
from .components import components
from .shingles import mix, shingle_sets

#: Bits of a shingle's hash that are sent; 44 leave a chance of 10^-8 that two documents seem to share one more.
HASH_BITS = 44
#: Shingles that one lot of a task sends, and input bytes for one range of hashes; both bound a task's memory.
LOT_SHINGLES = 1_000_000
RANGE_BYTES = 8 << 20
#: Tasks that the ranges are dealt to at most.
RANGE_TASKS = 20_000
#: Document frequency up to which a shingle is a signature by itself.
RARE = 32
CLASS_SIZE = 16
#: Homes that a signature may have before they become one.
HOMES = 8
#: Sets and bytes of one block of a group; two blocks are compared at a time.
BLOCK_SETS = 256
BLOCK_BYTES = 8 << 20
#: Sets of two blocks that must have a shingle for it to be a column of the matrix product, and columns at a time.
DENSE = 24
CHUNK = 4096


def least_common(size, percent: int):
    """Shingles that a set of this size shares with any linked partner at least."""
    return -(-percent * size // 100)


def _map_sets(words: int, ranges: int):
    @lean
    def run(batches):
        task = TaskContext.get().partitionId()
        lot, held, number = [], 0, 0

        def flush():
            nonlocal lot, held, number
            key = (task << 24) | number
            number += 1
            sizes = np.array([len(s) for _, s in lot], np.int64)
            known = np.array([i is not None for i, _ in lot], np.uint8)
            own = np.array([i or 0 for i, _ in lot], "<i8")
            sums = np.array([[np.add.reduce(mix(s)), np.bitwise_xor.reduce(mix(s + np.uint64(0x5851F42D4C957F2D)))] for _, s in lot], np.uint64).reshape(-1, 2)
            table = pack_many(known.tobytes(), own.tobytes(), sizes.astype("<u4").tobytes(), np.ascontiguousarray(sums, "<u8").tobytes())
            rows = [(int(key % ranges), key, 0, table)]
            hashes = np.concatenate([s for _, s in lot]) >> np.uint64(64 - HASH_BITS)
            owner = np.repeat(np.arange(len(lot), dtype=np.uint32), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            target = (hashes >> np.uint64(HASH_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)
            cuts = np.searchsorted(target, np.arange(ranges + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[k], cuts[k + 1])
                rows.append((k, key, 1, pack_many(pack_rising(hashes[part]), owner[part].astype("<u2").tobytes())))
            lot, held = [], 0
            for at in range(0, len(rows), 64):
                some = list(zip(*rows[at : at + 64]))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, kinds)], ["range", "lot", "kind", "blob"])

        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(utf8_values(batch.column("text")), words)):
                    lot.append((doc_id, s))
                    held += len(s)
                    if held >= LOT_SHINGLES or len(lot) >= 60_000:
                        yield from flush()
        if lot:
            yield from flush()

    return run


@lean
def _count_ranges(batches):
    """Of each range's blobs, the shingles that two documents or more have, with their frequencies."""
    kinds = (pa.int64(), pa.int32(), pa.binary())
    row = lambda *values: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], ["lot", "kind", "blob"])
    at, lots, hashes, owners = None, [], [], []

    def flush():
        if not lots:
            return
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        sizes = np.diff(np.concatenate((heads, [len(ordered)])))
        frequency = np.empty(len(flat), np.uint32)
        frequency[order] = np.repeat(sizes, sizes)
        del order, ordered
        start = 0
        for key, own, owner in zip(lots, hashes, owners):
            part = frequency[start : start + len(own)]
            start += len(own)
            shared = part > 1
            if shared.any():
                yield row(key, 1, pack_many(pack_rising(own[shared]), owner[shared].tobytes(), pack(part[shared])))

    for batch in batches:
        for where, key, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("range", "lot", "kind", "blob"))):
            if where != at:
                yield from flush()
                at, lots, hashes, owners = where, [], [], []
            if kind == 0:
                yield row(key, 0, blob)
                continue
            first, second = unpack_many(blob, 2)
            lots.append(key)
            hashes.append(unpack_rising(first))
            owners.append(np.frombuffer(second, "<u2"))
    yield from flush()


def _gather_lot(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        hashes, owners, frequencies, rows = [np.zeros(0, np.uint64)], [np.zeros(0, "<u2")], [np.zeros(0, np.uint64)], None
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
            if kind == 0:
                rows = unpack_many(blob, 4)
            else:
                a, b, c = unpack_many(blob, 3)
                hashes.append(unpack_rising(a))
                owners.append(np.frombuffer(b, "<u2"))
                frequencies.append(unpack(c))
        known, own = np.frombuffer(rows[0], np.uint8), np.frombuffer(rows[1], "<i8")
        sizes, sums = np.frombuffer(rows[2], "<u4").astype(np.int64), np.frombuffer(rows[3], "<u8").reshape(-1, 2).view(np.int64)
        hashes, owners, frequencies = np.concatenate(hashes), np.concatenate(owners), np.concatenate(frequencies)
        order = np.lexsort((hashes, owners))
        hashes, owners, frequencies = hashes[order], owners[order], frequencies[order]
        cuts = np.searchsorted(owners, np.arange(len(own) + 1))
        tokens, weights = [], []
        for k, size in enumerate(sizes.tolist()):
            part = slice(cuts[k], cuts[k + 1])
            alive = size > 0 and part.stop - part.start >= least_common(size, percent)
            tokens.append(hashes[part].astype("<u8").tobytes() if alive else None)
            weights.append(pack(frequencies[part]) if alive else None)
        return pa.table(
            [
                pa.array((key[0].as_py() << 16) + np.arange(len(own))), pa.array([int(x) if k else None for x, k in zip(own, known)], pa.int64()), pa.array(sizes), pa.array(sums[:, 0]), pa.array(sums[:, 1]),
                pa.array(tokens, pa.binary()), pa.array(weights, pa.binary()),
            ],
            names=["row", "doc_id", "n", "s1", "s2", "tokens", "weights"],
        )

    return run


def signatures(size: int, tokens: np.ndarray, weights: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set with these shared shingles; all its others come before them in the order."""
    order = np.lexsort((tokens, weights))
    tokens, weights = tokens[order], weights[order]
    need = size - least_common(size, percent) + 1 - (size - len(tokens))
    out = []
    for step in {size.bit_length(), (size * 100 // percent).bit_length()}:
        scale = 1 << (step - 1)
        classes = scale // CLASS_SIZE
        frequent = weights > RARE if classes else np.zeros(len(tokens), bool)
        kind = (mix(tokens) % np.uint64(max(1, classes))).astype(np.int64)
        kind[~frequent] = -1
        # a shingle holds out once more than its class has no other yet
        first = np.zeros(len(tokens), bool)
        spots = np.flatnonzero(frequent)
        first[spots[np.unique(kind[spots], return_index=True)[1]]] = True
        held = np.cumsum(~first)
        reached = np.searchsorted(held, need) + 1
        tokens_in, kind_in = tokens[:reached], kind[:reached]
        out.append(mix(tokens_in[kind_in < 0]))
        many = np.flatnonzero(kind_in >= 0)
        many = many[np.lexsort((tokens_in[many], kind_in[many]))]
        bounds = np.flatnonzero(np.concatenate(([True], np.diff(kind_in[many]) != 0, [True]))) if len(many) else []
        for a, b in zip(bounds[:-1], bounds[1:]):
            group = tokens_in[many[a:b]]
            i, j = np.triu_indices(len(group), 1)
            out.append(mix(mix(group[i]) * np.uint64(3) + group[j]))
    return np.unique(np.concatenate(out))


def _sign(percent: int):
    @lean
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                keys, owners = [], []
                columns = (batch.column(c)[at : at + 512].to_pylist() for c in ("cls", "n", "tokens", "weights"))
                for cls, n, tokens, weights in zip(*columns):
                    found = signatures(n, np.frombuffer(tokens, "<u8").astype(np.uint64), unpack(weights), percent)
                    keys.append(found)
                    owners.append(np.full(len(found), cls, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["sig", "cls"])

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    tokens = np.concatenate((*left, *right))
    _, code, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [*map(len, left), *map(len, right)])
    dense = np.flatnonzero(counts > DENSE)
    for at in range(0, len(dense), CHUNK):
        place = np.full(len(counts), -1)
        place[dense[at : at + CHUNK]] = np.arange(len(dense[at : at + CHUNK]))
        hit = place[code] >= 0
        table = np.zeros((len(left) + len(right), min(CHUNK, len(dense) - at)), np.float32)
        table[owner[hit], place[code][hit]] = 1
        out += table[: len(left)] @ table[len(left) :].T
    rare = np.flatnonzero((counts[code] > 1) & (counts[code] <= DENSE))
    rare = rare[np.argsort(code[rare], kind="stable")]
    heads = np.flatnonzero(np.diff(code[rare], prepend=-1))
    sizes = np.diff(np.append(heads, len(rare)))
    flat = out.reshape(-1)
    for size in np.unique(sizes):
        members = owner[rare[heads[sizes == size][:, None] + np.arange(size)]]
        for i in range(size):
            for j in range(size):
                pair = (members[:, i] < len(left)) & (members[:, j] >= len(left))
                np.add.at(flat, members[pair, i] * len(right) + members[pair, j] - len(left), 1)
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (first found, other) of a spanning forest of a symmetric boolean matrix."""
    left, out = np.ones(len(links), bool), []
    for root in range(len(links)):
        if left[root]:
            left[root] = False
            front = np.array([root])
            while len(front):
                front = np.flatnonzero(links[front].any(axis=0) & left)
                left[front] = False
                out += [(root, int(x)) for x in front]
    return out


def linked_pairs(percent: int, left: list[tuple], right: list[tuple] | None) -> list[tuple[int, int]]:
    """Edges between classes (cls, n, tokens) of two sides, or of one among themselves: a spanning forest of the links."""
    sides = [left, left if right is None else right]
    tokens = [[t for *_, t in side] for side in sides]
    sizes = [np.array([n for _, n, _ in side], np.int64) for side in sides]
    common = common_counts(*tokens).astype(np.int64)
    linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    ids = [cls for cls, *_ in left]
    if right is None:
        return [(ids[u], ids[v]) for u, v in forest(linked)]
    ids += [cls for cls, *_ in right]
    whole = np.zeros((len(ids), len(ids)), bool)
    whole[: len(left), len(left) :], whole[len(left) :, : len(left)] = linked, linked.T
    return [(ids[u], ids[v]) for u, v in forest(whole)]


def _verify(percent: int):
    """Of rows (x, y, bx, by, side, cls, n, tokens) sorted by the first four, the edges of each such block pair."""

    @lean
    def run(batches):
        at, sides = None, ([], [])

        def found():
            if sides[0] and sides[1]:
                return linked_pairs(percent, *sides)
            # blocks of their own are not sent twice
            return linked_pairs(percent, sides[0], None) if len(sides[0]) > 1 and at[0] == at[1] and at[2] == at[3] else []

        def rows(edges):
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in edges], pa.int64()), pa.array([v for _, v in edges], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("x", "y", "bx", "by"))))
            for i, (key, side, cls, n) in enumerate(zip(keys, *(batch.column(c).to_pylist() for c in ("side", "cls", "n")))):
                if key != at:
                    if at is not None:
                        yield from rows(found())
                    at, sides = key, ([], [])
                sides[side].append((cls, n, np.frombuffer(batch.column("tokens")[i].as_buffer(), "<u8")))
        if at is not None:
            yield from rows(found())

    return run


def _document_sets(docs: DataFrame, words: int, percent: int, tables: SharedTables) -> DataFrame:
    ranges = int(max(shuffle_partitions(docs.sparkSession), input_bytes(docs) // RANGE_BYTES))
    sent = docs.mapInArrow(_map_sets(words, ranges), "range int, lot long, kind int, blob binary")
    tasks = min(ranges, RANGE_TASKS)
    dealt = sent.repartitionById(tasks, F.floor(F.col("range") * tasks / ranges).cast("int"))
    if tasks < ranges:
        dealt = dealt.sortWithinPartitions("range")
    counted = dealt.mapInArrow(_count_ranges, "lot long, kind int, blob binary")
    gathered = counted.groupBy("lot").applyInArrow(_gather_lot(percent), "row long, doc_id long, n long, s1 long, s2 long, tokens binary, weights binary")
    return tables.save(gathered, "sets")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id that links lead to."""
    tables = SharedTables(docs.sparkSession)
    sets = _document_sets(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), words, percent, tables)
    key = ["s1", "s2", "n"]
    classes = tables.save(sets.where("n > 0").groupBy(*key).agg(F.min("row").alias("cls"), F.min("doc_id").alias("rep")), "classes")
    alive = sets.where("tokens is not null").join(classes.select(F.col("cls").alias("row")), "row", "left_semi")
    reps = tables.save(alive.select(F.col("row").alias("cls"), "n", "tokens", "weights"), "reps")
    links = _links(reps, percent, tables)
    repeated = tables.save(sets.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id"), "repeated")
    several = not repeated.isEmpty()
    if several:
        # texts of one document link with each other
        own = sets.where("n > 0").join(repeated, "doc_id").join(classes.drop("rep"), key).select("doc_id", "cls").distinct()
        links = links.union(own.join(own.groupBy("doc_id").agg(F.min("cls").alias("a")), "doc_id").where("a <> cls").select("a", F.col("cls").alias("b")))
    nodes = components(links, tables, "components").select(F.col("node").alias("cls"), "label").join(classes.select("cls", "rep"), "cls")
    labels = tables.save(nodes.join(nodes.groupBy("label").agg(F.min("rep").alias("least")), "label").select("cls", "least"), "labels")
    for name in ("reps", "links"):
        tables.drop(name)
    known = sets.select("doc_id", "n", "s1", "s2").join(classes, key, "left").join(labels, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "rep", "doc_id"))
    out = known.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    if not several:
        return out
    # a row without words goes with the others of its document
    low = out.join(repeated, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("low"))
    return out.join(low, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("low", "component_id").alias("component_id"))


def _homes(lists: DataFrame, tables: SharedTables) -> DataFrame:
    """(sig, cls, home) of classes in lists (sig, cls, head); no signature has more than HOMES homes."""
    homes = tables.save(lists.groupBy("cls").agg(F.min("head").alias("home")), "homes")
    placed = lists.select("sig", "cls").join(homes, "cls")
    spread = placed.select("sig", "home").distinct()
    wide = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.min("home").alias("a")).where(F.col("k") > HOMES)
    merged = tables.save(spread.join(wide.select("sig", "a"), "sig").where("a <> home").select("a", F.col("home").alias("b")).distinct(), "merged")
    if merged.isEmpty():
        return placed
    joined = components(merged, tables, "homes-merged").select(F.col("node").alias("home"), "label")
    return placed.join(joined, "home", "left").select("sig", "cls", F.coalesce("label", "home").alias("home"))


def _links(reps: DataFrame, percent: int, tables: SharedTables) -> DataFrame:
    """(a, b): edges that connect all linked classes."""
    signed = tables.save(reps.select("cls", "n", "tokens", "weights").mapInArrow(_sign(percent), "sig long, cls long"), "signed")
    heads = signed.groupBy("sig").agg(F.min("cls").alias("head"), F.max("cls").alias("last")).where("head <> last").select("sig", "head")
    lists = tables.save(signed.join(heads, "sig"), "lists")
    placed = tables.save(_homes(lists, tables), "placed")
    members = placed.select("cls", "home").distinct()
    spread = placed.select("sig", "home").distinct()
    several = spread.groupBy("sig").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo <> hi").select("sig")
    others = spread.join(several, "sig").select("sig", F.col("home").alias("other"))
    across = placed.join(others, "sig").where("home <> other").select("cls", "home", "other").distinct()
    sets = reps.select("cls", "n", "tokens")
    shape = members.join(sets.select("cls", F.octet_length("tokens").alias("bytes")), "cls").groupBy("home").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    shape = tables.save(shape.select("home", blocks.alias("blocks"), (F.col("size") > 1).alias("several")), "shape")
    pairs = members.join(shape.where("several").select("home"), "home").select("cls", "home", F.col("home").alias("other")).union(across)
    # a class goes to every block of the other side
    far = shape.select(F.col("home").alias("other"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("there"))
    spots = pairs.join(shape.select("home", "blocks"), "home").withColumn("here", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).join(far, "other")
    swap = (F.col("home") > F.col("other")) | ((F.col("home") == F.col("other")) & (F.col("here") > F.col("there")))
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    keyed = spots.select(pick("home", "other").alias("x"), pick("other", "home").alias("y"), pick("here", "there").alias("bx"), pick("there", "here").alias("by"), swap.cast("int").alias("side"), "cls").join(sets, "cls")
    dealt = keyed.repartition("x", "y", "bx", "by").sortWithinPartitions("x", "y", "bx", "by")
    links = tables.save(dealt.select("x", "y", "bx", "by", "side", "cls", "n", "tokens").mapInArrow(_verify(percent), "a long, b long"), "links")
    for name in ("signed", "lists", "homes", "merged", "placed", "shape"):
        tables.drop(name)
    return links


#: Ids that may be broadcast to filter the documents; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, without near copies: the row with the smallest id of each component stays.

    Rows with a null id stay. Where an id has several rows, rows are compared instead of ids: of those that
    links connect, one with the smallest id stays, so no text goes without a near copy that is kept.
    """
    tables = SharedTables(docs.sparkSession)
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("k"))
    if ids.where("k > 1").isEmpty():
        found = jaccard_components(docs, words, percent, id_col, text_col)
        key, rows = id_col, docs
        gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone"))
    else:
        key, rows = "__row", tables.save(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        named = rows.where(F.col(id_col).isNotNull())
        found = jaccard_components(named, words, percent, "__row", text_col).join(named.select(F.col("__row").alias("doc_id"), F.col(id_col).alias("id")), "doc_id")
        first = found.groupBy("component_id").agg(F.min(F.struct("id", "doc_id"))["doc_id"].alias("kept"))
        gone = found.join(first, "component_id").where("doc_id <> kept").select(F.col("doc_id").alias("__gone"))
    gone = tables.save(gone.distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    kept = rows.join(F.broadcast(gone) if few else gone, F.col(key) == F.col("__gone"), "left_anti")
    return kept.select(*docs.columns)
