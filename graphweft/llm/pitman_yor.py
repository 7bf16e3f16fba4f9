"""Language-model scores by a hierarchical Pitman-Yor model of three words.

Every two words seen before another are a restaurant whose customers are the words that follow them. Its
parent is the restaurant of the nearer word alone, which all contexts that end in this word share: the
first customer at each table is a customer there too. Those restaurants share the root, whose parent is
uniform over the vocabulary and one unknown word. Seatings are sampled by Gibbs sweeps: a sweep takes all
customers of a dish away and seats them one after another, each at a new table with its conditional chance
given the tables of all restaurants after the sweep before. Restaurants are seated at once, as no task may
hold the whole model; beyond 64 customers of a dish they come in groups of a quarter of those seated, with
one binomial draw each at the chance in the group's middle. Scores use the predictive probabilities
averaged over the sweeps after the burn-in; each state's probabilities sum to one.

Plan:
1. One scan hashes the words and writes lots of about a million tokens, with a dictionary each, as files
   in the shared folder. Later steps read a lot's file, so texts and tokens are never shuffled. A longer
   document is cut to parts, which keep the two words before them.
2. Lots send the counts of their distinct words and word pairs, then of triples, to ranges of the hash, as
   packed columns; the totals come back in the order they were sent, without the hashes, and are written to
   a file of the lot, so no answer is shuffled twice. A triple with a
   pair that no other lot has is this lot's alone and not sent. The random numbers of a dish follow from
   its hash, so every lot that has it seats it alike, and one lot, its owner, adds it to the sums. What
   stands once in all has one customer at one table, so its sums are known and not sent, and it is counted
   once for all sweeps.
3. A file of each lot keeps what the sweeps still need: the words and pairs whose sums go round, and the
   triples of this lot that stand more than once. In each sweep two kinds of sums go round: by pair, the
   customers that triples send to their parent and the tables of a context, and by word, the same one level up.
4. Each lot scores its documents; parts of one document are added.
A frequent word or pair is one entry a lot, whatever its count, and ranges of hashes get equal shares. A
task works on one range after the other; where the input would need more ranges than RANGE_TASKS, a task
takes several, sorted by the shuffle. An entry is sent with at most one header, so what is sent stays in
proportion to the distinct entries of the lots.

Defined results: a null or empty text is the end alone; words of other documents than the training ones
are unknown; without training documents every token has the uniform probability of one unknown word;
repeated rows count each time; other columns are ignored. A null doc_id is a training document. Hashes of
pairs and triples have 42 bits; of 10^9 distinct ones about one in 4000 shares its hash with another, and
these two then count as one.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import pack, pack_many, pack_rising, pack_small, unpack, unpack_many, unpack_rising, unpack_small
from .common import SharedTables, byte_slices, input_bytes, reusing, shuffle_partitions, utf8_values
from .shingles import mix, word_hashes

LOT_TOKENS = 1_000_000
RANGE_BYTES = 16 << 20
#: Tasks that the ranges are dealt to at most.
RANGE_TASKS = 20_000
#: Bits of a pair's or triple's hash; the others of 64 hold a place in a lot while it is sorted.
HASH_BITS = 42
_END, _BEGIN = (mix(np.array([x], np.uint64)) for x in (0xE4D0, 0xBE61))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MESSAGE = "range int, lot long, kind int, blob binary"
_REPLY = "lot long, range int, kind int, blob binary"
#: A lot's file of one step (0: its texts); sums over all ranges have a negative lot.
_KEPT = "lot long, step int, path string, sums binary"
#: Keys that the ranges' sums are dealt to.
SUM_KEYS = 64
WORDS, PAIRS, TRIPLES, TOTALS = 1, 2, 3, 9
#: Kinds of a sweep's sums are these and the sweep's number.
BY_PAIR, BY_WORD = 1000, 2000
#: Customers of a dish that are seated one by one; a group after them is this share of those seated.
ONE_BY_ONE, GROUP = 64, 4


def _rows(rows: list[tuple], names: list[str]):
    kinds = {"range": pa.int32(), "lot": pa.int64(), "kind": pa.int32(), "blob": pa.binary()}
    for at in range(0, len(rows), 64):
        columns = zip(*rows[at : at + 64])
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(columns, names)], names)


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in [0, 1) that follow from the key and the number of the draw."""
    x = mix(keys + np.uint64(int(_STEP) * (draw + 1) % (1 << 64)))
    x >>= np.uint64(11)
    # below 2^53, and signed numbers become floats faster
    out = x.view(np.int64).astype(np.float64)
    out *= 2.0**-53
    return out


def _binomial(n: np.ndarray, p: np.ndarray, keys: np.ndarray, draw: int) -> np.ndarray:
    """Binomial numbers: by inversion where the mean is below 8, rounded normal ones beyond."""
    mean = n * p
    out = np.zeros(len(n))
    small = mean < 8
    many, odds = n[small], p[small] / np.maximum(1 - p[small], 1e-300)
    chance = np.exp(many * np.log1p(-np.minimum(p[small], 1 - 1e-16)))
    left = uniform(keys[small], draw) - chance
    drawn = np.zeros(len(left))
    for k in range(1, 60):
        over = (left >= 0) & (drawn < many)
        if not over.any():
            break
        drawn += over
        chance = chance * odds * (many - k + 1) / k
        left = left - np.maximum(chance, 0)
    out[small] = drawn
    big = ~small
    normal = np.sqrt(-2 * np.log1p(-uniform(keys[big], draw))) * np.cos(2 * np.pi * uniform(keys[big], draw + 1))
    out[big] = np.rint(mean[big] + np.sqrt(mean[big] * (1 - p[big])) * normal)
    return np.clip(out, 0, n)


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of dishes with these customers; ``pull`` is (strength + discount * tables) * the parent's probability."""
    out = (customers > 0).astype(np.float64)
    alive = np.flatnonzero(customers > 1)
    # those with most customers first: a step's dishes are the first ones, and no step gathers them
    size = np.minimum(customers[alive], ONE_BY_ONE + 1).astype(np.int64)
    alive = alive[np.argsort((ONE_BY_ONE + 1 - size).astype(np.uint8), kind="stable")]
    left = len(alive) - np.cumsum(np.bincount(size, minlength=ONE_BY_ONE + 2))
    own, keys, tables = pull[alive], keys[alive], out[alive]
    for i in range(1, ONE_BY_ONE):
        n = left[i]
        if not n:
            break
        tables[:n] += uniform(keys[:n], sweep * 1024 + i) < own[:n] / (i - discount * tables[:n] + own[:n])
    many = customers[alive[: left[ONE_BY_ONE]]]
    rest, done, draw = np.arange(len(many)), ONE_BY_ONE, ONE_BY_ONE
    while len(rest):
        pulled = own[rest]
        n = np.minimum(many[rest], done + done // GROUP) - done
        first = pulled / (done - discount * tables[rest] + pulled)
        # the chance in the middle of the group, by when it has about half of its new tables
        chance = pulled / (done + n / 2 - discount * (tables[rest] + n * first / 2) + pulled)
        tables[rest] += _binomial(n, np.clip(chance, 0, 1), keys[rest], sweep * 1024 + draw)
        done, draw = done + done // GROUP, draw + 2
        rest = rest[many[rest] > done]
    out[alive] = tables
    return out


def _group(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, rising; one entry of each; which one each entry is)."""
    n, free = len(hashes), 64 - bits
    low = n.bit_length()
    # hash and place in one number: plain sorting is much faster than sorting with places
    mask = np.uint64((1 << low) - 1)
    whole = hashes << np.uint64(free) & ~mask
    whole |= np.arange(n, dtype=np.uint64)
    whole.sort()
    at = (whole & mask).view(np.int64)
    keys = whole >> np.uint64(free) if low <= free else hashes[at]
    heads = np.ones(n, bool)
    heads[1:] = keys[1:] != keys[:-1]
    if low > free:
        # the place takes bits of the hash: different hashes that are alike in the others may stand mixed
        whole >>= np.uint64(low)
        if (heads[1:] & (whole[1:] == whole[:-1])).any():
            return np.unique(hashes, return_index=True, return_inverse=True)
    place = np.empty(n, np.int64)
    place[at] = np.cumsum(heads) - 1
    return keys[heads], at[heads], place


class Lot:
    """About a million tokens of documents or their parts, the words as codes of the lot's own dictionary.

    Each part is stored with the two words before it, which are no tokens of it.
    """

    def __init__(self, blob: bytes):
        known, own, rows, held, sizes, dictionary, codes = unpack_many(blob, 7)
        self.doc_ids = [int(x) if k else None for x, k in zip(np.frombuffer(own, "<i8"), np.frombuffer(known, np.uint8))]
        self.rows = np.frombuffer(rows, "<i8")
        self.held = np.frombuffer(held, np.uint8).astype(bool)
        self.sizes = unpack(sizes).astype(np.int64)
        self.words = np.frombuffer(dictionary, "<u8").astype(np.uint64)
        every = unpack(codes).astype(np.int64)
        stored = self.sizes + 2
        starts = np.cumsum(stored) - stored
        token = np.ones(len(every), bool)
        token[starts] = token[starts + 1] = False
        self.spots = np.flatnonzero(token)
        self.every, self.seconds = every, starts + 1
        self.codes = every[self.spots]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~self.held, self.sizes)
        self.order = np.argsort(self.words)
        self.end, self.begin = (int(np.flatnonzero(self.words == x)[0]) for x in (_END, _BEGIN))

    @staticmethod
    def dictionary(blob: bytes) -> np.ndarray:
        return np.frombuffer(unpack_many(blob, 7)[5], "<u8").astype(np.uint64)

    @staticmethod
    def write(parts: list[tuple]) -> bytes:
        """``parts``: (doc_id, row, held, hashes with two before them)."""
        flat = np.concatenate([*(p[3] for p in parts), _BEGIN, _END])
        words, _, codes = _group(flat, 64)
        by_count = np.argsort(-np.bincount(codes), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[by_count] = np.arange(len(words))
        return pack_many(
            np.array([p[0] is not None for p in parts], np.uint8).tobytes(), np.array([p[0] or 0 for p in parts], "<i8").tobytes(), np.array([p[1] for p in parts], "<i8").tobytes(),
            np.array([p[2] for p in parts], np.uint8).tobytes(), pack(np.array([len(p[3]) - 2 for p in parts])), words[by_count].astype("<u8").tobytes(), pack(rank[codes[:-2]]),
        )

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.codes[self.train], minlength=len(self.words))

    def group_pairs(self) -> None:
        """Distinct pairs of a word and the one before it, by rising hash; also those before a part."""
        second = np.ones(len(self.every), bool)
        second[self.seconds - 1] = False
        at, hashes = np.flatnonzero(second), self.words[self.every]
        mixed = mix(hashes[:-1] * _STEP + hashes[1:])[second[1:]]
        self.pair_hashes, some, place = _group(mixed >> np.uint64(64 - HASH_BITS), HASH_BITS)
        self.pair_first, self.pair_second, self.pair_mixed = self.every[at[some] - 1], self.every[at[some]], mixed[some]
        self.pair_at = np.empty(len(self.every), np.int64)
        self.pair_at[second] = place
        #: Two beginnings stand before every document and are no pair of tokens.
        self.opening = (self.pair_first == self.begin) & (self.pair_second == self.begin)

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_at[self.spots[self.train]], minlength=len(self.pair_hashes))

    def group_triples(self) -> None:
        """Distinct triples by rising hash: the pair before (``context``) and the pair of the nearer word and the last (``parent``)."""
        context, parent = self.pair_at[self.spots - 1], self.pair_at[self.spots]
        mixed = mix(self.pair_mixed[context] + self.words[self.codes] * _STEP)
        self.triple_hashes, some, self.triple_of = _group(mixed >> np.uint64(64 - HASH_BITS), HASH_BITS)
        self.context, self.parent = context[some], parent[some]
        self.triple_counts = np.bincount(self.triple_of[self.train], minlength=len(some))


class Shares:
    """What the lot knows of its words and pairs after the counts: totals, which pairs it owns, which others have too."""

    def __init__(self, lot: Lot, replies: dict):
        self.seen = _scattered(np.concatenate([unpack_small(b) for b in replies[WORDS]]).astype(np.int64), lot.order)
        spoken = self.seen > 1
        spoken[lot.begin] = True
        #: Words whose sums go round, by rising hash.
        self.words = lot.order[spoken[lot.order]]
        coded = np.concatenate([unpack_small(b) for b in replies[PAIRS]]).astype(np.int64)
        self.total, self.owned = coded >> 2, (coded >> 1 & 1).astype(bool)
        self.shared = (coded & 1).astype(bool) | lot.opening
        #: Pairs whose sums go round.
        self.spoken = lot.opening | (self.total > 1)
        self.goes_on = lot.pair_second != lot.end

    def _filled(self, blobs: list[bytes], where: np.ndarray, known: list[np.ndarray]) -> list[np.ndarray]:
        found = [np.concatenate(x) for x in zip(*([unpack_small(p) for p in unpack_many(b, len(known))] for b in blobs))]
        out = [x.astype(np.float64) for x in known]
        for whole, part in zip(out, found):
            whole[where] = part
        return out

    def sums(self, blobs: list[bytes]) -> list[np.ndarray]:
        """(customers, tables of the context) of all pairs."""
        return self._filled(blobs, self.spoken, [self.total, self.total * self.goes_on])

    def word_sums(self, blobs: list[bytes]) -> list[np.ndarray]:
        """(customers, tables, tables and customers of the restaurant after it) of all words."""
        return self._filled(blobs, self.words, [self.seen == 1] * 4)


class Seats:
    """What the sweeps need of a lot: words and pairs whose sums go round, by rising hash, and its triples that stand more than once.

    After them stand the few other words and pairs that these use, as two that share a hash count as one.
    """

    def __init__(self, lot: bytes, blob: bytes):
        words, first, second, owned, *small, context, parent, hashes, counts = unpack_many(blob, 15)
        dictionary, at = Lot.dictionary(lot), unpack(words).astype(np.int64)
        place = np.empty(len(dictionary), np.int64)
        place[at] = np.arange(len(at))
        self.words = dictionary[at]
        self.pair_first, self.pair_second = (place[unpack(x).astype(np.int64)] for x in (first, second))
        self.pair_hashes = mix(self.words[self.pair_first] * _STEP + self.words[self.pair_second]) >> np.uint64(64 - HASH_BITS)
        # sums of what stands once: by pair as parent and as context, by word as second and as first one
        self.as_parent, self.as_context, self.as_second, self.as_first, seen, total, tables = (unpack_small(x).astype(np.int64) for x in small)
        #: Pairs that this lot adds to the sums, of those that go round.
        self.owned = np.unpackbits(np.frombuffer(owned, np.uint8), count=len(self.as_parent)).astype(bool)
        #: Known sums of the other words and pairs.
        self.other_words, self.other_pairs = [seen] * 4, [total, tables]
        self.context, self.parent = unpack(context).astype(np.int64), unpack(parent).astype(np.int64)
        self.triple_hashes, self.triple_counts = unpack_rising(hashes), unpack_small(counts).astype(np.int64)

    @staticmethod
    def write(lot: Lot, shares: Shares, counts: np.ndarray, owned: np.ndarray) -> bytes:
        once, more, alone = owned & (counts == 1), owned & (counts > 1), shares.owned & ~shares.spoken
        context, parent = lot.context[more], lot.parent[more]
        spoken = np.flatnonzero(shares.spoken)
        other_pairs = np.unique(np.concatenate([x[~shares.spoken[x]] for x in (context, parent)]))
        pairs = np.concatenate([spoken, other_pairs])
        known = np.zeros(len(lot.words), bool)
        known[shares.words] = True
        first, second = lot.pair_first[pairs], lot.pair_second[pairs]
        other_words = np.unique(np.concatenate([x[~known[x]] for x in (first, second)]))
        place = np.empty(len(lot.pair_hashes), np.int64)
        place[pairs] = np.arange(len(pairs))
        small = [np.bincount(x[once], minlength=len(place))[spoken] for x in (lot.parent, lot.context)]
        small += [np.bincount(x[alone], minlength=len(known))[shares.words] for x in (lot.pair_second, lot.pair_first)]
        small += [shares.seen[other_words] == 1, shares.total[other_pairs], (shares.total * shares.goes_on)[other_pairs]]
        return pack_many(
            pack(np.concatenate([shares.words, other_words])), pack(first), pack(second), np.packbits(shares.owned[spoken]).tobytes(), *map(pack_small, small),
            pack(place[context]), pack(place[parent]), pack_rising(lot.triple_hashes[more]), pack_small(counts[more]),
        )

    def word_sums(self, blobs: list[bytes]) -> list[np.ndarray]:
        return self._all(blobs, self.other_words)

    def sums(self, blobs: list[bytes]) -> list[np.ndarray]:
        return self._all(blobs, self.other_pairs)

    @staticmethod
    def _all(blobs: list[bytes], others: list[np.ndarray]) -> list[np.ndarray]:
        parts = [[unpack_small(p) for p in unpack_many(b, len(others))] for b in blobs]
        return [np.concatenate([*(p[i] for p in parts), x]).astype(np.float64) for i, x in enumerate(others)]


def _scattered(rising: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Values in the order of rising hashes, put back to their places."""
    out = np.empty(len(rising), rising.dtype)
    out[order] = rising
    return out


def _cuts(hashes: np.ndarray, bits: int, ranges: int):
    target = (hashes >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)
    bounds = np.searchsorted(target, np.arange(ranges + 1))
    return [(k, slice(bounds[k], bounds[k + 1])) for k in np.flatnonzero(np.diff(bounds)).tolist()]


def _by_range(batches):
    """(range, its messages) of a task's rows, one range after the other."""
    at, messages = None, []
    for batch in batches:
        for where, lot, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("range", "lot", "kind", "blob"))):
            if where != at:
                if messages:
                    yield at, messages
                at, messages = where, []
            messages.append((lot, kind, blob))
    if messages:
        yield at, messages


class State:
    """What is known after a sweep of the words and pairs of a lot, or of those whose sums go round."""

    def __init__(self, chance, context_tables, context_customers, customers, tables):
        #: By word: root probability, and tables and customers of the restaurant after it.
        self.chance, self.context_tables, self.context_customers = chance, context_tables, context_customers
        #: By pair: customers of the word in the restaurant of the one before it, and tables of the restaurant after both.
        self.customers, self.tables = customers, tables


class Model:
    """Parameters and the steps that run on executors. Discounts and strengths: of the root, of one word, of two."""

    def __init__(self, folder: str, ranges: int, discounts: tuple[float, float, float], strengths: tuple[float, float, float]):
        self.folder, self.ranges = folder, ranges
        self.discounts, self.strengths = discounts, strengths

    # lots -------------------------------------------------------------

    def write_lots(self, batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder)
        files.create_dir(root, recursive=True)
        task, number, parts, n, row = TaskContext.get().partitionId(), 0, [], 0, 0
        most = LOT_TOKENS // 2

        def flush():
            nonlocal number, parts, n
            # the manifest names the file that counts, should a task run twice
            path = f"{root}/lot-{task}-{number}-{uuid.uuid4().hex}"
            with files.open_output_stream(path) as out:
                out.write(Lot.write(parts))
            kept = self._kept((task << 24) | number, 0, path, None)
            number, parts, n = number + 1, [], 0
            return kept.to_batches()[0]

        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                flat, bounds = word_hashes(utf8_values(batch.column("text")))
                for i, (doc_id, held) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist())):
                    hashes = np.concatenate((_BEGIN, _BEGIN, flat[bounds[i] : bounds[i + 1]], _END))
                    for at in range(0, len(hashes) - 2, most):
                        part = hashes[at : at + most + 2]
                        parts.append((doc_id, (task << 36) + row, held, part))
                        n += len(part) - 2
                        if n >= LOT_TOKENS:
                            yield flush()
                    row += 1
        if parts:
            yield flush()

    def _read(self, path: str) -> bytes:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.folder)
        with files.open_input_stream(path) as stream:
            return stream.read()

    @staticmethod
    def _kept(lot: int, step: int, path: str | None, sums: bytes | None) -> pa.Table:
        return pa.table([pa.array([lot], pa.int64()), pa.array([step], pa.int32()), pa.array([path], pa.string()), pa.array([sums], pa.binary())], names=["lot", "step", "path", "sums"])

    def _written(self, lot: int, step: int, whole: bytes) -> str:
        """The path of a new packed file; a manifest names the file that counts."""
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder)
        path = f"{root}/step-{step}-{lot}-{uuid.uuid4().hex}"
        with files.open_output_stream(path) as out, pa.CompressedOutputStream(out, "zstd") as packed:
            packed.write(whole)
        return path

    def keep(self, step: int):
        """Writes the answers to one lot as a file; adds the sums of the ranges."""

        def run(key: tuple, table: pa.Table) -> pa.Table:
            lot = key[0].as_py()
            rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "range", "blob"))), key=lambda r: r[:2])
            if lot < 0:
                return self._kept(lot, step, None, pack(sum(unpack(r[2]).astype(np.int64) for r in rows)))
            whole = pack_many(pack(np.array([r[0] for r in rows])), pack(np.array([len(r[2]) for r in rows])), b"".join(r[2] for r in rows))
            return self._kept(lot, step, self._written(lot, step, whole), None)

        return run

    def _unpacked(self, path: str) -> bytes:
        return pa.CompressedInputStream(pa.BufferReader(self._read(path)), "zstd").read()

    def _replies(self, paths: list[str]) -> dict[int, list[bytes]]:
        out: dict[int, list] = {}
        for path in paths:
            kinds, sizes, flat = unpack_many(self._unpacked(path), 3)
            at = 0
            for kind, size in zip(unpack(kinds).tolist(), unpack(sizes).tolist()):
                out.setdefault(kind, []).append(flat[at : at + size])
                at += size
        return out

    @staticmethod
    def on_lots(run):
        """A function for mapInArrow: ``run(lot, its files)`` gives record batches."""

        def task(batches):
            for batch in batches:
                for lot, files in zip(batch.column("lot").to_pylist(), batch.column("files").to_pylist()):
                    yield from run(lot, [f["path"] for f in files])

        return reusing(task)

    def _send(self, key: int, kind: int, hashes: np.ndarray, bits: int, *values: np.ndarray) -> list[tuple]:
        return [(k, key, kind, pack_many(pack_rising(hashes[c]), *(pack_small(v[c]) for v in values))) for k, c in _cuts(hashes, bits, self.ranges)]

    def send_counts(self, key: int, paths: list[str]):
        lot = Lot(self._read(paths[0]))
        lot.group_pairs()
        o = lot.order
        rows = self._send(key, WORDS, lot.words[o], 64, lot.word_counts()[o])
        rows += self._send(key, PAIRS, lot.pair_hashes, HASH_BITS, lot.pair_counts())
        return self._sent(rows)

    def send_triples(self, key: int, paths: list[str]):
        lot, shares, _ = self._opened(paths)
        out = self._sent_triples(lot, shares)
        return self._sent(self._send(key, TRIPLES, lot.triple_hashes[out], HASH_BITS, lot.triple_counts[out]))

    @staticmethod
    def _sent_triples(lot: Lot, shares: Shares) -> np.ndarray:
        return shares.shared[lot.context] & shares.shared[lot.parent]

    @staticmethod
    def _sent(rows: list[tuple]):
        return _rows(rows, ["range", "lot", "kind", "blob"])

    def write_seats(self, step: int):
        """What the sweeps need of one lot, as a file."""

        def run(key: int, paths: list[str]):
            lot, shares, replies = self._opened(paths)
            yield from self._kept(key, step, self._written(key, step, Seats.write(lot, shares, *self._triple_totals(lot, shares, replies))), None).to_batches()

        return run

    def _opened(self, paths: list[str]) -> tuple[Lot, Shares, dict]:
        lot, replies = Lot(self._read(paths[0])), self._replies(paths[1:])
        lot.group_pairs()
        lot.group_triples()
        return lot, Shares(lot, replies), replies

    def _seats(self, paths: list[str]) -> tuple[Seats, dict]:
        return Seats(self._read(paths[0]), self._unpacked(paths[1])), self._replies(paths[2:])

    def _triple_totals(self, lot: Lot, shares: Shares, replies: dict) -> tuple[np.ndarray, np.ndarray]:
        """(total, whether this lot owns it) of the triples."""
        total, owned, out = lot.triple_counts.copy(), np.ones(len(lot.context), bool), self._sent_triples(lot, shares)
        if out.any():
            coded = np.concatenate([unpack_small(b) for b in replies[TRIPLES]]).astype(np.int64)
            total[out], owned[out] = coded >> 2, (coded >> 1 & 1).astype(bool)
        return total, owned

    def _state(self, of: Shares | Seats, replies: dict, sweep: int, sums: list[dict]) -> State:
        customers, tables, after, served = of.word_sums(replies[BY_WORD + sweep])
        whole = self.strengths[0] + sums[sweep]["customers"]
        new = (self.strengths[0] + self.discounts[0] * sums[sweep]["tables"]) / whole / (sums[sweep]["vocabulary"] + 1)
        chance = np.maximum((customers - self.discounts[0] * tables) / whole + new, new)
        return State(chance, after, served, *of.sums(replies[BY_PAIR + sweep]))

    def _pair_tables(self, lot: Lot | Seats, customers: np.ndarray, before: State | None, sweep: int, which=slice(None)) -> np.ndarray:
        """Tables of the last word of each pair of ``which`` in the restaurant of the first; ``customers`` are theirs."""
        tables = (customers > 0).astype(np.float64)
        if before is not None:
            alive = np.flatnonzero(customers > 1)
            first, second, hashes = (x[which][alive] for x in (lot.pair_first, lot.pair_second, lot.pair_hashes))
            pull = (self.strengths[1] + self.discounts[1] * before.context_tables[first]) * before.chance[second]
            tables[alive] = seat(customers[alive], pull, self.discounts[1], hashes, sweep)
        return tables

    def _pair_chance(self, lot: Lot | Seats, state: State, before: State | None, sweep: int, which=slice(None)) -> np.ndarray:
        """Probability of the last word of each pair of ``which`` after the first."""
        customers, first = state.customers[which], lot.pair_first[which]
        seated = self._pair_tables(lot, customers, before, sweep, which)
        root = state.chance[lot.pair_second[which]]
        own = np.maximum(customers - self.discounts[1] * seated, 0) + (self.strengths[1] + self.discounts[1] * state.context_tables)[first] * root
        return np.where((state.context_customers > 0)[first], own / (self.strengths[1] + state.context_customers)[first], root)

    def _triple_tables(self, lot: Lot | Seats, counts: np.ndarray, state: State | None, before: State | None, sweep: int) -> np.ndarray:
        """Tables of each triple; ``state``: after the sweep before, ``before``: one earlier."""
        tables = (counts > 0).astype(np.float64)
        if state is not None:
            alive = np.flatnonzero(counts > 1)
            # chances of the pairs alone that have such triples
            needed = np.zeros(len(lot.pair_first), bool)
            needed[lot.parent[alive]] = True
            pairs = np.flatnonzero(needed)
            chance = np.empty(len(needed))
            chance[pairs] = self._pair_chance(lot, state, before, sweep - 1, pairs)
            pull = (self.strengths[2] + self.discounts[2] * state.tables[lot.context[alive]]) * chance[lot.parent[alive]]
            tables[alive] = seat(counts[alive], pull, self.discounts[2], lot.triple_hashes[alive], sweep)
        return tables

    def send_pair_sums(self, sweep: int, sums: list[dict]):
        """First half of a sweep on one lot: seats its triples and sends the sums by pair of those it owns."""

        def run(key: int, paths: list[str]):
            seats, replies = self._seats(paths)
            before = self._state(seats, replies, sweep - 2, sums) if sweep > 1 else None
            state = self._state(seats, replies, sweep - 1, sums) if sweep else None
            tables = self._triple_tables(seats, seats.triple_counts, state, before, sweep)
            n, every = len(seats.as_parent), len(seats.pair_first)
            add = lambda pairs, once: np.bincount(pairs, weights=tables, minlength=every)[:n].astype(np.int64) + once
            return self._sent(self._send(key, BY_PAIR + sweep, seats.pair_hashes[:n], HASH_BITS, add(seats.parent, seats.as_parent), add(seats.context, seats.as_context)))

        return run

    def send_word_sums(self, sweep: int, sums: list[dict]):
        """Second half: seats the pairs and sends the sums by word of those it owns."""

        def run(key: int, paths: list[str]):
            seats, replies = self._seats(paths)
            n, every = slice(len(seats.as_parent)), len(seats.words)
            customers = seats.sums(replies[BY_PAIR + sweep])[0][n] * seats.owned
            before = self._state(seats, replies, sweep - 1, sums) if sweep else None
            tables = self._pair_tables(seats, customers, before, sweep, n)
            add = lambda words, x, once: np.bincount(words[n], weights=x, minlength=every)[: len(once)].astype(np.int64) + once
            values = add(seats.pair_second, tables, seats.as_second), add(seats.pair_first, tables, seats.as_first), add(seats.pair_first, customers, seats.as_first)
            return self._sent(self._send(key, BY_WORD + sweep, seats.words[: len(seats.as_first)], 64, *values))

        return run

    def score(self, sums: list[dict], first: int):
        """(row, doc_id, held_out, n_tokens, n_known, base_score, score) of one lot's documents or parts."""

        def run(key: int, paths: list[str]):
            lot, shares, replies = self._opened(paths)
            seen = shares.seen
            # the context of two beginnings has as many customers as there are ends
            served = np.where(lot.opening, seen[lot.end], shares.total)
            some, whole = (served > 0)[lot.context], (self.strengths[2] + served)[lot.context]
            counts, _ = self._triple_totals(lot, shares, replies)
            mean, before, state = np.zeros(len(counts)), None, None
            for sweep in range(len(sums)):
                at = self._state(shares, replies, sweep, sums)
                if sweep >= first:
                    seated = self._triple_tables(lot, counts, state, before, sweep)
                    lower = self._pair_chance(lot, at, state, sweep)[lot.parent]
                    own = np.maximum(counts - self.discounts[2] * seated, 0) + (self.strengths[2] + self.discounts[2] * at.tables)[lot.context] * lower
                    mean += np.where(some, own / whole, lower)
                before, state = state, at
            logs = np.log10(mean / (len(sums) - first))[lot.triple_of]
            total, vocabulary = sums[0]["tokens"], sums[0]["vocabulary"]
            base = np.log10((seen + 0.1) / (total + 0.1 * (vocabulary + 1)))[lot.codes]
            add = lambda x: np.add.reduceat(x, lot.starts)
            return pa.table(
                [
                    pa.array(lot.rows, pa.int64()), pa.array(lot.doc_ids, pa.int64()), pa.array(lot.held), pa.array(lot.sizes),
                    pa.array(add((seen > 0).astype(np.int64)[lot.codes])), pa.array(add(base)), pa.array(add(logs)),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            ).to_batches()

        return run

    # ranges of hashes ---------------------------------------------------

    def total_ranges(self, batches):
        """Totals of the words, pairs and triples of each range, back to each lot in its order; and the sums over the range."""
        for where, rows in _by_range(batches):
            for kind in (WORDS, PAIRS, TRIPLES):
                messages = sorted((lot, *unpack_many(blob, 2)) for lot, k, blob in rows if k == kind)
                if not messages:
                    continue
                keys, counts = [unpack_rising(m[1]) for m in messages], [unpack_small(m[2]).astype(np.int64) for m in messages]
                number = np.concatenate(counts)
                distinct, _, place = _group(np.concatenate(keys), 64 if kind == WORDS else HASH_BITS)
                total = np.bincount(place, weights=number, minlength=len(distinct)).astype(np.int64)
                reply = total[place]
                if kind == WORDS:
                    sums = pack(np.array([int(total.sum()), int((total > 0).sum()), int((total == 1).sum())]))
                    yield from _rows([(-1 - where % SUM_KEYS, where, TOTALS, sums)], ["lot", "range", "kind", "blob"])
                else:
                    trained = np.flatnonzero(number > 0)
                    # the first one that has it in training owns it: the last to be written here
                    owner = np.full(len(distinct), -1)
                    owner[place[trained[::-1]]] = trained[::-1]
                    reply = 4 * reply
                    reply[owner[owner >= 0]] += 2
                    reply += (np.bincount(place) > 1)[place]
                cut = np.cumsum([0, *map(len, keys)])
                yield from _rows([(m[0], where, kind, pack_small(reply[cut[i] : cut[i + 1]])) for i, m in enumerate(messages)], ["lot", "range", "kind", "blob"])

    @staticmethod
    def _summed(rows: list, n: int, bits: int):
        """(messages, where each one's entries stand, distinct hashes, sums of the ``n`` values by distinct hash)."""
        messages = [(lot, *unpack_many(blob, n + 1)) for lot, _, blob in rows]
        keys = [unpack_rising(m[1]) for m in messages]
        distinct, _, place = _group(np.concatenate(keys), bits)
        add = lambda k: np.bincount(place, weights=np.concatenate([unpack_small(m[k]) for m in messages]).astype(np.float64), minlength=len(distinct)).astype(np.int64)
        cut = np.cumsum([0, *map(len, keys)])
        return [(m[0], place[cut[i] : cut[i + 1]]) for i, m in enumerate(messages)], distinct, [add(2 + k) for k in range(n)]

    def add_pairs(self, sweep: int):
        """The first half's sums, back to each lot that has the pair."""

        def run(batches):
            for where, rows in _by_range(batches):
                lots, _, values = self._summed(rows, 2, HASH_BITS)
                yield from _rows([(lot, where, BY_PAIR + sweep, pack_many(*(pack_small(v[at]) for v in values))) for lot, at in lots], ["lot", "range", "kind", "blob"])

        return run

    def seat_root(self, sweep: int, vocabulary: int, root_tables: float):
        """The second half's sums, and the root's part of the sweep on each range of words."""

        def run(batches):
            for where, rows in _by_range(batches):
                lots, distinct, (customers, after, served) = self._summed(rows, 3, 64)
                pull = np.full(len(distinct), (self.strengths[0] + self.discounts[0] * root_tables) / (vocabulary + 1))
                tables = seat(customers, pull, self.discounts[0], distinct, sweep).astype(np.int64)
                yield from _rows([(-1 - where % SUM_KEYS, where, TOTALS, pack(np.array([int(customers.sum()), int(tables.sum())])))], ["lot", "range", "kind", "blob"])
                values = (customers, tables, after, served)
                yield from _rows([(lot, where, BY_WORD + sweep, pack_many(*(pack_small(v[at]) for v in values))) for lot, at in lots], ["lot", "range", "kind", "blob"])

        return run


def _sums(kept: DataFrame, n: int) -> tuple[int, ...]:
    """``n`` numbers of each of SUM_KEYS keys reach the driver."""
    rows = kept.where("lot < 0").select("sums").collect()
    parts = np.array([unpack(bytes(r["sums"])).astype(np.int64) for r in rows], np.int64).reshape(-1, n)
    return tuple(int(x) for x in parts.sum(axis=0))


def score_documents(
    docs: DataFrame, held_out, sweeps: int = 2, burn_in: int = 1, discounts: tuple[float, float, float] = (0.6, 0.75, 0.85), strengths: tuple[float, float, float] = (10.0, 2.0, 1.0), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    Learns from the rows for which the column ``held_out`` is not true. ``sweeps`` Gibbs sweeps follow the
    first seating, one table for each dish; the states from number ``burn_in`` on are averaged. Discounts
    and strengths: of the root, of restaurants after one word, of those after two.
    """
    spark = docs.sparkSession
    tables = SharedTables(spark)
    ranges = int(max(shuffle_partitions(spark), input_bytes(docs, text_col) // RANGE_BYTES))
    tasks = min(ranges, RANGE_TASKS)
    model = Model(f"{tables.root}/lots", ranges, discounts, strengths)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    kept = [tables.save(rows.mapInArrow(reusing(model.write_lots), _KEPT), "step-0")]
    lots = max(1, min(RANGE_TASKS, kept[0].count()))

    def with_files(*steps: int) -> DataFrame:
        every = kept[0]
        for step in steps:
            every = every.union(kept[step])
        files = every.where("lot >= 0").groupBy("lot").agg(F.array_sort(F.collect_list(F.struct("step", "path"))).alias("files"))
        # dealt in turn, a lot to each task
        return files.repartition(lots)

    def ask(run, reduce, *steps: int) -> int:
        """The number of the step that ``run`` and ``reduce`` make of the files of ``steps``."""
        step = len(kept)
        sent = with_files(*steps).mapInArrow(model.on_lots(run), _MESSAGE).repartitionById(tasks, F.floor(F.col("range") * tasks / ranges).cast("int"))
        if tasks < ranges:
            sent = sent.sortWithinPartitions("range")
        answers = sent.mapInArrow(reusing(reduce), _REPLY).groupBy("lot")
        kept.append(tables.save(answers.applyInArrow(model.keep(step), _KEPT), f"step-{step}"))
        return step

    counts = ask(model.send_counts, model.total_ranges)
    tokens, vocabulary, once = _sums(kept[counts], 3)
    triples = ask(model.send_triples, model.total_ranges, counts)
    seats = len(kept)
    kept.append(tables.save(with_files(counts, triples).mapInArrow(model.on_lots(model.write_seats(seats)), _KEPT), f"step-{seats}"))
    by_pair: list[int] = []
    by_word: list[int] = []
    sums: list[dict] = []
    for sweep in range(sweeps + 1):
        last = slice(max(0, sweep - 2), sweep)
        by_pair.append(ask(model.send_pair_sums(sweep, sums), model.add_pairs(sweep), seats, *by_pair[last], *by_word[last]))
        last = slice(max(0, sweep - 1), sweep)
        by_word.append(ask(model.send_word_sums(sweep, sums), model.seat_root(sweep, vocabulary, sums[-1]["tables"] if sums else 0.0), seats, *by_pair[max(0, sweep - 1) :], *by_word[last]))
        customers, root = _sums(kept[by_word[-1]], 2)
        sums.append({"tokens": tokens, "vocabulary": vocabulary, "customers": customers + once, "tables": root + once})
    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = with_files(counts, triples, *by_pair, *by_word).mapInArrow(model.on_lots(model.score(sums, burn_in)), kinds)
    # parts of one document
    whole = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))).drop("row")
    return whole.withColumn("train_tokens", F.lit(tokens).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
