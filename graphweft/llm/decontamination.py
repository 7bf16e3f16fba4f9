"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. Each text streams through it, the state being the
longest run of an item that ends at the current word; a length of ``window`` or more there means that
the last ``window`` words stand in an item, and the state's ancestor of that length knows in which.
An item of fewer words counts where it stands whole. Words that no item has end every match, so only
stretches of item words are streamed.

Plan: no shuffle; one scan of the documents with the automata of the items broadcast. An automaton takes
200,000 item words at most (a longer item is cut to parts that overlap, which have the same windows) and a
scan four of them, so what the driver builds and a worker holds is bounded. A benchmark of more than
800,000 words takes several scans of one keyed copy of the documents, whose spans meet in one shuffle.

Defined results: a null or empty text has no words; null item texts have no windows; a null item_id
marks words but is never listed; repeated items count once; every document row gives one row.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, byte_slices, lean, utf8_values

#: Words of items in one automaton, and automata of one scan; both bound what is broadcast.
AUTOMATON_WORDS = 200_000
SCAN_AUTOMATA = 4
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class ItemAutomaton:
    """Suffix automaton over the word ids of several items, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        #: While it is built: transitions by state.
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            if words:
                coded.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.width = len(self.vocabulary) + 1
        #: state * width + word -> state; one table takes a quarter of the memory of one per state.
        self.go = {state * self.width + c: to for state, after in enumerate(self.next) for c, to in after.items()}
        self.next = []
        self.sizes = sorted({min(window, len(ids)) for _, ids in coded})
        #: By window size: state -> ids of the items with that window.
        self.windows: dict[int, dict[int, set]] = {n: {} for n in self.sizes}
        for item, ids in coded:
            size = min(window, len(ids))
            for state, length in self._stream(ids):
                if length >= size:
                    self.windows[size].setdefault(self._at(state, size), set()).add(item)
        #: Sizes of the items shorter than the window, which stand whole where they are found.
        self.short = [n for n in self.sizes if n < window]
        self._shortest = self.sizes[0] if self.sizes else 0
        self._stretch = re.compile(b"\x01{%d,}" % max(1, self._shortest))

    def _new(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, c: int, target: int) -> int:
        """The state of the run of length[state] + 1 words that ``target`` holds among longer ones."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(c) == target:
            self.next[state][c] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new, state = self._new(self.length[last] + 1, 0, {}), last
        while state >= 0 and c not in self.next[state]:
            self.next[state][c] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, c, self.next[state][c])
        return new

    def _stream(self, ids):
        """(state, matching length) after each word."""
        state = length = 0
        go, width, link, lengths = self.go.get, self.width, self.link, self.length
        for c in ids:
            after = go(state * width + c)
            while after is None and state:
                state = link[state]
                length = lengths[state]
                after = go(state * width + c)
            if after is not None:
                state = after
                length += 1
            yield state, length

    def _at(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def search(self, words: list[bytes], sizes: list[int] | None = None) -> tuple[list[tuple[int, int]], set]:
        """Stretches [start, end) of words inside windows, rising and apart, and the items with windows here; of windows of some ``sizes`` only where given."""
        spans: list[list[int]] = []
        found: set = set()
        sizes = self.sizes if sizes is None else sizes
        if not sizes:
            return [], found
        known = bytes(map(self.vocabulary.__contains__, words))
        for stretch in self._stretch.finditer(known):
            start = stretch.start()
            ids = [self.vocabulary[w] for w in words[start : stretch.end()]]
            for at, (state, length) in enumerate(self._stream(ids), start + 1):
                for size in sizes:
                    if size > length:
                        break
                    items = self.windows[size].get(self._at(state, size))
                    if items:
                        found |= items
                        first = at - size
                        while spans and spans[-1][0] >= first:
                            spans.pop()
                        if spans and spans[-1][1] >= first:
                            spans[-1][1] = at
                        else:
                            spans.append([first, at])
        return [(a, b) for a, b in spans], found


def build_automata(benchmark: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text"):
    """Automata of bounded size, one at a time; the items come to the driver one at a time."""
    lot, held = [], 0
    items = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item, text in items.toLocalIterator():
        words = words_of(text.encode())
        size = max(AUTOMATON_WORDS, 2 * window)
        for at in range(0, max(1, len(words) - window + 1), size - window + 1):
            part = words[at : at + size]
            if lot and held + len(part) > AUTOMATON_WORDS:
                yield ItemAutomaton(lot, window)
                lot, held = [], 0
            lot.append((item, part))
            held += len(part)
    yield ItemAutomaton(lot, window)


def _scans(benchmark: DataFrame, window: int):
    """Lists of the automata of one scan each."""
    lot: list[ItemAutomaton] = []
    for automaton in build_automata(benchmark, window):
        if len(lot) == SCAN_AUTOMATA:
            yield lot
            lot = []
        lot.append(automaton)
    yield lot


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = "array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _structs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def search_all(automata: list[ItemAutomaton], words: list[bytes]) -> tuple[list, list, set]:
    """(spans, spans of whole items shorter than the window, items) over several automata."""
    found = [a.search(words) for a in automata]
    spans = join_spans([s for x, _ in found for s in x])
    whole = join_spans([s for a in automata if a.short for s in a.search(words, a.short)[0]]) if spans else []
    return spans, whole, set().union(*(x for _, x in found))


def _scan(rows: DataFrame, automata: list[ItemAutomaton], key: str) -> DataFrame:
    """(key, n_words, spans, whole, items) of rows with a key and a ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(automata)

    @lean
    def run(batches):
        for batch in (x for whole in batches for x in byte_slices(whole, "text", 2 << 20)):
            sizes, spans, cut, items = [], [], [], []
            for text in utf8_values(batch.column("text")):
                words = words_of(text)
                where, whole, found = search_all(shared.value, words)
                sizes.append(len(words))
                spans.append(_structs(where))
                cut.append(_structs(whole))
                items.append(sorted(x for x in found if x is not None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(sizes, pa.int64()), pa.array(spans, _SPAN), pa.array(cut, _SPAN), pa.array(items, pa.list_(pa.string()))],
                [key, "n_words", "spans", "whole", "items"],
            )

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_words long, spans {_SPANS}, whole {_SPANS}, items array<string>")


def _merged(parts: list[DataFrame]) -> DataFrame:
    """(row, n_words, spans, whole, items) of the scans' results together."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    lists = every.groupBy("__row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("whole")).alias("whole"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    @lean
    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            for k in (2, 3):
                columns[k] = pa.array([_structs(join_spans([(s["start"], s["end"]) for s in x])) for x in columns[k].to_pylist()], _SPAN)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return lists.mapInArrow(run, lists.schema)


def _search(docs: DataFrame, scans, first: list, second: list, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(documents with a ``__row``, results by it) where the benchmark needs several scans."""
    tables = SharedTables(docs.sparkSession)
    keyed = tables.save(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    rows = keyed.select("__row", F.col(text_col).alias("text"))
    parts = []
    for automata in (x for lot in ([first, second], scans) for x in lot):
        parts.append(tables.save(_scan(rows, automata, "__row"), f"scan-{len(parts)}"))
    return keyed, _merged(parts)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items) of every row: stretches [start, end) of words in windows, and the ids of the items, sorted as strings."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scans = _scans(benchmark, window)
    first, second = next(scans), next(scans, None)
    if second is None:
        return _scan(rows, first, "doc_id").drop("whole")
    keyed, found = _search(rows, scans, first, second, "text")
    return keyed.select("__row", "doc_id").join(found, "__row").select("doc_id", "n_words", "spans", "items")


def contamination_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each stretch."""
    words = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : words[first][0]])
        at = words[end - 1][1]
    return b"".join((*out, text[at:]))


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_span: int = 9, max_coverage: float = 0.8, text_col: str = "text", length_col: str | None = "n_chars"
) -> DataFrame:
    """The documents, all columns kept, without stretches of more than ``max_span`` words in windows and without whole items shorter than the window.

    A document of which words in windows, of stretches of any length, make up more than ``max_coverage``
    goes whole. ``length_col``, where there is one, follows the cut text; untouched rows stay as they are.
    """
    scans = _scans(benchmark, window)
    first, second = next(scans), next(scans, None)
    names, schema = list(docs.columns), docs.schema
    text_at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None

    def cut(batch: pa.RecordBatch, found) -> pa.RecordBatch:
        """``found``: (words, spans, spans of whole short items) of each row."""
        keep, changed = [], {}
        texts = batch.column(text_at)
        for i, (n_words, spans, whole) in enumerate(found):
            keep.append(not spans or sum(b - a for a, b in spans) <= max_coverage * n_words)
            if spans and keep[-1] and (cuts := join_spans([s for s in spans if s[1] - s[0] > max_span] + whole)):
                changed[i] = cut_spans(texts[i].as_py().encode(), cuts).decode("utf-8", "replace")
        columns = list(batch.columns[: len(names)])
        if changed:
            columns[text_at] = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], texts.type)
            if length_at is not None:
                sizes = batch.column(length_at)
                columns[length_at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(sizes.to_pylist())], sizes.type)
        out = pa.RecordBatch.from_arrays(columns, names)
        return out if all(keep) else out.filter(pa.array(keep))

    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        @lean
        def run(batches):
            for batch in (x for whole in batches for x in byte_slices(whole, text_col, 2 << 20)):
                found = []
                for text in utf8_values(batch.column(text_at)):
                    words = words_of(text)
                    found.append((len(words), *search_all(shared.value, words)[:2]))
                yield cut(batch, found)

        return docs.mapInArrow(run, schema)

    @lean
    def run_found(batches):
        pairs = lambda x: [(s["start"], s["end"]) for s in x]
        for batch in (x for whole in batches for x in byte_slices(whole, text_col, 2 << 20)):
            n_words, spans, whole = (batch.column(len(names) + k).to_pylist() for k in range(3))
            yield cut(batch, [(n, pairs(x), pairs(y)) for n, x, y in zip(n_words, spans, whole)])

    keyed, found = _search(docs, scans, first, second, text_col)
    both = keyed.join(found, "__row").select(*names, F.col("n_words").alias("__n"), F.col("spans").alias("__spans"), F.col("whole").alias("__whole"))
    return both.mapInArrow(run_found, schema)
