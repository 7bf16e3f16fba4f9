"""Token ids and token counts of whole texts at the cost of their distinct words.

Texts stay one Arrow buffer: numpy finds where words and pieces begin, Arrow's dictionary encoding finds
the distinct ones, and the library's own model encodes each distinct piece once per task cache.
`tests/llm/test_operators.py` holds both coders against the library.
"""

from __future__ import annotations

import json
import os
import re
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

from .common import utf8_buffer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries a cache may hold; it starts anew beyond that, so memory is bounded and results are the same.
CACHE_ENTRIES = 300_000
#: Bytes of text that are cut at a time; a longer text is cut where its pieces part.
WINDOW = 4 << 20
_LETTER, _NUMBER, _OTHER, _SPACE, _UNKNOWN = 1, 2, 3, 4, 0
_ODD_CACHE = 50_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others from U+0100 upwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    return table | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def _ascii_classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
    table[0x30:0x3A] = _NUMBER
    table[[0x20, *range(0x09, 0x0E)]] = _SPACE
    table[0x80:] = _UNKNOWN
    return table


_ASCII = _ascii_classes()
#: The word coder leaves control characters to the library.
_WORD_CLASSES = np.where((np.arange(256) < 0x21) & (_ASCII != _SPACE) | (np.arange(256) == 0x7F), _UNKNOWN, _ASCII).astype(np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _parts(data: np.ndarray, bounds: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes between neighbouring bounds as an Arrow array, without a copy."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _distinct(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    coded = _parts(data, bounds).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class _Model:
    """The library's BPE model behind a plain white-space split, for pieces cut and normalised already."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.alphabet = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        suffix = described["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(described["model"]["vocab"].values()) + 1, bool) if suffix else None
        if suffix:
            self.ends[[i for t, i in described["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.special = [t["content"].encode() for t in described.get("added_tokens") or []]

    def _shown(self, piece: bytes) -> str:
        text = piece.decode("latin-1")
        return text if text.isascii() and text.isprintable() and " " not in text else text.translate(self.alphabet)

    def encode(self, pieces: list[bytes], per_call: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, where each piece's ids end)."""
        mark = self.alphabet[0]
        shown = [self._shown(p) for p in pieces]
        joint = " " if self.ends is not None else f" {mark} "
        texts = [joint.join(shown[i : i + per_call]) for i in range(0, len(shown), per_call)]
        ids = [np.zeros(0, np.uint32)]
        for start in range(0, len(texts), 64):
            for e in self.bare.encode_batch_fast(texts[start : start + 64]):
                ids.append(np.array(e.ids, dtype=np.uint32))
                if self.ends is None:
                    ids.append(np.array(self.bare.encode(mark).ids, np.uint32))
        flat = np.concatenate(ids)
        if self.ends is not None:
            ends = np.flatnonzero(self.ends[flat]) + 1
        else:
            # the mark is the byte 0, which pieces may hold only if they are encoded alone
            parted = flat == np.uint32(self.bare.encode(mark).ids[0])
            flat, ends = flat[~parted], np.flatnonzero(parted) - np.arange(int(parted.sum()))
        if len(ends) != len(pieces):
            raise ValueError("the model does not show where a piece ends")
        return flat, ends


class WordCoder:
    """Ids of a tokenizer that lower-cases, drops white space and marks the ends of pieces.

    A text is cut at ASCII white space, distinct words are cut to pieces, distinct pieces are encoded once.
    Words with an apostrophe, a special string or letters beyond Latin-1 go to the library one by one.
    """

    def __init__(self, path: str):
        self.model = _Model(path)
        if self.model.ends is None:
            raise ValueError("this coder is for files with a suffix at word ends")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.odd: dict[bytes, np.ndarray] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each distinct piece; blanks have number 0 and no ids."""
        if len(self.known) > CACHE_ENTRIES:
            self.forget()
        if not len(self.sizes):
            self.starts = self.sizes = np.zeros(1, np.int64)
        known = self.known
        new = [p for p in pieces if p not in known and not p.isspace()]
        if new:
            ids, ends = self.model.encode(new)
            sizes = np.diff(ends, prepend=0)
            known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.starts = np.concatenate((self.starts, len(self.flat) + ends - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, ids))
        return np.array([known.get(p, 0) for p in pieces], np.int64)

    def _by_library(self, words: list[bytes]) -> list[np.ndarray]:
        if len(self.odd) > _ODD_CACHE:
            self.odd.clear()
        new = [w for w in words if w not in self.odd]
        for w, e in zip(new, self.model.library.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)):
            self.odd[w] = np.array(e.ids, np.uint32)
        return [self.odd[w] for w in words]

    def _words(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many each has) of distinct words, white space after them allowed."""
        data, bounds = utf8_buffer(words)
        heads = bounds[:-1]
        kind, lower = _WORD_CLASSES[data], _LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        second = data[lead + 1]
        latin = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        lead, second = lead[latin], second[latin]
        kind[lead] = kind[lead + 1] = _LETTER
        lower[lead[second <= 0x9E] + 1] += 0x20
        strange = (kind == _UNKNOWN) | (data == 0x27)
        strange[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        odd = np.logical_or.reduceat(strange, heads)
        kind[np.repeat(odd, np.diff(bounds))] = _SPACE
        lower[kind == _SPACE] = 0x20
        first = kind == _NUMBER
        first[1:] |= kind[1:] != kind[:-1]
        first[heads] = True
        pieces = np.flatnonzero(first)
        codes, distinct = _distinct(lower, np.append(pieces, len(data)))
        number = self._learn(distinct.to_pylist())[codes]
        sizes = self.sizes[number]
        ids = self.flat[_ranges(self.starts[number], sizes)]
        counts = np.add.reduceat(sizes, np.searchsorted(pieces, heads))
        starts = np.cumsum(counts) - counts
        strange_words = np.flatnonzero(odd)
        if len(strange_words):
            found = self._by_library([w.rstrip(b" \t\n\r\x0b\x0c") for w in words.take(pa.array(strange_words)).to_pylist()])
            counts[strange_words] = [len(x) for x in found]
            starts[strange_words] = len(ids) + np.cumsum(counts[strange_words]) - counts[strange_words]
            ids = np.concatenate((ids, *found))
        return ids, starts, counts

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids), ``end_id`` after each; a null text has none of its own."""
        data, bounds = utf8_buffer(texts)
        parts, ends, total, at = [np.zeros(0, np.uint32)], np.zeros(len(bounds), np.int64), 0, 0
        while at < len(data):
            stop = at + WINDOW
            while stop < len(data):
                gap = np.flatnonzero(_WORD_CLASSES[data[stop : stop + 65536]] == _SPACE)
                if len(gap):
                    stop += int(gap[0])
                    break
                stop += 65536
            stop = min(stop, len(data))
            window = data[at:stop]
            gap = _WORD_CLASSES[window] == _SPACE
            first = ~gap
            first[1:] &= gap[:-1]
            first[0] = True
            own = slice(*np.searchsorted(bounds, [at, stop]))
            first[bounds[own] - at] = True
            words = np.flatnonzero(first)
            codes, distinct = _distinct(window, np.append(words, len(window)))
            ids, starts, counts = self._words(distinct)
            sizes = counts[codes]
            before = np.concatenate(([0], np.cumsum(sizes)))
            ends[own] = total + before[np.searchsorted(words, bounds[own] - at)]
            parts.append(ids[_ranges(starts[codes], sizes)])
            total += int(before[-1])
            at = stop
        ends[np.searchsorted(bounds, len(data)) :] = total
        flat = np.concatenate(parts)
        if end_id is not None:
            flat = np.insert(flat, ends[1:], np.uint32(end_id))
            ends = ends + np.arange(len(ends))
        return flat, ends


class ByteCounter:
    """Numbers of ids of a byte-level BPE with the library's default split.

    That split is done here on the bytes: runs of letters, of numbers, of other characters, each with the
    one space before it; English endings after an apostrophe; white space but for the last of a run. What
    kind a character beyond ASCII is, the library's own split is asked once. Each distinct pre-token is
    counted once per cache, joined to the frequencies of the pre-tokens of each text, and summed.
    """

    def __init__(self, path: str):
        self.model = _Model(path)
        self.special = re.compile(b"|".join(map(re.escape, self.model.special))) if self.model.special else None
        self.kinds = np.zeros(0x110000, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}

    def _kind(self, point: int) -> int:
        if 0xD800 <= point < 0xE000:
            return _OTHER
        split = self.model.library.pre_tokenizer.pre_tokenize_str
        for probe, kind in (("a", _LETTER), ("1", _NUMBER), ("!", _OTHER)):
            if len(split(probe + chr(point))) == 1:
                return kind
        return _SPACE

    def _classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind of each byte's character, bytes that go on with one)."""
        kind, inside = _ASCII[data], (data & 0xC0) == 0x80
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            wide = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
            point = data[lead].astype(np.int64) & (0x7F >> (wide + 1))
            for k in range(1, 4):
                more = wide >= k
                point[more] = (point[more] << 6) | (data[np.minimum(lead[more] + k, len(data) - 1)] & 0x3F)
            for p in np.unique(point[self.kinds[np.minimum(point, 0x10FFFF)] == 0]).tolist():
                self.kinds[min(p, 0x10FFFF)] = self._kind(min(p, 0x10FFFF))
            own = self.kinds[np.minimum(point, 0x10FFFF)]
            kind[lead] = own
            for k in range(1, 4):
                more = wide >= k
                kind[np.minimum(lead[more] + k, len(data) - 1)] = own[more]
        return kind, inside

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where pre-tokens begin, whether each is a special string); ``bounds``: where texts begin."""
        kind, inside = self._classes(data)
        forced = np.zeros(len(data) + 1, bool)
        forced[bounds] = True
        forced[0] = forced[len(data)] = True
        special = np.zeros(len(data), bool)
        for found in self.special.finditer(data.tobytes()) if self.special else ():
            if not forced[found.start() + 1 : found.end()].any():
                special[found.start() : found.end()] = True
                forced[found.start()] = forced[found.end()] = True
        first = forced[:-1].copy()
        first[1:] |= kind[1:] != kind[:-1]
        # of white space before something else, the last character parts from the others; a space goes with what follows
        after = np.flatnonzero(first[1:] & (kind[:-1] == _SPACE) & ~forced[1:-1]) + 1
        last = after - 1
        for _ in range(3):
            last -= inside[last]
        first[last] = True
        first[after[data[last] == 0x20]] = False
        # 's 't 're 've 'm 'll 'd where the apostrophe begins a pre-token
        mark = np.flatnonzero(data == 0x27)
        before = np.maximum(mark - 1, 0)
        begins = forced[mark] | (kind[before] == _LETTER) | (kind[before] == _NUMBER) | ((kind[before] == _SPACE) & (data[before] != 0x20))
        mark = mark[begins]
        letter = lambda k: np.where(mark + k < len(data), data[np.minimum(mark + k, len(data) - 1)], 0)
        one, two = letter(1), letter(2)
        own = forced[np.minimum(mark + 1, len(data))]
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        long &= ~own & ~forced[np.minimum(mark + 2, len(data))]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~own
        for at, size in ((mark[short], 2), (mark[long & ~short], 3)):
            first[at] = True
            first[at + 1] = False
            first[(at + size)[at + size < len(data)]] = True
        first[:] = np.where(special, forced[:-1], first)
        starts = np.flatnonzero(first)
        return starts, special[starts]

    def _sizes(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_ENTRIES:
            self.forget()
        known = self.known
        new = [p for p in pieces if p not in known]
        plain = [p for p in new if b"\x00" not in p]
        if plain:
            known.update(zip(plain, np.diff(self.model.encode(plain)[1], prepend=0).tolist()))
        for p in new:
            if p not in known:
                known[p] = len(self.model.bare.encode(self.model._shown(p)).ids)
        return np.array([known[p] for p in pieces], np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        data, bounds = utf8_buffer(texts)
        out, at = np.zeros(len(bounds) - 1, np.int64), 0
        plain = (data > 0x20) & (data < 0x7F) if len(data) > WINDOW else None
        while at < len(data):
            stop = at + WINDOW
            while stop < len(data):
                # before a single space between two visible ASCII characters, or where a text begins
                near = slice(stop, min(stop + 65536, len(data) - 1))
                good = np.flatnonzero((data[near] == 0x20) & plain[near.start - 1 : near.stop - 1] & plain[near.start + 1 : near.stop + 1])
                begins = bounds[np.searchsorted(bounds, stop)]
                if len(good) or begins < near.stop:
                    stop = min(stop + int(good[0]) if len(good) else len(data), int(begins))
                    break
                stop += 65536
            stop = min(stop, len(data))
            window, own = data[at:stop], bounds[slice(*np.searchsorted(bounds, [at, stop]))]
            starts, special = self._cut(window, own - at)
            codes, distinct = _distinct(window, np.append(starts, len(window)))
            sizes = self._sizes(distinct.to_pylist())
            owner = np.searchsorted(bounds, at + starts, side="right") - 1
            np.add.at(out, owner[special], 1)
            pairs, times = np.unique(owner[~special] * len(sizes) + codes[~special], return_counts=True)
            np.add.at(out, pairs // len(sizes), times * sizes[pairs % len(sizes)])
            at = stop
        return out


_coders: dict = {}


@contextmanager
def coder(kind: type, path: str):
    """The worker's one coder for a file; its caches go when the task ends, as idle workers keep their memory."""
    if (kind, path) not in _coders:
        _coders[kind, path] = kind(path)
    found = _coders[kind, path]
    try:
        yield found
    finally:
        found.forget()


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        tokenizer = json.load(f)
    ids = [*tokenizer["model"]["vocab"].values(), *(t["id"] for t in tokenizer.get("added_tokens") or [])]
    return max(ids) + 1
