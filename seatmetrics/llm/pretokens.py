"""Byte-level pre-tokenization of whole texts in numpy, and a bounded cache of encoded pretokens.

Both public byte-level vocabularies split text by the same published pattern. Here its rules are stated on
arrays of code points: runs of letters, of digits and of other marks, each with one space before it if there
is one; the contractions; and white space, which leaves its last character to what follows. Equal pretokens
meet by a 64-bit hash, so each is encoded once in a worker and then copied by index; the bytes of every pretoken are
compared with those that were encoded, and a text in which two pretokens share a hash is encoded without the cache.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import regex

from seatmetrics.llm.shared import hash_spans

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
# The contractions of the published pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """The class of each code point, as the public pattern's properties have it."""
    if "class" not in _tables:
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                if a < 0xD800 <= b:
                    table[a:0xD800] = kind
                    a = 0xE000
                table[a : b + 1] = kind
        _tables["class"] = table
    return _tables["class"]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Starts of the pretokens in an array of code points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    white = kind == WHITE
    starts = change.copy()
    # The last of a run of white space stands apart, unless the run ends the text; a plain space then joins what follows.
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:]
    starts |= last
    follows = np.zeros(n, bool)
    follows[1:] = last[:-1]
    joins = follows.copy()
    joins[1:] &= points[:-1] == 32
    starts &= ~joins
    marks = np.flatnonzero(points == 39)
    if len(marks):
        _contract(points, starts, marks)
    return np.flatnonzero(starts)


def _contract(points: np.ndarray, starts: np.ndarray, marks: np.ndarray) -> None:
    """An apostrophe that starts a pretoken takes the letters of a contraction; a run of marks is only cut where one starts."""
    n = len(points)
    free = -1
    for at in marks.tolist():
        if at < free or not starts[at]:
            continue
        for tail in CONTRACTIONS:
            end = at + 1 + len(tail)
            if end <= n and "".join(map(chr, points[at + 1 : end])) == tail:
                starts[at + 1] = False
                if end < n:
                    starts[end] = True  # what is left of the letters, or whatever follows them
                free = end
                break


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, starts and ends of their pretokens in them, and the number of pretokens of each text."""
    counts, first, parts, size = [], [], [], 0
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = boundaries(points)
        data = text.encode("utf-8", "surrogatepass")
        if len(data) != len(points):
            width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            offset = np.zeros(len(points) + 1, np.int64)
            np.cumsum(width, out=offset[1:])
            begins = offset[begins]
        counts.append(len(begins))
        first.append(begins + size)
        parts.append(data)
        size += len(data)
    joined = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.concatenate(first) if first else np.zeros(0, np.int64)
    ends = np.append(starts[1:], size) if len(starts) else starts
    return joined, starts, ends, np.array(counts, np.int64)


class PretokenCache:
    """Ids and bytes of distinct pretokens by hash, in sorted arrays; when full it starts anew, so its memory is bounded."""

    #: Characters of text that are encoded together, and pretokens that are compared together.
    BLOCK, COMPARED = 1 << 20, 1 << 17

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 2_000_000, most_bytes: int = 1 << 26):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.raw_at = np.zeros(0, np.int64)
        self.raw_n = np.zeros(0, np.int64)
        self.raw = np.zeros(0, np.uint8)

    def _add(self, keys: np.ndarray, tokens: list[bytes]) -> None:
        got = self.encode(tokens)
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(n.sum()))
        raw_n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        into = np.searchsorted(self.keys, keys)
        for name, new in (("keys", keys), ("at", len(self.ids) + np.cumsum(n) - n), ("n", n), ("raw_at", len(self.raw) + np.cumsum(raw_n) - raw_n), ("raw_n", raw_n)):
            setattr(self, name, np.insert(getattr(self, name), into, new))
        self.ids = np.concatenate([self.ids, flat])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(tokens), np.uint8)])

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each whole text, in blocks of texts of about a megabyte."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= self.BLOCK:
                yield from self._block(block)
                block, size = [], 0
        if block:
            yield from self._block(block)

    def _same_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Whether each pretoken has the bytes of its entry in the cache; pretokens lie side by side in ``data``."""
        size = ends - starts
        same = size == self.raw_n[found]
        for low in range(0, len(starts), self.COMPARED):
            some = slice(low, low + self.COMPARED)
            a, b = int(starts[some][0]), int(ends[some][-1])
            place = np.repeat(self.raw_at[found[some]] - starts[some], size[some]) + np.arange(a, b)
            differs = data[a:b] != self.raw[np.minimum(place, len(self.raw) - 1)]
            if differs.any():
                at = np.searchsorted(ends[some], np.flatnonzero(differs) + a, "right")
                same[low + at] = False
        return same

    def _block(self, texts: list[str]) -> Iterator[np.ndarray]:
        data, starts, ends, counts = pieces(texts)
        if not len(starts):
            yield from (np.zeros(0, np.uint32) for _ in texts)
            return
        keys = hash_spans(data, starts, ends)
        if len(self.keys) > self.most or len(self.raw) > self.most_bytes:
            self.clear()
        # Distinct keys in order: the search then walks through the cache once, whatever its size.
        order = np.argsort(keys)
        ordered = keys[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])
        distinct, sample = ordered[fresh], order[fresh]
        which = np.empty(len(keys), np.int64)
        which[order] = np.cumsum(fresh) - 1
        found = np.searchsorted(self.keys, distinct)
        known = found < len(self.keys)
        known[known] = self.keys[found[known]] == distinct[known]
        missing = np.flatnonzero(~known)
        if len(missing):
            raw, new = data.tobytes(), sample[missing]
            self._add(distinct[missing], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            found = np.searchsorted(self.keys, distinct)
        found = found[which]
        same = self._same_bytes(data, starts, ends, found)
        n = self.n[found]
        stop = np.cumsum(n)
        flat = self.ids[np.repeat(self.at[found] - (stop - n), n) + np.arange(int(stop[-1]))]
        last = np.cumsum(counts)
        edge = np.append(0, stop)[np.append(0, last)]
        for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
            own = slice(int(last[k] - counts[k]), int(last[k]))
            if same[own].all():
                yield flat[a:b]
            else:
                tokens = [data[x:y].tobytes() for x, y in zip(starts[own].tolist(), ends[own].tolist())]
                yield np.array([i for ids in self.encode(tokens) for i in ids], np.uint32)
