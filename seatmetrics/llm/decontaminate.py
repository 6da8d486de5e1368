"""Benchmark decontamination: CGK walks, bit-sampling LSH over item-sized windows, exact edit verification.

A document holds a benchmark item if one of its passages is within an edit distance of a fifth of the item's length,
counted in words (a similarity of 0.8 or more). With ``any_length`` (``PASSAGES``, as the query and the pipeline
have it) a passage may have any length, so that an inserted or deleted word is one edit; without it only windows of
the item's length (shorter at the document's end) are compared.

1. Starts from which no passage can be within that distance of an item are left out by a lossless count: by the
   q-gram lemma a passage keeps all but two of an item's word pairs for each edit, and it is longer than the item by
   one word for each edit at most.
2. The CGK embedding walks over a window: at step j it writes the current word and goes on to the next one or
   stays, as a random function of (j, word) says. Two texts at a small edit distance fall back into step, so their
   walks agree in most places. Items of similar length form a class, whose walks are short enough to stay within
   any of its windows.
3. A repetition samples a few places of a fresh walk as a key; where a start and an item share a key, the range of
   starts around it that the count left for this item is a candidate. The
   number of repetitions is found by simulation on the items with the most edits allowed, each kind of edit on its
   own, until the target recall is reached. Where ``most_repetitions`` do not reach it, as in classes of long items,
   every range that the count left is a candidate, so that nothing is missed.
4. Candidates are verified by exact edit distance, which one pass backwards gives for every start of the range and
   the best end.

Items are indexed in blocks of bounded size by tasks, which write each block's index to a file of the shared folder;
documents are read once, and a task that scans them loads one block after the other for some megabytes of text at a
time. The driver holds only the files' names. Defined results: null or empty texts hold nothing and null or empty
items are held by nothing; items of equal text, or of equal id, are items of their own and all reported; a null item
id is reported as null; repeated rows are reported alike; of several passages that hold an item the nearest, then the
first, is reported; ids of documents and items keep their type; no items or no documents, no rows.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from seatmetrics.llm.blocks import sorted_groups
from seatmetrics.llm.shared import NOT_WORD, hashed_words, mix, seeded, settle, shared_dir, slices

#: Items of a block, whose index a task loads at once, and characters of text that meet one block after the other.
ITEMS_AT_ONCE, CHARACTERS_AT_ONCE = 5_000, 1 << 24


@dataclass(frozen=True)
class Settings:
    share: float = 0.2
    recall: float = 0.99
    sampled: int = 3
    most_repetitions: int = 256
    class_ratio: float = 1.25
    any_length: bool = False


#: What the query and the pipeline ask for: passages of any length.
PASSAGES = Settings(any_length=True)


def allowed(n: int, share: float) -> int:
    """Edits that an item of ``n`` words allows."""
    return int(n * share + 1e-9)


def edit_distance(a: list[int], b: list[int]) -> int:
    """Levenshtein distance of two word sequences, a bit for each word of ``a``."""
    if not a:
        return len(b)
    at: dict[int, int] = defaultdict(int)
    for i, w in enumerate(a):
        at[w] |= 1 << i
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = every, 0, len(a)
    for w in b:
        match = at.get(w, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | (every & ~(diagonal | plus)), plus & diagonal
        distance += bool(up & top) - bool(down & top)
        up = ((up << 1) | 1) & every
        down = (down << 1) & every
        plus, minus = down | (every & ~(diagonal | up)), up & diagonal
    return distance


def start_distances(item: list[int], words: list[int]) -> list[int]:
    """For each start in ``words``, the distance of ``item`` to the nearest passage from there, whatever its end.

    Both are read backwards, so that a free end is a free beginning: no edit is charged for what lies before it.
    """
    at: dict[int, int] = defaultdict(int)
    for i, w in enumerate(reversed(item)):
        at[w] |= 1 << i
    every, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, distance, out = every, 0, len(item), []
    for w in reversed(words):
        match = at.get(w, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | (every & ~(diagonal | plus)), plus & diagonal
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1) & every, (down << 1) & every
        plus, minus = down | (every & ~(diagonal | up)), up & diagonal
        out.append(distance)
    return out[::-1]


def walk_keys(words: np.ndarray, starts: np.ndarray, salt: np.ndarray, sampled: np.ndarray, last: np.ndarray | int) -> np.ndarray:
    """Keys (repetition, start) of the CGK walks from ``starts``; the word at ``last`` is a pad that a walk never leaves.

    ``salt`` and ``sampled`` are (repetition, step): the random function of each step, and whether the key takes it.
    """
    at = np.broadcast_to(starts, (len(salt), len(starts))).copy()
    key = np.ones(at.shape, np.uint64) * np.arange(1, len(salt) + 1, dtype=np.uint64)[:, None]
    for j in range(salt.shape[1]):
        w = words[at]
        taken = np.flatnonzero(sampled[:, j])
        if len(taken):
            key[taken] = mix(key[taken] * np.uint64(0x9E3779B97F4A7C15) + w[taken])
        at += (((w ^ salt[:, j, None]) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, last, out=at)
    return key


class ItemClass:
    """Items of similar length, their filters, and one table of keys for each repetition."""

    def __init__(self, items: list[tuple[int, np.ndarray]], settings: Settings, seed: int):
        self.items, self.settings, self.seed = items, settings, seed
        self.shortest, self.longest = len(items[0][1]), len(items[-1][1])
        self.steps = max(1, int(1.5 * self.shortest))
        self.salt, self.sampled = self._draw(settings.most_repetitions)
        #: None where the most repetitions miss the target; every range is then verified.
        self.repetitions = self._simulate()
        self.salt, self.sampled = self.salt[: self.repetitions or 0], self.sampled[: self.repetitions or 0]
        self.tables = []
        self.lists = [w.tolist() for _, w in items]
        if self.repetitions is None:
            return
        joined, begins, pads = padded_together([w for _, w in items])
        for keys in walk_keys(joined, begins, self.salt, self.sampled, pads):
            order = np.argsort(keys, kind="stable")
            known, first = np.unique(keys[order], return_index=True)
            self.tables.append((known, np.append(first, len(order)), order))

    def _draw(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, self.steps])
        sampled = np.zeros((n, self.steps), bool)
        for row in sampled:
            row[rng.choice(self.steps, min(self.settings.sampled, self.steps), replace=False)] = True
        return seeded(n * self.steps, self.seed).reshape(n, self.steps), sampled

    def _simulate(self, trials: int = 200) -> int | None:
        """Repetitions until that share of edited items which the recall asks for has met its item, by the worst kind of edits."""
        needed = 1
        for kinds in ((2,), (1,), (0,), (0, 1, 2)):  # words deleted, inserted, replaced, and all of these
            met = self._first_met(trials, kinds)
            needed = max(needed, int(np.quantile(met, self.settings.recall, method="higher")))
            if needed > self.settings.most_repetitions:
                return None
        return needed

    def _first_met(self, trials: int, kinds: tuple[int, ...]) -> np.ndarray:
        """For each of some items with all allowed edits the repetition that first meets it, or one more than there are."""
        rng = np.random.default_rng([self.seed, 77, *kinds])
        plain, edited = [], []
        for _ in range(trials):
            _, item = self.items[int(rng.integers(len(self.items)))]
            other = item.tolist()
            for _ in range(allowed(len(item), self.settings.share)):
                kind, place, fresh = kinds[int(rng.integers(len(kinds)))], int(rng.integers(len(other))), int(rng.integers(1 << 62))
                if kind == 0:
                    other[place] = fresh
                elif kind == 1:
                    other.insert(place, fresh)
                elif len(other) > 1:
                    other.pop(place)
            plain.append(item)
            edited.append(np.array([*other, *rng.integers(1 << 62, size=len(item)).tolist()], np.uint64))
        a, b = padded_together(plain), padded_together(edited)
        first = np.full(trials, self.settings.most_repetitions + 1)
        for low in range(0, self.settings.most_repetitions, 64):
            some = slice(low, low + 64)
            same = walk_keys(a[0], a[1], self.salt[some], self.sampled[some], a[2]) == walk_keys(b[0], b[1], self.salt[some], self.sampled[some], b[2])
            first = np.where(same.any(0), np.minimum(first, low + 1 + same.argmax(0)), first)
            if (first <= low + 64).all():
                break
        return first

    def met(self, words: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Those of the ranges of starts (by item, then place; apart from each other) in which a walk shares a key with the range's item."""
        if self.repetitions is None:
            return np.ones(len(item), bool)
        n = len(words)
        padded = np.append(words, np.uint64(0))
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, high + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        begin, met = item * (n + 1) + low, np.zeros(len(item), bool)
        for at in range(0, len(starts), 4096):
            some = starts[at : at + 4096]
            for keys, (known, first, order) in zip(walk_keys(padded, some, self.salt, self.sampled, n), self.tables):
                found = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                s = np.flatnonzero(known[found] == keys)
                if not len(s):
                    continue
                size = first[found[s] + 1] - first[found[s]]
                stop = np.cumsum(size)
                k = order[np.repeat(first[found[s]] - (stop - size), size) + np.arange(int(stop[-1]))]
                s = np.repeat(some[s], size)
                r = np.searchsorted(begin, k * (n + 1) + s, "right") - 1
                met[r[(r >= 0) & (item[r] == k) & (s <= high[r])]] = True
        return met

    def hits(self, words: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, distance) of the nearest, then first, passage of each range that holds its item."""
        met = self.met(words, item, low, high)
        for k, first, last in zip(item[met].tolist(), low[met].tolist(), high[met].tolist()):
            of = self.lists[k]
            most = allowed(len(of), self.settings.share)
            near = start_distances(of, words[first : last + len(of) + most].tolist())[: last + 1 - first]
            near = [(d, first + j) for j, d in enumerate(near) if d <= most]
            if not self.settings.any_length:
                near = [(d, s) for _, s in near if (d := edit_distance(of, words[s : s + len(of)].tolist())) <= most]
            if near:
                distance, start = min(near)
                yield self.items[k][0], start, distance


def padded_together(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences one after the other with a pad behind each, their starts, and the places of their pads."""
    size = np.array([len(w) + 1 for w in sequences])
    stop = np.cumsum(size)
    return np.concatenate([x for w in sequences for x in (w, np.zeros(1, np.uint64))]), stop - size, stop - 1


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


class ItemIndex:
    """The classes of one block of items, and postings of their word pairs (of their words, where pairs cannot tell)."""

    def __init__(self, items: list[tuple[object, str]], settings: Settings):
        worded = sorted(((i, w) for i, t in items if len(w := hashed_words(t, NOT_WORD))), key=lambda x: (len(x[1]), str(x[0])))
        #: The id of each item; an item is known by its place here.
        self.ids = [i for i, _ in worded]
        hashed = [(k, w) for k, (_, w) in enumerate(worded)]
        groups: list[list[tuple[int, np.ndarray]]] = []
        for item in hashed:
            if not groups or len(item[1]) > len(groups[-1][0][1]) * settings.class_ratio:
                groups.append([])
            groups[-1].append(item)
        self.classes = [ItemClass(g, settings, k + 1) for k, g in enumerate(groups)]
        self.of_class = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        self.begin = np.cumsum([0, *map(len, groups)])
        self.length = np.array([len(w) for _, w in hashed], np.int64)
        edits = np.array([allowed(int(n), settings.share) for n in self.length], np.int64)
        self.longest = self.length + edits
        self.by_pairs = self.length - 1 - 2 * edits > 0
        self.least = np.where(self.by_pairs, self.length - 1 - 2 * edits, np.maximum(self.length - edits, 1))
        self.postings = [self._postings([(k, pair_hashes(w)) for k, (_, w) in enumerate(hashed) if self.by_pairs[k]]), self._postings([(k, w) for k, (_, w) in enumerate(hashed) if not self.by_pairs[k]])]

    @staticmethod
    def _postings(grams: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted grams, where their items begin, the items, and a table that rules most other grams out."""
        maybe = np.zeros(1 << 20, bool)
        if not grams:
            return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), maybe
        gram = np.concatenate([np.unique(g) for _, g in grams])
        item = np.concatenate([np.full(len(np.unique(g)), k) for k, g in grams])
        order = np.argsort(gram, kind="stable")
        known, first = np.unique(gram[order], return_index=True)
        maybe[known >> np.uint64(44)] = True
        return known, np.append(first, len(gram)), item[order], maybe

    def _windows(self, grams: np.ndarray, which: int, spare: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, first start, last start) of ranges of starts whose longest passages hold enough grams of one item."""
        known, first, items, maybe = self.postings[which]
        place = np.flatnonzero(maybe[grams >> np.uint64(44)]) if len(known) else np.zeros(0, np.int64)
        if not len(place):
            return []
        found = np.minimum(np.searchsorted(known, grams[place]), len(known) - 1)
        held = known[found] == grams[place]
        place, found = place[held], found[held]
        n = first[found + 1] - first[found]
        stop = np.cumsum(n)
        if not len(stop):
            return []
        item = items[np.repeat(first[found] - (stop - n), n) + np.arange(int(stop[-1]))]
        at = np.repeat(place, n)
        order = np.argsort(item, kind="stable")
        item, at = item[order], at[order]
        far = np.arange(len(item)) + self.least[item] - 1
        inside = np.minimum(far, len(item) - 1)
        room = self.longest[item] - 1 - spare
        enough = (far < len(item)) & (item[inside] == item) & (at[inside] - at <= room)
        k = np.flatnonzero(enough)
        return [(item[k], np.maximum(at[inside[k]] - room[k], 0), at[k])]

    def hits(self, text: str | None) -> dict[int, tuple[int, int]]:
        """Place of an item -> (distance, start) of the nearest, then first, passage of one whole text that holds it."""
        words = hashed_words(text, NOT_WORD)
        best: dict[int, tuple[int, int]] = {}
        if not len(words) or not self.classes:
            return best
        ranges = self._windows(pair_hashes(words), 0, 1) + self._windows(words, 1, 0)
        for item, low, high in ranges:
            # Ranges of one item come in order; those that touch become one.
            new = np.append(True, (item[1:] != item[:-1]) | (low[1:] > high[:-1] + 1))[: len(item)]
            last = np.append(new[1:], True)[: len(item)]
            item, low, high = item[new], low[new], high[last]
            for c in np.unique(self.of_class[item]).tolist():
                own = self.of_class[item] == c
                for i, start, distance in self.classes[c].hits(words, item[own] - self.begin[c], low[own], high[own]):
                    best[i] = min(best.get(i, (distance, start)), (distance, start))
        return best


def write_index(items: DataFrame, id_column: str, column: str, settings: Settings) -> tuple[str, list[str]]:
    """The folder and the files of the items' index, one for each block; a file that a failed task left is not among them."""
    usable = items.where(F.col(column).isNotNull()).select(F.col(id_column).alias("item_id"), F.col(column).alias("text"))
    blocks = max(1, -(-usable.count() // ITEMS_AT_ONCE))
    root = shared_dir(items.sparkSession, "benchmark-index")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for group in sorted_groups(batches, ["block"]):
            index = ItemIndex(list(zip(group.column("item_id").to_pylist(), group.column("text").to_pylist())), settings)
            store, base = fs.FileSystem.from_uri(root)
            store.create_dir(base, recursive=True)
            name = f"block-{uuid.uuid4().hex}.index"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(pickle.dumps(index))
            yield pa.RecordBatch.from_pydict({"file": pa.array([name])})

    # Rows of one block by a hash of id, text and row, so that items that repeat do not fill one block.
    block = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(blocks))
    parted = settle(usable.withColumn("block", block), "benchmark-items").repartition(blocks, "block").sortWithinPartitions("block")
    return root, [r["file"] for r in settle(parted.mapInArrow(build, "file string"), "benchmark-files").collect()]


_loaded: dict[str, ItemIndex] = {}


def load_index(root: str, name: str) -> ItemIndex:
    """One block's index; a worker keeps the last one that it used."""
    if name not in _loaded:
        from pyarrow import fs

        _loaded.clear()
        store, base = fs.FileSystem.from_uri(root)
        with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
            _loaded[name] = pickle.loads(stream.read())
    return _loaded[name]


def _gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches that hold about CHARACTERS_AT_ONCE of text together."""
    held, size = [], 0
    for batch in slices(batches):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= CHARACTERS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", column: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, start_word, edits, item_words."""
    root, files = write_index(items, item_id, item_text, settings)
    kinds = (docs.schema[id_column].dataType, items.schema[item_id].dataType, LongType(), LongType(), LongType())
    schema = StructType([StructField(n, t) for n, t in zip(("doc_id", "item_id", "start_word", "edits", "item_words"), kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _gathered(batches, "text"):
            for name in files:
                index = load_index(root, name)
                for batch in some:
                    rows = [(d, index.ids[k], s, e, int(index.length[k])) for d, t in zip(*(c.to_pylist() for c in batch.columns)) for k, (e, s) in sorted(index.hits(t).items())]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], to_arrow_type(t)) for k, t in enumerate(kinds)], names=schema.names)

    return docs.select(F.col(id_column).alias("doc_id"), F.col(column).alias("text")).mapInArrow(run, schema)


def without_leaks(docs: DataFrame, items: DataFrame, column: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns untouched, without a shuffle."""
    root, files = write_index(items, item_id, item_text, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _gathered(batches, column):
            for name in files:
                index = load_index(root, name)
                some = [batch.filter(pa.array([not index.hits(t) for t in batch.column(column).to_pylist()], pa.bool_())) for batch in some]
            yield from some

    return docs.mapInArrow(run, docs.schema)
