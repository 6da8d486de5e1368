"""Token counts without token ids: pieces are counted once for each distinct pretoken and joined to documents' frequencies.

1. Every text is normalized and split into pretokens as its vocabulary file says. A first pass yields the distinct
   pretokens of the whole corpus with the number of documents that hold each (a very long text may count more than once); the library encodes each of them once,
   and only the number of its pieces is kept.
2. The pretokens that most documents hold are the ``head``: as many as fit in a stated number of rows and bytes,
   found from a histogram of document counts. The head is broadcast. A second pass counts each document's pretokens,
   sums frequency times pieces over the head, and keeps the frequencies of the other pretokens, the tail.
3. The tail meets its piece counts by a shuffled join and is summed by document. No tail pretoken is frequent, as those
   are in the head, so the join has no hot key; what is too long for the head is left to Spark's splitting of skewed joins.

Added tokens' strings in a text are tokens of their own, cut out before normalizing, as the library does by default.
The pretoken strings themselves are the keys, so no hash can confuse two of them.

Defined results: null text counts as empty and has no bytes and no tokens; null and repeated ids keep their rows, each
counted by itself; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmetrics.llm.pretokens import CONTRACTIONS, NUMBER, WHITE, boundaries, classes
from seatmetrics.llm.shared import hash_spans, seeded, settle, slices

VOCABULARY = "word_bpe_49k.json"
#: The head that is broadcast: rows, and bytes of their strings.
HEAD_ROWS, HEAD_BYTES = 300_000, 1 << 24
#: Distinct pretokens that a task holds before it hands them on, and code points of a text that are split at once.
HELD, SEGMENT = 400_000, 1 << 20
# How the two supported kinds of vocabulary files state their normalizer and their pretokens.
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SAFE_CUT = re.compile(r"(?<=\S)[ \n](?=\w)", re.ASCII)
_loaded: dict[str, Splitter] = {}
_tables: dict[str, np.ndarray] = {}


def word_boundaries(points: np.ndarray) -> np.ndarray:
    """Starts of runs of letters, of single digits, of runs of other marks, of contractions, and of white space."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    starts = np.ones(n, bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    for at in np.flatnonzero((points == 39) & starts).tolist():
        for tail in CONTRACTIONS:
            end = at + 1 + len(tail)
            if end <= n and "".join(map(chr, points[at + 1 : end])) == tail:
                starts[at + 1] = False
                if end < n:
                    starts[end] = True
                break
    return np.flatnonzero(starts)


def code_point_values() -> np.ndarray:
    """A fixed pseudo-random word for each code point."""
    if "values" not in _tables:
        _tables["values"] = seeded(0x110000, 23)
    return _tables["values"]


def _all_equal(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether every pretoken has the code points of the one at ``like``."""
    n = ends - starts
    if (n != n[like]).any():
        return False
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return bool((points[np.repeat(starts, n) + inside] == points[np.repeat(starts[like], n) + inside]).all())


@dataclass(frozen=True)
class Block:
    """Distinct pretokens, and for each pretoken in turn which of these it is and whose text it is in."""

    distinct: list[str]
    which: np.ndarray
    owner: np.ndarray

    def of_texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, which, n): how often each text holds each of its pretokens."""
        size = max(len(self.distinct), 1)
        pair, n = np.unique(self.owner * size + self.which, return_counts=True)
        return pair // size, pair % size, n


class Splitter:
    """Pretokens of whole texts as one vocabulary file has them, and the number of pieces of a pretoken."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        parts = before.get("pretokenizers", [])
        self.words = len(parts) == 2 and parts[0].get("pattern") == {"Regex": WORD_PATTERN} and parts[0].get("behavior") == "Removed" and (spec["normalizer"] or {}).get("normalizers") == WORD_NORMALIZER
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec["normalizer"]
        if not self.words and not byte_level:
            raise ValueError(f"pretokens of this vocabulary are not known here: {path}")
        self.library = Tokenizer.from_file(path)
        added = list(self.library.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("added tokens that take what is around them into account are not supported")
        # Pretokens are normalized already, and what lower case made of a text need not stay as it is if it is composed again.
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
        self.plain.encode_special_tokens = True
        longest_first = sorted((t.content for t in added), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest_first))) if added else None
        if self.words:
            self._lower_table()

    def _lower_table(self) -> None:
        """Lower case by code point from the library; ``odd`` code points leave their text to the library's own normalizer."""
        points = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and p != 0x130], np.uint32)
        from tokenizers import normalizers

        low = normalizers.Lowercase().normalize_str(points.tobytes().decode("utf-32-le"))
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.lower[points] = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        self.odd = np.zeros(0x110000, bool)
        self.odd[[p for p in range(0x80, 0x110000) if p == 0x130 or unicodedata.category(chr(p)) == "Cn"]] = True

    def _points(self, text: str) -> np.ndarray:
        """Code points of a normalized text, white space left as it is."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not self.words:
            return points
        if not text.isascii() and (not unicodedata.is_normalized("NFC", text) or self.odd[points].any()):
            return np.frombuffer(self.library.normalizer.normalize_str(text).encode("utf-32-le"), np.uint32)
        return self.lower[points]

    def _segments(self, text: str) -> Iterator[str]:
        """Parts of a long text, each up to a line break or single space before a word: nothing is composed or split across these."""
        at = 0
        while len(text) - at > SEGMENT:
            end = SAFE_CUT.search(text, at + SEGMENT)
            if end is None:
                break
            yield text[at : end.start()]
            at = end.start()
        yield text[at:]

    def blocks(self, texts: list[str]) -> Iterator[Block]:
        """The pretokens of whole texts, in blocks of about a segment's length; a long text may go on in the next block."""
        parts, owners, size = [], [], 0
        for owner, text in enumerate(texts):
            for segment in self._segments(text):
                parts.append(self._points(segment))
                owners.append(owner)
                size += len(parts[-1])
                if size >= SEGMENT:
                    yield self._block(parts, owners)
                    parts, owners, size = [], [], 0
        if parts:
            yield self._block(parts, owners)

    def _block(self, parts: list[np.ndarray], owners: list[int]) -> Block:
        split = word_boundaries if self.words else boundaries
        found = [split(p) for p in parts]
        size = np.array([len(p) for p in parts])
        begin = np.cumsum(size) - size
        points = np.concatenate(parts)
        starts = np.concatenate([f + b for f, b in zip(found, begin.tolist())])
        ends = np.append(starts[1:], len(points))
        owner = np.repeat(np.array(owners), [len(f) for f in found])
        if self.words and len(starts):
            some = classes()[points[starts]] != WHITE
            starts, ends, owner = starts[some], ends[some], owner[some]
        string = points.tobytes().decode("utf-32-le")
        _, first, which = np.unique(hash_spans(points, starts, ends, code_point_values()), return_index=True, return_inverse=True)
        if len(starts) and not _all_equal(points, starts, ends, first[which]):  # two pretokens share a hash: known by their strings
            known: dict[str, int] = {}
            which = np.array([known.setdefault(string[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())])
            return Block(list(known), which, owner)
        return Block([string[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], which, owner)

    def without_added(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts cut at added tokens, the text that each part is of, and how many added tokens each text holds."""
        cut = [self.cut.split(t) if self.cut else [t] for t in texts]
        n = np.array([len(c) for c in cut], np.int64)
        return [p for c in cut for p in c], np.repeat(np.arange(len(texts)), n), n - 1

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(e) for e in self.plain.encode_batch_fast(pretokens, add_special_tokens=False)]


def splitter(path: str) -> Splitter:
    """The worker's splitter of one vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Splitter(path)
    return _loaded[path]


def pretoken_table(texts: DataFrame, path: str) -> DataFrame:
    """(pretoken, docs, pieces): each distinct pretoken of ``text``, how many rows hold it, and its number of pieces."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"pretoken": pa.array(list(held), pa.string()), "docs": pa.array(list(held.values()), pa.int64())})

        split = splitter(path)
        for batch in slices(batches):
            texts, of, _ = split.without_added(batch.column("text").to_pylist())
            for block in split.blocks(texts):
                pairs = Block(block.distinct, block.which, of[block.owner]).of_texts()
                docs = np.bincount(pairs[1], minlength=len(block.distinct))
                for pretoken, n in zip(block.distinct, docs.tolist()):
                    held[pretoken] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            yield batch.append_column("pieces", pa.array(splitter(path).pieces(batch.column("pretoken").to_pylist()), pa.int64()))

    counted = texts.mapInArrow(distinct, "pretoken string, docs bigint").groupBy("pretoken").agg(F.sum("docs").alias("docs"))
    return settle(counted.mapInArrow(encoded, "pretoken string, docs bigint, pieces bigint"), "pretokens")


def head_limit(table: DataFrame, rows: int, size: int) -> int:
    """The least number of documents from which on all pretokens together keep within ``rows`` and ``size`` bytes.

    Counts are looked at by eighths of a power of two, so the histogram that comes to the driver has a few hundred rows.
    """
    step = F.floor(F.log2("docs") * 8)
    found = table.groupBy(step.alias("step")).agg(F.min("docs").alias("least"), F.count("*").alias("n"), F.sum(F.octet_length("pretoken")).alias("bytes")).orderBy(F.desc("step")).collect()
    limit, n, held = 1 << 62, 0, 0
    for r in found:
        n, held = n + r["n"], held + r["bytes"]
        if n > rows or held > size:
            break
        limit = r["least"]
    return limit


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = 2048, id_column: str = "doc_id", text_column: str = "text", head_rows: int = HEAD_ROWS, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of ``docs``; ``vocabulary`` is a file's name or path."""
    spark: SparkSession = docs.sparkSession
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    table = pretoken_table(rows.select("text"), path)
    limit = head_limit(table, head_rows, head_bytes)
    in_head = F.col("docs") >= limit
    head = spark.sparkContext.broadcast({r["pretoken"]: r["pieces"] for r in table.where(in_head).select("pretoken", "pieces").collect()})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = splitter(path), head.value
        tail_type = pa.list_(pa.struct([("pretoken", pa.string()), ("n", pa.int64())]))
        for batch in slices(batches):
            texts, of, sums = split.without_added(batch.column("text").to_pylist())
            tails: list[list[dict]] = [[] for _ in sums]
            for block in split.blocks(texts):
                pieces = np.array([known.get(t, -1) for t in block.distinct], np.int64)
                text, which, n = Block(block.distinct, block.which, of[block.owner]).of_texts()
                k = pieces[which]
                np.add.at(sums, text[k >= 0], (n * k)[k >= 0])
                rest = k < 0
                for i, w, m in zip(text[rest].tolist(), which[rest].tolist(), n[rest].tolist()):
                    tails[i].append({"pretoken": block.distinct[w], "n": m})
            yield batch.drop_columns("text").append_column("known", pa.array(sums, pa.int64())).append_column("tail", pa.array(tails, tail_type))

    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    per_doc = sized.mapInArrow(summed, f"doc_id {id_type}, n_bytes bigint, known bigint, tail array<struct<pretoken: string, n: bigint>>")
    # Rows are numbered as they are written, so the number stays with its row whatever is computed again later.
    kept = settle(per_doc.withColumn("row", F.monotonically_increasing_id()), "token-sums")
    rest = kept.select("row", F.explode("tail").alias("t")).select("row", "t.pretoken", "t.n")
    sums = rest.join(table.where(~in_head).select("pretoken", "pieces"), "pretoken").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return kept.drop("tail").join(sums, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > most).alias("over_limit"))
