"""Stupid-backoff language-model scores: count tables by hash, joined to each document's n-grams, summed by document.

1. Documents are read in batches of whole texts. A batch lists its distinct n-grams of each order once, with how
   often each occurs in it, as sorted 64-bit hashes in slots (order, leading bits of the hash). A gram that every
   document holds is thus one entry for each batch, so no slot is larger than others because of a common gram.
2. Slots are shuffled by their key. A slot is one part of the count table of its order: entries of equal hash are
   added up, and the sums go back to the batches that asked for them. There are as many slots as the words of the
   input ask for, so a slot holds about ``slot_words`` entries whatever the size of the corpus.
3. A batch meets its sums again, looks up every n-gram of every document and adds up the logarithms.

The score of a word is the relative frequency of its longest n-gram that the corpus holds, times ``alpha`` for each
order it had to give up: count(gram) / count(gram without its last word), for a single word count / all words; a
word the corpus does not hold counts as seen once. When a corpus scores itself, a document's own occurrences are left
out of all counts it is scored with; else a text that nothing else resembles would get the best score of all.

Batches are made anew for step 3, so ``docs`` must give the same rows in the same order when read again, as tables
in files do; a batch that differs stops the job. Words are ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case.

Entries travel packed, one row for each batch and slot: as rows of their own (gram, batch, count) the n-grams of three
orders would take about twenty times the input on disk.

Defined results: null text and text without words have no words, log_score 0 and a null mean; a text longer than a
batch is a batch of its own, read whole; repeated rows are documents of their own; null ids pass through; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmetrics.llm.blocks import sorted_groups
from seatmetrics.llm.shared import SPACE, hashed_words, mix

_FORWARD = "slot int, batch string, asks boolean, keys binary, counts binary"
_BACK = "batch string, slot int, counts binary"


@dataclass(frozen=True)
class Settings:
    order: int = 3
    alpha: float = 0.4
    batch_words: int = 2_000_000
    slot_words: int = 2_000_000

    def slot_bits(self, words: int) -> int:
        """Leading bits of a hash that name a slot of an order, for a corpus of so many words."""
        return min(24, max(4, math.ceil(math.log2(max(1, words / self.slot_words)))))


def pack(values: np.ndarray) -> bytes:
    """Unsigned values as byte planes of the fewest bytes that hold the largest, compressed: a plane that says little costs little."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return struct.pack("<BI", width, len(values)) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BI", data)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:], max_output_size=width * n), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct keys: the first one, and the steps between them."""
    return int(keys[0]).to_bytes(8, "little") + pack(keys[1:] - keys[:-1])


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(np.append(np.frombuffer(data[:8], "<u8"), unpack(data[8:])), dtype=np.uint64)


class Grams:
    """The words of a batch of documents, and the hashes of its n-grams one order after the other."""

    def __init__(self, texts: list[str | None], order: int):
        words = [hashed_words(t, SPACE) for t in texts]
        self.order = order
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.minimum(np.arange(len(self.words)) - np.repeat(self.starts, self.lengths), order).astype(np.int8)

    def by_order(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, word positions at which an n-gram ends, hashes of these n-grams)."""
        hashed = self.words
        for n in range(1, self.order + 1):
            if n > 1 and len(hashed):
                hashed = np.append(np.zeros(1, np.uint64), mix(hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.words[1:]))
            at = np.flatnonzero(self.place >= n - 1)
            yield n, at, hashed[at]

    def in_document(self, n: int, entry: np.ndarray) -> np.ndarray:
        """For each n-gram occurrence, how often its document holds that n-gram."""
        out = np.zeros(len(entry), np.int64)
        edge = np.append(0, np.cumsum(np.maximum(self.lengths - n + 1, 0)))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b > a:
                _, back, counts = np.unique(entry[a:b], return_inverse=True, return_counts=True)
                out[a:b] = counts[back.reshape(-1)]
        return out


def slot_edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each slot's keys begin and end among sorted keys, by their leading bits."""
    tops = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, tops), len(keys))


def about_words(docs: DataFrame, column: str) -> int:
    """How many words ``docs`` hold at most, about: a word for each six bytes and one for each text, as batches are cut."""
    row = docs.agg(F.sum(F.octet_length(F.col(column))).alias("bytes"), F.count("*").alias("rows")).collect()[0]
    return (row["bytes"] or 0) // 6 + row["rows"]


def batches_of(docs: DataFrame, id_column: str, column: str, schema: str, make, settings: Settings) -> DataFrame:
    """``make(batch name, ids, texts)`` for each batch: documents in the order they are read, as many as hold ``batch_words`` words."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        texts: list[str | None] = []

        def name() -> str:
            mark = hashlib.blake2b(digest_size=8)
            for i, t in zip(ids, texts):
                mark.update(f"{i}:{-1 if t is None else len(t)};".encode())
            return f"{part}-{seq}-{mark.hexdigest()}"

        for frame in frames:
            for i, t in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "") // 6 + 1
                if size >= settings.batch_words:
                    yield from make(name(), ids, texts)
                    ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield from make(name(), ids, texts)

    return docs.select(F.col(id_column).cast("bigint"), F.col(column)).mapInArrow(run, schema)


def gram_slots(docs: DataFrame, id_column: str, column: str, bits: int, asks: bool, adds: bool, settings: Settings) -> DataFrame:
    """Each batch's distinct n-grams in slots; ``asks``: the batch wants sums back, ``adds``: its counts go into the tables."""

    def rows(batch: str, slots: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        counts = [c if adds else np.zeros(len(c), np.int64) for _, _, c in slots]
        return pa.RecordBatch.from_pydict(
            {
                "slot": pa.array([s for s, _, _ in slots], pa.int32()),
                "batch": pa.array([batch] * len(slots), pa.string()),
                "asks": pa.array([asks] * len(slots), pa.bool_()),
                "keys": pa.array([pack_sorted(k) for _, k, _ in slots], pa.binary()),
                "counts": pa.array([pack(c) for c in counts], pa.binary()),
            }
        )

    def make(batch: str, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        grams = Grams(texts, settings.order)
        # Order 0, the empty gram: all words.
        yield rows(batch, [(0, np.zeros(1, np.uint64), np.array([len(grams.words)]))])
        for n, _, hashed in grams.by_order():
            keys, counts = np.unique(hashed, return_counts=True)
            edges = slot_edges(keys, bits).tolist()
            yield rows(batch, [((n << bits) + k, keys[a:b], counts[a:b]) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a])

    return batches_of(docs, id_column, column, _FORWARD, make, settings)


def slot_sums(slots: DataFrame, partitions: int) -> DataFrame:
    """The count tables: entries of a slot added up by hash, and the sums for each batch that asked."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(frames, ["slot"]):
            lists = [unpack_sorted(x) for x in group.column("keys").to_pylist()]
            counts = [unpack(x) for x in group.column("counts").to_pylist()]
            _, back = np.unique(np.concatenate(lists), return_inverse=True)
            back = back.reshape(-1)
            total = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)[back]
            edge = np.append(0, np.cumsum([len(x) for x in lists]))
            keep = [k for k, asks in enumerate(group.column("asks").to_pylist()) if asks]
            batch, slot = group.column("batch").to_pylist(), group.column("slot")[0].as_py()
            yield pa.RecordBatch.from_pydict(
                {
                    "batch": pa.array([batch[k] for k in keep], pa.string()),
                    "slot": pa.array([slot] * len(keep), pa.int32()),
                    "counts": pa.array([pack(total[edge[k] : edge[k + 1]]) for k in keep], pa.binary()),
                }
            )

    return slots.repartition(partitions, "slot").sortWithinPartitions("slot").mapInArrow(run, _BACK)


def word_scores(grams: Grams, sums: list[np.ndarray], leave_out: bool, settings: Settings) -> np.ndarray:
    """The logarithm of the backed-off relative frequency at each word position of a batch; ``sums``: of its distinct grams by order."""
    own_words = np.repeat(grams.lengths, grams.lengths)
    every = np.maximum(int(sums[0][0]) - (own_words if leave_out else 0), 1)
    top = np.minimum(grams.place + 1, settings.order)
    out, before = np.zeros(len(grams.words)), every
    for n, at, hashed in grams.by_order():
        _, entry = np.unique(hashed, return_inverse=True)
        entry = entry.reshape(-1).astype(np.int32)
        known = np.zeros(len(grams.words), np.int64)
        known[at] = sums[n][entry].astype(np.int64) - (grams.in_document(n, entry) if leave_out else 0)
        if n == 1:
            out = (top - 1) * math.log(settings.alpha) + np.log(np.maximum(known, 1)) - np.log(every)
        else:
            longer = np.flatnonzero(known > 0)
            out[longer] = (top[longer] - n) * math.log(settings.alpha) + np.log(known[longer]) - np.log(before[longer - 1])
        before = known
    return out


def score_documents(docs: DataFrame, corpus: DataFrame | None = None, id_column: str = "doc_id", column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, log_score (sum over its words), mean_log_score for each row of ``docs``.

    Counts are those of ``corpus`` (same columns), or of ``docs`` itself without the scored document.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own_words = about_words(docs, column)
    bits = settings.slot_bits(own_words + (about_words(corpus, column) if corpus is not None else 0))
    slots = gram_slots(docs, id_column, column, bits, True, corpus is None, settings)
    if corpus is not None:
        slots = slots.unionByName(gram_slots(corpus, id_column, column, bits, False, True, settings))
    sums = slot_sums(slots, max(least, (settings.order << bits) // 2))

    def keep(batch: str, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        sink = pa.BufferOutputStream()
        rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as stream:
            stream.write_batch(rows)
        yield pa.RecordBatch.from_pydict({"batch": pa.array([batch], pa.string()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    held = batches_of(docs, id_column, column, "batch string, docs binary", keep, settings)
    leave_out = corpus is None

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            raise RuntimeError("docs gave other rows when read again; write them to files first")
        with pa.ipc.open_stream(left["docs"].iloc[0]) as stream:
            rows = stream.read_all()
        grams = Grams(rows.column("text").to_pylist(), settings.order)
        found = right.sort_values("slot")
        order = found["slot"].to_numpy() >> bits
        lists = [unpack(x) for x in found["counts"]]
        none = np.zeros(0, np.uint64)
        by_order = [np.concatenate([none, *(x for x, n in zip(lists, order) if n == k)]) for k in range(settings.order + 1)]
        scores = np.append(0, np.cumsum(word_scores(grams, by_order, leave_out, settings)))
        total = scores[grams.starts + grams.lengths] - scores[grams.starts]
        mean = np.divide(total, grams.lengths, out=np.full(len(total), np.nan), where=grams.lengths > 0)
        return pd.DataFrame({"doc_id": rows.column("doc_id").to_pandas(integer_object_nulls=True), "n_words": grams.lengths, "log_score": total, "mean_log_score": mean})

    schema = "doc_id bigint, n_words bigint, log_score double, mean_log_score double"
    # Both sides by batch in the same number of partitions, so that a task holds one batch after the other of about two.
    apart = max(least, own_words // settings.batch_words)
    out = held.repartition(apart, "batch").groupBy("batch").cogroup(sums.repartition(apart, "batch").groupBy("batch")).applyInPandas(finish, schema)
    return out.withColumn("mean_log_score", F.nanvl("mean_log_score", F.lit(None).cast("double")))
