"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file holds blocks of whole documents in ascending doc_id order. A block ranks its ids by their frequency in it,
most frequent first, and carries that table; ranks are written with one to four bytes, and two bits for each
rank in a separate run of control bytes say how many. numpy decodes a block by looking up the lengths of four
ranks for each control byte. Ranks are those of the block, so that tokenizing, which dominates, runs once.

Ids are those of the library's own call ``encode(text, add_special_tokens=False)``: the string of an added token, such
as ``<|endoftext|>``, that stands in a text becomes that token's id. ``added_as_text=True`` reads it as plain text, as
the library does after ``encode_special_tokens = True``.

File layout, little-endian: ``TIDS`` and then blocks of: documents, ids, table entries, data bytes (4 x uint32);
a validity byte for each doc_id; doc_ids (int64); ids of each document (uint32); table (uint32); control; data.

Defined results: null text counts as empty and has only the end id; a null doc_id sorts first; repeated doc_ids
stay, ordered by a hash of their text, and rows of one id may lie in several files; an empty table writes no file;
further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seatmetrics.llm.pretokens import PretokenCache
from seatmetrics.llm.shared import settle, shared_dir

MAGIC = b"TIDS"
#: A block is written when it holds so many ids, a file when it holds so many.
BLOCK_IDS, FILE_IDS = 2_000_000, 50_000_000
VOCABULARY = "byte_bpe_50k.json"
_loaded: dict[tuple[str, bool], TextEncoder] = {}
#: Bytes of each of the four ranks that a control byte stands for.
LENGTHS = 1 + ((np.arange(256)[:, None] >> (2 * np.arange(4))[None, :]) & 3).astype(np.int64)


class TextEncoder:
    """The tokenizers library behind the worker's cache of distinct pretokens; texts are cut at added tokens first, as the library does."""

    def __init__(self, path: str, added_as_text: bool):
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        plain.encode_special_tokens = True
        self.cache = PretokenCache(lambda tokens: [e.ids for e in plain.encode_batch_fast([t.decode("utf-8") for t in tokens], add_special_tokens=False)])
        added = [] if added_as_text else list(Tokenizer.from_file(path).get_added_tokens_decoder().items())
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added):
            raise ValueError("added tokens that take what is around them into account are not supported")
        self.ids = {t.content: i for i, t in added}
        longest_first = sorted(self.ids, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest_first))) if added else None

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        parts, plan = [], []
        for text in texts:
            marks = list(self.cut.finditer(text)) if self.cut else []
            edges = [0, *(m.end() for m in marks)]
            parts += [text[a:b] for a, b in zip(edges, [*(m.start() for m in marks), len(text)])]
            plan.append([self.ids[m[0]] for m in marks])
        encoded = self.cache.encode_texts(parts)
        for marks in plan:
            first = next(encoded)
            yield first if not marks else np.concatenate([first, *(x for i in marks for x in (np.array([i], np.uint32), next(encoded)))])


def encoder(path: str, added_as_text: bool = False) -> TextEncoder:
    """The worker's encoder of one vocabulary file."""
    if (path, added_as_text) not in _loaded:
        _loaded[path, added_as_text] = TextEncoder(path, added_as_text)
    return _loaded[path, added_as_text]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros((len(values) + 3) // 4 * 4, np.uint8)
    codes[: len(values)] = extra
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | (codes[:, 1] << 2) | (codes[:, 2] << 4) | (codes[:, 3] << 6)
    keep = np.arange(4, dtype=np.uint8)[None, :] <= extra[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The values again: lengths by table lookup, their running sum as places, one gather for each byte position."""
    length = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(length) - length
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(length > k)
        if not len(longer):
            break
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids)
    counts = np.bincount(flat)
    used = np.flatnonzero(counts)
    table = used[np.lexsort((used, -counts[used]))].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[table] = np.arange(len(table))
    control, data = pack(rank[flat])
    valid = bytes(d is not None for d in doc_ids)
    return (
        struct.pack("<4I", len(doc_ids), len(flat), len(table), len(data))
        + valid
        + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + np.array([len(x) for x in ids], "<u4").tobytes()
        + table.tobytes()
        + control
        + data
    )


def read_blocks(stream) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, ids of each document, all ids) for each block of a file."""
    if stream.read(4) != MAGIC:
        raise ValueError("not a file of token ids")
    while head := stream.read(16):
        docs, n, entries, size = struct.unpack("<4I", head)
        valid = np.frombuffer(stream.read(docs), np.uint8)
        doc_ids = np.frombuffer(stream.read(8 * docs), "<i8")
        lengths = np.frombuffer(stream.read(4 * docs), "<u4")
        table = np.frombuffer(stream.read(4 * entries), "<u4")
        control = np.frombuffer(stream.read((n + 3) // 4), np.uint8)
        data = np.frombuffer(stream.read(size), np.uint8)
        yield [int(d) if v else None for d, v in zip(doc_ids.tolist(), valid.tolist())], lengths, table[unpack(control, data, n)]


def _open(root: str, name: str | None = None):
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    if name is None:
        store.create_dir(base, recursive=True)
    return store, base


def write_token_files(docs: DataFrame, root: str, vocabulary: str = VOCABULARY, end_id: int = 0, added_as_text: bool = False) -> DataFrame:
    """Encode and write; returns the manifest (part, seq, file, n_tokens), whose order is that of the documents.

    A task that is run again writes files of new names; only those in the committed manifest count.
    """
    path = public_tokenizers.path(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        store, base = _open(root)
        out, name, in_file = None, "", 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0
        done = {"part": [], "seq": [], "file": [], "n_tokens": []}

        def flush(last: bool) -> None:
            nonlocal out, name, in_file, doc_ids, ids, held, seq
            if ids:
                if out is None:
                    name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tids"
                    out = store.open_output_stream(f"{base}/{name}")
                    out.write(MAGIC)
                out.write(block_bytes(doc_ids, ids))
                in_file += held
                doc_ids, ids, held = [], [], 0
            if out is not None and (last or in_file >= FILE_IDS):
                out.close()
                for k, v in (("part", part), ("seq", seq), ("file", name), ("n_tokens", in_file)):
                    done[k].append(v)
                out, in_file, seq = None, 0, seq + 1

        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), encoder(path, added_as_text).encode_texts(texts)):
                doc_ids.append(doc_id)
                ids.append(np.append(got, end))
                held += len(got) + 1
                if held >= BLOCK_IDS:
                    flush(False)
        flush(True)
        if done["file"]:
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k == "file" else pa.int64()) for k, v in done.items()})

    # The hash and the row's own number part rows of one id, or of none, so that they do not all meet in one task.
    order = [F.col("doc_id").asc_nulls_first(), "at", "row"]
    numbered = docs.select("doc_id", "text", F.xxhash64("text").alias("at"), F.monotonically_increasing_id().alias("row"))
    ordered = numbered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return settle(ordered.mapInArrow(write, "part bigint, seq bigint, file string, n_tokens bigint"), "token-manifest")


def file_starts(manifest: DataFrame) -> DataFrame:
    """(file, file_start): the ids of all files before it. The window runs over one row for each file."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("file_start"))


def read_documents(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, at in zip(frame["file"], frame["file_start"]):
                store, base = _open(root, name)
                with store.open_input_stream(f"{base}/{name}", buffer_size=1 << 20) as stream:
                    for doc_ids, lengths, ids in read_blocks(stream):
                        stop = np.cumsum(lengths, dtype=np.int64)
                        begin = stop - lengths
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist())]
                        yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": begin + at, "n_tokens": lengths.astype(np.int64), "ids_crc32": np.array(crc, np.int64)})
                        at += int(stop[-1])

    files = max(1, manifest.count())
    return file_starts(manifest).repartition(min(files, 8 * spark.sparkContext.defaultParallelism), "file").mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenize_to_files(docs: DataFrame, root: str | None = None, vocabulary: str = VOCABULARY, end_id: int = 0, added_as_text: bool = False) -> tuple[str, DataFrame]:
    root = root or shared_dir(docs.sparkSession, "token-ids")
    return root, write_token_files(docs, root, vocabulary, end_id, added_as_text)
