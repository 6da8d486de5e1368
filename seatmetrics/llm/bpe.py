"""Byte-level BPE by a segment tree over byte positions, and decoding, over whole texts.

Each pretoken of the published pattern is encoded on its own. The leaf of a byte position holds the rank of the
pair that starts there; inner nodes hold the leftmost least rank below them. A merge changes the leaves of the
live neighbours only, each in logarithmic time, so a pretoken of a million bytes costs n log n. Distinct
pretokens are encoded once in a worker and copied by index.

Defined results: null counts as empty text, which has no ids; texts of any length are encoded whole; repeated
rows and further columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from seatmetrics.llm.pretokens import PretokenCache
from seatmetrics.llm.shared import slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_loaded: dict[str, tuple] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pretoken; a pretoken that is itself a token is taken whole."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    none = (1 << 40) * size
    tree = [none] * (2 * size)
    for i in range(n - 1):
        if (rank := ranks.get(piece[i : i + 2])) is not None:
            tree[size + i] = rank * size + i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    # stop[i]: the end of the live part that starts at i; before[j]: the start of the part that ends at j.
    stop = list(range(1, n + 1))
    before = list(range(-1, n))

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    def pair(i: int) -> int:
        middle = stop[i]
        if middle >= n:
            return none
        rank = ranks.get(piece[i : stop[middle]])
        return none if rank is None else rank * size + i

    while tree[1] < none:
        i = tree[1] % size
        middle = stop[i]
        end = stop[middle]
        stop[i] = end
        before[end] = i
        if middle < n - 1:
            put(middle, none)
        if i < n - 1:
            put(i, pair(i))
        if i:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


class Codec:
    """Encoder and decoder of one rank file, with the worker's cache."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.cache = PretokenCache(lambda tokens: [encode_piece(t, ranks) for t in tokens], most=600_000, most_bytes=1 << 24)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        return self.cache.encode_texts(texts)

    def decode(self, ids: np.ndarray, block: int = 1 << 20) -> bytes:
        """The bytes of an id sequence, by one gather for each block of ids."""
        out = []
        for k in range(0, len(ids), block):
            part = ids[k : k + block]
            n = self.length[part]
            stop = np.cumsum(n)
            out.append(self.bytes[np.repeat(self.at[part] - (stop - n), n) + np.arange(int(stop[-1]))].tobytes())
        return b"".join(out)


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, column: str = "text", out: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with the ids of each whole text in an integer array column ``out`` in place of any column of that name."""
    path = public_tokenizers.path(vocabulary)
    kept = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = [x.astype(np.int32) for x in codec(path).encode([t or "" for t in batch.column(column).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(out, ArrayType(IntegerType()))]))


def round_trip(docs: DataFrame, id_column: str = "doc_id", column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """For each row: the number of ids, the SHA-256 of the ids as little-endian 32-bit integers, and that of the decoded bytes."""
    path = public_tokenizers.path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for ids in codec(path).encode([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(codec(path).decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_column).cast("bigint"), column).mapInArrow(run, f"{id_column} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
