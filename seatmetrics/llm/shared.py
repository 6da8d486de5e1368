"""Folders shared by all executors, and vectorised byte-text helpers used by several operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path under the cluster's shared folder ``spark.checkpoint.dir``.

    Where that setting is missing, a local session (as in tests) uses a folder of this process; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = current or "file://" + tempfile.mkdtemp(prefix="seatmetrics-")
        if not current:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan restarts from files that survive executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of a few rows, so that what is made of them in Python stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x1000193 & _MASK))


_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_BYTES = seeded(256, 11)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out)
    return _powers


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` from one prefix sum, whatever the number of spans; ``values`` has a word for each symbol."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def byte_table(keep: bytes) -> np.ndarray:
    """A lookup table that is true for the bytes in ``keep``."""
    table = np.zeros(256, bool)
    table[list(keep)] = True
    return table


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


#: Words by white space, as bytes.split() has it; and words without ASCII punctuation.
SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
NOT_WORD = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
SEGMENT = 1 << 20


def hashed_words(text: str | None, separators: np.ndarray) -> np.ndarray:
    """A hash for each word of the whole text, A-Z in lower case; long texts are taken in bounded segments."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and not separators[data[end]]:
            ahead = np.flatnonzero(separators[data[end : end + SEGMENT]])
            end = end + int(ahead[0]) if len(ahead) else min(len(data), end + SEGMENT)
        part = data[at:end]
        out.append(hash_spans(part, *runs(~separators[part])))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
