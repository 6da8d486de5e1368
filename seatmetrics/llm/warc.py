"""WARC archives with one Zstandard dictionary per file.

A file starts with a skippable frame that holds the dictionary, trained on the file's own first records; every
record follows as a frame of its own, so any record can be read alone. Payloads that repeat are written once:
the record with the largest page_id is the response and the others are revisits that refer to it.

Defined results: a null payload counts as empty; rows with a null id are written with the id ``null`` and read
back as null; rows that repeat the winning id and payload are all responses; an empty table writes no file and
reads back as no row; further columns are ignored. Payloads of any length pass through one at a time.

Reading measures what the archive holds: length and digest of a response are those of the payload that came out of
it, and one that differs from its record's head stops the job; ``resolved`` gives a revisit the values of the
response that it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmetrics.llm.shared import settle, shared_dir

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 32 * 1024
#: A dictionary is trained on the first records of a file, at most so many of them and so many bytes.
SAMPLE_RECORDS, SAMPLE_BYTES = 400, 2 << 20
FILE_BYTES = 256 << 20
_MANIFEST = "file string, records bigint, payload_bytes bigint"
_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 40 bits are eight digits of base 32, in the RFC 4648 alphabet."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to (null: a response).

    The winner of each digest comes from a pre-aggregated group-by on digests alone and is read back from files,
    so that the join can split a payload that many pages share.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    shared = rows.where(F.length("payload") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies"))
    winners = settle(shared.where("copies > 1").select(F.col("payload_digest").alias("shared_digest"), "winner"), "warc-winners")
    joined = rows.join(winners, (rows["payload_digest"] == winners["shared_digest"]) & (F.length("payload") >= least_bytes), "left")
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(~F.col("winner").eqNullSafe(F.col("page_id")), F.col("winner")).alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the payload's length in a header and leaves its bytes out."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where the records are too few or too small to train on, their own bytes serve as one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _filesystem(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class _ArchiveFile:
    """One output file: records wait until there are enough to train on, then go straight to the file."""

    def __init__(self, root: str, level: int):
        self.fs, base = _filesystem(root)
        self.name, self.level = f"part-{uuid.uuid4().hex}.warc.zst", level
        self.fs.create_dir(base, recursive=True)
        self.out = self.fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.waiting: list[bytes] = []
        self.compressor = None
        self.held = self.records = self.payload_bytes = 0

    def add(self, record: bytes, payload_bytes: int) -> None:
        self.records += 1
        self.payload_bytes += payload_bytes
        if self.compressor is not None:
            self.out.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if len(self.waiting) >= SAMPLE_RECORDS or self.held >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        dictionary = build_dictionary(self.waiting)
        self.out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        for record in self.waiting:
            self.out.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.compressor is None:
            self.start()
        self.out.close()
        return self.name, self.records, self.payload_bytes


def write_archive(records: DataFrame, root: str, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write planned records below ``root``; returns the manifest (file, records, payload_bytes).

    A task that is run again writes files of new names; only files in the manifest, which Spark commits, count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done = None, []
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[k].as_py() for c in cols)
                file = file or _ArchiveFile(root, level)
                file.add(record_bytes(page_id, url, payload, digest, refers_to, date), len(payload))
                if file.payload_bytes >= FILE_BYTES:
                    done.append(file.close())
                    file = None
        if file is not None:
            done.append(file.close())
        if done:
            yield pa.RecordBatch.from_pydict({n: pa.array([d[k] for d in done], t) for k, (n, t) in enumerate((("file", pa.string()), ("records", pa.int64()), ("payload_bytes", pa.int64())))})

    return settle(records.mapInArrow(write, _MANIFEST), "warc-manifest")


def parse_records(stream) -> Iterator[dict]:
    """Records of an uncompressed WARC stream, one at a time."""
    pending = b""

    def fill(n: int) -> bool:
        nonlocal pending
        while len(pending) < n:
            got = stream.read(max(1 << 16, n - len(pending)))
            if not got:
                return False
            pending += got
        return True

    while fill(1):
        while (end := pending.find(b"\r\n\r\n")) < 0:
            if not fill(len(pending) + 1):
                raise ValueError("a record's head is cut off")
        head = dict(line.split(": ", 1) for line in pending[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
        length = int(head["Content-Length"])
        if not fill(end + 4 + length + 4):
            raise ValueError("a record's block is cut off")
        head["block"], pending = pending[end + 4 : end + 4 + length], pending[end + 8 + length :]
        yield head


def read_file(root: str, name: str) -> Iterator[dict]:
    """All records of one archive file, by the dictionary that it carries."""
    fs, base = _filesystem(root)
    with fs.open_input_stream(f"{base}/{name}", compression=None) as raw:
        magic, size = struct.unpack("<II", raw.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{name} does not start with a dictionary frame")
        dictionary = zstandard.ZstdCompressionDict(raw.read(size))
        with zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw, read_across_frames=True) as stream:
            yield from parse_records(stream)


def payload_of(head: dict) -> bytes:
    """The payload of a response record; an error where its length or digest is not what the record's head says."""
    payload = head["block"].split(b"\r\n\r\n", 1)[1]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if (len(payload), digest) != (int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged: {len(payload)} bytes, {digest}")
    return payload


def read_archive(spark: SparkSession, root: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the manifest's files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit).

    Length and digest of a response are measured on its payload; a revisit has those of its head until it is ``resolved``.
    """

    def number(head: dict, key: str) -> int | None:
        value = head.get(key, "<urn:page:null>")[len("<urn:page:") : -1]
        return None if value == "null" else int(value)

    def rows(files: pd.Series) -> Iterator[tuple]:
        for name in files:
            for head in read_file(root, name):
                payload = payload_of(head) if head["WARC-Type"] == "response" else None
                size, digest = int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                yield number(head, "WARC-Record-ID"), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], number(head, "WARC-Refers-To"), payload if with_payload else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for row in rows(batch["file"]):
                held.append(row)
                size += 100 + len(row[-1] or b"")
                if size > 8 << 20:
                    yield _frame(held, names)
                    held, size = [], 0
            if held:
                yield _frame(held, names)

    files = max(1, manifest.count())
    spread = manifest.select("file").repartition(min(files, 4 * spark.sparkContext.defaultParallelism), "file")
    return spread.mapInPandas(read, _RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` of an archive with the length and digest of each revisit taken from the response that it refers to.

    A revisit whose response is missing or has another digest stops the job. Responses that others refer to are
    read from files, one for each digest, so that a payload that many pages share can be split.
    """
    records = settle(records, "warc-records")
    wanted = records.where("refers_to IS NOT NULL").select("refers_to", "payload_digest").distinct()
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("held_bytes")).distinct()
    referred = settle(wanted.join(held, ["refers_to", "payload_digest"], "left").select(F.col("refers_to").alias("at"), F.col("payload_digest").alias("at_digest"), "held_bytes"), "warc-referred")
    joined = records.join(referred, (records["refers_to"] == referred["at"]) & (records["payload_digest"] == referred["at_digest"]), "left")
    missing = F.raise_error(F.concat(F.lit("no response with the payload of revisit "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("bigint")
    size = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.coalesce("held_bytes", missing))
    return joined.withColumn("payload_bytes", size).select(*records.columns)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame.from_records(rows, columns=names)
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def archive(pages: DataFrame, root: str | None = None) -> tuple[str, DataFrame]:
    """Plan, write and give (root, manifest)."""
    root = root or shared_dir(pages.sparkSession, "warc")
    return root, write_archive(plan_records(pages), root)
