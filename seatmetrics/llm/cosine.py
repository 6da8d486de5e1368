"""Near-duplicate vectors by random-hyperplane signs in several tables, exact cosines and connected components.

1. Equal vectors of a label form one class, so copies are never paired. A class gets a signature: the signs of its
   projections on many random hyperplanes. Each table takes some of these bits as its bucket key; the number of
   bits follows the number of classes, and the number of tables follows from the recall that a pair exactly at the
   threshold must reach.
2. Ids and the first bits of the signatures, not vectors, meet in the buckets, in pairs of bounded blocks. There a
   pair is a candidate if these bits differ in no more places than those of a pair at the threshold do, but for a
   chance of ``1 - recall`` at most; a class goes on with a bucket only if it has a candidate there.
3. Vectors are sent to these places only. One matrix product for a pair of blocks gives all cosines in double
   precision, and a pair counts in the first table whose bits agree. A block returns sums of links for each class and
   a spanning forest, never its pairs.
4. Components of the confirmed links, by alternating large-star and small-star.

A link at the threshold is missed with a chance of twice ``1 - recall`` at most; vectors nearer than that more seldom.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null
label or a null id, link with nothing and are kept if they have an id; labels of any type are compared as they are; vectors of different length link with nothing;
rows with the same vec_id are vectors of their own; vectors of any length are compared whole; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.llm.blocks import block_pairs, sorted_groups, together
from seatmetrics.llm.components import components
from seatmetrics.llm.shared import mix, settle


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.93
    recall: float = 0.9995
    block: int = 1024
    seed: int = 41
    broadcast_rows: int = 100_000
    bucket: int = 512
    #: Bits of a signature that are sent to the buckets.
    sent: int = 192

    def shape(self, classes: int) -> Shape:
        """About ``bucket`` classes to a bucket before labels part them, tables enough for the recall, and a signature that holds all their bits and those that are sent."""
        apart = math.acos(self.threshold) / math.pi
        bits = min(30, max(4, math.ceil(math.log2(max(classes, 2) / self.bucket))))
        same = (1 - apart) ** bits
        tables = math.ceil(math.log(1 - self.recall) / math.log(1 - same))
        size = -(-max(self.sent, bits * tables) // 64) * 64
        # The least number of differing bits that a pair at the threshold exceeds with a chance below 1 - recall.
        chance, most = (1 - apart) ** self.sent, 0
        total = chance
        while total < self.recall:
            chance *= (self.sent - most) / (most + 1) * apart / (1 - apart)
            most += 1
            total += chance
        return Shape(bits, tables, size, self.sent, most)


@dataclass(frozen=True)
class Shape:
    """Bits of a key, tables, bits of a signature, how many of them are sent, and in how many of these a candidate may differ."""

    bits: int
    tables: int
    size: int
    sent: int
    most: int


def usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.coalesce(label.isNotNull() & finite & some, F.lit(False))


def signatures(vectors: np.ndarray, shape: Shape, seed: int) -> np.ndarray:
    """(rows, bytes) signs of the projections of unit vectors, a bit each."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], shape.size))
    return np.packbits(vectors @ planes > 0, axis=1)


def table_bits(signature: np.ndarray, shape: Shape, tables: int) -> np.ndarray:
    """(rows, tables) the bits that each of the first tables takes of a signature, or of its beginning."""
    signs = np.unpackbits(signature, axis=1)[:, : shape.bits * tables].reshape(len(signature), tables, shape.bits)
    return (signs * (np.uint64(1) << np.arange(shape.bits, dtype=np.uint64))).sum(2, dtype=np.uint64)


def bucket_keys(signature: np.ndarray, label: np.ndarray, length: int, shape: Shape) -> np.ndarray:
    """(rows, tables) bucket keys; the key also holds the label, the vectors' length and, in its last two bytes, the table."""
    table = np.arange(shape.tables, dtype=np.uint64)
    salt = mix((table + np.uint64(1))[None, :] * np.uint64(0x9E3779B97F4A7C15) + mix(label.astype(np.int64).view(np.uint64) + np.uint64(length))[:, None])
    return ((mix(table_bits(signature, shape, shape.tables) + salt) & ~np.uint64(0xFFFF)) | table[None, :]).view(np.int64)


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(len(column), -1).astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # squares of very large or small components leave the range of doubles
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def signed_classes(classes: DataFrame, shape: Shape, settings: Settings) -> DataFrame:
    """Classes with their signature and the array ``keys`` of their bucket keys; labels of any type enter the keys by ``label_hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length in set(batch.column("length").to_pylist()):
                part = batch.filter(pc.equal(batch.column("length"), length))
                label = part.column("label_hash").to_numpy(zero_copy_only=False)
                signs = signatures(_unit(part.column("vector")), shape, settings.seed)
                kept = {c: part.column(c) for c in ("node", "copies", "label", "vector")}
                yield pa.RecordBatch.from_pydict({**kept, "signature": pa.array([x.tobytes() for x in signs], pa.binary()), "keys": pa.array(list(bucket_keys(signs, label, length, shape)), pa.list_(pa.int64()))})

    return classes.mapInArrow(run, f"node bigint, copies bigint, label {classes.schema['label'].dataType.simpleString()}, vector {classes.schema['vector'].dataType.simpleString()}, signature binary, keys array<bigint>")


def without_earlier(pairs: np.ndarray, signature: np.ndarray, table: int, shape: Shape) -> None:
    """Take the pairs out whose bits agree in an earlier table, as far as ``signature`` holds its bits."""
    tables = min(table, signature.shape[1] * 8 // shape.bits)
    if not tables or not pairs.any():
        return
    taken = table_bits(signature, shape, tables)
    left, right = np.nonzero(pairs)
    for at in range(0, len(left), 1 << 16):
        i, j = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
        earlier = (taken[i] == taken[j]).any(1)
        pairs[i[earlier], j[earlier]] = False


def of_two_blocks(pairs: np.ndarray, group: pa.Table) -> None:
    """Take out a row's pair with itself, and pairs of one block where two meet."""
    np.fill_diagonal(pairs, False)
    if group.column("pair_a")[0] != group.column("pair_b")[0]:
        own = group.column("own_block").to_numpy()
        pairs &= own[:, None] != own[None, :]


def _table(group: pa.Table) -> int:
    return group.column("bucket")[0].as_py() & 0xFFFF


def candidates(group: pa.Table, shape: Shape) -> np.ndarray:
    """(rows, rows) the candidates of a bucket by the beginnings of their signatures."""
    begin = _bytes(group.column("begin"))
    words = begin.view(np.uint64)
    apart = np.zeros((len(words), len(words)), np.uint16)
    for k in range(words.shape[1]):
        apart += np.bitwise_count(words[:, k, None] ^ words[None, :, k])
    may = apart <= shape.most
    of_two_blocks(may, group)
    without_earlier(may, begin, _table(group), shape)
    return may


def meeting_places(signed: DataFrame, shape: Shape, settings: Settings) -> DataFrame:
    """(node, bucket, pair_a, pair_b, own_block) of each class in each pair of blocks in which it has a candidate."""
    placed = signed.select("node", F.substring("signature", 1, shape.sent // 8).alias("begin"), F.explode("keys").alias("bucket"))
    counts = settle(placed.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > settings.block), "large-buckets")
    if large := counts.count():
        big = counts.select(F.col("bucket").alias("at"), "members")
        sized = placed.join(F.broadcast(big) if large <= settings.broadcast_rows else big, placed["bucket"] == big["at"], "left").withColumn("members", F.coalesce("members", F.lit(1))).drop("at")
    else:
        sized = placed.withColumn("members", F.lit(1))
    keys = ["bucket", "pair_a", "pair_b"]
    rows = together(block_pairs(sized, "bucket", "members", "node", settings.block).select(*keys, "own_block", "node", "begin"), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            if group.num_rows > 1:
                if (some := candidates(group, shape).any(1)).any():
                    yield from group.select(["node", *keys, "own_block"]).filter(pa.array(some)).combine_chunks().to_batches()

    return settle(rows.mapInArrow(run, "node bigint, bucket bigint, pair_a int, pair_b int, own_block int"), "vector-meetings")


def _links(group: pa.Table, shape: Shape, settings: Settings) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Ids with their sums of links, and a spanning forest, of one pair of blocks of one bucket."""
    ids = group.column("node").to_numpy()
    copies, label = group.column("copies").to_numpy(), group.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    vectors = _unit(group.column("vector"))
    near = (vectors @ vectors.T >= settings.threshold) & (label[:, None] == label[None, :])
    of_two_blocks(near, group)
    without_earlier(near, _bytes(group.column("signature")), _table(group), shape)
    sums = near @ copies
    edges = []
    fresh = near.any(1)
    while fresh.any():
        root = int(np.argmax(fresh))
        front = np.array([root])
        fresh[root] = False
        while len(front):
            front = np.flatnonzero(near[front].any(0) & fresh)
            fresh[front] = False
            edges += [(int(ids[root]), int(ids[k])) for k in front.tolist()]
    linked = np.flatnonzero(sums)
    return ids[linked], sums[linked], edges


def bucket_links(signed: DataFrame, shape: Shape, settings: Settings) -> DataFrame:
    """Rows (a, b, n): b null for n links of a, else an edge of a spanning forest."""
    places = meeting_places(signed, shape, settings)
    keys = ["bucket", "pair_a", "pair_b"]
    rows = together(places.join(signed.drop("keys"), "node").select(*keys, "own_block", "node", "copies", "label", "signature", "vector"), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        edges: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            a = [*total, *(x for x, _ in edges)]
            b = [None] * len(total) + [y for _, y in edges]
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([*total.values(), *[0] * len(edges)], pa.int64())})

        for group in sorted_groups(batches, keys):
            ids, sums, found = _links(group, shape, settings)
            for i, n in zip(ids.tolist(), sums.tolist()):
                total[i] = total.get(i, 0) + n
            edges += found
            if len(total) + len(edges) > 100_000:
                yield out()
                total.clear()
                edges.clear()
        yield out()

    return settle(rows.mapInArrow(run, "a bigint, b bigint, n bigint"), "vector-links")


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label", settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    single = vectors.schema[column].dataType.simpleString() == "array<float>"  # half as much to send; cosines are taken in doubles
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(label).alias("label"), F.col(column).cast("array<float>" if single else "array<double>").alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("vector"), F.col("label")) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("class_key", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.length(F.col("label").cast("string")), F.col("label").cast("string"), F.transform("vector", lambda x: (x.cast("double") + F.lit(0.0)).cast("string"))), 256)))
    grouped = rows.where("ok").groupBy("class_key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    # A class is known by a number of its own, as ids may repeat; the number is made where the classes are written.
    classes = settle(grouped.withColumn("length", F.size("vector")).withColumn("label_hash", F.xxhash64("label")).withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    shape = settings.shape(classes.count())
    signed = settle(signed_classes(classes, shape, settings), "vector-signatures")
    found = bucket_links(signed, shape, settings)
    counted = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("node"), "n")
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    known = settle(classes.select("class_key", "node", "rep", "copies").join(counted, "node", "left").join(joined, "node", "left"), "vector-components")
    least = settle(known.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("smallest")).select(F.col("component").alias("of"), "smallest"), "vector-names")
    named = known.join(least, F.col("component") == F.col("of"), "left")
    named = settle(named.select(F.col("class_key").alias("at"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "rep").alias("component")), "named-vectors")
    out = rows.select("vec_id", "class_key").join(named, F.col("class_key") == F.col("at"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
