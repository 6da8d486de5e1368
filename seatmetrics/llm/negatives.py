"""Hard negatives by exact search over k-means inverted lists with stored radii.

1. Components become whole numbers. Equal vectors of a label form one class, which keeps only as many of its smallest ids
   as an answer can hold, so copies are never searched twice and no answer changes.
2. Centroids are fitted by k-means on a bounded sample; every class goes to the list of its nearest centroid, and a list's
   radius, the largest distance in it, is stored. Lists are written as packed blocks of bounded size.
3. A query has slots, each with a window of scores and a number of answers. By Cauchy-Schwarz no score in a list
   exceeds ``q.c + |q| r`` nor falls below ``q.c - |q| r``. In rounds a query visits its next lists by falling upper
   bound, skips those that cannot meet a window, and stops where the bound falls strictly below the kth score of every
   slot. A round is a join of (list, query) pairs, packed in blocks of queries, with the blocks of the lists.
4. First every query (a class that holds an anchor) looks for its positives, then for the negatives in the window of
   each of its distinct positive scores. Anchors take the answers of their class; an anchor is no positive of its own.

Scores are exact: products are taken in floats only where Cauchy-Schwarz proves that all partial sums are whole numbers
which these hold, else in 64-bit integers; numbers beyond 56 bits stop the job with an error.

Defined results: rows with a null id, a null label, a null or empty vector, or any null or non-finite component take no
part; labels are compared as they are; vectors of different lengths never meet; rows equal in id,
label and vector count once; other rows of one id are rows of their own, but never positives of that id; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatmetrics.llm.blocks import sorted_groups, together
from seatmetrics.llm.shared import mix, settle, slices


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    #: A negative's score lies between these hundredths of the positive's.
    low: int = 50
    high: int = 95
    #: Vectors to a list, most lists, most vectors and bytes of the sample that centroids are fitted on (and of the centroids).
    list_size: int = 512
    most_lists: int = 1024
    sample: int = 20_000
    sample_bytes: int = 1 << 25
    #: Bytes of a packed block of a list or of queries, taken as 64-bit numbers.
    block_bytes: int = 1 << 20
    query_bytes: int = 1 << 18
    #: Lists in a query's first round and the growth from round to round.
    first: int = 16
    growth: int = 8
    #: Pairs of a round are sent to all executors if they have no more bytes than this, else they are shuffled.
    broadcast_bytes: int = 1 << 25


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & (F.size(vector) > 0), F.lit(False))


def pack(matrix: np.ndarray) -> bytes:
    """Whole numbers as bytes, two each where all are small enough, else eight."""
    small = not matrix.size or int(np.abs(matrix).max()) < 1 << 15
    return matrix.astype("<i2" if small else "<i8").tobytes()


def unpack(packed: list[bytes], length: int) -> np.ndarray:
    """(rows, length) 64-bit numbers of rows that were packed one by one."""
    if len({len(p) for p in packed}) == 1:
        return np.frombuffer(b"".join(packed), "<i2" if len(packed[0]) == 2 * length else "<i8").reshape(len(packed), length).astype(np.int64)
    return np.stack([np.frombuffer(p, "<i2" if len(p) == 2 * length else "<i8").astype(np.int64) for p in packed])


def unpack_block(packed: bytes, rows: int, length: int) -> np.ndarray:
    return np.frombuffer(packed, "<i2" if len(packed) == 2 * length * rows else "<i8").reshape(rows, length).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two matrices of whole numbers, exact."""
    largest = math.sqrt(float((a.astype(np.float64) ** 2).sum(1).max())) * math.sqrt(float((b.astype(np.float64) ** 2).sum(1).max()))
    if largest < 1 << 23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if largest < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest < 1 << 56:
        return a @ b.T
    raise ValueError("inner products beyond 56 bits; take a smaller scale")


def whole_numbers(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, length, vector) with each component x of ``v`` as floor(scale * x), packed."""
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(flat) and np.abs(flat).max() >= 1 << 56:
                raise ValueError("components beyond 56 bits; take a smaller scale")
            size = np.diff(batch.column("v").offsets.to_numpy())
            ends = np.cumsum(size)
            whole = flat.astype(np.int64)
            packed = [pack(whole[b - n : b]) for b, n in zip(ends.tolist(), size.tolist())]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "length": pa.array(size, pa.int32()), "vector": pa.array(packed, pa.binary())})

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {id_type}, label {label_type}, length int, vector binary")


def classes_of(vectors: DataFrame, anchor: Column, settings: Settings, id_column: str, column: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Classes (node, label, length, vector, ids) and anchors (anchor_id, node)."""
    element = "float" if vectors.schema[column].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(label).alias("label"), F.col(column).cast(f"array<{element}>").alias("v"), anchor.alias("anchor"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(usable(F.col("v")))
    single = whole_numbers(rows, settings.scale).distinct()
    key = ["label", "length", "vector"]
    most = max(settings.positives + 1, settings.negatives)
    kept = single.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("k") <= most)
    # A class is known by the number that it is written with.
    classes = settle(kept.groupBy(*key).agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("node", F.monotonically_increasing_id()), "classes")
    asked = whole_numbers(rows.where("anchor"), settings.scale).distinct()
    return classes, settle(asked.join(classes.select(*key, "node"), key).select(F.col("vec_id").alias("anchor_id"), "node"), "anchors")


def fit_centroids(classes: DataFrame, settings: Settings, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """k-means on vectors of one length, and each list's share of the sample; the sample, by a hash of the vector, is bounded in rows and bytes."""
    most = max(1, min(settings.sample, settings.sample_bytes // (8 * length)))
    lists = max(1, min(settings.most_lists, n // settings.list_size, most // 8))
    picked = classes.where(F.col("length") == length)
    if n > most:
        picked = picked.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < math.ceil(1.2 * most / n * (1 << 20)))
    rows = [r["vector"] for r in picked.select("vector").limit(most).collect()]
    points = unpack([bytes(r) for r in rows], length).astype(np.float64) if rows else np.zeros((1, length))
    rng = np.random.default_rng(7)
    centroids = points[np.sort(rng.choice(len(points), min(lists, len(points)), replace=False))]
    for _ in range(10):
        near = (points @ centroids.T - (centroids**2).sum(1) / 2).argmax(1)
        count = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids, count / len(points)


def packed_lists(classes: DataFrame, centroids: dict[int, np.ndarray], parts: dict[int, np.ndarray], settings: Settings) -> DataFrame:
    """(length, list, block, far, nodes, labels, vectors): rows of bounded size, with the largest distance in each.

    ``parts`` says in how many parts a list is dealt out; each is cut into blocks as it comes.
    """
    shared = classes.sparkSession.sparkContext.broadcast((centroids, parts))
    label_type = classes.schema["label"].dataType

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            near, far, part = np.zeros(len(size), np.int32), np.zeros(len(size)), np.zeros(len(size), np.int32)
            for length in np.unique(size).tolist():
                own = np.flatnonzero(size == length)
                points, c = unpack(batch.column("vector").take(pa.array(own)).to_pylist(), length).astype(np.float64), shared.value[0][length]
                near[own] = (points @ c.T - (c**2).sum(1) / 2).argmax(1)
                far[own] = np.linalg.norm(points - c[near[own]], axis=1)
                part[own] = mix(batch.column("node").to_numpy()[own].astype(np.uint64)) % shared.value[1][length][near[own]].astype(np.uint64)
            yield batch.append_column("list", pa.array(near)).append_column("far", pa.array(far)).append_column("part", pa.array(part))

    found = classes.select("node", "label", "length", "vector").mapInArrow(nearest, f"node bigint, label {label_type.simpleString()}, length int, vector binary, list int, far double, part int")
    keys = ["length", "list", "part"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            length = group.column("length")[0].as_py()
            most = max(16, settings.block_bytes // (8 * length))
            for at in range(0, group.num_rows, most):
                block = group.slice(at, most).combine_chunks()
                matrix = unpack(block.column("vector").to_pylist(), length)
                label = block.column("label").combine_chunks()
                yield pa.RecordBatch.from_pydict(
                    {
                        **{k: pa.array([block.column(k)[0].as_py()], pa.int32()) for k in keys},
                        "far": pa.array([max(block.column("far").to_pylist())]),
                        "nodes": pa.array([block.column("node").to_pylist()], pa.list_(pa.int64())),
                        "labels": pa.ListArray.from_arrays([0, len(label)], label),
                        "vectors": pa.array([pack(matrix)], pa.binary()),
                    }
                )

    return settle(together(found, keys).mapInArrow(packed, f"length int, list int, part int, far double, nodes array<bigint>, labels array<{label_type.simpleString()}>, vectors binary"), "lists")


#: A query on its way: where it stands in its order of lists, and its slots with window and the scores found so far.
SLOTS = "array<struct<slot: bigint, low: bigint, high: bigint, kth: bigint>>"
FAR = 1 << 62


def next_lists(queries: DataFrame, index: Index, settings: Settings) -> DataFrame:
    """(length, list, part, of, own, points, slots): packed rows of the queries that visit a part of a list in this round.

    ``queries`` has node, label, length, vector, seen (lists already passed), step and slots.
    """
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radius, index.parts))
    label_type = queries.schema["label"].dataType.simpleString()

    def wanted(own: list[dict], length: int) -> dict[int, list[int]]:
        """Lists of this round with the queries that visit them."""
        c, far = shared.value[0][length], shared.value[1][length]
        q = unpack([r["vector"] for r in own], length).astype(np.float64)
        middle, reach = q @ c.T, np.linalg.norm(q, axis=1)[:, None] * far[None, :]
        slack = 1 + 1e-9 * (np.abs(middle) + reach)  # more than rounding can lose
        upper, lower = middle + reach + slack, middle - reach - slack
        order = np.argsort(-upper, axis=1, kind="stable")
        held: dict[int, list[int]] = {}
        for k, r in enumerate(own):
            now = order[k, r["seen"] : r["seen"] + r["step"]]
            visit = np.zeros(len(now), bool)
            for s in r["slots"]:
                visit |= (upper[k, now] >= max(s["low"], s["kth"])) & (lower[k, now] <= s["high"])
            for i in now[visit].tolist():
                held.setdefault(i, []).append(k)
        return held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            rows = batch.to_pylist()
            label_kind, slot_kind = batch.schema.field("label").type, batch.schema.field("slots").type
            for length in {r["length"] for r in rows}:
                own = [r for r in rows if r["length"] == length]
                most = max(16, settings.query_bytes // (8 * length))
                for i, ks in wanted(own, length).items():
                    for at in range(0, len(ks), most):
                        some = [own[k] for k in ks[at : at + most]]
                        n = int(shared.value[2][length][i])
                        one = pa.RecordBatch.from_pydict(
                            {
                                "length": pa.array([length] * n, pa.int32()),
                                "list": pa.array([i] * n, pa.int32()),
                                "part": pa.array(range(n), pa.int32()),
                                "of": pa.array([[p["node"] for p in some]] * n, pa.list_(pa.int64())),
                                "own": pa.array([[p["label"] for p in some]] * n, pa.list_(label_kind)),
                                "points": pa.array([pack(unpack([p["vector"] for p in some], length))] * n, pa.binary()),
                                "slots": pa.array([[p["slots"] for p in some]] * n, pa.list_(slot_kind)),
                            }
                        )
                        yield one

    return queries.select("node", "label", "length", "vector", "seen", "step", "slots").mapInArrow(run, f"length int, list int, part int, of array<bigint>, own array<{label_type}>, points binary, slots array<{SLOTS}>")


def answers(pairs: DataFrame, same: bool, most: int) -> DataFrame:
    """(node, slot, found, score): for each packed pair of queries and list block, the best of each slot's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = {n: batch.column(n)[at] for n in batch.schema.names}
                of, nodes, slots = r["of"].values.to_numpy(), r["nodes"].values.to_numpy(), r["slots"].as_py()
                length = r["length"].as_py()
                score = products(unpack_block(r["points"].as_py(), len(of), length), unpack_block(r["vectors"].as_py(), len(nodes), length))
                code = pa.concat_arrays([r["own"].values, r["labels"].values]).dictionary_encode().indices.to_numpy()
                alike = code[: len(of), None] == code[None, len(of) :]
                least = np.array([min(max(s["low"], s["kth"]) for s in row) for row in slots])
                top = np.array([max(s["high"] for s in row) for row in slots])
                allowed = (score >= least[:, None]) & (score <= top[:, None]) & (alike if same else ~alike)
                yield from _best(score, allowed, slots, of, nodes, most)

    return pairs.select("length", "of", "own", "points", "slots", "nodes", "labels", "vectors").mapInArrow(run, "node bigint, slot bigint, found bigint, score bigint")


def _best(score: np.ndarray, allowed: np.ndarray, slots: list, of: np.ndarray, nodes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for k in np.flatnonzero(allowed.any(1)).tolist():
        places = np.flatnonzero(allowed[k])
        values = score[k, places]
        for s in slots[k]:
            inside = (values >= max(s["low"], s["kth"])) & (values <= s["high"])
            v, p = values[inside], places[inside]
            if len(v) > most:  # all that tie with the last one stay: their ids decide later
                cut = np.partition(v, len(v) - most)[len(v) - most]
                v, p = v[v >= cut], p[v >= cut]
            if len(v):
                out.append((k, s["slot"], nodes[p], v))
    if out:
        n = [len(v) for _, _, _, v in out]
        yield pa.RecordBatch.from_pydict(
            {
                "node": pa.array(np.repeat(of[[k for k, *_ in out]], n), pa.int64()),
                "slot": pa.array(np.repeat(np.array([s for _, s, _, _ in out], np.int64), n), pa.int64()),
                "found": pa.array(np.concatenate([p for _, _, p, _ in out]), pa.int64()),
                "score": pa.array(np.concatenate([v for *_, v in out]), pa.int64()),
            }
        )


@dataclass(frozen=True)
class Index:
    """By length of the vectors: centroids, radii and numbers of parts of the lists; all classes; the packed lists."""

    centroids: dict[int, np.ndarray]
    radius: dict[int, np.ndarray]
    parts: dict[int, np.ndarray]
    classes: DataFrame
    lists: DataFrame

    @property
    def most_lists(self) -> int:
        return max(map(len, self.centroids.values()), default=0)


def build(classes: DataFrame, settings: Settings) -> Index:
    """Centroids, radii and numbers of parts are bounded and live on the driver; lists are files."""
    sizes = {r["length"]: r["n"] for r in classes.groupBy("length").agg(F.count("*").alias("n")).collect()}
    centroids, parts = {}, {}
    for length, n in sizes.items():
        centroids[length], share = fit_centroids(classes, settings, length, n)
        parts[length] = np.maximum(1, np.ceil(share * n / max(16, settings.block_bytes // (8 * length)))).astype(np.int64)
    lists = packed_lists(classes, centroids, parts, settings)
    radius = {length: np.zeros(len(c)) for length, c in centroids.items()}
    for r in lists.groupBy("length", "list").agg(F.max("far").alias("far")).collect():  # a row for each list
        radius[r["length"]][r["list"]] = r["far"] * (1 + 1e-9)
    return Index(centroids, radius, parts, classes, lists)


def search(index: Index, queries: DataFrame, same: bool, most: int, settings: Settings) -> DataFrame:
    """(node, slot, vec_id, score, place): the best ``most`` ids of each slot, exact, by falling score and then by id.

    ``queries`` has node, label, length, vector and slots (slot, low, high, kth = -FAR). ``same`` asks for rows of the
    query's own label, else for those of other labels.
    """
    ids = index.classes.select(F.col("node").alias("found"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("node", "slot").orderBy(F.desc("score"), "vec_id")
    now, kept, seen, step = queries, ids.selectExpr("found AS node", "0L AS slot", "vec_id", "0L AS score", "0 AS place").where("false"), 0, settings.first
    while seen < index.most_lists:
        visits = settle(next_lists(now.withColumn("seen", F.lit(seen)).withColumn("step", F.lit(step)), index, settings), "visits")
        size = visits.agg(F.sum(F.octet_length("points") + 64 * F.size("of") * F.size("slots"))).collect()[0][0] or 0
        few = F.broadcast(visits) if size <= settings.broadcast_bytes else visits
        got = settle(answers(index.lists.join(few, ["length", "list", "part"]), same, most), "answers")
        named = got.join(ids, "found").select("node", "slot", "vec_id", "score")
        every = named.unionByName(kept.drop("place"))
        kept = settle(every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most), "best")
        seen, step = seen + step, step * settings.growth
        if seen < index.most_lists:
            kth = kept.where(F.col("place") == most).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kths")).select(F.col("node").alias("at"), "kths")
            better = F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["low"].alias("low"), s["high"].alias("high"), F.coalesce(F.col("kths")[s["slot"]], s["kth"]).alias("kth")))
            now = settle(now.join(kth, F.col("node") == F.col("at"), "left").withColumn("slots", F.when(F.col("kths").isNull(), F.col("slots")).otherwise(better)).drop("at", "kths"), "queries")
    return kept


def slot(name: Column, low: Column, high: Column) -> Column:
    return F.struct(name.cast("bigint").alias("slot"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), F.lit(-FAR).alias("kth"))


def hard_negatives(vectors: DataFrame, anchor: Column, id_column: str = "vec_id", column: str = "embedding", label: str = "label", settings: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for each row where ``anchor`` holds and each of its positives."""
    classes, anchors = classes_of(vectors, anchor, settings, id_column, column, label)
    index = build(classes, settings)
    asked = classes.join(anchors.select("node").distinct(), "node").select("node", "label", "length", "vector")
    queries = settle(asked.withColumn("slots", F.array(slot(F.lit(0), F.lit(-FAR), F.lit(FAR)))), "queries")
    near = search(index, queries, True, settings.positives + 1, settings)
    first = Window.partitionBy("anchor_id", "node").orderBy(F.desc("score"), "vec_id")
    own = anchors.join(near.select("node", "vec_id", "score"), "node").where("vec_id <> anchor_id").withColumn("place", F.row_number().over(first)).where(F.col("place") <= settings.positives)
    positives = settle(own.select("anchor_id", "node", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # A window of whole numbers; it is empty below zero.
    windows = positives.where("positive_score >= 0").select("node", "positive_score").distinct()
    low, high = F.expr(f"(positive_score * {settings.low} + 99) div 100"), F.expr(f"(positive_score * {settings.high}) div 100")
    wanted = windows.groupBy("node").agg(F.collect_list(slot(F.col("positive_score"), low, high)).alias("slots")).select(F.col("node").alias("at"), "slots")
    harder = settle(queries.drop("slots").join(wanted, F.col("node") == F.col("at")).drop("at"), "queries")
    far = search(index, harder, False, settings.negatives, settings).select("node", F.col("slot").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").alias("rank"))
    return positives.join(far, ["node", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
