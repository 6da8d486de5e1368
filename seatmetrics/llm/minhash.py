"""Near-duplicate documents by universal-hash minima, banding, signature verification and exact confirmation.

1. Each whole text becomes the set of its word shingles (64-bit hashes), the minima of many universal hash
   functions over it, and the keys of the bands of those minima.
2. Documents of equal sets form one class, so copies are never paired with each other.
3. Classes that share a band key with others are joined into candidate clusters, by one edge from each member to
   the smallest of its bucket: as many edges as members, whatever the bucket's size.
4. Each member is confirmed on the full sets against one hub, the smallest class that it shares most buckets with.
   Members of a hub come in blocks, each with the hub's text, so a group of near copies costs as much as its size.
5. Where that leaves a cluster in several parts, its texts meet in pairs of bounded blocks, but for the pairs of two
   blocks of the largest part. There, pairs of different parts whose signatures agree enough are confirmed on the
   full sets. All links between different texts that banding found are thus tried, unless confirmed links already
   connect their ends.
6. Components of the confirmed links, by alternating large-star and small-star.

A link is missed where no band agrees, or in step 5 where a pair's signatures agree less than ``least_agreement``: by
the binomial law a pair at the similarity does so with a chance below 10^-5. All that is linked is confirmed exactly.

Defined results: null text and text without words have an empty set, link with nothing and are kept; fewer words
than a shingle make one shingle; rows with the same doc_id are documents of their own, all kept or none of one
component; rows without an id take part but never name a component and are not kept; a component of such rows only has
no id; texts of any length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmetrics.llm.blocks import Forest, sorted_groups, together
from seatmetrics.llm.components import components
from seatmetrics.llm.shared import SPACE, hashed_words, mix, seeded, settle, slices


@dataclass(frozen=True)
class Settings:
    """Shingle width, the similarity as a fraction of whole numbers, and the signature's shape.

    With 24 bands of 5 minima a pair at similarity 0.85 shares a band with probability 0.999999, at 0.8 with 0.9999.
    """

    width: int = 3
    above: int = 85
    below: int = 100
    bands: int = 24
    rows: int = 5
    block: int = 256
    hub_block: int = 128
    #: Roles of classes (about 60 bytes each) that are sent to the texts; more are joined by a shuffle.
    broadcast_rows: int = 200_000

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreement(self) -> float:
        """Pairs of signatures that agree less are not confirmed: four and a half standard errors below the similarity."""
        s = self.above / self.below
        return s - 4.5 * (s * (1 - s) / self.size) ** 0.5


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the whole text."""
    words = hashed_words(text, SPACE)
    n = len(words)
    if not n:
        return words
    span = min(n, width)
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - span + 1 + k])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Minima of ``size`` multiply-shift functions over a set, as 32-bit values."""
    a, b = seeded(size, 21) | np.uint64(1), seeded(size, 22)
    out = np.full(size, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024]
        np.minimum(out, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(1), out=out)
    return out.astype(np.uint32)


def band_keys(minima: np.ndarray, bands: int) -> np.ndarray:
    rows = minima.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def sketch(docs: DataFrame, id_column: str, column: str, settings: Settings) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, set_key, bands for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, keys, bands = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_set(text, settings.width)
                n.append(len(hashes))
                keys.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                bands.append(band_keys(signature(hashes, settings.size), settings.bands) if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_shingles", "set_key", "bands"])

    rows = docs.select(F.col(id_column).cast("bigint"), F.col(column), F.xxhash64(F.col(column)).alias("text_key"))
    return settle(rows.mapInArrow(run, "doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, bands array<bigint>"), "sketch")


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each set: its number ``rep``, the least id of its documents, the text of one of them by its hash, and the bands.

    Ids may repeat or be missing, so classes are known by numbers that are made where they are written.
    """
    filled = rows.where("n_shingles > 0")
    text_key = F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key"))
    grouped = filled.groupBy("set_key").agg(F.min("doc_id").alias("least_id"), text_key.alias("text_key"), F.first("bands").alias("bands"))
    return settle(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")


def any_repeated(rows: DataFrame) -> bool:
    """Whether two rows have the same id, or none, and the same text."""
    return not rows.where("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def bucket_edges(classes: DataFrame) -> DataFrame:
    """(a, b, shared): from each member of a band's bucket to its smallest member, and in how many bands."""
    keyed = classes.select("rep", F.explode("bands").alias("bucket"))
    centres = keyed.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("largest"))
    centres = settle(centres.where("centre <> largest").select(F.col("bucket").alias("at"), "centre"), "buckets")
    edges = keyed.join(centres, keyed["bucket"] == centres["at"]).where("rep <> centre")
    return settle(edges.groupBy(F.col("rep").alias("a"), F.col("centre").alias("b")).agg(F.count("*").alias("shared")), "bucket-edges")


def _alike(a: np.ndarray, b: np.ndarray, settings: Settings) -> bool:
    low, high = sorted((len(a), len(b)))
    if low * settings.below < high * settings.above:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return settings.below * both >= settings.above * (low + high - both)


def _texts(docs: DataFrame, classes: DataFrame, id_column: str, column: str, roles: DataFrame, settings: Settings, repeated: bool) -> DataFrame:
    """``roles`` (rep, ...) with the text of each; they are sent to the texts while they are few enough.

    Where rows repeat an id (or have none) and a text, each task hands on one of them, and one is left of those.
    """
    named = roles.join(classes.select("rep", "least_id", "text_key"), "rep")
    small = roles.count() <= settings.broadcast_rows
    rows = docs.select(F.col(id_column).cast("bigint").alias("own_id"), F.col(column).alias("text")).where(F.col("text").isNotNull())
    found = rows.join(F.broadcast(named) if small else named, rows["own_id"].eqNullSafe(F.col("least_id")) & (F.xxhash64("text") == F.col("text_key")))
    return found.groupBy(*roles.columns).agg(F.first("text").alias("text")) if repeated else found


def hub_links(docs: DataFrame, classes: DataFrame, edges: DataFrame, id_column: str, column: str, settings: Settings, repeated: bool) -> DataFrame:
    """(a, b): each member's link to its hub, where the full sets confirm it."""
    hubs = settle(edges.groupBy(F.col("a").alias("rep")).agg(F.max_by("b", F.struct(F.col("shared"), -F.col("b"))).alias("hub")), "hubs")
    blocks = settle(hubs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(settings.hub_block)).cast("int").alias("blocks")), "hub-sizes")
    members = hubs.join(blocks, "hub").select("rep", "hub", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("bigint")).cast("int").alias("part"), F.lit(False).alias("is_hub"))
    heads = blocks.select(F.col("hub").alias("rep"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(True).alias("is_hub"))
    roles = settle(members.unionByName(heads), "hub-roles")
    keys = ["hub", "part"]
    rows = together(_texts(docs, classes, id_column, column, roles, settings, repeated).select(*keys, "is_hub", "rep", "text"), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for group in sorted_groups(batches, keys):
            head = group.column("is_hub").to_pylist()
            ids, texts = group.column("rep").to_pylist(), group.column("text").to_pylist()
            if True not in head or False not in head:
                continue
            at = head.index(True)
            own = shingle_set(texts[at], settings.width)
            edges += [(i, ids[at]) for i, t, h in zip(ids, texts, head) if not h and _alike(own, shingle_set(t, settings.width), settings)]
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return settle(rows.mapInArrow(run, "a bigint, b bigint"), "hub-links")


def _confirm(group: pa.Table, settings: Settings) -> list[tuple[int, int]]:
    """Spanning forest of the confirmed links between the parts of one pair of blocks."""
    ids, part = group.column("rep").to_numpy(), group.column("part").to_numpy()
    if len(ids) < 2 or part.min() == part.max():
        return []
    own = group.column("own_block").to_numpy()
    sets = [shingle_set(t, settings.width) for t in group.column("text").to_pylist()]
    minima = np.stack([signature(s, settings.size) for s in sets])
    size = np.array([len(s) for s in sets])
    across = own.min() != own.max()
    least = int(np.ceil(settings.least_agreement * settings.size))
    found = []
    for i in range(len(ids) - 1):
        agree = (minima[i + 1 :] == minima[i]).sum(1)
        may = (agree >= least) & (part[i + 1 :] != part[i])
        if across:
            may &= own[i + 1 :] != own[i]
        j = np.flatnonzero(may)
        found.append((agree[j], np.full(len(j), i), j + i + 1))
    agree, left, right = (np.concatenate(x) for x in zip(*found))
    forest, edges = Forest(len(ids)), []
    _, first, of = np.unique(part, return_index=True, return_inverse=True)
    for i, k in enumerate(first[of.reshape(-1)].tolist()):
        forest.join(i, k)
    for k in np.argsort(-agree, kind="stable").tolist():
        i, j = int(left[k]), int(right[k])
        if forest.root(i) != forest.root(j) and _alike(sets[i], sets[j], settings):
            forest.join(i, j)
            edges.append((int(ids[i]), int(ids[j])))
    return edges


def open_clusters(clusters: DataFrame, linked: DataFrame) -> DataFrame:
    """Members of the clusters that confirmed links leave in parts: rep, cluster, part, whether it is of the largest one, and how many are and are not."""
    rows = settle(clusters.join(linked, "rep", "left").select("rep", "cluster", F.coalesce("part", "rep").alias("part")), "parts")
    sizes = rows.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max_by("part", F.struct(F.col("n"), -F.col("part"))).alias("core"), F.max("n").alias("core_n"), (F.sum("n") - F.max("n")).alias("rest_n"))
    largest = settle(largest.where("rest_n > 0"), "open-clusters")
    return settle(rows.join(largest, "cluster").withColumn("in_core", F.col("part") == F.col("core")).drop("core"), "open-members")


def part_blocks(members: DataFrame, block: int) -> DataFrame:
    """``members`` once for each pair of blocks that they meet in: the largest part's blocks never meet each other."""
    core, rest = (F.ceil(F.col(c) / F.lit(block)).cast("int") for c in ("core_n", "rest_n"))
    small = F.col("core_n") + F.col("rest_n") <= block
    mix_id = F.xxhash64(F.col("rep"), F.lit(17))
    own = F.when(small, F.lit(0)).when(F.col("in_core"), F.pmod(mix_id, core.cast("bigint")).cast("int")).otherwise(core + F.pmod(mix_id, rest.cast("bigint")).cast("int"))
    others = F.when(small, F.array(F.lit(0))).when(F.col("in_core"), F.sequence(core, core + rest - 1)).otherwise(F.sequence(F.lit(0), core + rest - 1))
    spread = members.withColumn("own_block", own).withColumn("other_block", F.explode(others))
    return spread.select("rep", "cluster", "part", "own_block", F.least("own_block", "other_block").alias("pair_a"), F.greatest("own_block", "other_block").alias("pair_b"))


def part_links(docs: DataFrame, classes: DataFrame, members: DataFrame, id_column: str, column: str, settings: Settings, repeated: bool) -> DataFrame:
    """(a, b): confirmed links between the parts of each open cluster, a spanning forest of each pair of blocks."""
    keys = ["cluster", "pair_a", "pair_b"]
    rows = _texts(docs, classes, id_column, column, settle(part_blocks(members, settings.block), "part-blocks"), settings, repeated)
    grouped = together(rows.select(*keys, "own_block", "part", "rep", "text"), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for group in sorted_groups(batches, keys):
            edges += _confirm(group, settings)
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return settle(grouped.mapInArrow(run, "a bigint, b bigint"), "part-links")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``, and text_key, the hash of its text."""
    rows = sketch(docs, id_column, column, settings)
    classes, repeated = classes_of(rows), any_repeated(rows)
    edges = bucket_edges(classes)
    clusters = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    links = hub_links(docs, classes, edges, id_column, column, settings, repeated)
    linked = components(links).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    members = open_clusters(clusters, linked)
    if members.take(1):
        more = part_links(docs, classes, members, id_column, column, settings, repeated)
        linked = components(links.unionByName(more)).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    known = settle(classes.select("set_key", "rep", "least_id").join(linked, "rep", "left"), "parted")
    least = settle(known.where("part IS NOT NULL").groupBy("part").agg(F.min("least_id").alias("part_id")).select(F.col("part").alias("of"), "part_id"), "part-names")
    named = known.join(least, F.col("part") == F.col("of"), "left").select(F.col("set_key").alias("class_key"), F.when(F.col("part").isNull(), F.col("least_id")).otherwise(F.col("part_id")).alias("component"))
    named = settle(named, "named")
    out = rows.select("doc_id", "n_shingles", "set_key", "text_key").join(named, (rows["set_key"] == named["class_key"]) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "text_key")
