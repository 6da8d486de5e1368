"""Importance resampling towards a target distribution, by hashed n-gram features.

1. Texts are taken in bounded chunks. A chunk's words get ids, and a suffix array over the ids, sorted to the depth of
   the longest feature by doubling, brings equal n-grams next to each other. Common prefixes of neighbours (LCP) cut it
   into runs: each run is one distinct n-gram of the chunk, whose bytes are hashed once, and the bucket id is scattered
   back to all places of the run.
2. A first pass sums the buckets of the whole corpus, and of the target texts. The gain of a bucket is the logarithm
   of the smoothed ratio of its shares, in floored thousandths; there is one gain for each bucket, whose number is fixed.
3. A second pass sums the gains of each document's features: its weight. With fixed Gumbel noise from the document's id
   that is a score, and the highest scores are a draw without replacement by importance.
4. Drawn documents are ranked in parallel: rows are dealt out by ranges of the score and numbered inside of a range,
   and a range starts after the rows of all ranges above it.

Defined results: null texts and texts without words have no features, weight 0, and are never drawn; a null id counts
as an empty string for the noise and comes before other ids among equal scores; rows that repeat an id are documents
of their own, equal ones in any order; no target texts, or no documents, leave all counts 0; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatmetrics.llm.shared import NOT_WORD, hash_spans, runs, settle


@dataclass(frozen=True)
class Settings:
    #: Longest feature in words, number of buckets, seed of the noise.
    longest: int = 1
    buckets: int = 10_000
    seed: int = 2024
    #: Documents with fewer words are not drawn; the share that is drawn, in hundredths.
    least_words: int = 20
    percent: int = 10
    #: Bytes of text in a chunk. A longer text is a chunk of its own.
    chunk: int = 1 << 23


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An id for each word, equal for equal bytes, and the place of one occurrence of each id.

    Words meet by a 64-bit hash and are compared with their first occurrence; should two of them share one, ids come from the bytes.
    """
    _, first, ids = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    like = first[ids]
    same = bool((size == size[like]).all())
    for low in range(0, len(starts), 1 << 18):
        if not same:
            break
        some = slice(low, low + (1 << 18))
        n = size[some]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = bool((data[np.repeat(starts[some], n) + inside] == data[np.repeat(starts[like[some]], n) + inside]).all())
    if not same:
        raw, known = data.tobytes(), {}
        ids = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        first = np.unique(ids, return_index=True)[1]
    return ids, first


def suffix_array(ids: np.ndarray, text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes that start there, compared to ``depth`` words and never beyond their text."""
    n = len(ids)
    rank, known = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        after = np.full(n, -1, np.int64)
        inside = text[known:] == text[: n - known]
        after[: n - known][inside] = rank[known:][inside]
        order = np.lexsort((after, rank))
        fresh = np.ones(n, bool)
        fresh[1:] = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        known *= 2
    return order


def common_prefixes(ids: np.ndarray, text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, how many words it shares with the one before, at most ``depth``."""
    n = len(ids)
    out = np.zeros(n, np.int64)
    same = np.ones(max(n - 1, 0), bool)
    for k in range(depth):
        a, b = order[:-1] + k, order[1:] + k
        inside = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same &= inside & (ids[a] == ids[b]) & (text[a] == text[order[:-1]]) & (text[b] == text[order[1:]])
        out[1:] += same
    return out


def chunk_buckets(texts: list[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, text of each feature, words of each text) of a chunk of lower-cased texts."""
    data = np.frombuffer(b" ".join(texts), np.uint8)  # the mark between texts is no part of a word
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    starts, ends = runs(~NOT_WORD[data]) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    text = np.searchsorted(begin, starts, "right") - 1
    n_words = np.bincount(text, minlength=len(texts)).astype(np.int64)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    ids, first = word_ids(data, starts, ends)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    order = suffix_array(ids, text, settings.longest)
    shared = common_prefixes(ids, text, order, settings.longest)
    buckets, owners = [], []
    for size in range(1, settings.longest + 1):
        whole = order + size <= n
        whole[whole] = text[order[whole] + size - 1] == text[order[whole]]
        # Suffixes shorter than the feature stand before those that it begins; a run goes on where the shared words reach its size.
        places = order[whole]
        head = shared[whole] < size
        heads = places[head]
        grams = [words[i] for i in ids[heads].tolist()] if size == 1 else [b" ".join(words[i] for i in row) for row in ids[heads[:, None] + np.arange(size)].tolist()]
        of_run = np.fromiter((zlib.crc32(g) % settings.buckets for g in grams), np.int64, len(grams))
        buckets.append(of_run[np.cumsum(head) - 1])
        owners.append(text[places])
    return np.concatenate(buckets), np.concatenate(owners), n_words


def chunks(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.Table]:
    """Rows in tables whose texts are about as long as a chunk."""
    held, size = [], 0
    for batch in batches:
        lengths = np.array([len(t) if t is not None else 0 for t in batch.column("text").to_pylist()], np.int64)
        edges = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = edges[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(edges, before + settings.chunk - size, "right")))
            stop = min(stop, batch.num_rows)
            held.append(batch.slice(at, stop - at))
            size += int(edges[stop - 1] - before)
            at = stop
            if size >= settings.chunk or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _lowered(table: pa.Table) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in table.column("text").to_pylist()]


def bucket_counts(texts: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, n) of all features of ``text``; a task hands on one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for table in chunks(batches, settings):
            total += np.bincount(chunk_buckets(_lowered(table), settings)[0], minlength=settings.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    return texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, settings: Settings) -> np.ndarray:
    """The gain of each bucket, in floored thousandths of the logarithm."""
    counts = []
    for texts in (corpus, target):
        n = np.zeros(settings.buckets)
        for r in bucket_counts(texts, settings).collect():  # one row for each bucket at most
            n[r["bucket"]] = r["n"]
        counts.append(n)
    s, t = counts
    ratio = (t + 1) * (s.sum() + settings.buckets) / ((s + 1) * (t.sum() + settings.buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, settings: Settings) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, settings):
            bucket, owner, n_words = chunk_buckets(_lowered(table), settings)
            weight = np.zeros(table.num_rows, np.int64)
            np.add.at(weight, owner, shared.value[bucket])
            n_features = np.bincount(owner, minlength=table.num_rows).astype(np.int64)
            out = pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n_words), "n_features": pa.array(n_features), "weight": pa.array(weight)})
            yield from out.combine_chunks().to_batches()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3... by falling score, then by id, as far as ``drawn``; null for the others.

    Equal rows are counted and ranked together and written out again afterwards, in blocks, so that no range is all ties.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("copies"))
    in_play = counted.where("eligible").repartitionByRange(F.desc("score"), F.asc_nulls_first("doc_id")).withColumn("range", F.spark_partition_id())
    placed = settle(in_play, "score-ranges")
    of_range = placed.groupBy("range").agg(F.sum("copies").alias("n"))  # a row for each partition
    offsets = F.broadcast(of_range.select(F.col("range").alias("at"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("above")))
    inside = Window.partitionBy("range").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "weight", "n_features").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumn("upto", F.sum("copies").over(inside)).join(offsets, F.col("range") == F.col("at")).withColumn("first", F.col("above") + F.col("upto") - F.col("copies") + 1)
    every = numbered.select(*columns, "copies", "first").unionByName(counted.where("NOT eligible").withColumn("first", F.lit(None).cast("bigint")))
    block = 4096
    blocks = every.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / block))))
    copy = F.explode(F.sequence(F.col("block") * block, F.least(F.col("copies"), (F.col("block") + 1) * block) - 1))
    rank = F.col("first") + F.col("copy")
    return blocks.withColumn("copy", copy).select(*columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``docs``; ``target`` has its texts in ``text_column`` too."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    gain = gains(rows, target.select(F.col(text_column).alias("text")), settings)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = weigh(rows, gain, settings).withColumn("score", score.cast("bigint")).withColumn("eligible", F.col("n_words") >= settings.least_words).drop("n_words")
    kept = settle(scored, "scores")
    drawn = settings.percent * kept.where("eligible").count() // 100
    return ranked(kept, drawn).select("doc_id", "n_features", "weight", "score", "rank")
