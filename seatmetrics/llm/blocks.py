"""Groups of rows in sorted partitions, and large groups cut into pairs of blocks.

A group of at most ``block`` rows is one task's work. A larger one is cut into blocks by a hash of the row's id, and
every pair of blocks is a group of its own, so no task ever holds more than two blocks and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, group: str, size: str, row_id: str, block: int) -> DataFrame:
    """``rows`` once for each pair of blocks that it belongs to, with ``pair_a``, ``pair_b`` and its own ``own_block``."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(row_id), F.lit(17)), blocks.cast("bigint")).cast("int")
    rows = rows.withColumn("own_block", F.when(F.col(size) > block, own).otherwise(F.lit(0)))
    others = F.when(F.col(size) > block, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0)))
    spread = rows.withColumn("other_block", F.explode(others))
    return spread.withColumn("pair_a", F.least("own_block", "other_block")).withColumn("pair_b", F.greatest("own_block", "other_block")).drop("other_block")


def together(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys in one partition and next to each other."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from sorted batches; a group may run over several batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over the rows of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
