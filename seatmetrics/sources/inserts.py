"""Inserts of large imports in slices: each row is stored once, whatever breaks off and is sent again.

A slice is a range of source rows. Every attempt writes its rows to a folder of its own, and they count from the moment
that the ledger names this attempt for the slice; so readers see whole slices only, what broke off is read by nobody, and
no file is ever written over or deleted while another job reads it. Should two senders finish one slice, one attempt counts. Rows whose key is stored already, by an earlier slice or by another import, are
skipped: what is stored stays as it is. An import is complete when the rows that are stored are as many as were accepted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LEDGER = "import_id string, slice bigint, attempt string, sent bigint, stored bigint"


class SlicedInsert:
    """The rows of one dataset at ``root``, with ``key``: the columns in which two rows are the same row (null equals null)."""

    def __init__(self, spark: SparkSession, root: str, key: tuple[str, ...], slice_rows: int = 500_000):
        self.spark, self.root, self.key, self.slice_rows = spark, root.rstrip("/"), key, slice_rows

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def ledger(self) -> DataFrame:
        """(import_id, slice, attempt, sent, stored) of the finished slices; of several attempts at one, the least."""
        path = f"{self.root}/ledger"
        if not self._exists(path):
            return self.spark.createDataFrame([], _LEDGER)
        entries = self.spark.read.schema(_LEDGER).parquet(path)
        return entries.groupBy("import_id", "slice").agg(F.min(F.struct("attempt", "sent", "stored")).alias("e")).select("import_id", "slice", "e.attempt", "e.sent", "e.stored")

    def stored(self, like: DataFrame) -> DataFrame:
        """All rows of finished slices, with ``import_id`` and ``slice``; ``like`` has the columns where nothing is stored yet."""
        path = f"{self.root}/rows"
        if not self._exists(path):
            return like.select("*", F.lit(None).cast("string").alias("import_id"), F.lit(None).cast("bigint").alias("slice")).where("false")
        rows = self.spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in like.schema)}, attempt string, import_id string, slice bigint").parquet(path)
        return rows.join(self.ledger().select("attempt", "import_id", "slice"), ["attempt", "import_id", "slice"], "left_semi").select(*like.columns, "import_id", "slice")

    def send(self, rows: DataFrame, import_id: str, most_slices: int | None = None) -> int:
        """Store the slices that the ledger does not name yet, ``most_slices`` of them at most, in one job; how many are left.

        ``rows`` are the accepted rows of the import with ``source_row``, the same at every call.
        """
        sliced = rows.withColumn("slice", F.floor(F.col("source_row") / self.slice_rows).cast("bigint"))
        done = self.ledger().where(F.col("import_id") == import_id).select("slice")
        counts = sliced.groupBy("slice").agg(F.count("*").alias("sent")).join(done, "slice", "left_anti").orderBy("slice").collect()  # a number for each slice
        now = counts if most_slices is None else counts[:most_slices]
        if not now:
            return 0
        chosen = sliced.where(F.col("slice").between(now[0]["slice"], now[-1]["slice"])).join(done, "slice", "left_anti")
        # Rows of a key meet once, those that are stored before those that are sent; of the stored ones only the key travels.
        sent = chosen.select(*rows.columns, "slice", F.lit(False).alias("held"))
        held = self.stored(rows).select(*[F.col(c) if c in self.key else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes], F.lit(None).cast("bigint").alias("slice"), F.lit(True).alias("held"))
        first = Window.partitionBy(*self.key).orderBy(F.col("held").desc(), "source_row")
        fresh = sent.unionByName(held).withColumn("place", F.row_number().over(first)).where("place = 1 AND NOT held")
        attempt = uuid.uuid4().hex
        kept = fresh.select(*rows.columns, F.lit(attempt).alias("attempt"), F.lit(import_id).alias("import_id"), "slice")
        path = f"{self.root}/rows"
        kept.write.mode("append").partitionBy("attempt", "import_id", "slice").parquet(path)
        # What counts is what is found in the files, not what was meant to be written.
        own = self.spark.read.schema("attempt string, import_id string, slice bigint").parquet(path).where(F.col("attempt") == attempt)
        found = own.groupBy("slice").agg(F.count("*").alias("stored"))
        written = self.spark.createDataFrame([tuple(r) for r in now], "slice bigint, sent bigint").join(found, "slice", "left")
        entry = written.select(F.lit(import_id).alias("import_id"), "slice", F.lit(attempt).alias("attempt"), "sent", F.coalesce("stored", F.lit(0)).cast("bigint").alias("stored"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")  # a row for each slice of this call
        return len(counts) - len(now)

    def complete(self, import_id: str, accepted: int) -> int:
        """The number of rows stored for the import; an error unless it is the number of accepted ones."""
        row = self.ledger().where(F.col("import_id") == import_id).agg(F.coalesce(F.sum("stored"), F.lit(0)).alias("n")).collect()[0]
        if row["n"] != accepted:
            raise RuntimeError(f"{row['n']} rows stored, {accepted} accepted")
        return row["n"]
