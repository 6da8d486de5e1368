"""A kept analysis: rows written under a version, counted again, and only then published under the key of their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Projection:
    """Versions of one analysis in a shared folder; readers see the last version that was published."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _published(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/published")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(f"{self.root}/published")

    def current(self) -> tuple[str, str] | None:
        """(evidence key, version) of what was published last."""
        rows = None if self._published() is None else self._published().orderBy(F.col("number").desc()).limit(1).collect()
        return (rows[0]["evidence_key"], rows[0]["version"]) if rows else None

    def usable(self, evidence_key: str) -> bool:
        """Whether the published version is that of the evidence as it is now."""
        return (now := self.current()) is not None and now[0] == evidence_key

    def build(self, rows: DataFrame, evidence_key: str, recount: DataFrame, counted: int) -> str:
        """Write ``rows`` and publish them, unless ``recount`` (one row: rows) no longer gives ``counted``: the evidence then changed while it was read."""
        number = 1 if self._published() is None else self._published().agg(F.max("number")).collect()[0][0] + 1
        version = f"v{number}"
        rows.write.mode("overwrite").parquet(f"{self.root}/versions/{version}")
        if recount.collect()[0]["rows"] != counted:
            raise RuntimeError("the evidence changed while the analysis was made; nothing was published")
        entry = self.spark.createDataFrame([(number, version, evidence_key)], "number bigint, version string, evidence_key string")
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/published")
        return version

    def read(self) -> DataFrame:
        now = self.current()
        if now is None:
            raise LookupError("nothing was published yet")
        return self.spark.read.parquet(f"{self.root}/versions/{now[1]}")
