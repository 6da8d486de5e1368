"""Exports and the store of imports: files that Spark writes, each import a partition of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmetrics.operators.normalize import DATASETS


def guarded(x: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(x.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def csv_cell(x: Column) -> Column:
    text = F.coalesce(guarded(x.cast("string")), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(columns: list[Column]) -> Column:
    return F.concat_ws(",", *map(csv_cell, columns))


def write_csv(df: DataFrame, path: str) -> None:
    """Text files with guarded cells and CRLF, each with a head line behind the byte-order mark that spreadsheets expect.

    The mark is the first character of the first column's name, so Spark writes it at the beginning of each file.
    """
    rows = df.select(*[guarded(F.col(c).cast("string")).alias(c if k else "\ufeff" + c) for k, c in enumerate(df.columns)])
    rows.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path)


EXPORTS = {
    "portfolio": ("feature_id", "feature_name", "vendor_name", "license_model", "entitled", "recommended", "current_cost", "opportunity", "risk", "confidence"),
    "reclaim": ("feature_id", "employee_id", "display_name", "department", "last_used", "idle_days", "annual_value"),
    "renewals": ("contract_id", "vendor_name", "renewal_date", "days_to_renewal", "current_spend", "recommended_spend"),
    "users": ("feature_id", "employee_id", "total_sessions", "total_hours", "last_used"),
    "cost": ("grp", "allocated_spend", "share_pct", "headcount", "cost_per_engineer"),
}


def export(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*EXPORTS[kind])


class ImportStore:
    """Canonical rows by dataset and import. A second commit of the same import replaces it; another import of the same fingerprint is refused."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, dataset: str) -> str:
        return f"{self.root}/{dataset}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def imports(self) -> DataFrame | None:
        return self.spark.read.parquet(self._path("imports")) if self._exists(self._path("imports")) else None

    def commit(self, rows: DataFrame, dataset: str, import_id: str, fingerprint: str, expected: int) -> int:
        """Write the rows of one import and count them; they can be read once the count is right and the import is entered.

        A commit that fails leaves rows that no reader sees, and the next commit of this import writes over them.
        """
        if dataset not in DATASETS:
            raise ValueError(f"no dataset {dataset}")
        known = self.imports()
        if known is not None and known.where((F.col("fingerprint") == fingerprint) & (F.col("import_id") != import_id)).limit(1).count():
            raise ValueError("this file was imported before")
        out = rows.withColumn("import_id", F.lit(import_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_id").parquet(self._path(dataset))
        stored = self.spark.read.parquet(self._path(dataset)).where(F.col("import_id") == import_id).count()
        if stored != expected:
            raise RuntimeError(f"{stored} rows stored, {expected} accepted")
        entry = self.spark.createDataFrame([(import_id, dataset, fingerprint, stored)], "import_id string, dataset string, fingerprint string, rows bigint")
        entry.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_id").parquet(self._path("imports"))
        return stored

    def read(self, dataset: str, import_id: str | None = None) -> DataFrame:
        """All rows of a dataset's entered imports, or of one of them: a filter on partitions."""
        rows = self.spark.read.parquet(self._path(dataset))
        entered = self.imports()
        known = [] if entered is None else [r["import_id"] for r in entered.where(F.col("dataset") == dataset).select("import_id").collect()]
        rows = rows.where(F.col("import_id").isin(known))
        return rows if import_id is None else rows.where(F.col("import_id") == import_id)

    def delete(self, dataset: str, import_id: str) -> None:
        """Drop the partitions of one import."""
        for name in (dataset, "imports"):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/import_id={import_id}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
