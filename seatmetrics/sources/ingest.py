"""One export from file to canonical rows: look at its head, map its columns, type its cells, say what was wrong."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatmetrics.operators import contracts, normalize
from seatmetrics.sources import adapters, files, mapping


#: Rows whose cells help to tell a file's origin, and rows whose cells help to tell what its columns are.
SAMPLE_ROWS, MAPPING_ROWS = 20, 1_000


@dataclass(frozen=True)
class Ingested:
    """``rows`` as checked (``accepted`` and ``rejections`` are filters on them), the mapping, and who wrote the file."""

    dataset: str
    rows: DataFrame
    mapped: list[mapping.Mapped]
    source: str
    confidence: int
    #: (table, header, field, confidence, score, sample) of every column of every sheet, for review.
    columns: list[tuple[str, str, str | None, str, int, str | None]]

    @property
    def accepted(self) -> DataFrame:
        out = normalize.accepted(self.rows)
        return priced(out) if self.dataset == "contracts" else out

    @property
    def rejections(self) -> DataFrame:
        return normalize.rejections(self.rows)

    @property
    def summary(self) -> DataFrame:
        return normalize.rejection_summary(self.rows)

    @property
    def quality(self) -> DataFrame:
        return normalize.field_quality(self.rows, self.dataset, float(self.confidence))

    @property
    def report(self) -> DataFrame:
        """Coverage of every field of the dataset, and why one has none."""
        return adapters.quality_report(self.rows.withColumn("source", F.lit(self.source)), self.dataset)


def priced(lines: DataFrame) -> DataFrame:
    """Contract lines with their cost by the best evidence; columns that the file lacked are null."""
    kinds = {"quantity": "double", "unit_price": "double", "total_cost": "double", "annual_cost": "double", "start_date": "date", "end_date": "date"}
    return contracts.derive_cost(lines.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in lines.columns}))


def with_fallbacks(raw: DataFrame, dataset: str) -> DataFrame:
    """A blank feature takes the product, in contracts also the part number."""
    stand_ins = [c for c in ("feature", "product", *(("sku",) if dataset == "contracts" else ())) if c in raw.columns]
    if dataset == "people" or not stand_ins:
        return raw
    return raw.withColumn("feature", F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in stand_ins]))


def ingest(spark: SparkSession, path: str, dataset: str, overrides: dict[str, str] | None = None, day_first: bool = False, ignored: tuple[str, ...] = ()) -> Ingested:
    """Read a delimited file, or all sheets of a workbook, as rows of ``dataset``.

    The first rows help to find out who wrote the file, and that decides which names of columns come first; more of them
    settle what a name leaves open. Contracts are never taken for a licence manager's.
    """
    if not files.accepted_name(path):
        raise ValueError(f"not a file of a known kind: {path}")
    book = files.kind_of(files.head_of(spark, path, 8)) == "workbook"
    if book:
        raw = files.read_workbooks(spark, path)
        found = raw.select("sheet", F.explode(F.map_keys("cells")).alias("h")).distinct().collect()
        heads = {s: sorted(r["h"] for r in found if r["sheet"] == s) for s in sorted({r["sheet"] for r in found})}
        tables = {s: raw.where(F.col("sheet") == s).select(*[F.col("cells")[h].alias(h) for h in hs]) for s, hs in heads.items()}
    else:
        raw = files.read_delimited(spark, path)
        tables = {"": raw.drop("source_row")}
    source, sure = "generic", 0
    if dataset != "contracts":
        samples = [v for t in tables.values() for r in t.limit(SAMPLE_ROWS).collect() for v in r if v is not None]
        source, sure = mapping.detect([h for t in tables.values() for h in t.columns], path.rsplit("/", 1)[-1], samples)
    by_table, columns = {}, []
    for name, table in tables.items():
        by_table[name], cells = mapping.map_columns(table.limit(MAPPING_ROWS), dataset, overrides, source, ignored, day_first)
        columns += [(name, *row) for row in mapping.reviewed(table.columns, by_table[name], cells, dataset)]
    named = by_sheet(raw, by_table) if book else mapping.apply(raw, by_table[""])
    rows = normalize.checked(with_fallbacks(named, dataset), dataset, day_first, adapters.denied_reader(F.lit(source)))
    return Ingested(dataset, rows, list(dict.fromkeys(m for mapped in by_table.values() for m in mapped)), source, sure, columns)


def by_sheet(cells: DataFrame, mapped: dict[str, list[mapping.Mapped]]) -> DataFrame:
    """Rows of ``read_workbooks`` under their canonical names; each sheet has columns of its own."""
    fields = dict.fromkeys(m.field for sheet in mapped.values() for m in sheet)
    own = {f: [F.when(F.col("sheet") == sheet, F.col("cells")[m.column]) for sheet, ms in mapped.items() for m in ms if m.field == f] for f in fields}
    return cells.select(*[F.coalesce(*parts).alias(f) for f, parts in own.items()], "source_row")
