"""Tables read by ranges of a key, from a given key on: a data source whose partitions are ranges found in file statistics.

Each partition reads only the row groups whose statistics meet its range and yields its rows in the order of the key, so
a reader that stopped at a key goes on behind it without reading what it has. Register with ``register(spark)``, then

    spark.read.format("keyset").option("key", "id").option("after", "41").load(path)

Options: ``key`` (a column of whole numbers), ``after`` (rows up to this key are left out), ``rows`` (about how many a
partition reads), ``columns`` (comma-separated; all without it), ``pushdown`` (true where the session has
``spark.sql.python.filterPushdown.enabled``: comparisons of the key with constants then narrow the ranges). Rows without
a key have no place in the order and are not read, as a comparison with null is never true.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

ROWS = 1_000_000


@dataclass(frozen=True)
class Group:
    """A row group: its file, its number there, its rows, and its least and greatest key."""

    file: str
    number: int
    rows: int
    least: int
    greatest: int


@dataclass
class KeyRange(InputPartition):
    """Keys above ``after`` up to ``upto``, and the row groups that may hold some: (file, numbers)."""

    after: int
    upto: int
    groups: list[tuple[str, list[int]]] = field(default_factory=list)


def ranges(groups: list[Group], rows: int, low: int, high: int) -> list[KeyRange]:
    """Ranges of about ``rows`` rows above ``low`` and up to ``high``, taking keys as evenly spread inside of a row group."""
    inside = [g for g in groups if g.greatest > low and g.least <= high and g.rows]
    if not inside:
        return []
    bounds: set[int] = set()
    for g in inside:
        parts = -(-g.rows // rows)
        bounds |= {g.least + (g.greatest - g.least) * k // parts for k in range(1, parts)} | {g.greatest}
    cuts = sorted(b for b in bounds if low < b < high) + [min(high, max(g.greatest for g in inside))]

    def expected(a: int, b: int) -> float:
        return sum(g.rows * max(0, min(b, g.greatest) - max(a, g.least - 1)) / (g.greatest - g.least + 1) for g in inside)

    merged, start = [], low
    for k, cut in enumerate(cuts):  # small neighbours are read together
        if k + 1 == len(cuts) or expected(start, cuts[k + 1]) > rows:
            merged.append((start, cut))
            start = cut
    out = []
    for a, b in merged:
        by_file: dict[str, list[int]] = {}
        for g in inside:
            if g.greatest > a and g.least <= b:
                by_file.setdefault(g.file, []).append(g.number)
        if by_file:
            out.append(KeyRange(a, b, sorted(by_file.items())))
    return out


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.path.endswith(".parquet"))


def statistics(path: str, key: str) -> list[Group]:
    """Row groups by the footers of the files; one without statistics of the key may hold any."""
    import pyarrow.parquet as pq

    store, _ = _store(path)
    out = []
    for file in _files(path):
        meta = pq.ParquetFile(store.open_input_file(file)).metadata
        place = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == key)
        for n in range(meta.num_row_groups):
            column = meta.row_group(n).column(place)
            known = column.statistics is not None and column.statistics.has_min_max
            if known or column.statistics is None or column.statistics.null_count != column.num_values:
                least, greatest = (column.statistics.min, column.statistics.max) if known else (-(1 << 63), (1 << 63) - 1)
                out.append(Group(file, n, meta.row_group(n).num_rows, least, greatest))
    return out


class KeysetReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.key = options["path"], options["key"]
        self.rows = int(options.get("rows", ROWS))
        self.low, self.high = int(options.get("after", -(1 << 63))), (1 << 63) - 1
        self.columns = schema.names

    def partitions(self) -> list[InputPartition]:
        return ranges(statistics(self.path, self.key), self.rows, self.low, self.high) or [KeyRange(0, -1)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, _ = _store(self.path)
        wanted = list(dict.fromkeys([*self.columns, self.key]))
        parts = []
        for file, numbers in partition.groups:
            for batch in pq.ParquetFile(store.open_input_file(file)).iter_batches(row_groups=numbers, columns=wanted):
                keys = batch.column(batch.schema.get_field_index(self.key))
                inside = pc.and_(pc.greater(keys, pa.scalar(partition.after, pa.int64())), pc.less_equal(keys, pa.scalar(partition.upto, pa.int64())))
                parts.append(pa.Table.from_batches([batch]).filter(inside))
        if parts:
            yield from pa.concat_tables(parts).sort_by(self.key).select(self.columns).to_batches(max_chunksize=10_000)


class PushingReader(KeysetReader):
    """A reader for sessions that push filters to data sources; the others refuse one that could take them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of the key narrow the ranges; Spark keeps the others."""
        for f in filters:
            own = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self.key,) and isinstance(f.value, int)
            if not own:
                yield f
                continue
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = max(self.low, f.value - (not isinstance(f, GreaterThan)))
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))


class KeysetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> StructType:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        store, _ = _store(self.options["path"])
        arrow = pq.read_schema(store.open_input_file(_files(self.options["path"])[0])).remove_metadata()
        asked = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else arrow.names
        return from_arrow_schema(pa.schema([arrow.field(c) for c in asked]), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> KeysetReader:
        pushing = self.options.get("pushdown", "false") == "true"
        return (PushingReader if pushing else KeysetReader)(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KeysetSource)


def read_after(spark: SparkSession, path: str, key: str, after: int | None = None, rows: int = ROWS, columns: str = "") -> DataFrame:
    """Rows of the Parquet files at ``path`` whose key is above ``after``."""
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("keyset").option("key", key).option("rows", rows).option("columns", columns).option("pushdown", pushdown)
    return (reader if after is None else reader.option("after", after)).load(path)
