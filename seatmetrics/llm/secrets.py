"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame functions only.

Every historical version of a file is addressed by the SHA-256 of its content. A ledger in a shared folder
remembers which (blob, rule version) pairs were scanned and where each rule version found something; a run reads
the content of each distinct blob once, applies only the rule versions that its ledger rows lack, appends, and joins
findings back to every path that ever held the blob. Findings count for the rule versions that a run asks for, so a
version that was withdrawn is not reported any more.

Texts stay where they are read: only contents that several rows share are brought together, one copy from each task.
Places are running sums of the lengths between and of matches, by a window over one blob's matches of one rule.

Defined results: null content counts as empty text and has no findings; equal contents share one scan;
repeated rows each get their findings; an empty table gives an empty result; further columns of the input
are kept unless the caller drops them, and internal columns start with ``_secret`` so that they cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seatmetrics.llm.shared import settle, shared_dir


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, the least length, and a literal that any match contains."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    holds: str | None = None
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules of the contract.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, holds="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", least=32),
)
#: What this operator adds: public token formats that the base rules do not name.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", holds="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", holds="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", holds="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", holds="eyJ"),
)
RULES = BASE_RULES + MORE_RULES
_FINDING = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"
SCANNED_SCHEMA = "blob_id string, rules array<string>"
FINDINGS_SCHEMA = "blob_id string, rule string, start bigint, end bigint"
#: Shared contents and findings up to so many are sent to the rows (about 100 bytes each); beyond, rows are shuffled to them.
BROADCAST_ROWS = 100_000


def match_lengths(text: Column, rule: Rule) -> Column:
    """For each match of a rule the lengths of the text before it since the last match, of the match, and of what counts of it."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    counted = hits if not rule.group else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    lengths = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), counted.alias("counted"))
    may = text.contains(rule.holds) & text.rlike(rule.pattern) if rule.holds else text.rlike(rule.pattern)
    return F.when(may, lengths).otherwise(F.array().cast("array<struct<gap:int,hit:int,counted:int>>"))


def matches(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob_id, rule, start, end) of all findings of ``blobs`` (blob_id, text, _secret_todo), in code points."""
    of_rule = [F.struct(F.lit(r.key).alias("rule"), F.lit(r.least).alias("least"), F.when(F.array_contains("_secret_todo", r.key), match_lengths(F.col("text"), r)).alias("all")) for r in rules]
    found = blobs.select("blob_id", F.explode(F.filter(F.array(*of_rule), lambda x: F.size(x["all"]) > 0)).alias("of"))
    one = found.select("blob_id", "of.rule", "of.least", F.posexplode("of.all").alias("nth", "match"))
    so_far = Window.partitionBy("blob_id", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = one.withColumn("end", F.sum((F.col("match.gap") + F.col("match.hit")).cast("bigint")).over(so_far))
    return placed.where("match.counted >= least").select("blob_id", "rule", (F.col("end") - F.col("match.hit")).alias("start"), "end")


def _few(rows: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` for a join that is broadcast while they are few, and whether they are."""
    few = rows.count() <= BROADCAST_ROWS
    return (F.broadcast(rows) if few else rows), few


class BlobLedger:
    """What was scanned and found, by blob and rule version, in a shared folder; each run appends what it scanned."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or shared_dir(spark, "secret-ledger")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def scanned(self) -> DataFrame | None:
        """(blob_id, rules): the rule versions that runs applied to a blob; None before the first run."""
        return self._read("scanned", SCANNED_SCHEMA)

    def unseen(self, content: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """Each distinct blob of ``content`` (blob_id, text) once, with the rule versions in ``_secret_todo`` that it lacks.

        Blobs of one row stay in place. A blob of several rows comes from a pre-aggregated group-by over these rows only.
        """
        copies = settle(content.groupBy("blob_id").agg(F.count("*").alias("n")).where("n > 1").select("blob_id"), "secret-shared")
        shared, few = _few(copies)
        if few:
            alone = content.join(shared, "blob_id", "left_anti")
            together = content.join(shared, "blob_id", "left_semi").groupBy("blob_id").agg(F.first("text").alias("text"))
            blobs = alone.unionByName(together)
        else:
            blobs = content.groupBy("blob_id").agg(F.first("text").alias("text"))
        keys = F.array(*[F.lit(r.key) for r in rules])
        if (known := self.scanned()) is None:
            return blobs.withColumn("_secret_todo", keys)
        past = known.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_secret_seen"))
        left = F.array_except(keys, F.coalesce("_secret_seen", F.array().cast("array<string>")))
        return blobs.join(past, "blob_id", "left").withColumn("_secret_todo", left).where(F.size("_secret_todo") > 0).drop("_secret_seen")

    def scan(self, content: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the unseen (blob, rule version) pairs of ``content`` (blob_id, text) and append them.

        Findings are written before the pairs are marked: a run that breaks off between the two is repeated, and
        findings that are then written again count once.
        """
        todo = self.unseen(content, rules)
        pairs = settle(todo.select("blob_id", F.col("_secret_todo").alias("rules")), "secret-pairs") if self.scanned() is not None else None
        matches(todo, rules).write.mode("append").parquet(f"{self.root}/findings")
        marks = pairs if pairs is not None else content.select("blob_id").distinct().withColumn("rules", F.array(*[F.lit(r.key) for r in rules]))
        marks.write.mode("append").parquet(f"{self.root}/scanned")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """One row for each blob that holds anything under ``rules``: blob_id, findings (start, kind_no, end, kind) by start, then rule.

        ``kind_no`` is the rule's place among ``rules``.
        """
        held = self._read("findings", FINDINGS_SCHEMA).where(F.col("rule").isin([r.key for r in rules])).distinct()
        number, kind = (F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.key, (k, r.kind)[which])]), F.col("rule")) for which in (0, 1))
        one = F.struct("start", number.cast("int").alias("kind_no"), "end", kind.alias("kind"))
        return held.groupBy("blob_id").agg(F.array_sort(F.collect_list(one)).cast(_FINDING).alias("findings"))


def scan_secrets(versions: DataFrame, content: str = "text", ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES, names: tuple[str, str] = ("blob_id", "findings")) -> DataFrame:
    """``versions`` with the blob id and the findings (start, kind_no, end, kind; by start, then rule) of every row, under ``names`` in place of columns of those names.

    Few findings are sent to the rows. Many are read from files, so that Spark can split a blob that a third of the paths hold.
    """
    ledger = ledger or BlobLedger(versions.sparkSession)
    text, (blob, found) = F.coalesce(F.col(content), F.lit("")), names
    ledger.scan(versions.select(F.sha2(text, 256).alias("blob_id"), text.alias("text")), rules)
    held = settle(ledger.findings(rules), "secret-findings").select(F.col("blob_id").alias("_secret_blob"), F.col("findings").alias("_secret_found"))
    own = versions.drop(blob, found).withColumn(blob, F.sha2(text, 256))
    joined = own.join(_few(held)[0], own[blob] == held["_secret_blob"], "left")
    return joined.withColumn(found, F.coalesce("_secret_found", F.array().cast(_FINDING))).drop("_secret_blob", "_secret_found")


def span_text(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def redacted(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with each found stretch replaced once; stretches that overlap count as one.

    What is kept is cut out between the ends so far and the next start, and joined once.
    """
    reach = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<low:bigint,high:bigint>>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        gap = F.array(F.struct(state["at"].alias("low"), x["start"].alias("high"))).cast("array<struct<low:bigint,high:bigint>>")
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(x["start"] >= state["at"], F.concat(state["kept"], gap)).otherwise(state["kept"]).alias("kept"))

    def done(state: Column) -> Column:
        last = F.substring(text, (state["at"] + 1).cast("int"), F.length(text))
        parts = F.transform(state["kept"], lambda g: F.substring(text, (g["low"] + 1).cast("int"), (g["high"] - g["low"]).cast("int")))
        return F.array_join(F.concat(parts, F.array(last)), mark)

    return F.when(F.size(findings) > 0, F.aggregate(findings, reach, step, done)).otherwise(text)
