"""Which column of an export is which canonical field, and which licence manager wrote it.

Head lines are short, so names are compared on the driver; what the cells say comes from one aggregate over the rows.
A field takes the column whose name is nearest to one of its names. Where a name does not settle it, the cells do:

* a column that is not named exactly can feed a typed field only if most of its cells read as that type;
* a column that several money fields claim feeds one of them only if the rows prove it (quantity times unit price makes
  the total), and stays unmapped otherwise: a total that is read as a price is wrong by the quantity.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatmetrics.functions.text import cell, day_part, read_boolean, read_date, read_hour, read_number
from seatmetrics.operators.normalize import DATASETS, STAMPS
from seatmetrics.sources.names import of_field, of_source

# Words that name no field by themselves.
STRUCTURAL = ("license", "licenses", "lic", "name", "code", "value", "data", "info", "type", "key", "num", "number")
EXACT, STRONG, PART, LEAST = 100, 70, 55, 35
MONEY = ("unit_price", "total_cost", "annual_cost")
#: Share of a column's cells that must read as a field's type, and of rows that must prove what a money column is.
READABLE, PROVEN = 0.5, 0.9
KINDS = ("date", "timestamp", "number", "hour", "boolean")


def header(text: str) -> str:
    out = re.sub(r"[\s\-./\\]+", "_", text.strip().lower())
    return re.sub("_+", "_", re.sub("[^a-z0-9_]", "", out)).strip("_")


def column(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def names_of(dataset: str, field: str, source: str = "generic") -> tuple[str, ...]:
    """Normalized names of a field, those of a source first."""
    return tuple(dict.fromkeys((*of_source(source, dataset, field), field, *of_field(dataset, field))))


def _spelled(name: str) -> str:
    """Spelling variants that mean the same: British, and words written together."""
    return name.replace("licence", "license").replace("_", "")


def _places(words: list[str], name: str) -> list[tuple[int, int]]:
    """Where the words of ``name`` stand in a row in ``words``."""
    own = name.split("_")
    return [(k, k + len(own)) for k in range(len(words) - len(own) + 1) if words[k : k + len(own)] == own]


def score(text: str, names: tuple[str, ...]) -> float:
    """100 for a name itself, 60 to 85 for a header that contains one as whole words, 55 for whole words of one, 30 to 45 for common telling words."""
    own = header(text)
    if not own:
        return 0
    if _spelled(own) in map(_spelled, names):
        return EXACT
    words = own.split("_")
    inside = [60 + min(25, 2 * len(n)) for n in names if len(n) >= 3 and _places(words, n)]
    if inside:
        return max(inside)
    if len(own) >= 4 and any(_places(n.split("_"), own) for n in names):
        return PART
    telling = {w for w in words if len(w) >= 3} - set(STRUCTURAL)
    shares = [len(telling & w) / len(w) for n in names if (w := {x for x in n.split("_") if len(x) >= 3} - set(STRUCTURAL))]
    return 30 + 15 * max(shares) if any(shares) else 0


def money_claims(text: str, dataset: str) -> tuple[str, ...]:
    """Money fields that claim a header which none of them is named by exactly: the fields of all longest names in it, or of which it is a part."""
    own = header(text)
    fields = [f.name for f in DATASETS[dataset] if f.name in MONEY]
    named = {f: names_of(dataset, f) for f in fields}
    if any(_spelled(own) in map(_spelled, n) for n in named.values()):
        return ()
    words = own.split("_")
    found = {(a, b, f) for f, names in named.items() for n in names for a, b in _places(words, n)}
    longest = {f for a, b, f in found if not any(c <= a and b <= d and (c, d) != (a, b) for c, d, _ in found)}
    part = {f for f, names in named.items() if len(own) >= 4 and any(_places(n.split("_"), own) for n in names)}
    claims = longest or part
    return tuple(f for f in fields if f in claims) if len(claims) > 1 else ()


@dataclass(frozen=True)
class Profile:
    """What a column's cells are: how many there are, the share that reads as each kind, and the first of them."""

    cells: int
    shares: dict[str, float]
    sample: str | None = None

    def reads_as(self, kind: str) -> float:
        return self.shares.get(kind, 1.0) if self.cells else 1.0


@dataclass(frozen=True)
class Mapped:
    field: str
    column: str
    score: float

    @property
    def confidence(self) -> str:
        return "exact" if self.score >= EXACT else "strong" if self.score >= STRONG else "possible"


def profiled(raw: DataFrame, day_first: bool = False) -> DataFrame:
    """One row for each column of ``raw`` that has cells (header, cells, one count for each kind), from one aggregate.

    Cells go out as rows of (header, text), so that the readers stand in the plan once, however many columns there are;
    what one reader needs of another is read once. All that is added up are counts, so that no task sorts the cells.
    """
    own = [c for c in raw.columns if c != "source_row"]
    pairs = F.array(*[F.struct(F.lit(c).alias("header"), cell(column(c).cast("string")).alias("text")) for c in own])
    cells = raw.select(F.explode(pairs).alias("c")).select("c.header", "c.text").where("text IS NOT NULL")
    text, day = F.col("text"), F.col("day")
    read = cells.select("header", "text", day_part(text).alias("day"), read_number(text).alias("number"))
    # No number is a date: a date keeps two separators or a month's letters.
    read = read.select("*", F.when(F.col("number").isNull(), read_date(text, day_first)).alias("date"))
    stamp = F.when(F.col("number").isNotNull() | (day == text), F.col("date")).otherwise(read_date(day, day_first))
    read = read.select("header", "date", stamp.alias("timestamp"), "number", read_hour(text, F.col("number")).alias("hour"), read_boolean(text).alias("boolean"))
    return read.groupBy("header").agg(F.count("*").alias("cells"), *[F.count(k).alias(k) for k in KINDS])


def samples(raw: DataFrame) -> dict[str, str | None]:
    """The first cell of each column, up to 60 characters: one row."""
    own = [c for c in raw.columns if c != "source_row"]
    row = raw.agg(*[F.min(F.substring(cell(column(c).cast("string")), 1, 60)).alias(f"c{k}") for k, c in enumerate(own)]).collect()[0] if own else []
    return dict(zip(own, row))


def profiles(raw: DataFrame, day_first: bool = False) -> dict[str, Profile]:
    """By header; as many rows come to the driver as ``raw`` has columns."""
    own = [c for c in raw.columns if c != "source_row"]
    rows, first = profiled(raw, day_first).collect() if own else [], samples(raw)
    return {c: Profile(0, {k: 0.0 for k in KINDS}) for c in own} | {r["header"]: Profile(r["cells"], {k: r[k] / r["cells"] for k in KINDS}, first[r["header"]]) for r in rows}


def money_proofs(raw: DataFrame, mapped: list[Mapped], open_columns: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """For columns that several money fields claim: the field that the rows prove.

    A column is the total where it is quantity times the unit price, and the unit price where quantity times it is the
    total. The year's cost cannot be told from a total by the cells of a row, so it is never proven.
    """
    at = {m.field: m.column for m in mapped}
    number = lambda name: read_number(cell(column(name).cast("string")))
    tests: list[tuple[str, str, Column]] = []
    for name, claims in open_columns.items():
        if "total_cost" in claims and {"quantity", "unit_price"} <= set(at):
            tests.append((name, "total_cost", F.abs(number(at["quantity"]) * number(at["unit_price"]) - number(name)) <= 0.005 * F.abs(number(name)) + 0.005))
        if "unit_price" in claims and {"quantity", "total_cost"} <= set(at):
            tests.append((name, "unit_price", F.abs(number(at["quantity"]) * number(name) - number(at["total_cost"])) <= 0.005 * F.abs(number(at["total_cost"])) + 0.005))
    if not tests:
        return {}
    row = raw.agg(*[x for k, (_, _, holds) in enumerate(tests) for x in (F.count(F.when(holds, 1)).alias(f"yes{k}"), F.count(holds).alias(f"all{k}"))]).collect()[0]
    return {name: field for k, (name, field, _) in enumerate(tests) if row[f"all{k}"] and row[f"yes{k}"] >= PROVEN * row[f"all{k}"]}


def resolve(headers: list[str], dataset: str, overrides: dict[str, str] | None = None, source: str = "generic", cells: dict[str, Profile] | None = None, ignored: tuple[str, ...] = ()) -> list[Mapped]:
    """Each column to at most one field and each field to one column.

    Overrides come first, and ``ignored`` columns stay unmapped. Then the best scores; of equal ones a source's own
    names, then the column whose cells read best as the field, then headers by the alphabet and fields in their order.
    Columns that several money fields claim are left to ``money_proofs``. A common word is never enough for money, and a
    column whose name fits money better than a field, or a field better than money, does not feed the other.
    """
    chosen = [Mapped(f, c, EXACT) for f, c in (overrides or {}).items() if c in headers]
    fields, columns = {m.field for m in chosen}, {m.column for m in chosen} | set(ignored)
    best = {h: [max((score(h, names_of(dataset, f.name, source)) for f in DATASETS[dataset] if (f.name in MONEY) == money), default=0) for money in (True, False)] for h in headers}
    scored = []
    for k, f in enumerate(DATASETS[dataset]):
        names, special = names_of(dataset, f.name, source), of_source(source, dataset, f.name)
        for h in headers:
            points = score(h, names)
            fit = cells[h].reads_as(f.kind) if cells and h in cells else 1.0
            if points < LEAST or (points < EXACT and fit < READABLE):
                continue
            as_money, as_other = best[h]
            if f.name in MONEY and (money_claims(h, dataset) or points < PART or (points < EXACT and points < as_other)):
                continue
            if f.name not in MONEY and points < EXACT and PART <= as_money and points <= as_money:
                continue
            own = points == EXACT and header(h) in special
            scored.append((-points, not own, -round(fit, 3), h.lower(), k, f.name, h))
    for points, _, _, _, _, field, name in sorted(scored):
        if field not in fields and name not in columns:
            chosen.append(Mapped(field, name, -points))
            fields.add(field)
            columns.add(name)
    return chosen


def map_columns(raw: DataFrame, dataset: str, overrides: dict[str, str] | None = None, source: str = "generic", ignored: tuple[str, ...] = (), day_first: bool = False, cells: dict[str, Profile] | None = None) -> tuple[list[Mapped], dict[str, Profile]]:
    """The columns of ``raw`` by their names and cells, and what the cells are; ``cells`` where these rows' profiles are known already."""
    headers = [c for c in raw.columns if c != "source_row"]
    cells = profiles(raw, day_first) if cells is None else {c: cells[c] for c in headers}
    mapped = resolve(headers, dataset, overrides, source, cells, ignored)
    taken, used = {m.field for m in mapped}, {m.column for m in mapped} | set(ignored)
    left = {h: claims for h in headers if h not in used and (claims := money_claims(h, dataset))}
    for name, field in (money_proofs(raw, mapped, left) if left else {}).items():
        if field not in taken:
            mapped.append(Mapped(field, name, STRONG))
            taken.add(field)
    return mapped, cells


def reviewed(headers: list[str], mapped: list[Mapped], cells: dict[str, Profile], dataset: str) -> list[tuple[str, str | None, str, int, str | None]]:
    """(header, field, confidence, score, sample) of every column, as it is shown before anything is kept; an unsettled money column says so."""
    by_column = {m.column: m for m in mapped}
    out = []
    for h in headers:
        m = by_column.get(h)
        kind = m.confidence if m else "ambiguous" if money_claims(h, dataset) else "none"
        out.append((h, m.field if m else None, kind, round(m.score) if m else 0, cells[h].sample if h in cells else None))
    return out


def missing_required(mapped: list[Mapped], dataset: str) -> list[str]:
    """A product, or a part number in contracts, stands in for the feature, and in usage a timestamp for the date."""
    have = {m.field for m in mapped}
    stand_in = {"feature": {"product"} | ({"sku"} if dataset == "contracts" else set()), "date": set(STAMPS) if dataset == "usage" else set()}
    return [f.name for f in DATASETS[dataset] if f.required and f.name not in have and not (stand_in.get(f.name, set()) & have)]


def apply(raw: DataFrame, mapped: list[Mapped]) -> DataFrame:
    """``raw`` under its canonical names."""
    return raw.select(*[column(m.column).alias(m.field) for m in mapped], "source_row")


# What points to a licence manager: weight, where to look, and the terms. ``is``: a header is a term; ``holds``: a header
# holds one; ``all``: headers hold every term; ``any``: a header, the file name or a cell holds one.
SIGNATURES = {
    "flexnet": (
        (55, "is", ("vendor_daemon", "daemon")),
        (55, "any", ("flexlm", "flexnet", "lmgrd", "lmstat", "lmutil")),
        (20, "is", ("feature", "feature_name")),
        (35, "all", ("user", "host", "display")),
        (20, "holds", ("checkout", "check_out", "checkin", "check_in")),
        (20, "all", ("issued", "in_use")),
    ),
    "rlm": (
        (55, "is", ("isv", "isv_name", "rlm_isv")),
        (55, "any", ("reprise",)),
        (45, "holds", ("rlm_",)),
        (25, "all", ("product", "count")),
        (15, "holds", ("pool",)),
        (15, "is", ("handle", "checkout_handle")),
    ),
    "dsls": (
        (60, "any", ("dsls", "dassault", "3dexperience")),
        (50, "holds", ("dsls",)),
        (35, "holds", ("token",)),
        (35, "all", ("license_name", "in_use")),
        (25, "is", ("product_line",)),
        (15, "is", ("server_id",)),
    ),
    "sentinel": (
        (60, "any", ("sentinel", "lservrc")),
        (50, "holds", ("sentinel", "lserv")),
        (45, "holds", ("sublicense", "sub_license")),
        (30, "holds", ("client_user", "client_host")),
        (25, "all", ("feature", "version")),
        (25, "holds", ("sample_time", "poll_time", "snapshot")),
    ),
}
FLOOR, NEAR = 55, 15


def terms_held(raw: DataFrame) -> list[str]:
    """Telling terms that any cell of ``raw`` holds, from one aggregate over all its rows."""
    terms = sorted({t for rules in SIGNATURES.values() for _, where, some in rules if where == "any" for t in some})
    own = [F.lower(column(c).cast("string")) for c in raw.columns if c != "source_row"]
    if not own:
        return []
    row = raw.agg(*[F.bool_or(F.concat_ws("\n", *own).contains(t)).alias(t) for t in terms]).collect()[0]
    return [t for t in terms if row[t]]


def detect(headers: list[str], file_name: str = "", samples: list[str] | None = None) -> tuple[str, int]:
    """(licence manager or generic, confidence): fired weights up to 99; a runner-up within 15 costs 20, and below 55 nothing is sure."""
    heads = [header(h) for h in headers]
    anywhere = [*heads, file_name.lower(), *(s.lower() for s in samples or [])]

    def fired(where: str, terms: tuple[str, ...]) -> bool:
        if where == "is":
            return any(t in heads for t in terms)
        if where == "all":
            return all(any(t in h for h in heads) for t in terms)
        return any(t in h for t in terms for h in (heads if where == "holds" else anywhere))

    points = sorted(((min(99, sum(w for w, where, terms in rules if fired(where, terms))), name) for name, rules in SIGNATURES.items()), key=lambda x: (-x[0], x[1]))
    (best, name), (second, _) = points[:2]
    if best >= FLOOR and best - second < NEAR:
        best = max(0, best - 20)
    return (name, best) if best >= FLOOR else ("generic", 0)
