"""The numbered queries over the tables: SQL where there is some, the pipeline by its parts."""

import math
import os

import duckdb
import pytest

import corpus_pipeline
from seatmetrics.llm import decontaminate, minhash, oracles, queries
from tests.llm.conftest import EDGES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    got = con.execute(oracles.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=str)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_is_its_stages(spark):
    """Each stage by its own rule: languages by letters, one document of each group, no benchmark item, no secret."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = corpus_pipeline.language_id(spark, docs, SF)
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert {r["doc_id"] for r in named.collect()} == {i for i, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}
    kept = corpus_pipeline.near_duplicates(spark, named, SF)
    marked = minhash.near_duplicates(named, settings=minhash.Settings(width=5, above=80))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in marked.where("kept").collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = corpus_pipeline.decontamination(spark, kept, SF)
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(kept, items).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in kept.collect()} - leaks
    redacted = corpus_pipeline.secret_scan(spark, clean, SF)
    assert redacted.columns == docs.columns and redacted.count() == clean.count()
    changed = [r for r in redacted.collect() if r["text"] != rows[r["doc_id"]]["text"]]
    assert all("[SECRET]" in r["text"] and r["n_chars"] == len(r["text"]) for r in changed)
    assert corpus_pipeline.run(spark, SF).count() == clean.count()


def test_pipeline_stages_on_edges(make_docs):
    """Nulls, repeats, long texts and columns named like results go through every stage; an empty table stays empty."""
    secret = "my password = hunter2hunter2 and some more words to read"
    rows = [*EDGES, (50, secret), (51, secret + " again"), (52, None)]
    docs = make_docs(rows)
    spark = docs.sparkSession
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert (name, out.columns, [f.dataType for f in out.schema]) == (name, docs.columns, [f.dataType for f in docs.schema])
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert all(r["findings"] == "mine" and r["lang_pred"] == "x" for r in out.collect())
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = docs.collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(["4", "5", "6", "6", "8", "9", "50", "None"])  # 51 is a near copy of 50
    assert {r["text"] for r in left if r["doc_id"] == 50} == {"my [SECRET] and some more words to read"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(left)


def test_near_duplicate_stage_drops_rows_not_ids(make_docs):
    """A text like no other stays, whatever shares its id; a row without id goes with its group."""
    text = "a small text of some words that is copied here and there with little change"
    rows = [(3, text), (5, text + " too"), (5, "nothing like that one at all in any of its many words"), (5, None), (None, text), (None, "a text of its own that has no id and no copy"), (6, "once more"), (6, "once more")]
    left = corpus_pipeline.near_duplicates(make_docs(rows).sparkSession, make_docs(rows), SF).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left))) == sorted(map(str, [rows[0], rows[2], rows[3], rows[5], rows[6], rows[7]]))


def test_language_stage_on_the_tables(spark):
    """Of texts planted in no labelled language most leave, also with one wrong label, and no clean document goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = ["መልካም ቀን ለሁሉም ሰዎች", "ខ្មែរ ភាសា ជាតិ", "ဗမာစာ ဘာသာ စကား", "ՀԱՅԵՐԵՆ ԼԵԶՈՒ ԳԻՐ", "ᐃᓄᒃᑎᑐᑦ ᐅᖃᐅᓯᖅ"]
    odd = [(900_000 + k, t, None, "planted", len(t)) for k, t in enumerate(foreign)] + [(900_100, "qzxj wvkq zzxq", "en", "planted", 14)]
    every = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, every, SF).collect()}
    clean = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert kept >= clean and len(kept & set(range(900_000, 900_005))) <= 2
