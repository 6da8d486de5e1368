"""The pipeline's first stage: what the classifier rejects, and a table without labels."""

import random

import pytest

import corpus_pipeline
from seatmetrics.llm import langid

SOUNDS = {"aa": ["ka", "to", "mi"], "bb": ["schr", "ung", "ein"], "cc": ["é", "ou", "à"], "dd": ["the", "ing", "or"]}
FOREIGN = ["መልካም", "ខ្មែរ", "ဗမာစာ", "ՀԱՅԵՐԵՆ"]
SCHEMA = "doc_id bigint, text string, lang string"


def labelled():
    rng = random.Random(9)
    return [(k, " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang) for k in range(600) for lang in [list(SOUNDS)[k % 4]]]


def test_ambiguous_and_far_texts_leave(spark):
    foreign = [(1000 + k, t, None) for k, t in enumerate(FOREIGN)]
    docs = spark.createDataFrame([*labelled(), *foreign, (2000, "12 !", None), (2001, None, None)], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept >= set(range(600)) and not kept & {2000, 2001}
    assert len(kept & {i for i, _, _ in foreign}) < len(foreign)
    model = langid.fit(docs.where(~langid.held_out()))
    ambiguous = {r["doc_id"] for r in langid.predict(docs, model, ambiguous_below=0.6).where("lang_ambiguous").collect()}
    assert {i for i, _, _ in foreign} - kept <= ambiguous


@pytest.mark.parametrize("rows", [[(k, t, None) for k, t, _ in labelled()[:40]], [(5, "kato", "aa"), (2, "one", None)]])
def test_without_labels_only_letterless_texts_leave(spark, rows):
    docs = spark.createDataFrame([*rows, (2000, "12 !", None), (2001, None, None), (None, "mika", None)], SCHEMA)
    assert langid.fit(docs.where(~langid.held_out())).languages == []
    kept = [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [*(i for i, _, _ in rows), None]))
