"""Benchmark passages that edits made longer or shorter, against a brute force over all passage lengths."""

import random

import numpy as np
import pytest

import corpus_pipeline
from seatmetrics.llm import decontaminate, queries
from tests.llm.test_pairs import levenshtein, plain_words


def nearest(item, words):
    """(start, edits) of the nearest, then first, passage among those of n - d to n + d words, or None."""
    n, d = len(item), decontaminate.allowed(len(item), 0.2)
    found = [(levenshtein(item, words[s : s + size]), s) for s in range(len(words)) for size in range(n - d, min(n + d, len(words) - s) + 1)]
    edits, start = min(found, default=(d + 1, 0))
    return (start, edits) if edits <= d else None


def changed(passage, kind, n, rng):
    """``passage`` with ``n`` words deleted, ``n`` inserted, or ``n`` edits of all kinds."""
    out = list(passage)
    for _ in range(n):
        at, edit = rng.randrange(len(out)), kind if kind < 2 else rng.randrange(3)
        out[at : at + 1] = [[], [out[at], "yy"], ["zz"]][edit]
    return out


@pytest.fixture(scope="module")
def tables(spark, make_docs, words, tmp_path_factory):
    rng, rows = random.Random(21), []
    items = [(k, words(rng.choice((4, 8, 15, 22, 30)), 700 + k)) for k in range(9)]
    for k in range(54):
        item = items[k % 9][1]
        passage = changed(item, k % 3, rng.randint(0, decontaminate.allowed(len(item), 0.2) + 1), rng)
        rows.append((k, " ".join([*words(rng.randint(0, 15), 3000 + k), *passage, *words(rng.randint(0, 15), 4000 + k)])))
    at = str(tmp_path_factory.mktemp("passages"))
    make_docs(rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    want = {(d, i): (*best, len(item)) for d, t in rows for i, item in items if (best := nearest(item, plain_words(t)))}
    return at, rows, want


def test_passages_equal_brute_force_over_all_lengths(spark, tables):
    at, _, want = tables
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["edits"], r["item_words"]) for r in queries.op8_decontamination(spark, at).collect()}
    assert set(got) <= set(want)
    assert sum(k in got for k in want) >= 0.98 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got)


def test_pipeline_drops_passages_of_all_lengths(spark, tables):
    at, rows, want = tables
    held = {d for d, _ in want}
    kept = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()}
    assert {i for i, _ in rows} - held <= kept and len(kept & held) <= 0.02 * len(held)


def test_start_distances():
    rng = random.Random(6)
    for _ in range(60):
        item, words = [rng.randrange(4) for _ in range(rng.randrange(1, 70))], [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
        assert decontaminate.start_distances(item, words) == [min(levenshtein(item, words[s:e]) for e in range(s, len(words) + 1)) for s in range(len(words))]


@pytest.mark.parametrize("size, kind", [(40, 0), (1000, 0), (1500, 2)])
def test_recall_by_kind_of_edit(words, size, kind):
    """Items with all allowed edits of one kind are found as often as the recall says, however long they are."""
    rng, items = random.Random(size), [(k, words(size, 800 + k)) for k in range(6)]
    index = decontaminate.ItemIndex([(i, " ".join(w)) for i, w in items], decontaminate.PASSAGES)
    lost, trials = 0, 120 if size < 100 else 18
    for k in range(trials):
        i, item = items[k % 6]
        out = list(item)
        for at in sorted(rng.sample(range(size), size // 5), reverse=True):
            out[at : at + 1] = [] if kind == 0 else [f"zz{at}"]
        lost += i not in [index.ids[place] for place in index.hits(" ".join([*words(20, 5000 + k), *out, *words(20, 6000 + k)]))]
    assert lost <= 0.02 * trials


def test_repetitions_that_miss_the_target(words):
    """A class whose repetitions miss the target verifies every range."""
    item = words(30, 900)
    index = decontaminate.ItemIndex([(1, " ".join(item))], decontaminate.Settings(any_length=True, most_repetitions=1))
    rng = np.random.default_rng(3)
    for k in range(60):
        places = set(rng.choice(30, 6, replace=False).tolist())
        out = [f"n{j}" if j in places else w for j, w in enumerate(item) if k % 2 or j not in places]
        assert [index.ids[place] for place in index.hits(" ".join(out))] == [1]
