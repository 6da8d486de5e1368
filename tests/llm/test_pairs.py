"""Near-duplicate documents and vectors, components, and benchmark passages, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatmetrics.llm import cosine, decontaminate, minhash
from seatmetrics.llm.components import components
from tests.llm.conftest import EDGES


def shingles(text, width):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(rows, s):
    sets = {i: shingles(t, s.width) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and s.below * len(sets[a] & sets[b]) >= s.above * len(sets[a] | sets[b])]
    comp = groups(ids, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def near_rows(words):
    rng, rows = random.Random(5), []
    for k in range(40):
        base = words(rng.randint(30, 200), k)
        for _ in range(rng.choice((1, 2, 4))):
            rows.append((len(rows) * 3 + 1, " ".join(edited(base, rng.choice((0, 1, 2, 4, 9)), rng))))
    # A chain: neighbours are similar, its ends are not.
    chain = words(120, 999)
    for k in range(8):
        chain = edited(chain, 2, rng)
        rows.append((10_000 - k, " ".join(chain).upper()))
    rows += [(20_000 + k, "copied text of six words") for k in range(60)]
    return rows


@pytest.mark.parametrize("settings", [minhash.Settings(), minhash.Settings(width=5, above=80), minhash.Settings(block=16, hub_block=4, broadcast_rows=0)])
def test_minhash_equals_brute_force(make_docs, near_rows, settings):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(make_docs(near_rows), settings=settings).collect()}
    assert got == brute(near_rows, settings)


def test_minhash_edges(make_docs):
    rows = minhash.near_duplicates(make_docs(EDGES)).collect()
    assert len(rows) == len(EDGES)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None}
    assert got == brute(EDGES, minhash.Settings())
    assert minhash.near_duplicates(make_docs([(1, "a")]).limit(0)).count() == 0


def test_repeated_and_missing_ids(make_docs, words):
    """Rows of one id are documents of their own, and rows without an id join a group but never name one."""
    a, b, c = (words(60, k) for k in (71, 72, 73))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, " ".join([*a, "z"])), (9, " ".join([*b, "z"])), (None, " ".join(["z", *a])), (None, " ".join(c)), (None, " ".join([*c, "z"]))]
    for settings in (minhash.Settings(), minhash.Settings(broadcast_rows=0)):
        got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(make_docs(rows), settings=settings).collect())
        assert got == sorted([("5", "3", False), ("5", "5", True), ("3", "3", True), ("9", "5", False), ("None", "3", False), ("None", "None", False), ("None", "None", False)])


def test_copies_without_id_are_one_text(spark, words):
    """100,000 rows without id, or of one id, with one text: the texts that meet their hub are as many as classes, not rows."""
    a = words(40, 5)
    rows = spark.createDataFrame([(None, " ".join(a)), (4, " ".join([*a, "z"])), (7, " ".join(["y", *a]))], "doc_id bigint, text string")
    docs = rows.crossJoin(spark.range(100_000)).where("id < 50000 OR doc_id IS NULL OR doc_id = 4").select("doc_id", "text").where("doc_id IS NULL OR doc_id <> 7").unionByName(rows.where("doc_id = 7")).repartition(6)
    settings = minhash.Settings()
    rows = minhash.sketch(docs, "doc_id", "text", settings)
    classes = minhash.classes_of(rows)
    assert classes.count() == 3 and minhash.any_repeated(rows) and not minhash.any_repeated(rows.where("doc_id = 7"))
    roles = classes.select("rep", F.lit(1).alias("hub"), F.lit(0).alias("part"))
    for settings in (minhash.Settings(), minhash.Settings(broadcast_rows=0)):
        assert minhash._texts(docs, classes, "doc_id", "text", roles, settings, True).count() == 3
    got = {(r["doc_id"], r["component_id"], r["kept"], r["n"]) for r in minhash.near_duplicates(docs).groupBy("doc_id", "component_id", "kept").agg(F.count("*").alias("n")).collect()}
    assert got == {(None, 4, False, 100_000), (4, 4, True, 100_000), (7, 4, False, 1)}


def test_recall_of_banding(words):
    """Of pairs at the threshold and just above, the share that meets in a band and passes the signatures' margin."""
    rng, settings = random.Random(17), minhash.Settings()
    met = agreed = 0
    for k in range(1500):
        common = [rng.randrange(1 << 62) for _ in range(170)]
        a, b = (np.array(sorted(common + [rng.randrange(1 << 62) for _ in range(15)]), np.uint64) for _ in range(2))
        x, y = minhash.signature(a, settings.size), minhash.signature(b, settings.size)
        met += bool((minhash.band_keys(x, settings.bands) == minhash.band_keys(y, settings.bands)).any())
        agreed += (x == y).sum() >= np.ceil(settings.least_agreement * settings.size)
    assert met >= 1499 and agreed == 1500


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, None), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == groups({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("labels", [("a", "b"), (1.2, 1.7)])
def test_labels_and_lengths_of_vectors(spark, labels):
    """Labels that are no whole numbers are no equal ones, and cosines do not depend on how long vectors are."""
    kind = "string" if isinstance(labels[0], str) else "double"
    rows = [(1, [2.0, 1.0], labels[0]), (2, [2.0, 1.0], labels[1]), (3, [4.0, 2.1], labels[0])]
    rows += [(10 + k, [2.0 * x, 1.0 * x], labels[1]) for k, x in enumerate((1e-200, 1e200))] + [(20 + k, [1.0 * x, 2.0 * x], labels[1]) for k, x in enumerate((1e-200, 1e200))]
    got = {r["vec_id"]: r["component_id"] for r in cosine.near_vectors(spark.createDataFrame(rows, f"vec_id bigint, embedding array<double>, label {kind}")).collect()}
    assert got == {1: 1, 3: 1, 2: 2, 10: 2, 11: 2, 20: 20, 21: 20}


def vectors(seed=2, n=260, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.standard_normal(d)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((len(rows), [float(x) for x in base + rng.standard_normal(d) * rng.choice((0, 0.1, 0.25, 0.4))], int(rng.integers(0, 2))))
    rows += [(10_000 + k, rows[0][1], rows[0][2]) for k in range(30)]
    rows += [(20_000, None, 1), (20_001, [0.0] * d, 1), (20_002, [float("nan")] + [1.0] * (d - 1), 1), (20_003, [None] + [1.0] * (d - 1), 1), (20_004, [float("inf")] + [1.0] * (d - 1), 0), (20_005, rows[0][1], None), (20_006, [1.0, 2.0], 1), (20_007, [2.0, 4.0], 1), (20_008, [], 1)]
    return rows


@pytest.mark.parametrize("settings", [cosine.Settings(), cosine.Settings(block=8, broadcast_rows=0), cosine.Settings(bucket=8), cosine.Settings(bucket=4, block=4, sent=128)])
def test_vectors_equal_brute_force(spark, settings):
    rows = vectors()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cosine.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), settings=settings).collect()}
    ok = {i: np.array(v) for i, v, lab in rows if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    label = {i: lab for i, _, lab in rows}
    ids = sorted(ok)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.93]
    comp = groups(label, links)
    n = {i: 0 for i in label}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in label}


def test_vector_edges(spark):
    """Repeated and null ids are vectors of their own; other columns with the names of results do not matter; an empty table has no rows."""
    one, near, far = [1.0, 0.0, 0.1], [1.0, 0.05, 0.1], [0.0, 1.0, 0.0]
    rows = [(5, one, 1, "a"), (5, far, 1, "a"), (5, near, 1, "a"), (3, near, 1, "a"), (None, one, 1, "a"), (9, far, 2, "a"), (8, None, 1, "a")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, component string").withColumn("node", F.lit("x"))
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in cosine.near_vectors(table).collect())
    assert got == sorted([("5", 2, "3", False), ("5", 0, "5", True), ("5", 2, "3", False), ("3", 2, "3", True), ("None", 0, "None", False), ("9", 0, "9", True), ("8", 0, "8", True)])
    assert cosine.near_vectors(table.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Of 3000 pairs just above the threshold, amid others, hardly any is missed."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((3000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    turned = 0.9301 * base + math.sqrt(1 - 0.9301**2) * side
    rows = [(2 * k, base[k].tolist(), 0) for k in range(3000)] + [(2 * k + 1, turned[k].tolist(), 0) for k in range(3000)]
    for bucket in (512, 32):
        got = {r["vec_id"]: r["n_links"] for r in cosine.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), settings=cosine.Settings(bucket=bucket)).collect()}
        assert sum(got[2 * k] > 0 for k in range(3000)) >= 2993


def plain_words(text):
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def held(docs, items, share=0.2):
    out = {}
    for d, t in docs:
        w = plain_words(t)
        for i, item in items:
            q = plain_words(item)
            if q and w and d is not None and i is not None:
                best = min((levenshtein(q, w[s : s + len(q)]), s) for s in range(len(w)))
                if best[0] <= int(len(q) * share + 1e-9):
                    out[d, i] = (best[1], best[0], len(q))
    return out


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(70))] for _ in range(2))
        assert decontaminate.edit_distance(a, b) == levenshtein(a, b)


def test_leaks_equal_brute_force(spark, make_docs, words):
    rng = random.Random(8)
    items = [(k, " ".join(words(rng.choice((1, 3, 6, 12, 25, 40)), 500 + k))) for k in range(24)] + [(90, None), (91, ""), (92, "!!")]
    rows = []
    for k in range(60):
        doc = words(rng.randint(5, 120), 2000 + k)
        if k % 2:
            _, item = items[rng.randrange(24)]
            passage = item.split()
            for _ in range(rng.randint(0, int(len(passage) * 0.25) + 1)):
                kind, at = rng.randrange(3), rng.randrange(len(passage))
                passage[at : at + 1] = [["zz"], [], [passage[at], "yy"]][kind] if len(passage) > 1 else passage[at : at + 1]
            at = rng.randrange(len(doc))
            doc[at:at] = passage
        rows.append((k, ", ".join(doc).title()))
    rows.append((500, " ".join(words(3000, 77)) + " " + items[4][1]))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = held(rows, items)
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["edits"], r["item_words"]) for r in decontaminate.find_leaks(make_docs(rows), table).collect()}
    assert set(got) <= set(want)
    assert sum(k in got for k in want) >= 0.98 * len(want)
    assert all(k in got for k, v in want.items() if v[1] == 0)
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got)
    clean = decontaminate.without_leaks(make_docs(rows), table)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in got}
    assert clean.columns == make_docs(rows).columns


def test_leak_edges(spark, make_docs):
    items = spark.createDataFrame([(1, "same words here again"), (2, "same words here again"), (None, "x")], "item_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontaminate.find_leaks(make_docs(EDGES), items).collect())
    assert got == sorted([("6", 1), ("6", 1), ("7", 1), ("6", 2), ("6", 2), ("7", 2)])
    assert decontaminate.find_leaks(make_docs(EDGES), items.limit(0)).count() == 0
    assert decontaminate.without_leaks(make_docs(EDGES), items.limit(0)).count() == len(EDGES)
    assert decontaminate.find_leaks(make_docs(EDGES).limit(0), items).count() == 0


def test_items_of_one_id_of_no_id_and_in_many_blocks(spark, make_docs, words, monkeypatch):
    """Each item row is reported with its own length, whatever its id and whatever block it is in."""
    four, six = "four words of one", "six words stand here for one"
    docs = make_docs([(1, f"x {four} y"), (2, f"{six} z"), (3, "nothing"), (4, None)])
    items = spark.createDataFrame([("a", four), ("a", six), (None, four), ("b", ""), ("c", None)], "item_id string, text string")
    want = [(1, "a", 1, 0, 4), (1, None, 1, 0, 4), (2, "a", 0, 0, 6)]
    for at_once in (5_000, 1):
        monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", at_once)
        got = decontaminate.find_leaks(docs, items).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, items).collect()) == [3, 4]
