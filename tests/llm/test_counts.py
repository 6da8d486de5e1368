"""Token counts against the library, resampling and hard negatives against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seatmetrics.llm import negatives, resample, token_counts
from tests.llm.conftest import EDGES

SPECIAL = ["<|endoftext|> and <|startoftext|>x", "<|ENDOFTEXT|>", "it's they'LL we've 'tis ''s don't", "İ\U0001e94a Σς ǅ É é", "a b c\u0085d\x1ce", "1234 ½ ²3", "​﻿!?", "日本語 텍스트"]
TEXTS = [*EDGES, *enumerate(SPECIAL, 100), (100, SPECIAL[0])]


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("head_rows", [token_counts.HEAD_ROWS, 3])
def test_counts_are_the_librarys(make_docs, vocabulary, head_rows):
    library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    got = token_counts.count_tokens(make_docs(TEXTS), vocabulary, most=7, head_rows=head_rows).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 7) for r in got)
    assert token_counts.count_tokens(make_docs(TEXTS).limit(0), vocabulary).count() == 0


def test_segments_and_shared_hashes_change_nothing(monkeypatch):
    """Texts cut in segments, and pretokens that all share one hash, are counted alike."""
    rng = random.Random(4)
    parts = [*"abS'é .\n1", "'ll", "<|endoftext|>", " ", "ǅ", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(200)]
    path = public_tokenizers.path("word_bpe_49k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    split = token_counts.Splitter(path)

    def counts():
        cut, of, sums = split.without_added(texts)
        for block in split.blocks(cut):
            np.add.at(sums, of[block.owner], np.array(split.pieces(block.distinct), np.int64)[block.which])
        return sums.tolist()

    assert counts() == want
    monkeypatch.setattr(token_counts, "SEGMENT", 7)
    assert counts() == want
    monkeypatch.setattr(token_counts, "hash_spans", lambda data, starts, ends, values: np.zeros(len(starts), np.uint64))
    assert counts() == want


def test_unknown_pretokens_are_refused(tmp_path):
    spec = tmp_path / "other.json"
    spec.write_text('{"pre_tokenizer": {"type": "Whitespace"}, "normalizer": null}')
    with pytest.raises(ValueError, match="not known"):
        token_counts.Splitter(str(spec))


def _features(text, longest):
    words, word = [], b""
    for c in (text or "").encode().lower() + b" ":
        if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz":
            word += bytes([c])
        elif word:
            words.append(word)
            word = b""
    return words, [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _resampled(docs, target, s):
    rows = [(i, *_features(t, s.longest)) for i, t in docs]
    bucket = lambda g: zlib.crc32(g) % s.buckets
    count = Counter(bucket(g) for _, _, f in rows for g in f)
    aim = Counter(bucket(g) for t in target for g in _features(t, s.longest)[1])
    n, m = sum(count.values()) + s.buckets, sum(aim.values()) + s.buckets
    out = []
    for i, words, f in rows:
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * n / ((count[b] + 1) * m))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= s.least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[: s.percent * len(able) // 100]
    left = [r[:4] for r in out]
    for r in drawn:
        left.remove(r[:4])
    return sorted([(*r[:4], k) for k, r in enumerate(drawn, 1)] + [(*r, None) for r in left], key=str)


@pytest.mark.parametrize("longest,chunk", [(1, 1 << 23), (3, 300), (4, 1)])
def test_resampling_is_brute_force(spark, make_docs, words, longest, chunk):
    """Repeated n-grams, texts in chunks of any size, repeated rows and ids, hot groups of equal rows."""
    rows = [(i, " ".join(words(15 + i % 40, i % 30))) for i in range(150)] + [(7, " ".join(words(30, 3)))] * 60 + [(None, " ".join(words(25, 1)))] * 40 + [e for e in EDGES if len(e[1] or "") < 1000]
    target = [" ".join(words(40, k)) for k in range(5)] + [None, ""]
    settings = resample.Settings(longest=longest, buckets=97, percent=40, chunk=chunk)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = resample.resample(make_docs(rows), aim, settings)
    assert sorted(map(tuple, got.collect()), key=str) == _resampled(rows, target, settings)


def test_resampling_of_nothing(spark, make_docs):
    none = make_docs([(1, None)]).limit(0)
    assert resample.resample(none, none).count() == 0
    (row,) = resample.resample(make_docs([(3, "a b c")]), none).collect()
    assert (row["n_features"], row["rank"]) == (3, None)


def test_suffixes_are_in_order():
    rng = np.random.default_rng(3)
    ids, text = rng.integers(0, 4, 300), np.sort(rng.integers(0, 9, 300))
    for depth in (1, 2, 3, 5):
        suffix = lambda i: tuple(ids[j] for j in range(i, min(300, i + depth)) if text[j] == text[i])
        order = resample.suffix_array(ids, text, depth)
        assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(300))
        shared = resample.common_prefixes(ids, text, order, depth)
        for k in range(1, 300):
            a, b = suffix(order[k - 1]), suffix(order[k])
            assert shared[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _mined(rows, anchor, s):
    good = {(i, label, tuple(math.floor(s.scale * x) for x in v)) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, label, q in good:
        if not anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in good if len(v) == len(q)]
        best = sorted((-n, i) for n, i, other in scored if other == label and i != a)[: s.positives]
        for p, i in best:
            some = sorted((-n, j) for n, j, other in scored if other != label and s.low * -p <= 100 * n <= s.high * -p)[: s.negatives]
            out += [(a, i, k, j, -p, -n) for k, (n, j) in enumerate(some, 1)]
    return sorted(out)


SCHEMA = "vec_id bigint, embedding array<double>, label string, anchor_id int"


@pytest.mark.parametrize("scale", [256, 1 << 18, 1 << 22])
def test_negatives_are_brute_force(spark, scale):
    """Many lists and rounds, large groups of equal vectors, ties, odd rows, several lengths; floats, doubles and 64-bit products."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    rows = [(i, str(i % 4), (centres[i % 12] + rng.normal(size=8) * 0.4).round(2).tolist()) for i in range(600)]
    rows += [(1000 + i, "1", centres[2].tolist()) for i in range(300)] + [(2000 + i, "2", centres[2].tolist()) for i in range(80)]
    rows += [(3000, None, [1.0] * 8), (3010, "1", None), (3020, "1", []), (3030, "1", [math.nan] * 8), (3040, "1", [None] * 8), (None, "1", [1.0] * 8), (3050, "1", [math.inf] + [0.0] * 7), (3060, "3", [0.0] * 8)]
    rows += [(4000 + i, str(i % 2), [float(i), 1.0]) for i in range(40)] + [(20, "0", centres[1].tolist()), (20, "0", centres[1].tolist())]
    vectors = spark.createDataFrame([(i, v, label, 5) for i, label, v in rows], SCHEMA).repartition(5)
    settings = negatives.Settings(scale=scale, list_size=12, block_bytes=2048, query_bytes=1024, first=2, growth=3)
    for most in (1 << 25, 0):  # pairs broadcast, and shuffled
        got = negatives.hard_negatives(vectors, F.col("vec_id") % 10 == 0, settings=negatives.Settings(**{**settings.__dict__, "broadcast_bytes": most}))
        assert sorted(map(tuple, got.collect())) == _mined(rows, lambda i: i % 10 == 0, settings)


def test_negatives_of_nothing_and_too_much(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], "a", 1), (10, None, "a", 1)], SCHEMA)
    assert negatives.hard_negatives(one, F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(Exception, match="56 bits"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e200], "a", 1)], SCHEMA), F.col("vec_id") % 10 == 0).count()
