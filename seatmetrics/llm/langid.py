"""Language identification by error-correcting output codes.

Each language has a binary codeword; one linear classifier on hashed byte n-grams predicts each bit. Decoding
adds up, for each codeword, the loss of the bits that disagree with it, weighted by how well that bit's
classifier separated the training rows; the codeword of least loss wins, and a text whose two nearest codewords
are almost as near is flagged as ambiguous.

Training takes a bounded sample (``bounded_sample``): distinct labelled texts, drawn by a hash of the text, with hard
limits by language and in all; their hashed counts are made on the executors. Prediction reads every whole text, on
the executors.

Defined results: null text and text without a letter get ``und``, score 0, not ambiguous; an empty training set
gives ``und`` for every row; rows without a label are never learned from; repeated rows are learned from once and
predicted alike; texts of any length are read whole; labels beyond the limit, those with the fewest texts, are never
predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from seatmetrics.llm.shared import settle, slices

BUCKETS = 1 << 12
SIZES = (1, 2, 3, 4)
SEGMENT = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def features(text: str) -> np.ndarray:
    """Length-normalised square roots of hashed counts of byte n-grams of the whole text, in bounded segments."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), SEGMENT):
        part = data[at : at + SEGMENT + max(SIZES) - 1].astype(np.uint32)
        hashed = np.zeros(len(part), np.uint32)
        for k, size in enumerate(SIZES):
            n = len(part) - size + 1
            if n <= 0:
                break
            hashed = (hashed[:n] if k else np.zeros(n, np.uint32)) * np.uint32(0x01000193) + (part[k : k + n] + np.uint32(1)) * _FACTORS[k]
            last = min(n, SEGMENT)
            counts += np.bincount(((hashed[:last] ^ (hashed[:last] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=BUCKETS)
    x = np.sqrt(counts)
    return (x / (np.linalg.norm(x) or 1)).astype(np.float32)


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 for each language, columns all different and none constant.

    Up to seven languages get the exhaustive code of 2**(k-1) - 1 bits; more get a random code of 10 log2(k) bits.
    """
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 7:
        bits = np.arange(1, 2 ** (languages - 1))
        rows = [np.ones(len(bits), np.int8)] + [np.where((bits >> k) & 1, -1, 1).astype(np.int8) for k in range(languages - 1)]
        return np.stack(rows)
    width = int(np.ceil(10 * np.log2(languages)))
    rng = np.random.default_rng(seed)
    best = max((np.where(rng.random((languages, width)) < 0.5, -1, 1).astype(np.int8) for _ in range(50)), key=lambda c: np.abs(c @ c.T - np.diag([width] * languages)).max() * -1)
    best[0, (best == best[0]).all(0)] *= -1
    return best


#: The share of held-out labelled texts whose loss counts as usual, and how far from there to a text without n-grams is far.
USUAL, FAR = 0.95, 0.75


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    #: A text that loses more than this on its nearest codeword is like none of the labelled languages.
    far: float = np.inf

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, score between 0 and 1, the margin to the next, and the loss, for each row of features."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :])  # logistic loss of each bit
        total = (loss * self.trust).sum(2)
        order = np.argsort(total, 1, kind="stable")
        best = np.take_along_axis(total, order[:, :1], 1)[:, 0]
        share = np.exp(best[:, None] - total)
        share = share / share.sum(1, keepdims=True)
        p = np.take_along_axis(share, order, 1)
        return order[:, 0], p[:, 0], p[:, 0] - (p[:, 1] if p.shape[1] > 1 else 0), best


def _train_bits(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 4.0, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of all bits at once by full-batch gradient steps with momentum."""
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    b = np.zeros(y.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        pull = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        vw = 0.9 * vw - rate * (x.T @ pull + decay * w)
        vb = 0.9 * vb - rate * pull.sum(0)
        w, b = (w + vw).astype(np.float32), (b + vb).astype(np.float32)
    return w, b


def bounded_sample(labelled: DataFrame, per_language: int, most_languages: int, most_rows: int) -> DataFrame:
    """(text, lang) of at most ``per_language`` distinct texts of each of at most ``most_languages`` labels, and of ``most_rows`` in all.

    The labels with the most distinct texts are taken. Texts are drawn by a hash of the text alone, so rows that repeat
    a text, or an id, count once: a threshold on the hash leaves about twice as many as are wanted, of which the least
    hashes are taken. Copies collapse within a task before anything is shuffled.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != "und")).select("lang", "text")
    drawn = usable.withColumn("draw", F.pmod(F.xxhash64(F.lit("language sample"), F.col("text")), F.lit(1 << 62)))
    sizes = settle(drawn.select("lang", "draw").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages), "languages")
    each = max(1, min(per_language, most_rows // max(1, sizes.count())))
    cut = sizes.select(F.col("lang").alias("of"), (F.least(F.lit(1.0), F.lit(2.0 * each) / F.col("count")) * float(1 << 62)).alias("below"))
    near = drawn.join(F.broadcast(cut), (F.col("lang") == F.col("of")) & (F.col("draw") < F.col("below")))
    one = near.groupBy("lang", "draw").agg(F.first("text").alias("text"))
    ranked = one.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
    return ranked.where(F.col("nth") <= each).select("text", "lang")


def fit(labelled: DataFrame, per_language: int = 600, most_languages: int = 200, most_rows: int = 20_000) -> Model:
    """Learn from ``labelled`` (text, lang) on the bounded sample of these parameters; its features are made on the executors."""

    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"lang": frame["lang"], "x": [features(t).astype(np.float16).tobytes() for t in frame["text"]]})

    sample = bounded_sample(labelled, per_language, most_languages, most_rows).mapInPandas(shrink, "lang string, x binary").toPandas()
    sample = sample.sort_values(["lang", "x"], kind="stable")
    languages = sorted(set(sample["lang"]))
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    x = np.frombuffer(b"".join(sample["x"]), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    place = {lang: k for k, lang in enumerate(languages)}
    which = np.array([place[v] for v in sample["lang"]], np.int64)
    code = codewords(len(languages))
    y = code[which].astype(np.float32)
    held = np.arange(len(x)) % 5 == 4
    w, b = _train_bits(x[~held] if held.any() else x, y[~held] if held.any() else y)
    right = ((x[held] @ w + b) * y[held] > 0).mean(0) if held.any() else np.ones(y.shape[1])
    error = np.clip(1 - right, 0.01, 0.49)
    trust = np.log((1 - error) / error)
    model = Model(languages, code.astype(np.float32), w, b, trust / trust.mean())
    if held.any():
        # From the far end of the rows held out of training most of the way to a text without any n-gram; a few mislabelled rows do not move it.
        usual = float(np.quantile(model.decode(x[held])[3], USUAL))
        nothing = float(model.decode(np.zeros((1, BUCKETS), np.float32))[3].max())
        model.far = max(usual, usual + FAR * (nothing - usual))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", ambiguous_below: float = 0.2, names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_ambiguous")) -> DataFrame:
    """``docs`` with the language, its score and whether it is ambiguous, under ``names``, in place of columns of those names."""
    kept = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            known = np.array([bool(model.languages) and bool(_LETTER.search(t)) for t in texts], bool)
            lang = np.full(len(texts), "und", object)
            score, margin = np.zeros(len(texts)), np.ones(len(texts))
            if known.any():
                rows = np.flatnonzero(known)
                best, p, gap, _ = model.decode(np.stack([features(texts[k]) for k in rows]))
                lang[rows] = np.array(model.languages, object)[best]
                score[rows], margin[rows] = np.clip(p, 0, 1), gap
            new = [pa.array(lang, pa.string()), pa.array(score), pa.array(margin < ambiguous_below)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    schema = StructType([*kept.schema.fields, *map(StructField, names, (StringType(), DoubleType(), BooleanType()))])
    return kept.mapInArrow(run, schema)


def without_unknown(docs: DataFrame, model: Model, text: str = "text", unsure_below: float = 0.6) -> DataFrame:
    """``docs`` without texts that have no letter, and without those that are unsure and far from every codeword.

    Either alone is no ground: a short text of a known language can be far, and one in two languages unsure.
    A model without languages cannot tell, and then only texts without a letter are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            keep = np.array([bool(_LETTER.search(t)) for t in texts], bool)
            rows = np.flatnonzero(keep)
            if model.languages and len(rows):
                _, _, gap, loss = model.decode(np.stack([features(texts[k]) for k in rows]))
                keep[rows] = (gap >= unsure_below) | (loss <= model.far)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_column: str = "doc_id") -> Column:
    """True for the ids that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))
