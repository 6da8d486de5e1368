"""License scans by a positional index of rare words.

Templates are whole public licence texts and the notices that licences ask for. A first pass counts in how many
documents each licence word occurs. The words of highest IDF in a template are its anchors, and the index holds postings
(template, place) of them.

A second pass ranks each file's own licence words by IDF and looks the highest up, down to the least that the index
holds. Every place of such a word says where a passage of a template would begin; these postings are intersected by
relative position, with a slack of a twelfth of the template, so that words put in or left out do not part them: a
passage may begin where at least three quarters of the template's anchors agree. There it is verified with all words of the
template: at least ``AGREE`` of them must stand within the slack of their places, and the key phrase must stand in the
passage. Base phrases are counted wherever their words stand consecutively.

``score`` is the greatest share of a template's words that was verified; a file with base phrases and no verified
template has ``PHRASE_SCORE``, one without either 0.

Defined results: null text counts as empty; places count words from 0; a phrase at several places has its label
once; null ids and repeated rows each have their row; with no document the result is empty; further columns are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmetrics.llm.licence_texts import TEMPLATES
from seatmetrics.llm.shared import NOT_WORD, hashed_words, slices

# The base phrases and labels of the contract.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Rarest words of a template in the index, and the share of its words that a passage must have.
ANCHORS = 8
AGREE = 0.6
#: Hundredths of a template's anchors that must agree on where a passage begins.
MEET = 75
#: Beginnings of passages that are verified at once.
AT_ONCE = 256
PHRASE_SCORE = 0.5


def words_of(text: str | None) -> np.ndarray:
    return hashed_words(text, NOT_WORD)


def plain_words(text: str) -> list[str]:
    """The words of a template; these are plain ASCII."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


class Vocabulary:
    """The places of known words in a document, by binary search in the sorted hashes of all licence words."""

    def __init__(self, words: list[str]):
        hashes = words_of(" ".join(words))
        order = np.argsort(hashes)
        self.keys, self.words = hashes[order], [words[i] for i in order]

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        """The number of each word of a document, -1 for words that no licence holds."""
        found = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        return np.where(self.keys[found] == hashed, found, -1)


def licence_words() -> list[str]:
    return sorted({w for t in TEMPLATES for w in plain_words(f"{t.text} {t.key}")} | {w for p, _ in BASE_PHRASES for w in p.split()})


def document_frequency(docs: DataFrame, column: str = "text") -> tuple[int, dict[str, int]]:
    """Over all documents: how many there are, and how many hold each licence word.

    Each task returns one count for each licence word, so what meets is bounded by the templates.
    """
    words = licence_words()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(words)
        seen, total = np.zeros(len(words) + 1, np.int64), 0
        for frame in frames:
            for text in frame[column]:
                seen[np.unique(vocabulary.numbers(words_of(text)))] += 1
            total += len(frame)
        yield pd.DataFrame({"word": ["", *vocabulary.words], "n": [total, *seen[:-1].tolist()]})

    rows = docs.select(column).mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: int(r["n"]) for r in rows}
    return counts.pop("", 0), counts


def standing(number: np.ndarray, phrase: list[int]) -> np.ndarray:
    """The places at which the words of ``phrase`` stand one after the other."""
    n = len(number) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(number[:n] == phrase[0])
    for k, w in enumerate(phrase[1:], 1):
        at = at[number[at + k] == w]
    return at


def slack(length: int) -> int:
    """How far a word of a passage may stand from its place."""
    return max(2, length // 12)


class LicenceIndex:
    """The words of each template, its anchors, and the anchors' postings."""

    def __init__(self, documents: int, frequency: dict[str, int]):
        self.vocabulary = Vocabulary(licence_words())
        number = {w: k for k, w in enumerate(self.vocabulary.words)}
        self.idf = np.array([math.log((1 + documents) / (1 + frequency.get(w, 0))) + 1 for w in self.vocabulary.words])
        self.base = [([number[w] for w in phrase.split()], label) for phrase, label in BASE_PHRASES]
        self.key = [[number[w] for w in plain_words(t.key)] for t in TEMPLATES]
        self.words = [np.array([number[w] for w in plain_words(t.text)], np.int64) for t in TEMPLATES]
        self.needed: list[int] = []
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            ranked = sorted(set(words.tolist()), key=lambda w: (-self.idf[w], self.vocabulary.words[w]))[:ANCHORS]
            anchors = [(place, w) for place, w in enumerate(words.tolist()) if w in ranked]
            self.needed.append(-(-MEET * len(anchors) // 100))
            for place, w in anchors:
                self.postings.setdefault(w, []).append((k, place))
        self.least_idf = min(self.idf[w] for w in self.postings)

    def candidates(self, number: np.ndarray) -> dict[int, np.ndarray]:
        """Template -> places at which a passage of it may begin: where the postings of enough anchors meet."""
        known = np.unique(number[number >= 0])
        ranked = known[np.argsort(-self.idf[known], kind="stable")]
        hits: dict[int, list[np.ndarray]] = {}
        for w in ranked[self.idf[ranked] >= self.least_idf].tolist():
            if w in self.postings:
                at = np.flatnonzero(number == w)
                for template, place in self.postings[w]:
                    hits.setdefault(template, []).append(at - place)
        return {t: begin for t, x in hits.items() if len(x) >= self.needed[t] and len(begin := self._meet(x, t, len(number)))}

    def _meet(self, begins: list[np.ndarray], template: int, n: int) -> np.ndarray:
        """Beginnings that are within the slack of those of at least as many anchors as are needed."""
        length, wide = len(self.words[template]), slack(len(self.words[template]))
        first = -length - wide
        agree = np.zeros(n + length + 2 * wide + 1, np.int32)
        for begin in begins:
            edge = np.zeros(len(agree) + 1, np.int32)
            np.add.at(edge, begin - wide - first, 1)
            np.add.at(edge, np.minimum(begin + wide + 1 - first, len(agree)), -1)
            agree += np.cumsum(edge[:-1]) > 0
        return np.flatnonzero(agree >= self.needed[template]) + first

    def shares(self, number: np.ndarray, template: int, begin: np.ndarray) -> np.ndarray:
        """The share of all words of the template that stand within the slack of where a passage from ``begin`` has them."""
        words, n = self.words[template], len(number)
        wide = slack(len(words))
        own = np.flatnonzero(number >= 0)
        held = np.sort(number[own].astype(np.int64) * n + own)  # places of each word in a row
        out = np.zeros(len(begin))
        for low in range(0, len(begin), AT_ONCE):
            place = begin[low : low + AT_ONCE, None] + np.arange(len(words))[None, :]
            least, most = np.maximum(place - wide, 0), np.minimum(place + wide, n - 1)
            found = np.searchsorted(held, words[None, :] * n + least)
            stands = (least <= most) & (found < len(held)) & (held[np.minimum(found, len(held) - 1)] <= words[None, :] * n + most)
            out[low : low + AT_ONCE] = stands.mean(1)
        return out

    def verified(self, number: np.ndarray) -> list[tuple[str, float]]:
        """(label, share) of each template that stands in a file: its best passage among those that hold the key phrase."""
        out = []
        for template, begin in self.candidates(number).items():
            keys = standing(number, self.key[template])
            if not len(keys):
                continue
            length = len(self.words[template])
            wide = slack(length)
            first = np.searchsorted(keys, begin - wide)
            ends = begin + length - len(self.key[template]) + wide
            begin = begin[(first < len(keys)) & (np.append(keys, 0)[first] <= ends)]
            share = self.shares(number, template, begin)
            if len(begin) and share.max() >= AGREE - 1e-9:
                out.append((TEMPLATES[template].label, float(share.max())))
        return out

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first, last, base labels, labels, score of one whole text."""
        number = self.vocabulary.numbers(words_of(text))
        places, base = [], set()
        for phrase, label in self.base:
            at = standing(number, phrase).tolist()
            places += at
            if at:
                base.add(label)
        found = self.verified(number) if len(number) else []
        labels = base | {label for label, _ in found}
        score = max([PHRASE_SCORE if base else 0.0, *(share for _, share in found)])
        return len(number), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    index = LicenceIndex(*document_frequency(docs, column))
    kinds = {id_column: pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(d, *index.scan(t)) for d, t in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    return docs.select(F.col(id_column).cast("bigint"), column).mapInArrow(run, f"{id_column} bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
