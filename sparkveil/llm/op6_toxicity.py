"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is a bag of sentences.  A sentence's probability is a logistic function
of its hashed word unigrams and bigrams (lower-cased, outer punctuation stripped)
and of the words' beginnings of six and eight letters, which catch inflected and
compound insults; the document's is the noisy-or ``1 - prod(1 - p)``.  Only document labels are used:
the gradient of the document's log-likelihood reaches each sentence in proportion
to its share of the noisy-or.  Once trained, the sentence scores locate the
offending sentences (``locate``).

Weights are fitted by AdaGrad with an L2 pull, for features of at least
``least_docs`` documents (rarer ones would only be memorised).  Word weights
stay at zero or above: only evidence for toxicity adds up, so a sentence cannot be
excused by its common words.  One sampled document in ``CHECKED`` does not train the weights but
sets the threshold, which is moved to a score of one half.  Training reads at most ``sample`` labelled
documents (a documented bound: 6,000 by default, chosen by a hash of the id), every one of them whole and of any length:
their words' hashes lie in the shared folder and the driver reads them again each epoch, holding those of ``memory`` bytes.  Scoring reads every whole text in one pass without a shuffle; the model is a
fixed 4 * 2**BITS bytes or so.

Edge cases: null and empty texts have no sentence; their score is that of a sentence
without words.  Without labels of both classes every score, of long texts too, is the smoothed share of
the class seen (one half without labels).  Null ids are scored and never held out; repeated documents are
scored for themselves and repeated labels count once; an empty table gives no rows; columns other than
doc_id, text and the label are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Replayed, labelled_sample, map_slices, remainder, table

BITS = 20
WORDS_KEPT = 200_000
#: One in so many sampled documents sets the threshold instead of the weights.
CHECKED = 5
FALSE_ALARM = 3
_ENDS = (".", "!", "?", "…", "。")
_MARKS = " \t\r\n.,;:!?\"'()[]{}<>*#$%&@^_`|~-+=/\\«»„“”…"
#: The place of a weight that stays zero; the threshold's logit and the bias follow it.
_NOTHING = 1 << BITS
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Vocabulary(dict):
    """word -> its place in ``hash``; ``ends`` marks words that end a sentence."""

    def __init__(self) -> None:
        self._room(WORDS_KEPT)

    def _room(self, size: int) -> None:
        old_hash, old_ends = getattr(self, "hash", np.zeros((3, 0), np.uint64)), getattr(self, "ends", np.zeros(0, np.uint8))
        self.hash, self.ends = np.zeros((3, size), np.uint64), np.zeros(size, np.uint8)
        self.hash[:, : old_ends.size], self.ends[: old_ends.size] = old_hash, old_ends
        self._hash, self._six, self._eight, self._ends = map(memoryview, (*self.hash, self.ends))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at >= len(self._hash):  # one text has more words than are kept
            self._room(2 * at)
        core = word.strip(_MARKS).lower()
        self._hash[at] = xxhash.xxh64_intdigest(core)
        self._six[at] = xxhash.xxh64_intdigest(core[:6], 6)
        self._eight[at] = xxhash.xxh64_intdigest(core[:8], 8)
        self._ends[at] = word.rstrip("\"')]»”*").endswith(_ENDS)
        self[word] = at
        return at


class Sentences:
    """Hashed features of the sentences of a text."""

    def __init__(self) -> None:
        self.known = _Vocabulary()

    def words(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and of their beginnings (three rows), and where each sentence starts."""
        words = text.split() if text else []
        if len(self.known) > WORDS_KEPT * 3 // 4:
            self.known = _Vocabulary()
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        starts = np.flatnonzero(self.known.ends[at[:-1]]) + 1 if at.size else np.zeros(0, np.int64)
        return self.known.hash[:, at], np.concatenate([[0], starts]).astype(np.int64)[: max(1, at.size)]

    @staticmethod
    def features(word: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Four features of each word; a bigram does not reach into the sentence before, a word that repeats the last has none."""
        before = np.concatenate([np.zeros(1, np.uint64), word[0, :-1]])
        before[starts] = 0
        every = np.concatenate([word, (before * _MIX[1] + word[0])[None]])
        out = ((every * _MIX[0]) >> np.uint64(64 - BITS)).astype(np.int64)
        out[:, 1:][:, word[0, 1:] == word[0, :-1]] = _NOTHING
        return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sentence_logits(weights: np.ndarray, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if not word.size:
        return weights[-1:].astype(np.float64)
    return np.add.reduceat(weights[Sentences.features(word, starts)].sum(0, dtype=np.float64), starts) + weights[-1]


def noisy_or(z: np.ndarray) -> float:
    """1 - prod(1 - p), from logits, without losing small values."""
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def logit(p: float | np.ndarray) -> float | np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit, between those of 0.02 and 0.5, with the least errors; the middle of several such.

    A clean document called toxic counts as ``FALSE_ALARM`` errors.
    """
    if len(set(y.tolist())) < 2:
        return 0.0
    tried = np.linspace(logit(0.02), 0.0, 79)
    called = z[None] >= tried[:, None]
    errors = (~called & (y[None] == 1)).sum(1) + FALSE_ALARM * (called & (y[None] == 0)).sum(1)
    best = np.flatnonzero(errors == errors.min())
    return float(tried[best[len(best) // 2]])


def document_score(weights: np.ndarray, z: np.ndarray) -> float:
    """Noisy-or of the sentences, moved so that the learned threshold is one half."""
    return float(_logistic(logit(noisy_or(z)) - weights[-2]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0, sample: int = 6000, epochs: int = 12, rate: float = 0.5, l2: float = 1e-4, start: float = -6.0, least_docs: int = 6, memory: int = 128_000_000) -> np.ndarray:
    """Weights (the bias last) from at most ``sample`` labelled documents outside the held-out fold."""
    chosen = F.broadcast(labelled_sample(labels, label, modulus, held, sample))

    def make():
        sentences = Sentences()

        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            ties, hashes, orders, starts = [], [], [], []
            for text in part.column("text").to_pylist():
                w, s = sentences.words(text)
                _, first, order = np.unique(w[0], return_index=True, return_inverse=True)
                ties.append(hashlib.md5((text or "").encode()).digest())
                hashes.append(w[:, first].astype("<u8").tobytes())
                orders.append(order.astype("<i4").tobytes())
                starts.append(s.astype("<i4").tobytes())
            columns = [part.column("place"), part.column("label"), *(pa.array(c, pa.binary()) for c in (ties, hashes, orders, starts))]
            return pa.record_batch(columns, names=["place", "label", "tie", "hashes", "words", "starts"])

        return kernel

    rows = docs.select(F.col("doc_id").alias("sample_id"), "text").join(chosen, "sample_id").select("place", "label", "text")

    def bag(x) -> tuple:
        word = np.frombuffer(x.hashes, "<u8").reshape(3, -1)[:, np.frombuffer(x.words, "<i4")]
        starts = np.frombuffer(x.starts, "<i4").astype(np.int64)
        at, where = np.unique(Sentences.features(word, starts), return_inverse=True)
        return x.label, at, where.reshape(4, -1).astype(np.int32), starts

    got = map_slices(rows, make, "place long, label int, tie binary, hashes binary, words binary, starts binary")
    bags = Replayed(got, bag, memory)  # some three times as large once decoded
    sums = bags.table.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    worded = bags.table.where(F.octet_length("words") > 0)
    classes = worded.select("label").distinct().count()
    bags.table = worded
    common = np.zeros((1 << BITS) + 3, np.int32)  # documents of the sample that have a feature
    for _, at, _, _ in bags:
        common[at] += 1
    common = common >= least_docs
    common[_NOTHING] = False
    ones, seen_docs = sums.ones, sums.n
    w = np.zeros((1 << BITS) + 3)
    if ones in (0, seen_docs) or classes < 2:
        # no sentence counts, whatever their number; the threshold puts that at the share of the documents
        w[-1] = -30 * np.log(10)
        w[-2] = logit(0.0) - np.log((ones + 1) / (seen_docs - ones + 1))
        return w.astype(np.float32)
    w[-1], seen = start, np.full(w.size, 0.1)
    for _ in range(epochs):
        for k, (y, at, where, starts) in enumerate(bags):
            if k % CHECKED == 0:
                continue
            z = np.add.reduceat(w[at][where].sum(0), starts) + w[-1]
            p = _logistic(z)
            total = max(noisy_or(z), 1e-9)
            slope = -p * (1 - total) / total if y else p  # of the loss by each sentence's logit
            by_word = np.repeat(slope, np.diff(np.append(starts, where.shape[1])))
            g = (np.bincount(where.ravel(), np.tile(by_word, 4), at.size) + l2 * w[at]) * common[at]
            seen[at] += g * g
            w[at] = np.maximum(w[at] - rate * g / np.sqrt(seen[at]), 0)
            g = slope.sum()
            seen[-1] += g * g
            w[-1] -= 0.2 * rate * g / np.sqrt(seen[-1])
    checked = [(logit(noisy_or(np.add.reduceat(w[at][where].sum(0), starts) + w[-1])), y) for k, (y, at, where, starts) in enumerate(bags) if k % CHECKED == 0]
    bags.drop()
    w[-2] = best_threshold(np.array([z for z, _ in checked]), np.array([y for _, y in checked]))
    return w.astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        sentences, w = Sentences(), sent.value

        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            out = [document_score(w, sentence_logits(w, *sentences.words(t))) for t in part.column("text").to_pylist()]
            return pa.record_batch([part.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

        return kernel

    id_type = dict(docs.dtypes)["doc_id"]
    return map_slices(docs.select("doc_id", "text"), make, f"doc_id {id_type}, score double")


def locate(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score) of the sentences that score at least ``least``; offsets are code points."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        sentences, w = Sentences(), sent.value

        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            for key, text in zip(part.column("doc_id"), part.column("text").to_pylist(), strict=True):
                word, starts = sentences.words(text)
                p = _logistic(sentence_logits(w, word, starts)) if word.size else np.zeros(0)
                if p.size and p.max() >= least:
                    places = [m.span() for m in re.finditer(r"\S+", text)]
                    ends = np.append(starts[1:], word.shape[1])
                    rows += [(key.as_py(), places[starts[k]][0], places[ends[k] - 1][1], float(p[k])) for k in np.flatnonzero(p >= least)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (part.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.float64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "end", "score"])

        return kernel

    id_type = dict(docs.dtypes)["doc_id"]
    return map_slices(docs.select("doc_id", "text"), make, f"doc_id {id_type}, start long, end long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
