"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal.

Features are word unigrams and bigrams and the unigrams to trigrams of *word
shapes* (case pattern, digits, punctuation kept; a word that repeats the one
before has the shape ``=``), all hashed into one weight vector of 2**BITS
entries.  A text's value for a feature is its count over the square root of the
number of features, so scores do not grow with length.  Weights are learned by
follow-the-regularised-leader updates, one document at a time; scoring is a sparse
dot product: a gather from the broadcast weight vector (a fixed 4 * 2**BITS bytes).

Training reads a sample of at most ``sample`` labelled documents (a documented
bound: 6,000 by default, chosen by a hash of the id), every one of them whole and of any
length: features are made in tasks, lie in the shared folder, and the driver reads them again each epoch, holding
``memory`` bytes of them at most beside the part it is reading.  Scoring reads every whole text.

Edge cases: null and empty texts have no features, so their score is the logistic
of the bias; without labels of both classes every score is the (smoothed) share
of the class seen (one half without labels); null ids are scored and never held out;
repeated documents are scored for themselves and repeated labels count once; an empty
table gives no rows; columns other than doc_id, text and the label are not read, whatever their names.
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
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Kinds(dict):
    """Code point -> A or a for letters by case, 0 for digits, else itself; for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self[code] = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        return out


_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KINDS, _RUNS, _ENDS = _Kinds(), re.compile(r"(.)\1{2,}", re.DOTALL), re.compile(r"(.)\1{3,}", re.DOTALL)


def shape(word: str) -> str:
    """Case, digits and punctuation of a whole word; a run of one kind counts as two, of one final mark as three."""
    core = word.rstrip(_MARKS)
    if core.isalpha():
        tail = _ENDS.sub(r"\1\1\1", word[len(core) :])
        if core.islower():
            return ("aa" if len(core) > 1 else "a") + tail
        if core.isupper():
            return ("AA" if len(core) > 1 else "A") + tail
        if core[0].isupper() and core[1:].islower():
            return ("Aaa" if len(core) > 2 else "Aa") + tail
    return _RUNS.sub(r"\1\1", word.translate(_KINDS))


_SAME = np.uint64(xxhash.xxh64_intdigest("=", 7))


class _Vocabulary(dict):
    """word -> its place in ``columns``: hash of the word, hash of its shape."""

    def __init__(self) -> None:
        self._room(WORDS_KEPT)

    def _room(self, size: int) -> None:
        """Make room for ``size`` words; the columns are also held as views that take single integers fast."""
        old = getattr(self, "columns", np.zeros((2, 0), np.uint64))
        self.columns = np.zeros((2, size), np.uint64)
        self.columns[:, : old.shape[1]] = old
        self.word, self.form = memoryview(self.columns[0]), memoryview(self.columns[1])

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at >= len(self.word):  # one text has more words than are kept
            self._room(2 * at)
        self.word[at] = xxhash.xxh64_intdigest(word)
        self.form[at] = xxhash.xxh64_intdigest(shape(word), 7)
        self[word] = at
        return at


class Features:
    """Hashed feature ids of one text, with repeats."""

    def __init__(self) -> None:
        self.known = _Vocabulary()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        if not words:
            return np.zeros(0, np.int64)
        if len(self.known) > WORDS_KEPT * 3 // 4:
            self.known = _Vocabulary()
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        word, form = self.known.columns[0][at], self.known.columns[1][at]
        form[1:][at[1:] == at[:-1]] = _SAME
        parts = [word * _MIX[0], form * _MIX[1], (word[:-1] * _MIX[2] + word[1:]) * _MIX[0], (form[:-1] * _MIX[3] + form[1:]) * _MIX[1]]
        parts.append(((form[:-2] * _MIX[3] + form[1:-1]) * _MIX[2] + form[2:]) * _MIX[0])
        return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal logistic regression over sparse examples."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        """One example; the last position is the bias."""
        at, value = np.append(at, self.z.size - 1), np.append(value, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
        g = (p - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1, sample: int = 6000, epochs: int = 4, memory: int = 48_000_000) -> np.ndarray:
    """Weights (the bias last) from at most ``sample`` labelled documents outside the held-out fold."""
    chosen = F.broadcast(labelled_sample(labels, label, modulus, held, sample))

    def make():
        features = Features()

        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in part.column("text").to_pylist():
                at, count = np.unique(features(text), return_counts=True)
                out.append((hashlib.md5((text or "").encode()).digest(), at.astype("<i4").tobytes(), count.astype("<i4").tobytes(), int(count.sum())))
            ties, ats, counts, totals = zip(*out, strict=True)
            return pa.record_batch([part.column("place"), part.column("label"), *(pa.array(c, pa.binary()) for c in (ties, ats, counts)), pa.array(totals, pa.int64())], names=["place", "label", "tie", "at", "n", "total"])

        return kernel

    rows = docs.select(F.col("doc_id").alias("sample_id"), "text").join(chosen, "sample_id").select("place", "label", "text")
    found = Replayed(map_slices(rows, make, "place long, label int, tie binary, at binary, n binary, total long"), lambda x: (x.label, np.frombuffer(x.at, "<i4"), np.frombuffer(x.n, "<i4"), x.total), memory)
    seen = found.table.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    if seen.ones in (0, seen.n):
        out = np.zeros((1 << BITS) + 1)
        out[-1] = np.log((seen.ones + 1) / (seen.n - seen.ones + 1))
        return out.astype(np.float32)
    model = Ftrl(1 << BITS)
    for _ in range(epochs):
        for y, at, count, total in found:
            model.update(at.astype(np.int64), count / max(1, total) ** 0.5, y)
    found.drop()
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        features, w = Features(), sent.value
        bias = float(w[-1])

        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            out = np.full(part.num_rows, bias)
            for k, text in enumerate(part.column("text").to_pylist()):
                if (at := features(text)).size:
                    out[k] += float(w[at].sum(dtype=np.float64)) / at.size**0.5
            return pa.record_batch([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], names=["doc_id", "score"])

        return kernel

    id_type = dict(docs.dtypes)["doc_id"]
    return map_slices(docs.select("doc_id", "text"), make, f"doc_id {id_type}, score double")


def keep_good(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The documents whose score is at least one half, in one pass over the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        features, w = Features(), sent.value

        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for text in part.column("text").to_pylist():
                at = features(text)
                keep.append(float(w[-1]) + (float(w[at].sum(dtype=np.float64)) / at.size**0.5 if at.size else 0.0) >= 0)
            return part.filter(pa.array(keep, pa.bool_()))

        return kernel

    return map_slices(docs, make, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
