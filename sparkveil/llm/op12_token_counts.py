"""Token counts by byte-pair merging with a heap and a linked list; no token id is made.

A pre-token starts as its symbols, a doubly linked list.  The heap holds the adjacent
pairs that have a merge, by rank and place; the least is popped again and again, its
right symbol is unlinked and its two new neighbours are pushed.  An entry whose pair
has changed since is skipped.  Each merge takes one symbol away, so the count is the
number of symbols at the start less the number of merges: n log n steps for a
pre-token of any length.

A text is cut at ASCII white space, across which neither normaliser nor
pre-tokeniser looks.  A word of plain characters is split by the pattern
here, any other by the library's own normaliser and pre-tokeniser (merging is done
here for all).  Special strings in a text count one token each and are found before
normalising, as the library does by default.  Counters live as long as a Python
worker and keep a bounded number of words and pre-tokens.

Only texts go to Python and one number a text comes back.  One pass, no shuffle.

Edge cases: null texts are empty and have no tokens; a text without white space is one word; a
text of any length is read in windows of a million bytes, cut at white space; repeated rows are
counted alike; no rows give no rows; columns other than doc_id and text are not read, whatever
their names.  Vocabularies: files of the tokenizers library with a BPE model over bytes and a
pre-tokeniser that drops white space; others are refused.
"""

from __future__ import annotations

import json
import os
import re
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .op2_bpe import tokenizer_path

LIMIT = 2048
KEPT = 150_000
WINDOW = 1 << 20
#: Words of these characters only are normalised by lower-casing alone, and then split by _PIECE as the pre-tokeniser does.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SPACE = re.compile(rb"[\x09-\x0D\x20]")
#: The character of each byte in the vocabulary: printable ones stand for themselves, the others follow 255 in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHARACTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_SHIFT, _PLACE = 20, (1 << 40) - 1


class Counter:
    """Counts the tokens of texts with one vocabulary; keeps words and pre-tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        model = stated["model"]
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or self.pre_tokenizer.pre_tokenize_str(" \n"):
            raise ValueError(f"{path}: not a byte-level BPE whose pre-tokeniser drops white space")
        vocabulary, self.ending = model["vocab"], model.get("end_of_word_suffix") or ""
        self.symbols = {c: vocabulary.get(c) for c in map(chr, [*_PRINTED, *_AS_CHARACTERS.values()])}
        self.last = {c: vocabulary.get(c + self.ending) for c in self.symbols}
        self.merges: dict[int, int] = {}
        self.products: list[int] = []
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges[vocabulary[left] << _SHIFT | vocabulary[right]] = rank
            self.products.append(vocabulary[left + right])
        special = sorted((t["content"] for t in stated["added_tokens"]), key=len, reverse=True)
        if any(s.isalpha() or re.search(r"\s", s) for s in special):
            raise ValueError(f"{path}: a special string of letters only, or with white space")
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.pieces: dict[str, int] = {}
        self.words: dict[bytes, int] = {}

    def merged(self, symbols: list[int]) -> int:
        """How many of the symbols are left when no adjacent pair has a merge."""
        n = left = len(symbols)
        rank, products = self.merges.get, self.products
        heap = []
        for k in range(n - 1):
            r = rank(symbols[k] << _SHIFT | symbols[k + 1])
            if r is not None:
                heap.append(r << 40 | k)
        if not heap:
            return n
        heapify(heap)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            k, made = entry & _PLACE, products[entry >> 40]
            mine, j = symbols[k], following[k]
            if mine < 0 or j == n:
                continue
            now = rank(mine << _SHIFT | symbols[j])
            if now is None or products[now] != made:
                continue
            symbols[k], symbols[j] = made, -1
            left -= 1
            after = following[k] = following[j]
            if after < n:
                before[after] = k
                r = rank(made << _SHIFT | symbols[after])
                if r is not None:
                    heappush(heap, r << 40 | k)
            j = before[k]
            if j >= 0:
                r = rank(symbols[j] << _SHIFT | made)
                if r is not None:
                    heappush(heap, r << 40 | j)
        return left

    def _mapped(self, own: str) -> int:
        """Tokens of one pre-token in the vocabulary's characters; characters that it lacks give none, as in the library."""
        symbols = [self.symbols[c] for c in own[:-1]]
        symbols.append(self.last[own[-1]])
        return self.merged([s for s in symbols if s is not None])

    def _piece(self, text: str) -> int:
        own = text if text.isascii() else text.encode().decode("latin-1").translate(_AS_CHARACTERS)
        out = self.pieces[text] = self._mapped(own)
        return out

    def _learn(self, words: set[bytes]) -> None:
        """Count the tokens of words that are not kept yet."""
        known, pieces, piece = self.words, self.pieces, self._piece
        for w in words:
            t = w.decode()
            if w.isalpha():  # ASCII letters: one pre-token
                t = t.lower()
                known[w] = pieces.get(t) or piece(t)
            elif not self.special.search(t) and _PLAIN.fullmatch(t):
                known[w] = sum([pieces.get(p) or piece(p) for p in _PIECE.findall(t.lower())])
            else:
                parts = self.special.split(t)
                known[w] = len(parts) - 1 + sum(self._mapped(p) for part in parts if part for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part)) if p)

    def count(self, data: bytes) -> int:
        """Tokens of a text in UTF-8."""
        total = at = 0
        while at < len(data):
            end = at + WINDOW
            if end < len(data):
                space = _SPACE.search(data, end)
                end = space.end() if space else len(data)
            words = data[at:end].split()
            self._learn(set(words).difference(self.words))
            total += sum(map(self.words.__getitem__, words))
            for kept in (self.words, self.pieces):
                if len(kept) > KEPT:
                    for k in list(islice(kept, len(kept) // 2)):
                        del kept[k]
            at = end
        return total


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """This process's counter of a vocabulary: it outlives tasks."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    place = path or tokenizer_path()

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        counter = counter_of(place)
        return pa.array([counter.count(t.as_py() or b"") for t in texts.cast(pa.binary())], pa.int64())

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 2,048 tokens."""
    return count_tokens(table(spark, sf_dir, "documents"))
