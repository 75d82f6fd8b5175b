"""BPE encoding and decoding with content-defined chunk reuse.

A text's UTF-8 bytes are cut where a rolling hash of the last eight bytes hits a
fixed pattern (about one byte in ``1 << CHUNK_BITS``), so that equal passages give
equal chunks wherever they stand.  A chunk is encoded once, whole, and kept with its
token ids; chunks that documents share are not encoded again.

A cut can fall inside a word, so each join is repaired: the neighbourhood of the cut
is encoded again and grows, over as many chunks as it takes, until the tokens at both
of its edges agree exactly with those of the chunks around it.  They provably do at
ASCII white space (neither the normaliser nor the pre-tokeniser joins or looks across
a run of it), so the neighbourhood is the word that the cut or cuts are in.

A fresh chunk is encoded by its words; a word of plain characters is split into
pre-tokens, and each distinct pre-token passes the library's merge model once.  Any
other word goes to the library whole.  Codecs live as long as a Python worker, over
tasks and queries; words, pre-tokens and chunks are kept up to a bounded number, the
oldest go first.  One pass over the documents, no shuffle.

Decoding joins the vocabulary's token strings as the library does for a tokenizer
that has no decoder: by single spaces, special tokens included.

Edge cases: null texts are empty and have no tokens; a text without white space is
one word, whatever its length; the tokenizer's own special strings in a text are
special tokens, as in the library; repeated documents are encoded for themselves; an
empty table gives no rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import map_slices, table

CHUNK_BITS = 9
WORDS_KEPT, CHUNK_BYTES_KEPT = 100_000, 16_000_000
#: Words of these characters only are normalised by lower-casing alone, and then split by _PIECE as the pre-tokeniser does.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The model's character of each byte: printable ones stand for themselves, the others follow 255 in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHARACTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_GEAR = np.random.default_rng(20240).integers(0, 1 << 32, 256, dtype=np.uint32)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(data: bytes) -> list[int]:
    """Where the chunks of a text begin, and its end; never inside a character."""
    if len(data) <= 1 << CHUNK_BITS:
        return [0, len(data)]
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    at = np.flatnonzero((h[:-1] >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    for _ in range(3):
        at = at + (raw[np.minimum(at, raw.size - 1)] & 0xC0 == 0x80)
    return [0, *np.unique(at[at < raw.size]).tolist(), len(data)]


def packed(ids: list[int]) -> bytes:
    """Token ids as little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encodes and decodes texts with one tokenizer; keeps chunks, words and pre-tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.names[i] = t.encode()
        self.pieces: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple | None] = {}
        self.chunk_bytes = 0
        self.asked = self.reused = 0

    def decode(self, ids: bytes) -> bytes:
        """The decoded text of packed token ids, in UTF-8."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _piece(self, text: str) -> bytes:
        """Packed ids of one pre-token, whose bytes the model reads as characters."""
        own = text if text.isascii() else text.encode().decode("latin-1").translate(_AS_CHARACTERS)
        out = self.pieces[text] = packed([t.id for t in self.model.tokenize(own)])
        return out

    def _learn(self, words: set[bytes]) -> None:
        """Encode the words that are not kept yet."""
        known, pieces, piece = self.words, self.pieces, self._piece
        whole: list[tuple[bytes, str]] = []
        for w in words:
            if w in known:
                continue
            if w.isalpha():  # ASCII letters: one pre-token
                t = w.lower().decode()
                known[w] = pieces.get(t) or piece(t)
                continue
            t = w.decode()
            if "<|" not in t and _PLAIN.fullmatch(t):
                known[w] = b"".join([pieces.get(p) or piece(p) for p in _PIECE.findall(t.lower())])
            else:
                whole.append((w, t))
        for start in range(0, len(whole), 5_000):
            part = whole[start : start + 5_000]
            for (w, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                known[w] = packed(e.ids)

    def _forget(self) -> None:
        """Drop the older half of what has outgrown its bound."""
        for kept in (self.words, self.pieces):
            if len(kept) > WORDS_KEPT:
                for k in list(islice(kept, len(kept) // 2)):
                    del kept[k]
        if self.chunk_bytes > CHUNK_BYTES_KEPT:
            for k in list(islice(self.chunks, len(self.chunks) // 2)):
                self.chunk_bytes -= _weight(k, self.chunks.pop(k))

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """Token ids of each UTF-8 text, as little-endian 32-bit numbers."""
        self._forget()
        chunks = self.chunks
        cut_up = []
        fresh: dict[bytes, tuple[bytes, list[bytes], bytes] | None] = {}
        for data in texts:
            at = cuts(data) if data else []
            own = [data[first:end] for first, end in zip(at, at[1:], strict=False)]
            cut_up.append(own)
            self.asked += len(own)
            for c in own:
                if c not in chunks and c not in fresh:
                    fresh[c] = _parts(c)
        self.reused += sum(map(len, cut_up)) - len(fresh)
        need: set[bytes] = set()
        for parts in fresh.values():
            if parts:
                need.update(parts[1])
                need.update((parts[0], parts[2]))
        self._learn(need)
        word = self.words.__getitem__
        for c, parts in fresh.items():
            # both fragments with the ids that they have by themselves, and the ids of what lies between
            chunks[c] = kept = (parts[0], word(parts[0]), b"".join(map(word, parts[1])), parts[2], word(parts[2])) if parts else None
            self.chunk_bytes += _weight(c, kept)
        plans = [self._plan(own) for own in cut_up]
        self._learn({p for plan in plans for p in plan if type(p) is bytes})
        word = self.words.__getitem__
        return [b"".join([word(p) if type(p) is bytes else p[0] for p in plan]) for plan in plans]

    def _plan(self, own: list[bytes]) -> list:
        """What a text's ids are made of: ids that stand, as (ids,), and neighbourhoods of cuts, to be encoded again."""
        plan: list = []
        left, left_ids = b"", b""  # what follows the last white space so far
        for c in own:
            kept = self.chunks[c]
            if kept is None:  # no white space: the neighbourhood grows by the whole chunk
                left, left_ids = left + c, b""
                continue
            head, head_ids, ids, tail, tail_ids = kept
            if left and head:
                plan.append(left + head)
            elif left:
                plan.append((left_ids,) if left_ids else left)
            else:
                plan.append((head_ids,))
            plan.append((ids,))
            left, left_ids = tail, tail_ids
        if left:
            plan.append((left_ids,) if left_ids else left)
        return plan


def _parts(chunk: bytes) -> tuple[bytes, list[bytes], bytes] | None:
    """What precedes the first white space, the words between, what follows the last; none without white space."""
    words = chunk.split()
    if not words:
        return b"", [], b""
    opens, ends = chunk[:1].isspace(), chunk[-1:].isspace()
    if len(words) == 1 and not opens and not ends:
        return None
    head = b"" if opens else words.pop(0)
    tail = b"" if ends else words.pop()
    return head, words, tail


def _weight(chunk: bytes, kept: tuple | None) -> int:
    """About how many bytes a kept chunk takes."""
    return len(chunk) + 300 + (sum(map(len, kept)) if kept else 0)


_codecs: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """This process's codec of a tokenizer: it outlives tasks."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids of every document."""
    place = path or tokenizer_path()

    def make():
        codec = codec_of(place)

        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            done = codec.encode_all(part.column("text").cast(pa.binary()).to_pylist())
            columns = [part.column("doc_id"), pa.array([len(i) // 4 for i in done], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in done]), pa.array([hashlib.sha256(codec.decode(i)).hexdigest() for i in done])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                flat = np.frombuffer(b"".join(done), "<i4")
                ends = np.cumsum([0, *(len(i) // 4 for i in done)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            return pa.record_batch(columns, names=names)

        return kernel

    id_type = dict(docs.dtypes)["doc_id"]
    return map_slices(docs.select("doc_id", "text"), make, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode(table(spark, sf_dir, "documents"))
