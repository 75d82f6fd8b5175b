"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` (20) consecutive words.  A word goes if a window covers it whose
words also start earlier: in a document with a smaller id, or earlier in the same one.

Anchors are runs of ``ANCHOR`` (8) words at the positions that lie in a difference
cover modulo ``PERIOD`` (13): {0, 1, 3, 9}.  For any two positions i and j there is a
shift d < 13 that puts both i + d and j + d into the cover, so two equal windows
always share an anchor at one offset.  Only 4 of 13 positions are hashed and sent.  Windows
that hold an anchor seen twice are the only candidates; extending such anchors to
whole windows (hashed to 96 bits) decides which of them start earlier.

Scale.  Documents are packed, compressed, into blocks of neighbouring ids of some
``BLOCK_BYTES``; a block is worked on by one task, one at a time, and a block's repeats
inside itself are settled there.  Between blocks travel only sorted, distinct
hashes, dealt by hash range into buckets, and what comes back is one bit a hash:

  1. blocks send anchor hashes (6 bytes each); buckets answer which are repeated;
  2. blocks send candidate windows (12 bytes each); buckets answer which occur in an earlier block;
  3. blocks remove the covered words.

A hash reaches a bucket at most once from a block, so a passage with thousands of copies
makes no hot bucket, and nothing is compared pair by pair.  Texts are shuffled, compressed, once
a step; the answers' bits are small.  A block sends a message only to
buckets that get a hash of it, so there are never more messages than hashes, however many
blocks and buckets.  A 48-bit anchor hash may collide: that only adds candidates.  Block
bounds are quantiles of a sample of at most some 200,000 ids; with more blocks than that,
the ids between two bounds are cut evenly.  Rows of one id (or of null) that fill several
blocks are dealt by a hash of their text.

Edge cases: null and word-less texts have no words; null ids count as smaller than all
others; rows that repeat a doc_id are ordered by a hash of their text, then by the text,
equal rows by place; an empty table gives no rows; columns other than doc_id and text are
not read, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans import scratch
from ._common import table

WINDOW, PERIOD, COVER, ANCHOR = 20, 13, (0, 1, 3, 9), 8
BLOCK_BYTES, BUCKET_BYTES = 8_000_000, 16_000_000
PACK_BYTES, WORDS_KEPT, BOUNDS_SAMPLE, KEYS_A_TASK = 24_000_000, 300_000, 200_000, 4
_M = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)]
_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True


class _Hashes(dict):
    """word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _text_hash(text: bytes | None) -> int:
    return xxhash.xxh64_intdigest(text or b"", 8)


def _power(m: np.uint64, k: int) -> np.uint64:
    return np.uint64(pow(int(m), k, 1 << 64))


def run_hashes(words: np.ndarray, size: int, m: np.uint64) -> np.ndarray:
    """Hash of the ``size`` words from each position on; by doubling."""
    n = words.size - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, length = None, 0, words, 1
    while True:
        if size & length:
            part = power[done : done + n]
            out = part.copy() if out is None else out * _power(m, length) + part
            done += length
        if 2 * length > size:
            break
        power = power[: power.size - length] * _power(m, length) + power[length:]
        length *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Block:
    """The documents of a block in order, with the hashes of their words."""

    def __init__(self, parts: list[bytes], known: _Hashes) -> None:
        rows = []
        for part in parts:
            rows += zip(*pickle.loads(zstandard.decompress(part)), strict=True)  # noqa: S301  packed by pack()
        rows.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, _text_hash(r[1]), r[1] or b""))
        self.ids, self.texts = [r[0] for r in rows], [r[1] or b"" for r in rows]
        self.words, starts = [], [0]
        for t in self.texts:
            w = t.split()
            self.words.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
            starts.append(starts[-1] + len(w))
        self.starts = np.array(starts)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """48-bit hashes of the block's anchors, and their places among the block's words."""
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for w, start in zip(self.words, self.starts, strict=False):
            if w.size >= WINDOW:
                h = run_hashes(w, ANCHOR, _M[0])
                at = np.flatnonzero(_IN_COVER[np.arange(h.size) % PERIOD])
                hashes.append(h[at] >> np.uint64(16))
                places.append(at + start)
        return np.concatenate(hashes), np.concatenate(places)

    def candidates(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (two columns: 64 and 32 bits) and places of the windows that hold one of the anchors at ``places``."""
        marked = np.zeros(self.starts[-1] + 1, np.int64)
        marked[places] = 1
        before = np.concatenate([[0], np.cumsum(marked)])
        hashes, at_all = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
        for w, start in zip(self.words, self.starts.tolist(), strict=False):
            n = w.size - WINDOW + 1
            if n <= 0 or before[start + w.size] == before[start]:
                continue
            held = before[start + PERIOD : start + n + PERIOD] - before[start : start + n]
            at = np.flatnonzero(held)
            both = [run_hashes(w, WINDOW, m)[at] for m in _M]
            hashes.append(np.stack([both[0], both[1] >> np.uint64(32)], 1))
            at_all.append(at + start)
        return np.concatenate(hashes), np.concatenate(at_all)


def _ranges(sorted_hashes: np.ndarray, bits: int, buckets: int) -> tuple[list[int], list[int], list[int]]:
    """The buckets that sorted hashes fall into, in order, and where the hashes of each begin and end."""
    bucket = (sorted_hashes >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63))) if bucket.size else np.zeros(0, np.int64)
    return bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), bucket.size][: first.size]


def _first(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 96-bit hashes in order, the row of each one's first occurrence, each row's number among them."""
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))  # stable: equal hashes stay in the order of their places
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]).any(1)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return h[new], order[new], number


def _write_windows(hashes: np.ndarray) -> bytes:
    return hashes[:, 0].astype("<u8").tobytes() + hashes[:, 1].astype("<u4").tobytes()


def _read_windows(data: bytes) -> np.ndarray:
    n = len(data) // 12
    return np.stack([np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n).astype(np.uint64)], 1)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one key after another, from batches sorted by the key."""
    held: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
            if held and held[0][key] != row[key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held


class Blocks:
    """Which block a document falls into: blocks are in the order of ids, null first, then of the texts' hashes.

    ``bounds`` are sorted quantiles of the ids, with repeats; ``cuts``: in how many blocks the numbers between two bounds are cut.
    """

    def __init__(self, bounds: list, nulls: int = 1, cuts: int = 1) -> None:
        self.bounds, self.nulls = bounds, nulls
        self.cuts = cuts if bounds and isinstance(bounds[0], (int, float)) else 1

    def __call__(self, key, text: bytes | None) -> int:
        if key is None:
            return _text_hash(text) * self.nulls >> 64
        first, end = bisect.bisect_left(self.bounds, key), bisect.bisect_right(self.bounds, key)
        if end > first + 1:  # the id fills blocks of its own
            return self.nulls + self.cuts * (first + 1 + (_text_hash(text) * (end - first - 1) >> 64))
        at = self.nulls + self.cuts * end
        if self.cuts > 1 and 0 < end < len(self.bounds):
            low, high = self.bounds[end - 1], self.bounds[end]
            at += min(self.cuts - 1, int((key - low) * self.cuts // (high - low)))
        return at


def pack(docs: DataFrame, block_of: Blocks) -> DataFrame:
    """(key, kind, part, data): compressed documents by the block that they fall into."""
    sent = docs.sparkSession.sparkContext.broadcast(block_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_of, held, size = sent.value, {}, 0
        coder = zstandard.ZstdCompressor(level=1)

        def flush():
            keys = sorted(held)
            data = [coder.compress(pickle.dumps(tuple(zip(*held[k], strict=True)), 5)) for k in keys]
            n = len(keys)
            return pa.record_batch([pa.array(keys, pa.int64()), pa.array([2] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(data, pa.binary())], names=["key", "kind", "part", "data"])

        for batch in batches:
            for key, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = cell.as_buffer().to_pybytes() if cell.is_valid else None
                held.setdefault(block_of(key, text), []).append((key, text))
                size += len(text or b"") + 50
                if size >= PACK_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, _ROW)


_ROW = "key long, kind int, part long, data binary"
#: Kinds of a block's rows, in the order in which they are read.
_ANCHOR_BITS, _WINDOW_BITS = 0, 1


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["key", "kind", "part", "data"])


def _by_key(df: DataFrame, keys: int) -> DataFrame:
    """A key's rows together and in order; more partitions than the session's where they would hold too many keys."""
    wide = -(-keys // KEYS_A_TASK)
    dealt = df.repartition(wide, "key") if wide > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition("key")
    return dealt.sortWithinPartitions("key", "kind", "part")


def _bits(rows: list[dict], kind: int, ranges: tuple[list[int], list[int], list[int]]) -> np.ndarray:
    """Answers to all that a block has sent: bits of the buckets in order; a bucket that says nothing means none."""
    out = np.zeros(ranges[2][-1] if ranges[2] else 0, bool)
    place = {b: (first, end) for b, first, end in zip(*ranges, strict=True)}
    for r in rows:
        if r["kind"] == kind:
            first, end = place[r["part"]]
            out[first:end] = np.unpackbits(np.frombuffer(r["data"], np.uint8), count=end - first)
    return out


def _open(rows: list[dict], known: _Hashes, buckets: int) -> tuple[Block, np.ndarray, np.ndarray]:
    """A block, its candidate windows' hashes and places, given the answers about its anchors."""
    block = Block([r["data"] for r in rows if r["kind"] == 2], known)
    hashes, places = block.anchors()
    distinct, number, count = np.unique(hashes, return_inverse=True, return_counts=True)
    repeated = (count > 1) | _bits(rows, _ANCHOR_BITS, _ranges(distinct, 48, buckets))
    return block, *block.candidates(places[repeated[number]] if hashes.size else places)


def ask_anchors(blocks: DataFrame, n: int, buckets: int) -> DataFrame:
    """Rows for the buckets: each block's distinct anchor hashes."""

    def run(batches):
        known = _Hashes()
        for key, rows in _groups(batches, "key"):
            distinct = np.unique(Block([r["data"] for r in rows], known).anchors()[0])
            data = np.ascontiguousarray(distinct.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            yield _rows([(b, 0, key, data[first:end].tobytes()) for b, first, end in zip(*_ranges(distinct, 48, buckets), strict=True)])

    return _by_key(blocks, n).mapInArrow(run, _ROW)


def answer_anchors(asked: DataFrame, buckets: int) -> DataFrame:
    """Rows for the blocks: which of their anchors another block has too."""

    def run(batches):
        for bucket, rows in _groups(batches, "key"):
            own = []
            for r in rows:
                wide = np.zeros((len(r["data"]) // 6, 8), np.uint8)
                wide[:, :6] = np.frombuffer(r["data"], np.uint8).reshape(-1, 6)
                own.append(wide.view("<u8").ravel())
            every = np.sort(np.concatenate(own))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            out = []
            for r, h in zip(rows, own, strict=True):
                at = np.searchsorted(twice, h)
                hit = (at < twice.size) & (twice[np.minimum(at, max(0, twice.size - 1))] == h) if twice.size else np.zeros(h.size, bool)
                if hit.any():
                    out.append((r["part"], _ANCHOR_BITS, bucket, np.packbits(hit).tobytes()))
            yield _rows(out)

    return _by_key(asked, buckets).mapInArrow(run, _ROW)


def ask_windows(blocks: DataFrame, n: int, buckets: int) -> DataFrame:
    """Rows for the buckets: each block's distinct candidate windows."""

    def run(batches):
        known = _Hashes()
        for key, rows in _groups(batches, "key"):
            _, hashes, _ = _open(rows, known, buckets)
            distinct, _, _ = _first(hashes)
            yield _rows([(b, 0, key, _write_windows(distinct[first:end])) for b, first, end in zip(*_ranges(distinct[:, 0], 64, buckets), strict=True)])

    return _by_key(blocks, n).mapInArrow(run, _ROW)


def answer_windows(asked: DataFrame, buckets: int) -> DataFrame:
    """Rows for the blocks: which of their windows an earlier block has."""

    def run(batches):
        for bucket, rows in _groups(batches, "key"):  # a bucket's rows come in the order of the blocks
            own = [_read_windows(r["data"]) for r in rows]
            _, first, number = _first(np.concatenate(own))
            late = np.ones(len(number), bool)
            late[first] = False
            out, at = [], 0
            for r, h in zip(rows, own, strict=True):
                hit = late[at : at + len(h)]
                at += len(h)
                if hit.any():
                    out.append((r["part"], _WINDOW_BITS, bucket, np.packbits(hit).tobytes()))
            yield _rows(out)

    return _by_key(asked, buckets).mapInArrow(run, _ROW)


def remove(blocks: DataFrame, n: int, buckets: int, id_type: str, with_text: bool) -> DataFrame:
    """The result rows of dedup()."""
    kinds = [to_arrow_type(T._parse_datatype_string(id_type)), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string()]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept"]

    def run(batches):
        known = _Hashes()
        for _, rows in _groups(batches, "key"):
            block, hashes, places = _open(rows, known, buckets)
            distinct, first, number = _first(hashes)
            late = np.ones(len(number), bool)
            late[first] = False  # a later occurrence inside the block goes anyway
            late |= _bits(rows, _WINDOW_BITS, _ranges(distinct[:, 0], 64, buckets))[number] if len(number) else False
            depth = np.zeros(block.starts[-1] + 1, np.int32)
            np.add.at(depth, places[late], 1)
            np.add.at(depth, places[late] + WINDOW, -1)
            gone = np.cumsum(depth)[:-1] > 0
            out = []
            for k, (key, text) in enumerate(zip(block.ids, block.texts, strict=True)):
                words, mask = text.split(), gone[block.starts[k] : block.starts[k + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
                kept = b" ".join([w for w, g in zip(words, mask.tolist(), strict=True) if not g] if edges.size else words)
                out.append((key, len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest(), edges.reshape(-1, 2).tolist(), kept.decode() if with_text else None))
            for at in range(0, len(out), 2000):
                columns = list(zip(*out[at : at + 2000], strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return _by_key(blocks, n).mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, removed array<array<bigint>>, kept string")


def _blocks(docs: DataFrame, n: int, blocks: int, null_bytes: int) -> Blocks:
    """Bounds that cut the documents into about equal blocks of neighbours, from a bounded sample of the ids.

    Rows are sampled by a hash of id and text, so an id that many rows repeat is in the sample as often as it should be.
    """
    every = max(1, n // BOUNDS_SAMPLE)
    sampled = docs.where("doc_id is not null")
    sampled = sampled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0) if every > 1 else sampled
    ids = sorted(r[0] for r in sampled.select("doc_id").collect())
    asked = min(blocks, max(1, len(ids) // 2))
    return Blocks([ids[k * len(ids) // asked] for k in range(1, asked)], max(1, -(-null_bytes // BLOCK_BYTES)), -(-blocks // asked))


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (word spans [first, end)) and, with_text, the kept text of every document."""
    length = F.octet_length("text")
    size = docs.agg(F.sum(length).alias("bytes"), F.sum(F.when(F.col("doc_id").isNull(), length)).alias("null_bytes"), F.count(F.lit(1)).alias("n")).first()
    blocks, buckets = max(24, -(-(size.bytes or 0) // BLOCK_BYTES)), max(24, -(-(size.bytes or 0) // BUCKET_BYTES))
    packed = pack(docs, _blocks(docs, size.n, blocks, size.null_bytes or 0))
    anchors, _ = scratch.write(answer_anchors(ask_anchors(packed, blocks, buckets), buckets))
    scratch.release(docs.sparkSession)
    windows, _ = scratch.write(answer_windows(ask_windows(packed.unionAll(anchors), blocks, buckets), buckets))
    scratch.release(docs.sparkSession)
    return remove(packed.unionAll(anchors).unionAll(windows), blocks, buckets, dict(docs.dtypes)["doc_id"], with_text)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return dedup(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = {
    "op8_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, w, ps FROM w LEFT JOIN gone USING (doc_id)),
words AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM kept)),
left_over AS (SELECT a.doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words a ANTI JOIN (SELECT doc_id, unnest(ps) AS i FROM gone) b ON a.doc_id = b.doc_id AND a.i = b.i GROUP BY a.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept LEFT JOIN left_over USING (doc_id)
"""
}
