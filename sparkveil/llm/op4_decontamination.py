"""Benchmark decontamination with a generalised suffix automaton of the test items.

Both sides are normalised to words (A-Z lower-cased, maximal runs of digits,
letters and non-ASCII characters).  The items' words make one generalised suffix
automaton; training words stream through it and the longest matching length is
tracked at every word.  A length of ``window`` (10) or more means that the last
``window`` words are a window of some item; items shorter than a window match as a
whole.  Each automaton state that stands for a window knows its items.  Runs of
words that no item uses reset the automaton, so only runs of known words that are
at least as long as the shortest window are streamed.

Scale: one pass over the documents without a shuffle.  The items reach the
executors by broadcast in blocks of at most ``BLOCK_CHARS`` characters (sizes
are checked first, by hash bucket, and buckets are put together up to the bound; only an item that is longer
by itself exceeds it); a larger benchmark takes one pass a block, with the hits so far
carried along and written to the shared folder between passes.

``clean`` is the pipeline's form: spans of hit words go, documents with more than
``max_coverage`` of their words hit go as a whole.  Removal repeats until no window
is left, as it can bring words together.  With more than one block, coverage and
cuts come from the spans of all blocks, and whole rounds repeat over the documents
that changed.

Edge cases: null or word-less texts have no words and no hits; null or word-less
items match nothing; items without an id hit like any other, and all of them count
as one in n_items and not in items_sha256; an item_id counts once in n_items, whatever rows it has; repeated documents count for themselves; an empty
benchmark hits nothing; no documents give no rows; ``clean`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..plans import scratch
from ._common import map_slices, table

WINDOW = 10
BLOCK_CHARS = 2_000_000
#: A-Z to a-z, every other ASCII character that is no digit or letter to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.numbers = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set] = {}
        self.short: dict[int, set] = {}
        numbered = [(k, [self.numbers.setdefault(w, len(self.numbers)) for w in words]) for k, words in items if words]
        for _, seq in numbered:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        for k, seq in numbered:
            state, size = 0, 0
            for c in seq:
                state, size = self.step(state, size, c)
                if size >= window:
                    self.items.setdefault(self.suffix(state, window), set()).add(k)
            if len(seq) < window:
                self.short.setdefault(len(seq), {}).setdefault(self.suffix(state, len(seq)), set()).add(k)
        self.least = min([window, *self.short]) if numbered else 0

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the strings of q that end at p's length plus one."""
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """Read one word: the state and the length of the longest suffix that occurs in an item."""
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], size + 1
        return 0, 0

    def suffix(self, state: int, size: int) -> int:
        """The state of the last ``size`` words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [first, end) of hit words, in order and disjoint, and the items that occur."""
        if not self.least or len(words) < self.least:
            return [], set()
        get = self.numbers.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids >= 0, [0]]).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set = set()
        for first, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - first < self.least:
                continue
            state, size = 0, 0
            for at, c in enumerate(ids[first:end].tolist(), first + 1):
                state, size = self.step(state, size, c)
                reach = 0
                if size >= self.window:
                    found |= self.items[self.suffix(state, self.window)]
                    reach = self.window
                for n, ends in self.short.items():
                    if size >= n and (own := ends.get(self.suffix(state, n))):
                        found |= own
                        reach = max(reach, n)
                if reach:
                    start = at - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at))
        return spans, found


def _items(bench: DataFrame) -> DataFrame:
    return bench.select(F.col("item_id").cast("string").alias("k"), F.col("text").alias("t")).where("t is not null").distinct()


def _block_plan(bench: DataFrame, block_chars: int) -> tuple[int, list[list[int]]]:
    """Into how many hash buckets the items are dealt, and which buckets make a block of bounded size."""
    rows = _items(bench)
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if total <= block_chars:
        return 1, [[0]]
    n = 16 * -(-total // block_chars)
    sizes = rows.groupBy(F.pmod(F.xxhash64("k", "t"), F.lit(n)).cast("int").alias("b")).agg(F.sum(F.length("t")).alias("c")).orderBy("b").collect()
    blocks, size = [], 0
    for r in sizes:
        if not blocks or size + r.c > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append(r.b)
        size += r.c
    return n, blocks


def _blocks(bench: DataFrame, plan: tuple[int, list[list[int]]]) -> Iterable[list[tuple[object, bytes]]]:
    """The items, one block at a time."""
    n, blocks = plan
    for own in blocks:
        rows = _items(bench)
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)).isin(own))
        yield [(r.k, r.t.encode()) for r in part.collect()]


def _pass(docs: DataFrame, block: list[tuple[object, bytes]], window: int) -> DataFrame:
    """Add a block's hits to the columns spans (pairs of little-endian 32-bit numbers) and items."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        automaton = Automaton(((k, words_of(t)) for k, t in sent.value), window)

        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            counts, spans, items = [], [], []
            for text, old, before in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True):
                words = words_of(text)
                got, found = automaton.hits(words)
                counts.append(len(words))
                if old:
                    got = merged([*got, *map(tuple, np.frombuffer(old, "<i4").reshape(-1, 2).tolist())])
                spans.append(np.array(got, "<i4").tobytes())
                items.append(sorted(found | set(before or ()), key=lambda k: (k is None, k or "")))
            columns = {name: part.column(name) for name in part.schema.names}
            columns |= {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))}
            return pa.record_batch(list(columns.values()), names=list(columns))

        return kernel

    return map_slices(docs, make, docs.schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as ordered, disjoint spans."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and out[-1][1] >= first:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def find(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, text, n_words, spans of hit words and items of every document."""
    return _find(docs.select("doc_id", "text"), bench, window, _block_plan(bench, block_chars))


def _find(docs: DataFrame, bench: DataFrame, window: int, plan: tuple) -> DataFrame:
    """``docs`` with n_words, spans and items, from all blocks of the plan."""
    rows = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    path = None
    for k, block in enumerate(_blocks(bench, plan)):
        if k:
            following, new_path = scratch.write(rows)
            if path:
                scratch.drop(docs.sparkSession, path)
            rows, path = following, new_path
        rows = _pass(rows, block, window)
    return rows


def cut(text: str, automaton: Automaton, max_coverage: float) -> str | None:
    """The text without hit words; None if more than ``max_coverage`` of its words are hit."""
    first = True
    while True:
        words = words_of(text.encode())
        spans, _ = automaton.hits(words)
        if not spans:
            return text
        if first and sum(e - f for f, e in spans) > max_coverage * len(words):
            return None
        first = False
        text = without(text, spans)


def without(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """The text without the words of ordered, disjoint spans."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for f, e in spans:
        out.append(text[at : places[f][0]])
        at = places[e - 1][1]
    return "".join([*out, text[at:]])


def _clean_by_blocks(docs: DataFrame, bench: DataFrame, window: int, max_coverage: float, plan: tuple) -> DataFrame:
    """``clean`` for a benchmark of several blocks: each round cuts what all blocks hit, and changed documents go round again."""
    others = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != "text"]
    todo = docs.select(F.struct(*others).alias("row"), "text")
    kept: DataFrame | None = None
    while True:
        first = kept is None

        def make(first=first):
            def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
                after, keep, changed = [], [], []
                for text, words, found in zip(part.column("text").to_pylist(), part.column("n_words").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    spans = np.frombuffer(found or b"", "<i4").reshape(-1, 2).tolist()
                    keep.append(not (first and spans and sum(e - f for f, e in spans) > max_coverage * words))
                    changed.append(bool(spans))
                    after.append(without(text, spans) if spans and keep[-1] else text)
                columns = [part.column("row"), pa.array(after, part.schema.field("text").type), pa.array(changed, pa.bool_())]
                return pa.record_batch(columns, names=["row", "text", "changed"]).filter(pa.array(keep, pa.bool_()))

            return kernel

        schema = StructType([*todo.schema.fields, StructField("changed", BooleanType())])
        done, _ = scratch.write(map_slices(_find(todo, bench, window, plan).select("row", "text", "n_words", "spans"), make, schema))
        cell = lambda c: F.col("text") if c == "text" else F.col("row")[c]
        length = lambda c: F.length("text").cast(docs.schema[c].dataType).alias(c)
        own = done.where("not changed").select(*[length(c) if c == "n_chars" and not first else cell(c).alias(c) for c in docs.columns])
        kept = own if first else kept.unionAll(own)
        todo = done.where("changed").select("row", "text")
        if todo.isEmpty():
            return kept


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents without benchmark windows; n_chars follows the text, other columns stay."""
    plan = _block_plan(bench, block_chars)
    if len(plan[1]) > 1:
        return _clean_by_blocks(docs, bench, window, max_coverage, plan)
    for block in _blocks(bench, plan):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def make(sent=sent):
            automaton = Automaton(((k, words_of(t)) for k, t in sent.value), window)

            def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
                before = part.column("text").to_pylist()
                after = [cut(t, automaton, max_coverage) if t else t for t in before]
                if after == before:
                    return part
                keep = pa.array([a is not None or b is None for a, b in zip(after, before, strict=True)], pa.bool_())
                columns = {name: part.column(name) for name in part.schema.names}
                columns["text"] = pa.array(after, part.schema.field("text").type)
                if "n_chars" in columns:
                    n = [old if a is b or a is None else len(a) for a, b, old in zip(after, before, columns["n_chars"].to_pylist(), strict=True)]
                    columns["n_chars"] = pa.array(n, part.schema.field("n_chars").type)
                return pa.record_batch(list(columns.values()), names=list(columns)).filter(keep)

            return kernel

        docs = map_slices(docs, make, docs.schema)
    return docs


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    id_type = dict(found.dtypes)["doc_id"]

    def digest(batches):
        for part in batches:
            spans = [np.frombuffer(x or b"", "<i4").reshape(-1, 2) for x in part.column("spans").to_pylist()]
            items = [x or [] for x in part.column("items").to_pylist()]
            n_hit = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
            sha = [hashlib.sha256(",".join(sorted(k for k in x if k is not None)).encode()).hexdigest() for x in items]
            yield pa.record_batch([part.column("doc_id"), part.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(list(map(len, items)), pa.int64()), pa.array(sha), pa.array([n > 0 for n in n_hit])], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.select("doc_id", "n_words", "spans", "items").mapInArrow(digest, f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


ORACLE = {
    "op4_benchmark_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT d.doc_id, d.i, d.n, win.item_id
        FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)) d
        JOIN win ON win.n = d.n AND win.g = d.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
}
