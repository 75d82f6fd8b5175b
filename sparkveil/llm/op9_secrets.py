"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

Base spans come from three patterns (see the fixed values below): leftmost,
non-overlapping matches of a kind, of which those that are too short are dropped
after matching.

The novelty part looks at candidate strings, of any length and with inner dots,
that follow a sensitive word on the same line; all that start within ``REACH`` of
it count, not only the first.  A candidate is measured whole, by its parts between
dots and by what base spans leave of it, in pieces of at most ``PIECE`` characters, and is reported whole if
any of these is novel.  For each it measures the *marginal* compressed size: zstandard is
primed with a dictionary of common identifiers, of the identifiers that the corpus itself
repeats (``learn_identifiers``: the ``LEARNED`` most frequent by documents) and of the surrounding code (``AROUND`` characters
on either side, without the candidate); the candidate's compressed size in that dictionary, less that
of nothing, over its length is its novelty.  What the surroundings or the
identifiers explain compresses; a random key does not.  Candidates whose novelty
is at least ``novelty`` and that mix digits with letters, or that are letters whose case
changes at least every fourth letter, are reported with kind ``novel``, unless base spans already cover all of them.

Scale: one pass over the documents to count identifiers (pre-aggregated in the tasks, at most
``LEARNED`` rows reach the driver) and one to scan them, neither of which shuffles texts; a text's memory is its own.

Edge cases: null texts are empty; offsets are code points of the whole text, ends
exclusive; candidates of any length are reported whole; overlapping spans are all listed, by start,
then kind as listed; repeated documents are scanned for themselves; an empty table gives no rows;
columns other than doc_id and text are not read (``clean`` keeps them), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_slices, table

# The three base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more: the same as dropping shorter runs
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex")

_SENSITIVE = re.compile(r"(?=(secret|token|passw|pwd|api_?key|access_?key|private_?key|auth|bearer|credential))", re.IGNORECASE | re.ASCII)
#: Where a candidate starts: after a dot too, as 'secret.<key>' holds the sensitive word in its own run.
_START = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]", re.ASCII)
_RUN = re.compile(r"[A-Za-z0-9+/_-]+(?:\.+[A-Za-z0-9+/_-]+)*(?:={1,2}(?![A-Za-z0-9+/_.=-]))?", re.ASCII)
REACH, LEAST, PIECE = 40, 16, 64
_TURN = re.compile(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")
_HINT = re.compile(r"secret|token|passw|pwd|key|auth|bearer|credential", re.IGNORECASE | re.ASCII)
IDENTIFIERS = (
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 authorization bearer credentials password secret token api_key "
    b"access_key_id secret_access_key private_key public_key client_secret client_id session_token refresh_token username user_name "
    b"localhost example default changeme placeholder your_token_here config settings environment variable export import from return "
    b"function class const public static void string integer boolean http https www com org net index value name type path file data "
)
AROUND, LEARNED = 1000, 1000
#: Names of two or more words, without digits: no key looks like that, however often it is copied.
_NAME = re.compile(r"(?<![A-Za-z0-9_])(?:[A-Za-z][a-z]{2,}(?:_[A-Za-z][a-z]{2,})+|[A-Z]{3,}(?:_[A-Z]{3,})+|[A-Za-z][a-z]{2,}(?:[A-Z][a-z]{2,})+)(?![A-Za-z0-9_])", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def learn_identifiers(docs: DataFrame, most: int = LEARNED) -> bytes:
    """The names that most documents hold, at least two; the most frequent last, where a dictionary costs least."""

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for cell in batch.column("text"):
                text = cell.as_py()
                if text and _HINT.search(text):
                    found.update(set(_NAME.findall(text)))
            yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["name", "n"])

    counts = docs.select("text").mapInArrow(count, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    return " ".join([r.name for r in reversed(counts.orderBy(F.desc("n"), "name").limit(most).collect())]).encode()


def novelty_of(candidate: str, around: str, names: bytes = b"") -> float:
    """Marginal compressed bytes a character, given the surroundings and identifiers."""
    own = zstandard.ZstdCompressionDict(IDENTIFIERS + names + b" " + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    coder = zstandard.ZstdCompressor(level=19, dict_data=own, write_content_size=False, write_dict_id=False, write_checksum=False)
    data = candidate.encode()
    return (len(coder.compress(data)) - len(coder.compress(b""))) / len(data)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Whole runs of candidate characters that start at most ``REACH`` after a sensitive word, on its line; each run once."""
    run_end = at = 0
    for m in _SENSITIVE.finditer(text):
        at, last = max(at, m.end(1)), m.end(1) + REACH
        if (line_end := text.find("\n", m.end(1), last)) >= 0:
            last = line_end
        while found := _START.search(text, at, last + 1):
            start = found.start()
            if start >= run_end:
                run_end = _RUN.match(text, start).end()
                if run_end - start >= LEAST:
                    yield start, run_end
            at = max(start + 1, run_end)


def pieces(parts: list[str]) -> Iterator[str]:
    """What is measured: parts that mix digits with letters or change case often, at most ``PIECE`` characters at a time.

    Over a long text zstandard's entropy coder gains on the alphabet alone, so a long key would seem explained.
    """
    for part in dict.fromkeys(parts):
        for at in range(0, len(part), PIECE):
            piece = part[at : at + PIECE] if at + LEAST <= len(part) else part[-PIECE:]
            if len(piece) >= LEAST and any(c.isalpha() for c in piece) and (any(c.isdigit() for c in piece) or 4 * len(_TURN.findall(piece)) >= len(piece)):
                yield piece


def uncovered(start: int, end: int, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What base spans, which are in order, leave of a range."""
    out = []
    for s, e, _ in base:
        if s < end and start < e:
            out.append((start, s))
            start = e
    return [(s, e) for s, e in [*out, (start, end)] if s < e]


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: float, names: bytes = b"") -> list[tuple[int, int, str]]:
    """Incompressible strings in sensitive context that base spans do not cover."""
    if not _HINT.search(text):
        return []
    out = []
    for start, end in candidates(text):
        if not (left := uncovered(start, end, base)):
            continue
        word = text[start:end]
        around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
        if any(novelty_of(piece, around, names) >= novelty for piece in pieces([word, *word.split("."), *(text[s:e] for s, e in left)])):
            out.append((start, end, "novel"))
    return out


def scan(text: str | None, novelty: float = 0.85, names: bytes = b"") -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, of a whole text."""
    base = base_spans(text or "")
    added = novel_spans(text, base, novelty, names) if text else []
    return base, sorted([*base, *added], key=lambda s: (s[0], (*KINDS, "novel").index(s[2])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by a mark of its kind; overlapping spans become one mark."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[REDACTED_{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, novelty: float = 0.85) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind) of every document."""
    names = learn_identifiers(docs)

    def make():
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [scan(t, novelty, names) for t in part.column("text").to_pylist()]
            lists = [pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in f[k]] for f in found], kind) for k in (0, 1)]
            return pa.record_batch([part.column("doc_id"), *lists], names=["doc_id", "base", "spans"])

        return kernel

    id_type = dict(docs.dtypes)["doc_id"]
    row = "array<struct<start:bigint,end:bigint,kind:string>>"
    return map_slices(docs.select("doc_id", "text"), make, f"doc_id {id_type}, base {row}, spans {row}")


def clean(docs: DataFrame, novelty: float = 0.85) -> DataFrame:
    """All documents with their secrets replaced by marks; n_chars follows the text, other columns stay."""
    names = learn_identifiers(docs)

    def make():
        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            before = part.column("text").to_pylist()
            after = [redact(t, s) if t and (s := scan(t, novelty, names)[1]) else t for t in before]
            columns = {name: part.column(name) for name in part.schema.names}
            columns["text"] = pa.array(after, part.schema.field("text").type)
            if "n_chars" in columns:
                n = [old if a is b else len(a) for a, b, old in zip(after, before, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(n, part.schema.field("n_chars").type)
            return pa.record_batch(list(columns.values()), names=list(columns))

        return kernel

    return map_slices(docs, make, docs.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = find(table(spark, sf_dir, "documents"))
    id_type = dict(found.dtypes)["doc_id"]

    def digest(batches):
        write = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
        for part in batches:
            base = part.column("base").to_pylist()
            counts = [pa.array([sum(s["kind"] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(write(b).encode()).hexdigest() for b in base]
            yield pa.record_batch([part.column("doc_id"), *counts, pa.array(sha), pa.array([write(s) for s in part.column("spans").to_pylist()])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(digest, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
