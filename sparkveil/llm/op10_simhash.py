"""SimHash near-dedup with covering locality-sensitive hashing.

A document's fingerprint has 64 bits: bit k is set if more than half of its
shingles' XXH64 values (seed 42) have it set.  Documents link if their
fingerprints differ in at most ``radius`` (4) bits; a document's component is the
smallest doc_id that it reaches over links.

Links are found by a covering family of bit masks: every bit position k gets a
random vector m(k) of radius + 1 bits, and each of the 2**(radius + 1) - 1 nonzero
vectors v gives the mask of the positions with <m(k), v> odd.  At most ``radius``
positions span at most that many dimensions, so some v is orthogonal to all of
them: two fingerprints within the radius agree on that mask and *must* meet in its
table.  Nothing is missed; what meets is verified by counting the bits that differ.

Scale: equal fingerprints are one node, so copies cost one row.  Each node sends
31 small rows; the rows of a table's bucket meet in one task in sorted order and
only a spanning forest of their links leaves it, never all pairs.  A bucket with
more than ``BUCKET`` nodes is not compared there: its rows go to a next level,
where a fresh covering family splits it (again without loss, as the members'
other bits still differ in at most ``radius`` places).  What is over the limit on all levels
is compared in blocks: a bucket's nodes are dealt to blocks of some ``LAST_BLOCK`` and each pair
of blocks meets in one task, so no task holds more than two blocks.  Components are found by distributed star
contractions.  Fingerprints, links and components stay in the executors.

Edge cases: null or word-less texts have fingerprint zero and link like any other;
fewer words than a shingle make one shingle of all words; repeated doc_ids are
rows of their own with equal results; null doc_ids count for links but are never a
component's id unless a component has no other (then it is null); an empty table gives
no rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from ..plans.components import connected_components
from ._common import map_slices, table

SHINGLE, RADIUS, SEED = 4, 4, 42
BUCKET, LEVELS, LAST_BLOCK = 2048, 4, 65_536


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text."""
    words = text.lower().split() if text else []  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    bits = np.unpackbits(np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8), axis=1)
    n = len(bits)
    if pad := -n % 255:
        bits = np.concatenate([bits, np.zeros((pad, 64), np.uint8)])
    counts = bits.reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed 64-bit number."""

    def make():
        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            got = np.array([fingerprint(t, shingle) for t in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            return pa.record_batch([part.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

        return kernel

    id_type = dict(docs.dtypes)["doc_id"]
    return map_slices(docs.select("doc_id", "text"), make, f"doc_id {id_type}, fp long")


def masks(radius: int = RADIUS, level: int = 0) -> list[int]:
    """The covering family's masks, as signed 64-bit numbers."""
    m = np.random.default_rng(1000 + level).integers(1, 1 << (radius + 1), 64)
    out = []
    for v in range(1, 1 << (radius + 1)):
        odd = np.bitwise_count((m & v).astype(np.uint64)) & 1
        out.append(int(np.packbits(odd.astype(np.uint8)).view(">i8")[0]))
    return out


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected within the radius; at most one fewer than members.

    A search from each member that is not reached yet; its memory is one row of distances.
    """
    out, left = [], members
    while left.size > 1:
        reached, left = [left[0]], left[1:]
        while reached and left.size:
            at = reached.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                new = left[near]
                out += [(int(at), int(x)) for x in new]
                reached += list(new)
                left = left[~near]
    return out


def _links(batches, radius: int, limit: int | None):
    """Sorted rows (path, fp) of one partition -> links, and the rows of buckets over the limit."""

    def done(path: str, parts: list[np.ndarray], over: bool):
        members = np.concatenate(parts)
        if over:
            return [], [(path, int(x)) for x in members.view(np.int64)]
        return forest(members, radius) if members.size > 1 else [], []

    held: list[np.ndarray] = []
    held_path, over = None, False

    def batch_of(links, rest):
        a = np.array([x for x, _ in links], np.uint64).view(np.int64)
        b = np.array([x for _, x in links], np.uint64).view(np.int64)
        n, m = len(links), len(rest)
        return pa.record_batch(
            [pa.array([None] * n + [p for p, _ in rest], pa.binary()), pa.array(np.concatenate([a, np.array([x for _, x in rest], np.int64)])), pa.array([int(x) for x in b] + [None] * m, pa.int64())], names=["path", "a", "b"]
        )

    for batch in batches:
        links: list[tuple[int, int]] = []
        rest: list[tuple[str, int]] = []
        if not batch.num_rows:
            continue
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        table_no, key = batch.column("t").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((table_no[1:] != table_no[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], edges])
        ends = np.concatenate([edges, [len(fps)]])
        last = len(starts) - 1
        path_of = lambda k: int(table_no[starts[k]]).to_bytes(8, "big", signed=True) + int(key[starts[k]]).to_bytes(8, "big", signed=True)
        todo = np.flatnonzero((ends - starts > 1) | (np.arange(last + 1) == last) | (np.arange(last + 1) == 0))
        for k in todo.tolist():
            path = path_of(k)
            if path != held_path:
                if held:
                    x, y = done(held_path, held, over)
                    links += x
                    rest += y
                held, held_path, over = [], path, False
            held.append(fps[starts[k] : ends[k]])
            if limit and (over or sum(map(len, held)) > limit):
                over = True
                rest += [(path, int(x)) for h in held for x in h.view(np.int64)]
                held = [np.zeros(0, np.uint64)]
        yield batch_of(links, rest)
    if held:
        yield batch_of(*done(held_path, held, over))


def _in_blocks(over: DataFrame, radius: int, block: int) -> DataFrame:
    """Links among rows (path, fp) of buckets that no level has split: every pair of a bucket's blocks in one task."""
    sizes = over.groupBy("path").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    dealt = over.join(sizes, "path").select("path", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("t"), F.lit(0).cast("long").alias("key"), "fp").distinct()
    dealt = dealt.repartition("t").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(partial(_links, radius=radius, limit=None), "path binary, a long, b long").select("a", "b")


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, block: int = LAST_BLOCK) -> DataFrame:
    """(a, b): links within the radius that connect all that is connected; ``nodes`` has distinct fp."""
    spark = nodes.sparkSession
    rows = nodes.select("fp", F.lit(0).cast("long").alias("seed"))
    found: DataFrame | None = None
    for level in range(LEVELS):
        tables = F.array(*[F.struct(F.xxhash64("seed", F.lit(level), F.lit(k)).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(radius, level))])
        spread = rows.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
        spread = spread.repartition("t", "key").sortWithinPartitions("t", "key")
        done, _ = scratch.write(spread.mapInArrow(partial(_links, radius=radius, limit=bucket), "path binary, a long, b long"))
        own = done.where("path is null").select("a", "b")
        found = own if found is None else found.unionAll(own)
        over = done.where("path is not null")
        if over.isEmpty():
            break
        # a bucket's members meet again under the next family, apart from other buckets
        rows = over.select(F.col("a").alias("fp"), F.xxhash64("path").alias("seed"))
    else:
        found = found.unionAll(_in_blocks(over.select("path", F.col("a").alias("fp")), radius, block))
    return found


def rooted(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, least, root): the fingerprint that stands for each one's component, and the fingerprint's smallest doc_id."""
    nodes, _ = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots, _ = scratch.write(connected_components(links(nodes, radius)))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id): the smallest doc_id that each fingerprint reaches."""
    joined = rooted(prints, radius)
    smallest = joined.where("component is not null").groupBy("root").agg(F.min("least").alias("smallest"))
    return joined.join(smallest, "root", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))


def find(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    prints, _ = scratch.write(fingerprints(docs, shingle))
    return prints.join(components(prints, radius), "fp").select("doc_id", "fp", "component_id")


def identified(docs: DataFrame) -> DataFrame:
    """(row, no_id, own_id, digest): each row whole, and what tells it apart, in the order in which a row is kept.  Columns of any name stay inside ``row``."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("own_id"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"))


def keep_least(docs: DataFrame, chosen: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``identified`` documents that ``chosen`` (own_id, digest) names; once: of rows equal in both, one."""
    c = chosen.select(F.col("own_id").alias("c_id"), F.col("digest").alias("c_digest")).hint("merge")
    kept = docs.join(c, (F.col("digest") == F.col("c_digest")) & F.col("own_id").eqNullSafe(F.col("c_id")), "left_semi")
    return kept.dropDuplicates(["own_id", "digest"]) if once else kept


def repeats(prints: DataFrame) -> bool:
    """Whether rows are equal in own_id and digest."""
    return not prints.groupBy("own_id", "digest").count().where("count > 1").isEmpty()


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component stays: the least by doc_id, null ids last, then by a digest of its text."""
    own = identified(docs)
    types = dict(own.dtypes)

    def make():
        def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
            got = np.array([fingerprint(t, shingle) for t in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            return pa.record_batch([*(part.column(c) for c in ("no_id", "own_id", "digest")), pa.array(got.view(np.int64))], names=["no_id", "own_id", "digest", "fp"])

        return kernel

    prints, _ = scratch.write(map_slices(own.select("no_id", "own_id", "digest", F.col("row")["text"].alias("text")), make, f"no_id boolean, own_id {types['own_id']}, digest string, fp long"))
    joined = prints.join(rooted(prints.withColumnRenamed("own_id", "doc_id"), radius).select("fp", "root"), "fp")
    kept, _ = scratch.write(joined.groupBy("root").agg(F.min(F.struct("no_id", "own_id", "digest")).alias("w")).select("w.own_id", "w.digest"))
    return keep_least(own, kept, repeats(prints)).select("row.*")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
