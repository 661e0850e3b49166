"""MinHash near-duplicates with tensored banding.

1. One narrow pass over the texts: the set of a text's shingles (64-bit hashes), its digest,
   two small collections of ``HALVES`` half keys, each from ``ROWS`` minhashes: 2 * 14 * 3 = 84
   minhashes, and a parity sketch. Every pair of a half key of the first and one of the second
   collection is a table's key: 196 tables of six rows, which would take 1176 minhashes one
   by one.
2. Equal sets are one node. A table's key can repeat only if both of its halves do, so halves
   that no other node has are dropped first; only what is left is paired. Of buckets with
   the same nodes one is kept.
3. In each bucket all nodes meet the bucket's pivot, the node with the most company; what the
   sketches allow is confirmed on the full sets. Groups of copies with changes are settled
   by that, in as many pairs as nodes.
4. Buckets whose nodes are not yet all in one component are searched whole, in blocks: nodes of
   different components are compared by their sketches, and what these allow is confirmed on
   the full sets too. A bucket above ``BLOCK`` nodes is cut and every pair of blocks is a unit
   of its own.

A parity sketch has a bit for each cell of a hash: whether an odd number of shingles falls
there. Bits that differ between two sketches cannot outnumber the shingles that differ
between the sets, so a pair with too many is no link: this filter loses nothing, and of pairs
below a similarity of 0.79 it leaves few. It takes half a byte to one byte a shingle.

Components of the confirmed links are the result: a link needs ``percent`` of the union in
common, counted on whole sets. Two sets at a Jaccard similarity of exactly 0.8 share no table
with probability 2 * (1 - 0.8^3)^14 = 9e-5 (at 0.85: 3e-6). Full sets stay in the shared
folder only for nodes of some pair.

A text of fewer words than a shingle is one shingle; null, empty and blank texts have an empty
set, are linked with nothing and are their own component. Rows with a null id link but have a
null component and are not kept. Repeated rows share everything; different texts under one id
are judged each by itself. A very long text takes memory of a few times its size, in its task
alone. Extra columns are not needed and not returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..session import materialize
from .common import map_batches, slices

SHINGLE, PERCENT, HALVES, ROWS, BLOCK, LEAST_BITS = 4, 80, 14, 3, 1024, 256
MINHASHES = 2 * HALVES * ROWS
_draw = np.random.Generator(np.random.PCG64(12))
FACTOR = _draw.integers(0, 1 << 63, MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _draw.integers(0, 1 << 63, MINHASHES, dtype=np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k, h = min(size, len(words)), xxhash.xxh3_64_intdigest
    n = len(words) - k + 1
    return np.unique(np.fromiter((h(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n))


def minhashes(found: np.ndarray) -> np.ndarray:
    low = np.full(MINHASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1 << 12):
        part = found[i : i + (1 << 12)]
        mixed = part[None, :] * FACTOR[:, None] + SHIFT[:, None]
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(29))).min(axis=1))
    return low


def half_keys(low: np.ndarray) -> list[int]:
    """First those of one collection, then those of the other; each knows its place."""
    rows = low.reshape(2 * HALVES, ROWS)
    return [xxhash.xxh3_64_intdigest(rows[i].tobytes(), i) - (1 << 63) for i in range(2 * HALVES)]


def parity(found: np.ndarray) -> bytes:
    """The parity sketch: a power of two of cells, at least four for each shingle."""
    bits = max(LEAST_BITS, 1 << int(4 * len(found) - 1).bit_length())
    return np.packbits(np.bincount((found >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def halved(sketch: np.ndarray) -> np.ndarray:
    """Sketches (of 64-bit words, the last axis) with half as many cells."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def fewest_differences(a: bytes, b: bytes) -> int:
    """At least so many shingles differ between the sets of two sketches."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = halved(x)
    while len(y) > len(x):
        y = halved(y)
    return int(np.bitwise_count(x ^ y).sum())


def allowed(differences, n1, n2, percent: int):
    """Whether sets of these sizes can be a link. d = n1 + n2 - 2 k shingles differ if k are
    common, of n1 + n2 - k in all."""
    total = n1 + n2
    return 100 * (total - differences) >= percent * (total + differences)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Written ``row, doc_id, n, digest, halves, sketch``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in batch.column(1).to_pylist():
            found = shingles(t, shingle)
            out.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), *((half_keys(minhashes(found)), parity(found)) if len(found) else ([], b""))))
        n, digest, halves, sketch = zip(*out)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(halves, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "n", "digest", "halves", "sketch"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    found = map_batches(rows, run, "doc_id long, n long, digest binary, halves array<long>, sketch binary", "t")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()))


def buckets(nodes: DataFrame) -> DataFrame:
    """Written ``key, node, company``: the tables' keys of nodes (``node, halves``) whose
    halves both repeat, of keys with the same nodes one; company: in how many places halves
    of the node meet others."""
    each = nodes.select("node", F.posexplode("halves").alias("at", "half"))
    shared = each.groupBy("half").count().where(F.col("count") > 1).select((F.col("half").bitwiseXOR(F.lit(1).cast("long"))).alias("jk"), "count")
    # a join key of its own gets an exchange of its own, which adaptive execution can split
    met = each.withColumn("jk", F.col("half").bitwiseXOR(F.lit(1).cast("long"))).join(materialize(shared), "jk")
    own = met.groupBy("node").agg(F.collect_list(F.when(F.col("at") < HALVES, F.col("half"))).alias("a"), F.collect_list(F.when(F.col("at") >= HALVES, F.col("half"))).alias("b"), F.sum("count").alias("company"))
    keyed = own.select("node", "company", F.explode("a").alias("x"), "b").select("node", "company", "x", F.explode("b").alias("y"))
    keyed = materialize(keyed.select(F.xxhash64("x", "y").alias("key"), "node", "company"))
    members = keyed.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "node"), 20)).alias("s")).where("size > 1")
    once = materialize(members.groupBy("size", "x", "s").agg(F.min("key").alias("key")).select(F.col("key").bitwiseXOR(F.lit(1).cast("long")).alias("jk")))
    return materialize(keyed.withColumn("jk", F.col("key").bitwiseXOR(F.lit(1).cast("long"))).join(once, "jk").drop("jk"))


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    a = nodes.select(F.col("node").alias("src"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    b = nodes.select(F.col("node").alias("dst"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))

    def run(batches):
        for batch in batches:
            least = np.array([fewest_differences(x, y) for x, y in zip(*(batch.column(c).to_pylist() for c in (4, 5)))], np.int64)
            ok = allowed(least, batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(ok))

    near = pairs.join(a, "src").join(b, "dst").where(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    return near.select("src", "dst", "n1", "n2", "s1", "s2").mapInArrow(run, "src long, dst long")


def _rest(keyed: DataFrame, nodes: DataFrame, percent: int, block: int) -> DataFrame:
    """``src, dst``: possible pairs of different components in the buckets that hold some.
    ``keyed``: ``key, node, component``."""
    open_ = keyed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    open_ = materialize(open_.select(F.col("key").bitwiseXOR(F.lit(1).cast("long")).alias("jk"), F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    dealt = keyed.withColumn("jk", F.col("key").bitwiseXOR(F.lit(1).cast("long"))).join(open_, "jk").drop("jk").join(nodes.select("node", "n", "sketch"), "node")
    units = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "n", "sketch", "own")
    ordered = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def pairs_of(t: pa.Table):
        i, j, node, component, n, own = (t.column(c).to_numpy() for c in ("i", "j", "node", "component", "n", "own"))
        raw = t.column("sketch").to_pylist()
        size = np.array([len(x) for x in raw])
        for cells in np.unique(size):
            # sets of one size of sketch, and those of the next, halved: no other sizes can link
            mine, next_ = np.flatnonzero(size == cells), np.flatnonzero(size == 2 * cells)
            rows = np.concatenate((mine, next_))
            words = np.frombuffer(b"".join(raw[k] for k in mine), np.uint64).reshape(len(mine), -1)
            if len(next_):
                words = np.concatenate((words, halved(np.frombuffer(b"".join(raw[k] for k in next_), np.uint64).reshape(len(next_), -1))))
            for a in range(len(mine)):
                b = np.arange(a + 1, len(rows))
                to = rows[b]
                ok = (component[to] != component[mine[a]]) & (100 * np.minimum(n[to], n[mine[a]]) >= percent * np.maximum(n[to], n[mine[a]]))
                if i[0] != j[0]:
                    ok &= own[to] != own[mine[a]]  # pairs within a block are another unit's
                b, to = b[ok], to[ok]
                ok = allowed(np.bitwise_count(words[b] ^ words[a]).sum(axis=1, dtype=np.int64), n[to], n[mine[a]], percent)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[to[ok]], node[mine[a]])), pa.array(np.maximum(node[to[ok]], node[mine[a]]))], ["src", "dst"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        unit = None
        for batch in batches:
            key, i, j = (batch.column(c).to_numpy() for c in (0, 1, 2))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                now = (key[lo], i[lo], j[lo])
                if now != unit and held:
                    yield from pairs_of(pa.Table.from_batches(held))
                    held = []
                unit = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, "src long, dst long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The written pairs whose full sets have the share in common."""
    asked = materialize(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(nodes.select("node", "doc_id", "digest"), "node"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, shingle) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["digest", "members"])

    # only the texts of asked ids are read into sets; the digest tells texts of one id apart
    ids = asked.select(F.coalesce("doc_id", F.lit(-1)).alias("id")).distinct()
    texts = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "t").join(ids, "id", "left_semi").select("t")
    own = map_batches(texts, sets, "digest binary, members binary", "t").join(asked.select("node", "digest"), "digest")
    own = materialize(own.groupBy("node").agg(F.any_value("members").alias("members")))

    def run(batches):
        for batch in slices(batches, "m1", 16 << 20):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                ok.append(100 * both >= percent * ((len(x) + len(y)) // 8 - both))
            yield batch.select(["src", "dst"]).filter(pa.array(ok))

    a = own.select(F.col("node").alias("src"), F.col("members").alias("m1"))
    b = own.select(F.col("node").alias("dst"), F.col("members").alias("m2"))
    return materialize(pairs.join(a, "src").join(b, "dst").select("src", "dst", "m1", "m2").mapInArrow(run, "src long, dst long"))


def links(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``src, dst``: confirmed links that hold together every component of all links."""
    keyed = buckets(nodes)
    pivot = keyed.groupBy("key").agg(F.max(F.struct("company", "node")).alias("p"), F.count("*").alias("size")).where("size > 1")
    pivot = materialize(pivot.select(F.col("key").bitwiseXOR(F.lit(1).cast("long")).alias("jk"), F.col("p.node").alias("dst")))
    met = keyed.withColumn("jk", F.col("key").bitwiseXOR(F.lit(1).cast("long"))).join(pivot, "jk").where("node <> dst").select(F.col("node").alias("src"), "dst").distinct()
    found = _confirmed(materialize(_possible(met, nodes, percent)), docs, nodes, percent, shingle)
    component = connected_components(found)
    now = keyed.join(component, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    more = _confirmed(materialize(_rest(now, nodes, percent, block)), docs, nodes, percent, shingle)
    return found.unionByName(more)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: the smallest document id reachable over links."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    rows = sketches(texts, "doc_id", "t", shingle)
    sets = rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"))
    sets = materialize(sets)
    one = rows.select("row", "n", "halves", "sketch").join(sets, F.col("row") == F.col("node"))
    nodes = materialize(one.select("node", F.col("low").alias("doc_id"), "digest", "n", "halves", "sketch"))
    component = connected_components(links(texts, nodes, percent, shingle, block))
    named = sets.join(component, "node", "left").select("digest", "low", F.coalesce("component", "node").alias("component"))
    named = materialize(named)
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id")).withColumnRenamed("component", "c2")
    by_set = materialize(named.join(lowest, F.col("component") == F.col("c2")).select(F.reverse("digest").alias("d2"), "component_id"))
    found = rows.withColumn("d2", F.reverse("digest")).join(by_set, "d2", "left")
    label = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id")).withColumn("kept", kept)
