"""SimHash near-duplicates with bit-sliced fingerprint comparison.

1. Fingerprints: per document, in one pass over the text, no shuffle.
2. Distinct fingerprints only go on; each is a node.
3. Candidates: two fingerprints at most ``radius`` bits apart agree on at least two of
   ``radius + 2`` segments, so each is dealt once per pair of segments (15 keys at radius
   4). A key with more than ``block`` fingerprints is cut into blocks and every pair of
   blocks is a task unit of its own: exact, and no task holds the whole key.
4. Comparison inside a unit is bit-sliced: the unit's fingerprints are stored as 64
   vertical bit planes, 64 candidates to a machine word. A query xors its bits with the
   planes and adds the differing lanes into carry-save counters; words in which all
   lanes have passed the radius are abandoned.
5. A unit emits a spanning forest of its links, never the pairs; components over all
   forests are the components over all links.

Nulls and empty or all-blank texts have fingerprint zero and link like any other. Rows with
a null id link too and keep a null component. Repeated rows share everything. A very long
text takes memory of a few times its size, in its task alone. Extra columns do not matter to
``near_duplicates``; ``one_of_each`` returns them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..session import materialize
from .common import free_name, map_batches

SHINGLE, SEED, RADIUS, BLOCK = 4, 42, 4, 2048
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingles' XXH64; words are runs of non-blank characters."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """``doc_id, fp`` (fp: the 64 bits as a long) and binary columns to ``keep``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([simhash(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], ["doc_id", "fp", *keep])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"), *keep)
    return map_batches(rows, run, ", ".join(["doc_id long, fp long", *(f"`{c}` binary" for c in keep)]), "t")


def _planes(fps: np.ndarray, slot: np.ndarray, words: int) -> np.ndarray:
    """Bit b of the fingerprint in slot s is bit s % 64 of planes[b, s // 64]."""
    lanes = np.zeros(words * 64, np.uint64)
    lanes[slot] = fps
    return np.stack([np.packbits(((lanes >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(64)])


def _survivors(planes: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tile (query fingerprint, word of 64 candidates): index of the tile and the
    lanes within the radius. Counters are carry-save bit slices; a tile is abandoned when
    every lane has passed the radius."""
    width = max(1, int(radius).bit_length())
    alive = np.arange(len(query))
    counter = np.zeros((width, len(query)), np.uint64)
    over = np.zeros(len(query), np.uint64)
    q, w = query, word
    for b in range(64):
        carry = planes[b][w] ^ (np.uint64(0) - ((q >> np.uint64(b)) & np.uint64(1)))
        for s in range(width):
            both = counter[s] & carry
            counter[s] ^= carry
            carry = both
        over |= carry
        if b in (15, 23, 31, 47, 63):
            # lanes whose counter is above the radius: compare bit slices with the constant
            above, equal = np.zeros(len(q), np.uint64), np.full(len(q), ONES)
            for s in reversed(range(width)):
                if radius >> s & 1:
                    equal &= counter[s]
                else:
                    above |= equal & counter[s]
                    equal &= ~counter[s]
            over |= above
            keep = np.flatnonzero(over != ONES)
            if len(keep) < len(q):
                alive, q, w, over = alive[keep], q[keep], w[keep], over[keep]
                counter = np.ascontiguousarray(counter[:, keep])
    return alive, ~over


def link_forest(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS, side: np.ndarray | None = None, tile: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group. Returns (row, root row) for every row linked to a smaller row,
    directly or over others of its group: a spanning forest of the links at most
    ``radius`` bits apart."""
    n = len(fps)
    label = np.arange(n)
    if n < 2:
        return label[:0], label[:0]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, n))
    words = (size + 63) // 64
    base = np.concatenate(([0], np.cumsum(words)[:-1]))
    member = np.repeat(np.arange(len(first)), size)
    within = np.arange(n) - first[member]
    slot = base[member] * 64 + within
    row_at = np.full(int(words.sum()) * 64, -1)
    row_at[slot] = np.arange(n)
    planes = _planes(fps, slot, int(words.sum()))
    # a query meets the words from its own to the last of its group
    todo = np.where(within + 1 < size[member], words[member] - within // 64, 0)
    ends = np.cumsum(todo)
    for lo in range(0, int(ends[-1]), tile):
        ids = np.arange(lo, min(lo + tile, int(ends[-1])))
        row = np.searchsorted(ends, ids, side="right")
        word = slot[row] // 64 + (ids - (ends[row] - todo[row]))
        alive, lanes = _survivors(planes, fps[row], word, radius)
        if not len(alive):
            continue
        bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        t, lane = np.nonzero(bits)
        a, b = row[alive[t]], row_at[word[alive[t]] * 64 + lane]
        ok = b > a
        a, b = a[ok], b[ok]
        while len(a):
            la, lb = label[a], label[b]
            split = la != lb
            if not split.any():
                break
            a, b, la, lb = a[split], b[split], la[split], lb[split]
            low = np.minimum(la, lb)
            np.minimum.at(label, np.maximum(la, lb), low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _segment_keys(fp: F.Column, radius: int) -> F.Column:
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    seg = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    wide = max(b - a for a, b in zip(cuts, cuts[1:]))
    return F.array(*(F.lit(k << (2 * wide)) + F.shiftleft(seg[i], wide) + seg[j] for k, (i, j) in enumerate(combinations(range(n), 2))))


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``src, dst``: a spanning forest, by unit of comparison, of all links between the
    rows of ``nodes`` (node long, fp long; fingerprints distinct)."""
    keyed = nodes.select("node", "fp", F.explode(_segment_keys(F.col("fp"), radius)).alias("key"))
    big = keyed.groupBy("key").count().where(F.col("count") > block).select(F.col("key").bitwiseXOR(F.lit(1).cast("long")).alias("jk"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = keyed.withColumn("jk", F.col("key").bitwiseXOR(F.lit(1).cast("long"))).join(big, "jk", "left").drop("jk")
    own = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.lit(0))
    units = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    units = units.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp")
    sorted_units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= 1 << 16:
                held = yield from flush(held, False)
        if held:
            yield from flush(held, True)

    def flush(held, last):
        t = pa.Table.from_batches(held)
        key, i, j, node, fp = (t.column(c).to_numpy() for c in ("key", "i", "j", "node", "fp"))
        change = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        end = len(key) if last or not len(change) else int(change[-1])
        if not last and not len(change):
            return held  # one unit so far: wait for its end
        group = np.zeros(end, np.int64)
        group[change[change < end]] = 1
        row, root = link_forest(np.cumsum(group), fp[:end].view(np.uint64), radius)
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(node[root])], ["src", "dst"])
        rest = t.slice(end).combine_chunks().to_batches()
        return [b for b in rest if b.num_rows]

    return sorted_units.mapInArrow(run, "src long, dst long")


def groups(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``fp2, component``: the smallest fingerprint (as a long) reachable from each of the
    column ``fp``. Nodes are distinct fingerprints, so copies cost nothing."""
    nodes = materialize(fps.select("fp").distinct())
    found = connected_components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius, block))
    return materialize(nodes.join(found, nodes["fp"] == found["node"], "left").select(F.col("fp").alias("fp2"), F.coalesce("component", "fp").alias("component")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest document id reachable over links."""
    fps = materialize(fingerprints(docs, doc_id, text))
    found = groups(fps, radius, block)
    low = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("low"))
    named = found.join(low, F.col("fp2") == F.col("fp"), "left").groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = materialize(found.join(named.withColumnRenamed("component", "c2"), F.col("component") == F.col("c2")).select("fp2", "component_id"))
    return fps.join(by_fp, fps["fp"] == by_fp["fp2"], "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row of each group of linked documents, with its own columns: that with the smallest
    id (a null id comes last), then the smallest digest of id and text. Different texts
    under one id are judged by their fingerprints like any others. Of rows with one id and
    one text the one with the smallest digest of all columns stays. Texts meet small sets
    of digests only: those that go and those that repeat."""
    key = free_name(docs.columns, "key_")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.length(text), F.coalesce(F.col(text).cast("string"), F.lit(""))))))
    rows = fingerprints(keyed, doc_id, text, key)
    keys = materialize(rows.groupBy("doc_id", F.col(key).alias("key"), "fp").agg(F.count("*").alias("n")))
    found = groups(keys, radius, block)
    best = keys.join(found, keys["fp"] == found["fp2"]).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "n")).alias("b"))
    best = materialize(best.select(F.col("b.key").alias("kept"), F.col("b.n").alias("rows")))
    # texts meet both kinds of digests in one join, by merging at every size, so that the plan is
    # the same for a large input and a small one
    repeated = best.where("rows > 1").select(F.col("kept").alias("key"), F.lit(True).alias("again"))
    gone = keys.select("key").join(best, F.col("key") == F.col("kept"), "left_anti").withColumn("again", F.lit(False))
    marks = materialize(gone.unionByName(repeated)).select(F.col("key").alias(f"{key}met"), F.col("again").alias(f"{key}again"))
    joined = keyed.where(F.col(key).isNotNull()).join(marks.hint("merge"), F.col(key) == F.col(f"{key}met"), "left")
    single = joined.where(F.col(f"{key}met").isNull())
    copies = joined.where(F.col(f"{key}again"))
    first = copies.groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.sha2(F.to_json(F.struct(*docs.columns)), 256)).alias(f"{key}row")).select(f"{key}row.*")
    return single.select(*docs.columns).unionByName(first)
