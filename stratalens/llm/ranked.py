"""Ranked lexical search: a join seeded with thresholds from stored impacts.

1. One narrow pass counts each document's terms and writes those that some item asks for
   (term ids and numbers of occurrences), with the document's number of all terms.
2. Sums over all documents: N, L and each term's df, hence its weight and each posting's
   impact, all in 64-bit integers. Each term's k highest impacts are found, k at most from a
   task: the highest bounds what the term can add, the k-th is stored.
3. An item's k-th score is at least the greatest k-th impact among its terms: k documents have
   that from this term alone. This seeds its threshold.
4. The items' terms are sorted by what they can add at most. Terms whose sum from the low end
   stays below the threshold are pruned: a document that holds no other term cannot be among
   the k. Postings of the other terms, joined with the items that ask for them, give
   candidates and part of their scores; those that the pruned terms cannot lift to the
   threshold go, the rest are rescored exactly with all terms.
5. A task raises its thresholds to the k-th of the scores that it has found itself and prunes
   more terms from then on. It returns k rows an item at most, and the best k of those remain.

The items are the stated query set. They meet the documents in blocks of at most
``BLOCK_TERMS`` (item, term) pairs, which are broadcast; each block is one narrow pass over the
written postings, never over the texts. Terms are filtered in the first pass by the broadcast
set of asked terms if that set is below ``ASKED_BYTES``, else by a join.

Null texts have no terms and are not counted. Empty tables give no rows. An item without known
terms has no rows; of rows with equal item_ids each is an item of its own whose rows all
return; a null item_id stays null. Documents with a score of 0 are no result. Repeated
documents are ranked one by one, a null doc_id first. Very long texts take memory of a few
times their size in their task alone. Extra columns are not needed and not returned.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .common import map_batches

K, BLOCK_TERMS, ASKED_BYTES, TILE, STEP = 10, 1 << 20, 32 << 20, 1 << 20, 1024
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # a maximal match in UTF-8: any byte of a character beyond ASCII


def terms_of(text: str | None) -> list[str]:
    return [t.decode("utf-8", "surrogatepass") for t in TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())]


def asked_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written: ``item, item_id, tid, asked`` (asked: occurrences in the item) and ``tid, term``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Counter(terms_of(t)) for t in batch.column(1).to_pylist()]
        cuts = np.cumsum([0, *(len(c) for c in found)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(cuts, pa.array([x for c in found for x in get(c)], kind)) for get, kind in ((dict.keys, pa.string()), (dict.values, pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *lists], ["item_id", "terms", "asked"])

    rows = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("t"))
    found = map_batches(rows, run, "item_id string, terms array<string>, asked array<long>", "t")
    found = found.withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", F.explode(F.arrays_zip("terms", "asked")).alias("x"))
    found = materialize(found.select("item", "item_id", F.col("x.terms").alias("term"), F.col("x.asked").alias("asked")))
    ids = materialize(found.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")))
    return found.join(ids, "term").select("item", "item_id", "tid", "asked"), ids


def postings(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written ``doc_id, n, tids, tfs`` of the documents that have a term; tids are sorted."""
    spark = docs.sparkSession
    small = ids.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    known = spark.sparkContext.broadcast({r["term"].encode("utf-8", "surrogatepass"): r["tid"] for r in ids.collect()} if small <= ASKED_BYTES else None)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, terms, tfs, cuts = [], [], [], [0]
        for t in batch.column(1).to_pylist():
            found = TERM.findall((t or "").encode("utf-8", "surrogatepass").lower())
            n.append(len(found))
            own = Counter(found)
            if known.value is not None:
                get = known.value.get
                kept = sorted((i, k) for w, k in own.items() if (i := get(w)) is not None)
            else:
                kept = list(own.items())
            terms += [x for x, _ in kept]
            tfs += [k for _, k in kept]
            cuts.append(len(terms))
        cuts = np.array(cuts, np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(terms, kind)), pa.ListArray.from_arrays(cuts, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    kind = pa.int64() if known.value is not None else pa.binary()
    schema = "doc_id long, n long, terms array<%s>, tfs array<long>"
    if known.value is not None:
        found = map_batches(rows, run, schema % "long", "t").withColumnRenamed("terms", "tids")
        return materialize(found.where("n > 0"))
    found = materialize(map_batches(rows, run, schema % "binary", "t").where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    each = found.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("row", F.col("x.terms").cast("string").alias("term"), F.col("x.tfs").alias("tf"))
    lists = each.join(ids, "term").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("tid", "tf"))).alias("x"))
    none = F.array().cast("array<long>")
    return materialize(found.select("row", "doc_id", "n").join(lists, "row", "left").select("doc_id", "n", F.coalesce("x.tid", none).alias("tids"), F.coalesce("x.tf", none).alias("tfs")))


def _flat(batch: pa.RecordBatch, total: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of postings: row, tid and impact before the term's weight."""
    tids, tfs = batch.column(2), batch.column(3)
    size = np.diff(tids.offsets.to_numpy())
    row, tf = np.repeat(np.arange(len(size)), size), tfs.flatten().to_numpy(zero_copy_only=False)
    m = 25 + (75 * batch.column(1).to_numpy() * total) // length
    return row, tids.flatten().to_numpy(zero_copy_only=False), (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])


def _first_of(key: np.ndarray, k: int) -> np.ndarray:
    """Of sorted keys, whether each is among the first k of its kind."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key)))) < k


def best_impacts(found: DataFrame, total: int, length: int, k: int = K) -> DataFrame:
    """``tid, df, top, kth``: of each term the documents that hold it, the highest impact and
    the k-th (0 where fewer documents hold it), without its weight."""

    def run(batches):
        tid, g, df = np.zeros(0, np.int64), np.zeros(0, np.int64), Counter()
        for batch in batches:
            _, t, new = _flat(batch, total, length)
            distinct, n = np.unique(t, return_counts=True)
            df.update(dict(zip(distinct.tolist(), n.tolist())))
            tid, g = np.concatenate((tid, t)), np.concatenate((g, new))
            order = np.lexsort((-g, tid))
            order = order[_first_of(tid[order], k)]
            tid, g = tid[order], g[order]
        if len(tid):
            lead = _first_of(tid, 1)
            yield pa.RecordBatch.from_arrays([pa.array(tid), pa.array(g), pa.array(np.where(lead, [df[i] for i in tid.tolist()], 0))], ["tid", "g", "df"])

    parts = found.mapInArrow(run, "tid long, g long, df long")
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("g")))).where(F.col("r") <= k)
    high = ranked.groupBy("tid").agg(F.max("g").alias("top"), F.coalesce(F.max(F.when(F.col("r") == k, F.col("g"))), F.lit(0)).alias("kth"))
    return materialize(parts.groupBy("tid").agg(F.sum("df").alias("df")).join(high, "tid"))


class Block:
    """The (item, term) pairs of some items; ``adds``: weight times occurrences in the item."""

    def __init__(self, item: np.ndarray, tid: np.ndarray, adds: np.ndarray, top: np.ndarray, kth: np.ndarray):
        self.items, own = np.unique(item, return_inverse=True)
        bound = adds * top
        order = np.lexsort((tid, bound, own))
        self.own, self.tid, self.adds, bound = own[order], tid[order], adds[order], bound[order]
        start = np.searchsorted(self.own, np.arange(len(self.items)))
        run = np.cumsum(bound)
        self.below = run - np.concatenate(([0], run))[start][self.own]  # what this term and those before it can add
        self.seed = np.zeros(len(self.items), np.int64)
        np.maximum.at(self.seed, own, adds * kth)
        by_term = np.lexsort((self.own, self.tid))
        self.by_term, self.sorted_tid = by_term, self.tid[by_term]
        key = self.tid * len(self.items) + self.own
        self.pair_order = np.argsort(key)
        self.pair_key = key[self.pair_order]

    def kept_terms(self, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs sorted by term that are not pruned; of each item what the pruned can add."""
        kept = self.below >= threshold[self.own]
        rest = np.zeros(len(self.items), np.int64)
        np.maximum.at(rest, self.own[~kept], self.below[~kept])
        return self.by_term[kept[self.by_term]], rest

    def exact(self, row: np.ndarray, item: np.ndarray, starts: np.ndarray, tid: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The scores of (row, item) candidates from all terms of each row."""
        size = starts[row + 1] - starts[row]
        pair = np.repeat(np.arange(len(row)), size)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + starts[row][pair]
        key = tid[at] * len(self.items) + item[pair]
        where = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        adds = np.where(self.pair_key[where] == key, self.adds[self.pair_order[where]], 0)
        score = np.zeros(len(row), np.int64)
        np.add.at(score, pair, adds * g[at])
        return score


def _search(block: Block, total: int, length: int, k: int):
    def run(batches):
        n = len(block.items)
        held = [np.zeros(0, np.int64) for _ in range(3)]  # item, -score, doc (null: the smallest)
        threshold, before = block.seed.copy(), None
        step = max(1, min(STEP, TILE // n))
        for batch in batches:
            row, tid, g = _flat(batch, total, length)
            starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            first, ids = 0, batch.column(0).fill_null(-(1 << 63)).to_numpy()
            while first < batch.num_rows:
                if before is None or (threshold > before).any():
                    kept, rest = block.kept_terms(threshold)
                    kept_tid, before = block.tid[kept], threshold.copy()
                own = slice(starts[first], starts[min(first + step, batch.num_rows)])
                lo, hi = np.searchsorted(kept_tid, tid[own]), np.searchsorted(kept_tid, tid[own], side="right")
                # as many rows as make at most TILE parts of scores, one at least
                parts = np.concatenate(([0], np.cumsum(hi - lo)))[starts[first : first + step + 1] - starts[first]]
                last = first + max(1, int(np.searchsorted(parts, TILE, side="right")) - 1)
                lo, hi = (x[: starts[last] - starts[first]] for x in (lo, hi))
                met = np.repeat(np.arange(len(lo)), hi - lo)
                pair = kept[np.arange(len(met)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[met]]
                met += starts[first]
                part = np.zeros((last - first) * n, np.int64)
                np.add.at(part, (row[met] - first) * n + block.own[pair], block.adds[pair] * g[met])
                at = np.flatnonzero(part)
                at = at[part[at] + rest[at % n] >= threshold[at % n]]
                score = np.concatenate([block.exact(x // n + first, x % n, starts, tid, g) for x in np.array_split(at, 1 + len(at) // STEP)])
                good = (score >= threshold[at % n]) & (score > 0)
                held = [np.concatenate((a, b[good])) for a, b in zip(held, (at % n, -score, ids[at // n + first]))]
                order = np.lexsort((held[2], held[1], held[0]))
                order = order[_first_of(held[0][order], k)]
                held = [a[order] for a in held]
                begin = np.searchsorted(held[0], np.arange(n))
                full = np.flatnonzero(np.searchsorted(held[0], np.arange(n), side="right") - begin == k)
                threshold[full] = np.maximum(threshold[full], -held[1][begin[full] + k - 1])
                first = last
        if len(held[0]):
            doc = pa.array(held[2], mask=held[2] == -(1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(block.items[held[0]]), doc, pa.array(-held[1])], ["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents with the highest score above 0 of
    each item, equal scores by ascending doc_id."""
    spark = docs.sparkSession
    asked, ids = asked_terms(items)
    found = postings(docs, ids)
    total, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    stats = best_impacts(found, total, max(1, length), k)
    weight = F.floor(1000 * F.log((2.0 * total + 2) / (2.0 * F.col("df") + 1)))
    pairs = materialize(asked.join(stats, "tid").select("item", "item_id", "tid", (F.col("asked") * weight).alias("adds"), "top", "kth").where("adds > 0"))
    size = pairs.groupBy("item").count()
    many = size.agg(F.sum("count")).first()[0] or 0
    blocks = -(-many // block_terms)
    parts = None
    for b in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "tid", "adds", "top", "kth").toPandas()
        if not len(rows):
            continue
        part = found.mapInArrow(_search(Block(*(rows[c].to_numpy(np.int64) for c in rows)), total, length, k), "item long, doc_id long, score long")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], "item_id string, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))
    best = parts.withColumn("rank", rank).where(F.col("rank") <= k)
    names = pairs.select("item", "item_id").distinct()
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2)::DOUBLE / (2.0 * df + 1)::DOUBLE)) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), t),
s AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * docs) // len))))) AS BIGINT) AS score
  FROM asked JOIN p USING (term) JOIN f USING (term) JOIN d USING (doc_id), t GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10"""
