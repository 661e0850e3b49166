"""Benchmark decontamination over training suffix arrays.

The documents are cut into shards of bounded size inside the tasks that read them. A
shard's words become integers over the benchmark's vocabulary and its word suffixes are
sorted by prefix doubling. Every benchmark suffix is binary-searched in every shard, with the
words that both ends of the search have in common skipped; its neighbours there give its
longest verbatim match. ``longest_matches`` sorts and compares to the end of the longest item;
which words are hit depends on windows only, so ``hits`` sorts and compares as many words as a
window has, and a long verbatim copy takes time in proportion to its length. Suffixes whose
match holds a window then get the range of their places, once
for each distinct window, and the words there are marked. Suffixes of the shard that start
with fewer than the least window of vocabulary words cannot hold a match and are left out
of the array.

At one place at most one distinct window of each length stands, so what a shard marks grows
with its words, never with words times windows. A text longer than a shard is cut into
pieces that overlap by a window less a word; marks in the overlap are united.

The benchmark is cut into blocks of at most ``block_bytes`` of text, which pass over the
driver one by one. Each block is one narrow pass that adds its hits to the two state
columns of a document, so a benchmark of any size is searched whole, nothing is shuffled,
and what travels to the tasks never exceeds a block. Each pass reads the words anew.

A null text has no words. An item without words has no window. Items with equal texts
all count; of rows with equal item_ids the id counts once. A null item_id is kept as the
string ``null``. Repeated documents are judged alike. Extra columns stay untouched, whatever
their names; where the result would take a name that is in use, ``prefix`` must tell them
apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name, map_batches

WINDOW, BLOCK_BYTES, SHARD_BYTES, CHUNK = 13, 4 << 20, 4 << 20, 1 << 20
WORD, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
PLACES = "item_id string, n_words int, row string, doc_start long, item_start int"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII characters."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class TestSet:
    """The suffixes of one block of benchmark items that can start a window."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.item_ids: list[str] = []
        tokens, starts, lengths = [], [], []
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.item_ids.append(item_id)
                starts.append(len(tokens))
                lengths.append(len(words))
                tokens += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
        self.depth = max(lengths, default=0)
        self.tokens = np.array(tokens + [0] * (self.depth + 1), np.int64)
        n = np.array(lengths, np.int64)
        each = np.maximum(n - window, 0) + 1
        self.item = np.repeat(np.arange(len(n)), each)
        self.offset = np.arange(len(self.item)) - np.repeat(np.cumsum(each) - each, each)
        self.start = np.repeat(np.array(starts, np.int64), each) + self.offset
        self.left = n[self.item] - self.offset if len(n) else self.offset
        self.need = np.minimum(self.left, window)
        self.least = int(self.need.min(initial=window)) if len(n) else 0
        # windows with equal words are one
        seen: dict[bytes, int] = {}
        self.window = np.array([seen.setdefault(self.tokens[a : a + k].tobytes(), len(seen)) for a, k in zip(self.start.tolist(), self.need.tolist())], np.int64)
        # items of each window: a row of distinct (window, item)
        pairs = np.unique(self.window * max(1, len(n)) + self.item)
        self.member = pairs % max(1, len(n))
        self.first = np.searchsorted(pairs // max(1, len(n)), np.arange(len(seen) + 1))


def suffix_array(tokens: np.ndarray, keep: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``keep`` sorted by the first ``depth`` or more tokens from there.
    Token 0 ends a suffix. Prefix doubling, a numpy sort per doubling."""
    rank, k = tokens, 1
    while True:
        if k >= depth:
            return keep[np.argsort(rank[keep], kind="stable")]
        second = np.zeros_like(rank)
        second[:-k] = rank[k:]
        second[rank == 0] = 0
        key = rank * (int(second.max(initial=0)) + 1) + second
        _, rank2 = np.unique(key, return_inverse=True)
        rank = np.where(tokens == 0, 0, rank2 + 1)
        k *= 2


def _compare(tokens, pos, test, start, limit, known):
    """Words in common (up to limit; ``known`` of them are) and whether the shard's suffix
    is smaller."""
    lcp, less, live = known.copy(), np.zeros(len(pos), bool), np.arange(len(pos))
    while len(live):
        d = lcp[live]
        open_ = d < limit[live]
        a, b = tokens[pos[live] + d], test[start[live] + d]
        less[live[(a < b) & open_]] = True
        live = live[(a == b) & open_]
        lcp[live] += 1
    return lcp, less


def bound(tokens, sa, test, start, limit, upper: bool = False):
    """First place whose suffix is not smaller in its first ``limit`` words (``upper``:
    greater), and the longest match of those beside it."""
    n = len(start)
    lo, hi, below, above = np.zeros(n, np.int64), np.full(n, len(sa)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    while (open_ := lo < hi).any():
        i = np.flatnonzero(open_)
        mid = (lo[i] + hi[i]) // 2
        lcp, less = _compare(tokens, sa[mid], test, start[i], limit[i], np.minimum(below[i], above[i]))
        right = less | (lcp >= limit[i]) if upper else less
        lo[i[right]], below[i[right]] = mid[right] + 1, lcp[right]
        hi[i[~right]], above[i[~right]] = mid[~right], lcp[~right]
    return lo, np.maximum(below, above)


class Shard:
    """The suffix array of some rows of word numbers, and the longest verbatim match of
    every test suffix in it, up to ``limit`` words (no limit: the rest of its item)."""

    def __init__(self, rows: list[np.ndarray], test: TestSet, limit: np.ndarray | None = None):
        limit = test.left if limit is None else limit
        depth = int(limit.max(initial=1))
        self.test, self.bases = test, np.cumsum([0, *(len(r) + 1 for r in rows)])
        end, none = np.zeros(1, np.int64), np.zeros(0, np.int64)
        tokens = np.concatenate([part for r in rows for part in (r, end)] + [np.zeros(test.depth + 1, np.int64)])
        self.where = self.sa = none
        self.longest = np.zeros(len(test.start), np.int64)
        if not test.least:
            return
        # words up to the next one outside the vocabulary
        gap = np.flatnonzero(tokens == 0)
        run = gap[np.searchsorted(gap, np.arange(len(tokens)))] - np.arange(len(tokens))
        near = run >= test.least
        if not near.any():
            return
        # keep only stretches that can hold a match; what follows a dropped word is not read
        ends = np.flatnonzero(near & ~np.concatenate((near[1:], [False])))
        edge = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(edge, ends, 1)
        np.add.at(edge, np.minimum(ends + run[ends] + 1, len(tokens)), -1)
        self.where = np.flatnonzero(near | (np.cumsum(edge[:-1]) > 0))
        self.tokens = np.concatenate((tokens[self.where], np.zeros(test.depth + 1, np.int64)))
        self.sa = suffix_array(self.tokens, np.flatnonzero(near[self.where]), depth)
        _, self.longest = bound(self.tokens, self.sa, test.tokens, test.start, limit)

    def ranges(self, which: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the test suffixes ``which``: places of the suffixes with the same first words."""
        args = self.tokens, self.sa, self.test.tokens, self.test.start[which], length
        return bound(*args)[0], bound(*args, upper=True)[0]

    def places(self, which: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into ``which``, position in the rows joined), in bounded chunks."""
        if not len(which):
            return
        lo, hi = self.ranges(which, length)
        ends = np.cumsum(hi - lo)
        for a in range(0, int(ends[-1]), CHUNK):
            at = np.arange(a, min(a + CHUNK, int(ends[-1])))
            i = np.searchsorted(ends, at, side="right")
            yield i, self.where[self.sa[hi[i] - (ends[i] - at)]]

    def row_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, position, side="right") - 1


def hits(rows: list[np.ndarray], test: TestSet) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A mask of hit words of each row, and distinct (row, item) with an occurring window."""
    shard, items = Shard(rows, test, test.need), max(1, len(test.item_ids))
    edge = np.zeros(int(shard.bases[-1]) + test.depth + 2, np.int64)
    # one suffix of each distinct window that stands here
    found = np.flatnonzero(shard.longest >= test.need) if len(shard.sa) else np.zeros(0, np.int64)
    found = found[np.unique(test.window[found], return_index=True)[1]]
    pairs = np.zeros(0, np.int64)
    for i, position in shard.places(found, test.need[found]):
        np.add.at(edge, position, 1)
        np.add.at(edge, position + test.need[found][i], -1)
        met = np.unique(shard.row_of(position) * len(test.first) + test.window[found][i])
        row, window = met // len(test.first), met % len(test.first)
        ends = np.cumsum(test.first[window + 1] - test.first[window])
        for a in range(0, int(ends[-1]), CHUNK):
            at = np.arange(a, min(a + CHUNK, int(ends[-1])))
            k = np.searchsorted(ends, at, side="right")
            pairs = np.union1d(pairs, row[k] * items + test.member[test.first[window[k] + 1] - (ends[k] - at)])
    hit = np.cumsum(edge) > 0
    return [hit[a : a + len(r)] for a, r in zip(shard.bases.tolist(), rows)], pairs // items, pairs % items


def numbered(text: str | None, test: TestSet, size: int = SHARD_BYTES) -> Iterator[np.ndarray]:
    """The words as numbers, in pieces of about ``size`` bytes."""
    data, at, get = (text or "").encode("utf-8", "surrogatepass").lower(), 0, test.vocab.get
    while at < len(data):
        cut = GAP.search(data, at + size)
        end = cut.start() if cut else len(data)
        words = WORD.findall(data, at, end)
        yield np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        at = end


def overlapping(text: str | None, test: TestSet, overlap: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words before the piece, piece), each piece behind the last words of the one before."""
    before, tail = 0, np.zeros(0, np.int64)
    for piece in numbered(text, test, size):
        row = np.concatenate((tail, piece))
        yield before, row
        tail = row[len(row) - min(overlap, len(row)) :]
        before += len(row) - len(tail)


def text_hits(texts: list[str | None], test: TestSet, size: int = SHARD_BYTES) -> list[tuple[int, np.ndarray, list[int]]]:
    """Of each text: number of words, mask of those hit, items with an occurring window."""
    window = int(test.need.max(initial=1))
    pieces = [[(b, r) for b, r in overlapping(t, test, window - 1, size)] for t in texts]
    rows = [(d, b, r) for d, own in enumerate(pieces) for b, r in own]
    masks = [np.zeros(own[-1][0] + len(own[-1][1]) if own else 0, bool) for own in pieces]
    items: list[set[int]] = [set() for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []
    for k, row in enumerate(rows):
        held.append(row)
        if k + 1 == len(rows) or sum(len(r) for *_, r in held) + len(rows[k + 1][2]) > size // 4:
            found, at, item = hits([r for *_, r in held], test)
            for (d, b, r), mask in zip(held, found):
                masks[d][b : b + len(r)] |= mask
            for a, i in zip(at.tolist(), item.tolist()):
                items[held[a][0]].add(i)
            held = []
    return [(len(m), m, sorted(i)) for m, i in zip(masks, items)]


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """The items in blocks of bounded text, one block on the driver at a time."""
    block, held = [], 0
    for r in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.coalesce(F.col(text).cast("string"), F.lit(""))).toLocalIterator():
        if block and held + len(r[1]) > block_bytes:
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += len(r[1]) + 16
    if block:
        yield block


def _runs(mask: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of True, in turn."""
    return np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """``docs`` with three more columns: ``n_words``, ``hit_runs`` (start and end of each run
    of hit words, in turn) and ``items`` (ids with an occurring window, in no order)."""
    own = [prefix + c for c in ("n_words", "hit_runs", "items")]
    taken = {c.lower() for c in docs.columns} & {c.lower() for c in own}
    if taken:
        raise ValueError(f"choose a prefix, {sorted(taken)} are columns of the documents")
    out = docs.select("*", F.lit(0).cast("long").alias(own[0]), F.array().cast("array<long>").alias(own[1]), F.array().cast("array<string>").alias(own[2]))
    names, schema, at = out.columns, out.schema, out.columns.index(text)
    spark = docs.sparkSession

    def passed(out: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)  # kept in a file, not in the driver's memory

        def run(batch: pa.RecordBatch, made=[]) -> pa.RecordBatch:  # noqa: B006  one TestSet a task
            if not made:
                made.append(TestSet(shared.value, window))
            test, counts, runs, ids = made[0], [], [], []
            cols = list(batch.columns)
            found = text_hits(batch.column(at).to_pylist(), test)
            for (n, mask, items), before, known in zip(found, cols[-2].to_pylist(), cols[-1].to_pylist()):
                for a, b in zip(before[::2], before[1::2]):
                    mask[a:b] = True
                counts.append(n)
                runs.append(_runs(mask))
                ids.append(known + [test.item_ids[i] for i in items])
            return pa.RecordBatch.from_arrays([*cols[:-3], pa.array(counts, pa.int64()), pa.array(runs, cols[-2].type), pa.array(ids, cols[-1].type)], names)

        return map_batches(out, run, schema, text, SHARD_BYTES)

    empty = True
    for items in item_blocks(benchmark, item_id, item_text, block_bytes):
        out, empty = passed(out, items), False
    return passed(out, []) if empty else out  # without items the words are counted all the same


def judged(docs: DataFrame, benchmark: DataFrame, share: int = 20, prefix: str = "", **columns) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``contaminated``: at
    least one word in ``share`` is hit. ``prefix`` stands before these four names."""
    taken = {c.lower() for c in docs.columns} & {(prefix + c).lower() for c in ("n_words", "n_hit", "items", "contaminated")}
    if taken:
        raise ValueError(f"choose a prefix, {sorted(taken)} are columns of the documents")
    inner = free_name(docs.columns, "found_")
    found = find_hits(docs, benchmark, prefix=inner, **columns)
    n_words, runs = F.col(f"{inner}n_words"), F.col(f"{inner}hit_runs")
    n_hit = F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        *(found[c] for c in docs.columns), n_words.alias(f"{prefix}n_words"), n_hit.alias(f"{prefix}n_hit"), F.array_sort(F.array_distinct(f"{inner}items")).alias(f"{prefix}items"),
        ((n_hit > 0) & (share * n_hit >= n_words)).alias(f"{prefix}contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """The documents that are not contaminated, with their own columns and values."""
    prefix = free_name(docs.columns, "judged_")
    found = judged(docs, benchmark, prefix=prefix, **columns)
    return found.where(~F.col(f"{prefix}contaminated")).select(*(found[c] for c in docs.columns))


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, n_words, doc_id, doc_start, item_start``: the longest verbatim match of
    each item, with every place where it stands. Shards say their own longest matches; the
    longest of all are taken by a grouped maximum."""
    spark, parts = docs.sparkSession, []
    rows = docs.select(F.col(doc_id).cast("string").alias("row"), F.col(text).cast("string").alias("t"))
    schema = pa.schema([("item_id", pa.string()), ("n_words", pa.int32()), ("row", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int32())])

    def searched(items: list[tuple[str, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches):
            test = TestSet(shared.value, window)
            for batch in batches:
                for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for k, (before, piece) in enumerate(overlapping(t, test, max(0, test.depth - 1), SHARD_BYTES)):
                        yield from places(row, before, piece, test, max(0, test.depth - 1) if k else 0)

        def places(row, before, piece, test, overlap):
            shard = Shard([piece], test)
            best = np.zeros(len(test.item_ids), np.int64)
            np.maximum.at(best, test.item, np.where(shard.longest >= test.need, shard.longest, 0))
            which = np.flatnonzero((shard.longest >= test.need) & (shard.longest == best[test.item])) if len(shard.sa) else np.zeros(0, np.int64)
            for i, position in shard.places(which, shard.longest[which]):
                keep = position + shard.longest[which[i]] > overlap  # else the piece before has it
                s, position = which[i][keep], position[keep]
                yield pa.RecordBatch.from_arrays([pa.array([test.item_ids[x] for x in test.item[s]], pa.string()), pa.array(shard.longest[s], pa.int32()), pa.array([row] * len(s), pa.string()), pa.array(position + before, pa.int64()), pa.array(test.offset[s], pa.int32())], schema=schema)

        return rows.mapInArrow(run, PLACES)

    for items in item_blocks(benchmark, item_id, item_text, block_bytes):
        parts.append(searched(items))
    if not parts:
        parts = [searched([])]
    m = parts[0]
    for p in parts[1:]:
        m = m.unionByName(p)
    best = m.groupBy(F.col("item_id").alias("id2")).agg(F.max("n_words").alias("best"))
    return m.join(best, (F.col("item_id") == F.col("id2")) & (F.col("n_words") == F.col("best"))).select("item_id", "n_words", F.col("row").cast(docs.schema[doc_id].dataType).alias("doc_id"), "doc_start", "item_start")
