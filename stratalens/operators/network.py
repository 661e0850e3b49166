"""Evidence graphs: co-occurrence, neighbourhood measures, path centrality, search."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .components import connected_components


def cooccurrence_by_group(rows: DataFrame, group: str, member: str, cap: int = 20) -> DataFrame:
    """``g, a, b``: pairs of members of a group, a before b. Groups of more than ``cap``
    members give no pairs (part of the measure); see ``over_cap`` for their list. Members are
    numbered in order, and of a group no task sends more than the ``cap`` + 1 that tell that it
    is over the cap, so large groups never meet in one task."""
    r = rows.select(F.col(group).alias("g"), F.col(member).alias("m")).dropna().where("g is not null and m is not null").distinct()
    whole = Window.partitionBy("g")
    r = r.withColumn("place", F.row_number().over(whole.orderBy("m"))).where(F.col("place") <= cap + 1)
    r = r.withColumn("members", F.max("place").over(whole)).where(F.col("members").between(2, cap)).select("g", "m")
    return r.withColumnRenamed("m", "a").join(r.withColumnRenamed("m", "b"), "g").where("a < b").select("g", "a", "b")


def cooccurrence(rows: DataFrame, group: str, member: str, cap: int = 20) -> DataFrame:
    """``a, b, weight``: members that share a group, by number of groups."""
    return cooccurrence_by_group(rows, group, member, cap).groupBy("a", "b").agg(F.count("*").alias("weight"))


def over_cap(rows: DataFrame, group: str, member: str, cap: int = 20) -> DataFrame:
    return rows.select(group, member).dropna().distinct().groupBy(group).agg(F.count("*").alias("members")).where(F.col("members") > cap)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree, centrality``: distinct neighbours, alone and over all other nodes. A link
    travels once, its smaller end first (null before all), and is counted at both ends."""
    a, b = F.col("a"), F.col("b")
    turned = (a > b) | (a.isNotNull() & b.isNull())
    links = edges.select(F.when(turned, b).otherwise(a).alias("a"), F.when(turned, a).otherwise(b).alias("b")).distinct()
    d = links.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    # every node has a link; asking for the degree lets the total read what d has shuffled
    n = d.agg(F.count_if(F.col("degree") > 0).alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", F.round(F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("centrality"))


LIST = 512


MOST = 1 << 20  # of one list
LINKS = 1 << 24  # about as many in a block of nodes; a task meets two blocks
CHUNK, SLICE, APART = 1 << 18, 1 << 20, 1 << 17  # links of a packed row, ids looked up at once, links that are worth a block


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of some runs, one run after the other."""
    return np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)


def _packed(nodes: np.ndarray, deg: np.ndarray, first: np.ndarray, steps: np.ndarray) -> bytes:
    """Lists of ascending ids: their nodes, lengths and first ids, then the steps between ids
    (none at a list's first), as many planes of 16 bits as the largest step needs."""
    planes = next(k for k in (1, 2, 3, 4) if k == 4 or int(steps.view(np.uint64).max()) < 1 << 16 * k)
    low = steps.astype("<i8").view("<u2").reshape(-1, 4)[:, :planes]
    return b"".join([np.array([len(nodes), planes]).tobytes(), nodes.tobytes(), deg.tobytes(), first.tobytes(), np.ascontiguousarray(low.T).tobytes()])


def _unpacked(held: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``nodes, deg, first, steps``, as they were."""
    many, planes = np.frombuffer(held, np.int64, 2)
    nodes, deg, first = np.frombuffer(held, np.int64, 3 * many, 16).reshape(3, -1)
    low = np.frombuffer(held, "<u2", -1, 16 + 24 * many).reshape(planes, -1)
    steps = low[0].astype(np.int64)
    for k in range(1, planes):
        steps |= low[k].astype(np.int64) << 16 * k
    return nodes, deg, first, steps


def _ids(deg: np.ndarray, first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    ids = np.cumsum(steps)
    return ids + np.repeat(first - ids[np.cumsum(deg) - deg], deg)


def _sorted_lists(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``nodes, deg, ids`` of links a, b with a ascending."""
    begins = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    low, bits = int(b.min()), (int(b.max()) - int(b.min())).bit_length()
    if len(begins).bit_length() + bits < 63:
        key = np.repeat(np.arange(len(begins)) << bits, np.diff(begins, append=len(a))) | (b - low)
        key = np.unique(key)
        at, ids = key >> bits, (key & (1 << bits) - 1) + low
    else:
        at = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(a)))
        order = np.lexsort((b, at))
        at, ids = at[order], b[order]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])))
        at, ids = at[new], ids[new]
    return a[begins], np.bincount(at), ids


def _neighbour_lists(batches):
    """``links, most, marks, held`` of rows sorted by node: some whole lists, the longest
    one's length and a node for each 1024 links. A list beyond ``MOST``, or a null among the
    neighbours, is told by ``most`` alone."""
    kept, size = [], 0  # pieces of whole lists
    tail, long = [], 0  # the last node's links so far

    def row(links, most, marks, held):
        return pa.RecordBatch.from_arrays([pa.array([links]), pa.array([most]), pa.array([marks], pa.list_(pa.int64())), pa.array([held], pa.binary())], ["links", "most", "marks", "held"])

    def lists():
        nodes, deg, ids = _sorted_lists(*(np.concatenate(c) for c in zip(*kept)))
        first = np.cumsum(deg) - deg
        steps = np.diff(ids, prepend=ids[:1])
        steps[first] = 0
        marks = np.repeat(nodes, np.diff((np.cumsum(deg) + 512) // 1024, prepend=0))
        return row(len(ids), int(deg.max()), marks, _packed(nodes, deg, ids[first], steps))

    for batch in batches:
        if batch.column(1).null_count:
            yield row(0, MOST + 1, [], None)
            return
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        if not len(a):
            continue
        cut = int(np.searchsorted(a, a[-1]))  # here the batch's last node begins
        if tail and tail[-1][0][0] != a[-1]:
            kept, tail, size, long = kept + tail, [], size + long, 0
        if cut:
            kept.append((a[:cut].copy(), b[:cut].copy()))
            size += cut
        tail.append((a[cut:].copy(), b[cut:].copy()))
        long += len(a) - cut
        if long > 2 * MOST:
            only = np.unique(np.concatenate([x[1] for x in tail]))
            tail, long = [(np.full(len(only), a[-1]), only)], len(only)
            if long > MOST:
                yield row(0, long, [], None)
                return
        if size >= CHUNK:
            yield lists()
            kept, size = [], 0
    kept = kept + tail
    if kept:
        yield lists()


def _to_blocks(bounds: np.ndarray):
    """A list of block i goes to the task of each two blocks (i, j) of which j holds one of its
    neighbours; ``side`` is 0 for the first of the two."""

    def run(batches):
        for batch in batches:
            for held in batch.column(0):
                nodes, deg, first, steps = _unpacked(held.as_py())
                start = np.cumsum(deg) - deg
                own = np.searchsorted(bounds, nodes, side="right")
                asks = np.zeros((len(nodes), len(bounds) + 1), bool)
                asks[np.repeat(np.arange(len(nodes)), deg), np.searchsorted(bounds, _ids(deg, first, steps), side="right")] = True
                found = []
                for i in np.unique(own).tolist():
                    mine = np.flatnonzero(own == i)
                    for j in np.flatnonzero(asks[mine].any(0)).tolist():
                        to = mine[asks[mine, j]]
                        low, high = min(i, j), max(i, j)
                        found.append((high * (high + 1) // 2 + low, int(i > j), _packed(nodes[to], deg[to], first[to], steps[_spread(start[to], deg[to])])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.binary()))], ["pair", "side", "held"])

    return run


class _Lists:
    """The lists of one block's nodes, ids as places (of ids ``names``, or counted from ``low``)."""

    def __init__(self, rows: list):
        self.nodes, self.deg = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        self.start = np.cumsum(self.deg) - self.deg
        self.flat = np.concatenate([r[2] for r in rows])

    def place(self, low: int, names: np.ndarray | None):
        self.own = self.nodes - low if names is None else np.searchsorted(names, self.nodes)


def _met(x: _Lists, y: _Lists, size: int):
    """``a, b, shared, all`` of links between a node of x and one of y that has fewer links, or
    as many and no larger id. The neighbours of x's node are marked, those of y's are counted."""
    where = np.full(size, -1, np.int32)
    where[y.own] = np.arange(len(y.nodes), dtype=np.int32)
    mark = np.zeros(size, np.uint8)
    ends = np.cumsum(x.deg)
    lo = 0
    while lo < len(x.nodes):
        hi = max(lo + 1, int(np.searchsorted(ends, x.start[lo] + SLICE, side="right")))
        v = where.take(x.flat[x.start[lo] : ends[hi - 1]], mode="clip")
        u = np.repeat(np.arange(lo, hi), x.deg[lo:hi])[v >= 0]
        v = v[v >= 0]
        fewer = (y.deg[v] < x.deg[u]) | ((y.deg[v] == x.deg[u]) & (y.nodes[v] <= x.nodes[u]))
        u, v = u[fewer], v[fewer]
        n = y.deg[v]
        upto = np.cumsum(n)
        k = np.zeros(len(u), np.int64)
        at = 0
        while at < len(u):
            # ids of the next links' lists, SLICE at once; a list is never longer than MOST
            to = max(at + 1, int(np.searchsorted(upto, upto[at] - n[at] + SLICE, side="right")))
            ids = y.flat.take(_spread(y.start[v[at:to]], n[at:to]), mode="clip")
            hit = np.empty(len(ids), np.uint8)
            cuts = np.flatnonzero(np.concatenate(([True], u[at + 1 : to] != u[at : to - 1])))
            first = upto[at:to] - n[at:to] - (upto[at] - n[at])
            begins = first[cuts].tolist()
            for node, p, q in zip(u[at:to][cuts].tolist(), begins, begins[1:] + [len(ids)]):
                near = x.flat[x.start[node] : ends[node]]
                mark[near] = 1
                mark.take(ids[p:q], out=hit[p:q], mode="clip")
                mark[near] = 0
            k[at:to] = np.add.reduceat(hit, first, dtype=np.int64)
            at = to
        if len(u):
            a, b = x.nodes[u], y.nodes[v]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(a, b), np.maximum(a, b), k, x.deg[u] + n - k)], ["a", "b", "shared", "all"])
        lo = hi


def _shared_in_pairs(batches):
    """``a, b, shared, all`` of the lists of two blocks (or of one)."""
    rows: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for pair, side, held in zip(*(batch.column(k) for k in range(3))):
            nodes, deg, first, steps = _unpacked(held.as_py())
            ids = _ids(deg, first, steps)
            low, high = min(int(ids.min()), int(nodes.min())), max(int(ids.max()), int(nodes.max()))
            # as small as they can be held: steps from the least one
            ids = ids - low
            rows.setdefault(pair.as_py(), ([], []))[side.as_py()].append([nodes, deg, ids.astype(np.int32) if high - low < 1 << 31 else ids, low, high])
    for pair in sorted(rows):
        held = rows.pop(pair)
        every = [*held[0], *held[1]]
        low, high = min(r[3] for r in every), max(r[4] for r in every)
        names = None
        if high - low >= max(1 << 24, 4 * sum(len(r[2]) for r in every)):  # ids far apart are numbered
            names = np.unique(np.concatenate([np.unique(np.concatenate((r[2] + np.int64(r[3]), r[0]))) for r in every]))
        for r in every:
            r[2] = (r[2].astype(np.int64) + (r[3] - low)) if names is None else np.searchsorted(names, r[2] + np.int64(r[3]))
            r[2] = r[2].astype(np.int32)
        size = len(names) if names is not None else high - low + 1
        sides = [_Lists(r) for r in held if r]
        del every, held
        for s in sides:
            s.place(low, names)
        yield from _met(sides[0], sides[-1], size)
        if len(sides) > 1:
            yield from _met(sides[1], sides[0], size)


def jaccard(edges: DataFrame) -> DataFrame:
    """Of each linked pair (a < b, ids longs): shared neighbours over all neighbours. Nodes are
    cut into blocks (ranges of ids, by quantiles of the links) of about ``LINKS``, and each two
    blocks with links between them are a task, which holds the lists of their nodes packed and
    counts a pair at its end with fewer links. So a list is sent once for each block that
    holds a neighbour, and no row is made for a pair of neighbours. Other ids, other
    directions and nodes of more than ``MOST`` links go by ``jaccard_by_cells``."""
    e = edges.select("a", "b").dropna()
    if e.dtypes != [("a", "bigint"), ("b", "bigint")]:
        return jaccard_by_cells(materialize(e))
    spark = e.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = e.select(F.inline(F.array(F.struct("a", F.when(F.col("a") < F.col("b"), F.col("b")).alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    lists = materialize(n.repartition(tasks, "a").sortWithinPartitions("a").mapInArrow(_neighbour_lists, "links long, most long, marks array<long>, held binary"))
    links, most = lists.agg(F.sum("links"), F.max("most")).first()
    if (most or 0) > MOST:
        return jaccard_by_cells(materialize(e))
    # so many blocks that a task holds two in memory, and that there are pairs for all cores
    blocks = max(1, -(-(links or 0) // LINKS), min((links or 0) // APART, math.isqrt(6 * spark.sparkContext.defaultParallelism)))
    bounds = lists.select(F.explode("marks").alias("m")).agg(F.percentile_approx("m", [k / blocks for k in range(1, blocks)], 100 * blocks)).first()[0] if blocks > 1 else []
    bounds = np.unique(np.array(bounds, np.int64))
    pairs = (len(bounds) + 1) * (len(bounds) + 2) // 2
    sent = lists.select("held").mapInArrow(_to_blocks(bounds), "pair int, side int, held binary")
    met = sent.repartitionById(pairs, "pair").mapInArrow(_shared_in_pairs, "a long, b long, shared long, all long")
    return met.select("a", "b", F.round(F.col("shared") / F.col("all"), 6).alias("jaccard"))


def jaccard_by_cells(edges: DataFrame) -> DataFrame:
    """The same for any ids. Neighbour lists are cut
    into cells by a hash of the neighbour, so that no row holds more than about ``LIST``
    of them; an edge meets the lists of its end with fewer links first, then those of the
    other end in the same cells, and only counts travel on. No row is made for a pair of
    neighbours."""
    n = materialize(both_ways(edges))
    d = n.groupBy("a").agg(F.count("*").alias("deg"))
    cells = max(1, -(-(d.agg(F.max("deg")).first()[0] or 0) // LIST))
    lists = materialize(n.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(cells)).alias("cell")).agg(F.collect_list("b").alias("near")))
    e = edges.select("a", "b").join(d.select("a", F.col("deg").alias("da")), "a").join(d.select(F.col("a").alias("b"), F.col("deg").alias("db")), "b")
    e = materialize(e)
    first = F.col("da") <= F.col("db")
    asked = e.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("high"))
    low, high = (lists.select(F.col("a").alias(end), "cell", F.col("near").alias(f"near_{end}")) for end in ("low", "high"))
    met = asked.join(low, "low").join(high, ["high", "cell"]).select("a", "b", F.size(F.array_intersect("near_low", "near_high")).alias("k"))
    shared = met.groupBy("a", "b").agg(F.sum("k").alias("shared"))
    s = F.coalesce("shared", F.lit(0))
    return e.join(shared, ["a", "b"], "left").select("a", "b", F.round(s / (F.col("da") + F.col("db") - s), 6).alias("jaccard"))


def within_steps(edges: DataFrame, seed, steps: int = 2, limit: int | None = None) -> DataFrame:
    """``node, depth`` of the nodes at most ``steps`` links from the seed."""
    n = both_ways(edges)
    seen = edges.sparkSession.range(1).select(F.lit(seed).cast(n.schema["a"].dataType).alias("node"), F.lit(0).alias("depth"))
    for k in range(steps):
        more = seen.where(F.col("depth") == k).join(n, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(k + 1).alias("depth")).distinct()
        seen = materialize(seen.unionByName(more.join(seen.select(F.col("node").alias("s")), F.col("node") == F.col("s"), "left_anti")))
    return seen.orderBy("depth", "node").limit(limit) if limit else seen


def subgraph(edges: DataFrame, seed: str, depth: int = 2, limit: int = 500, in_scope: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Breadth-first from the seed over ``edges`` (edge_id, src, dst, ...), nodes of a level
    in the order of their finders and edge ids, ``limit`` nodes in all. Returns the nodes
    (node, depth, place), the edges among them, and stubs: per node the edges that the limit
    cut (``more_edges``) and those outside the scope (``cross_scope``)."""
    scope = F.lit(True) if in_scope is None else F.coalesce(in_scope, F.lit(False))
    e = edges.withColumn("_in", scope)
    ends = e.select("edge_id", "_in", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select("edge_id", "_in", F.col("dst").alias("a"), F.col("src").alias("b"))).where("a <> b")
    # of a known size, unlike a list of rows: the nodes seen are broadcast and no edge is shuffled
    seen = edges.sparkSession.range(1).select(F.lit(seed).cast("string").alias("node"), F.lit(0).alias("depth"), F.lit(0).alias("place"))
    cut, total = [], 1
    for k in range(depth):
        front = ends.where("_in").join(seen.where(F.col("depth") == k), F.col("a") == F.col("node")).select("a", "b", "edge_id", "place")
        fresh = materialize(front.join(seen.select(F.col("node").alias("_s")), F.col("b") == F.col("_s"), "left_anti"))
        first = fresh.groupBy("b").agg(F.min(F.struct("place", "edge_id")).alias("o")).orderBy("o").limit(limit - total)
        ranked = first.withColumn("place", (F.row_number().over(Window.orderBy("o")) + (total - 1)).cast("int"))
        more = materialize(ranked.select(F.col("b").alias("node"), F.lit(k + 1).alias("depth"), "place"))
        total += more.count()  # at most the limit
        if total >= limit:
            left = fresh.join(more.select(F.col("node").alias("_s")), F.col("b") == F.col("_s"), "left_anti")
            cut.append(left.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("more_edges")))
        seen = seen.unionByName(more)
    among = e.where("_in").join(seen.select(F.col("node").alias("src")), "src", "left_semi").join(seen.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)
    cross = ends.where("not _in").join(seen.select("node"), F.col("a") == F.col("node"), "left_semi").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("cross_scope"))
    stubs = reduce(DataFrame.unionByName, cut) if cut else seen.where("false").select("node", F.lit(0).cast("long").alias("more_edges"))
    stubs = stubs.groupBy("node").agg(F.sum("more_edges").alias("more_edges")).join(cross, "node", "full").select("node", F.coalesce("more_edges", F.lit(0)).cast("long").alias("more_edges"), F.coalesce("cross_scope", F.lit(0)).cast("long").alias("cross_scope"))
    return seen, among, stubs


# What a measure may be called, and its bounds.
ARTIFACT = "single-case clique — case-size artifact, excluded from bridge ranking"
BRIDGE = "high-connectivity bridge in the observed case-association graph"
HUB = "frequently co-occurring accused record"
BRIDGES, HUB_DEGREE = 3, 3


def graph_metrics(pairs: DataFrame, pivots: int = 500) -> DataFrame:
    """``pairs``: a, b, case_id. Per node: component, community, degree, centrality,
    co-occurrences, path betweenness, whether its component is one case's clique, and the
    words that may describe it: artifact before bridge before hub."""
    p = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "case_id").distinct())
    e = materialize(p.groupBy("a", "b").agg(F.count("*").alias("weight")))
    comp = connected_components(e, "a", "b")
    near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    shared = near.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("co_occurrences"))
    size = comp.groupBy("component").agg(F.count("*").alias("n_nodes"))
    inside = p.join(comp, F.col("a") == F.col("node")).groupBy("component").agg(F.countDistinct("a", "b").alias("n_edges"), F.min("case_id").alias("c1"), F.max("case_id").alias("c2"))
    clique = size.join(inside, "component").select("component", "n_nodes", ((F.col("c1") == F.col("c2")) & (F.col("n_edges") * 2 == F.col("n_nodes") * (F.col("n_nodes") - 1))).alias("artifact"))
    m = comp.join(clique, "component").join(degrees(e), "node").join(shared, "node").join(betweenness(e, pivots), "node").join(communities(e), "node")
    m = m.withColumn("betweenness", F.when(F.col("n_nodes") > 2, F.col("betweenness") * 2 / ((F.col("n_nodes") - 1) * (F.col("n_nodes") - 2))).otherwise(0.0))
    # the third largest of each component, by three grouped maxima: no component is sorted
    value = m.select("component", "node", "betweenness")
    third = value
    for _ in range(BRIDGES - 1):
        best = third.groupBy("component").agg(F.max(F.struct("betweenness", "node")).alias("top"))
        third = third.join(best.select(F.col("component").alias("_c"), F.col("top.node").alias("_n")), (F.col("component") == F.col("_c")) & (F.col("node") == F.col("_n")), "left_anti")
    bound = third.groupBy("component").agg(F.max("betweenness").alias("bound"))
    words = F.when(F.col("artifact"), ARTIFACT).when((F.col("betweenness") > 0) & (F.col("betweenness") >= F.coalesce("bound", F.lit(0.0))), BRIDGE).when(F.col("degree") >= HUB_DEGREE, HUB)
    return m.join(bound, "component", "left").select("node", "component", "community", "degree", "centrality", F.round("betweenness", 6).alias("betweenness"), "co_occurrences", "artifact", words.alias("interpretation"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "a"), "a", "left_semi").join(n.withColumnRenamed("node", "b"), "b", "left_semi")


def _path_scores(pairs: pd.DataFrame) -> pd.DataFrame:
    """Betweenness within one component (``component, a, b``, each link both ways): from every
    node, shortest paths are counted outwards and shares of them summed up inwards."""
    nodes, ends = pd.factorize(pd.concat([pairs["a"], pairs["b"]]))[::-1]
    half, near = len(pairs), [[] for _ in nodes]
    for x, y in zip(ends[:half].tolist(), ends[half:].tolist()):
        near[x].append(y)
    score = [0.0] * len(nodes)
    for source in range(len(nodes)):
        depth, paths, order = {source: 0}, {source: 1.0}, [source]
        for x in order:
            for y in near[x]:
                if y not in depth:
                    depth[y], paths[y] = depth[x] + 1, 0.0
                    order.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
        share = dict.fromkeys(order, 0.0)
        for y in reversed(order[1:]):
            part = (1 + share[y]) / paths[y]
            for x in near[y]:
                if depth[x] == depth[y] - 1:
                    share[x] += paths[x] * part
            score[y] += share[y]
    return pd.DataFrame({"node": np.asarray(nodes), "x": score, "component": pairs["component"].iloc[0]})


def betweenness(edges: DataFrame, pivots: int = 500, exact: int = 2000, steps: int = 1 << 24) -> DataFrame:
    """``node, betweenness`` from shortest paths. A component of at most ``exact`` nodes whose
    nodes times links are at most ``steps`` is one group, scored in one task: its size is
    bounded by both. Larger ones go by joins on (source, node), a level at a time, until none
    is left, and back: every node of a component of at most ``exact`` nodes is a source; of a
    larger one a hash draws about ``pivots``, and its scores are scaled by its nodes over its
    sources."""
    n = materialize(both_ways(edges))
    comp = connected_components(n.where("a < b"), "a", "b")
    size = comp.groupBy("component").agg(F.count("*").alias("n"))
    links = n.join(comp, F.col("a") == F.col("node")).drop("node")
    size = materialize(size.join(links.groupBy("component").agg(F.count("*").alias("m")), "component"))
    small = (F.col("n") <= exact) & (F.col("n") * F.col("m") <= steps)
    kind = n.schema["a"].dataType.simpleString()
    each = links.join(size.where(small).select("component"), "component").groupBy("component").applyInPandas(_path_scores, f"node {kind}, x double, component {comp.schema['component'].dataType.simpleString()}")
    found = each.select("node", "x", F.lit(1.0).alias("scale"))
    large = materialize(comp.join(size.where(~small), "component"))
    if not large.isEmpty():
        found = found.unionByName(_by_levels(n.join(large.select(F.col("node").alias("a")), "a", "left_semi"), large, pivots, exact))
    # each path is met from either end
    return found.select("node", F.round(F.coalesce(F.col("x") * F.col("scale"), F.lit(0.0)) / 2, 6).alias("betweenness"))


def _by_levels(n: DataFrame, comp: DataFrame, pivots: int, exact: int) -> DataFrame:
    """``node, x, scale`` of components (``component, node, n``), by joins."""
    drawn = comp.where((F.col("n") <= exact) | (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < F.lit(pivots * (1 << 20)) / F.col("n")))
    src = materialize(drawn.select("component", "node"))
    scale = comp.select("component", "n").distinct().join(src.groupBy("component").agg(F.count("*").alias("used")), "component").select("component", (F.col("n") / F.col("used")).alias("scale"))
    level = src.select(F.col("node").alias("s"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("sigma"))
    levels, seen = [level], level.select("s", "node")
    while True:
        step = levels[-1].join(n, F.col("node") == F.col("a")).groupBy("s", F.col("b").alias("node")).agg(F.sum("sigma").alias("sigma"))
        step = materialize(step.join(seen, ["s", "node"], "left_anti").withColumn("d", F.lit(len(levels))).select("s", "node", "d", "sigma"))
        if step.isEmpty():
            break
        levels.append(step)
        # an undirected link leads to the level before, the same one or the next
        seen = levels[-2].select("s", "node").unionByName(step.select("s", "node"))
    delta, parts = levels[-1].withColumn("delta", F.lit(0.0)), []
    for up in reversed(levels[:-1]):
        parts.append(delta)
        below = delta.select("s", F.col("node").alias("c"), ((1 + F.col("delta")) / F.col("sigma")).alias("pay"))
        pay = up.join(n, F.col("node") == F.col("a")).select("s", "node", F.col("b").alias("c")).join(below, ["s", "c"]).groupBy("s", "node").agg(F.sum("pay").alias("pay"))
        delta = materialize(up.join(pay, ["s", "node"], "left").withColumn("delta", F.coalesce(F.col("sigma") * F.col("pay"), F.lit(0.0))).drop("pay"))
    gone = reduce(DataFrame.unionByName, parts) if parts else delta.limit(0)
    score = gone.where("s <> node").groupBy("node").agg(F.sum("delta").alias("x"))
    return comp.join(scale, "component", "left").join(score, "node", "left").select("node", "x", "scale")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of ``labels`` (node, community) over ``edges`` (a, b, weight)."""
    n = _weighted_both_ways(edges)
    at = labels.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    other = labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    each = n.join(at, "a").join(other, "b").groupBy("ca").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    total = each.agg(F.sum("k").alias("all"))
    return each.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.col("inside") / F.col("all") - resolution * F.pow(F.col("k") / F.col("all"), 2)), 9).alias("modularity"))


def _weighted_both_ways(edges: DataFrame) -> DataFrame:
    w = edges.where("a <> b and weight > 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    return w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def _moved(n: DataFrame, label: DataFrame, total: float, resolution: float, seed: int, rounds: int, patience: int) -> DataFrame:
    """Local moving from ``label`` (node, community, k: degree): ``node, community`` with the
    highest modularity that was met. In a round every node asks for the gain of each
    community around it; the half that a hash draws moves to the best, so that neighbours
    do not swap for ever. It ends when no node would gain, or when ``patience`` rounds
    brought nothing."""
    best, kept, idle = -2.0, label, 0
    for turn in range(rounds):
        sums = materialize(label.groupBy("community").agg(F.sum("k").alias("sum"), F.count("*").alias("size")))
        votes = n.join(label.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("w"))
        votes = votes.unionByName(label.select("node", "community", F.lit(0.0).alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
        asked = votes.join(sums, "community").join(label.select("node", F.col("community").alias("was"), "k"), "node")
        own = F.col("community") == F.col("was")
        gain = F.round((F.col("w") - resolution * F.col("k") * (F.col("sum") - F.when(own, F.col("k")).otherwise(0.0)) / total) / total, 12)
        found = asked.withColumn("gain", gain).groupBy("node", "was", "k").agg(
            F.min_by(F.struct("community", "size"), F.struct(-F.col("gain"), "community")).alias("to"), F.max("gain").alias("top"),
            F.max(F.when(own, F.col("gain"))).alias("stay"), F.max(F.when(own, F.col("w"))).alias("inside"), F.max(F.when(own, F.col("size"))).alias("size"),
        )
        # of two nodes alone that want each other, one stays
        wants = (F.col("top") > F.col("stay")) & ~((F.col("size") == 1) & (F.col("to.size") == 1) & (F.col("to.community") > F.col("was")))
        drawn = F.pmod(F.xxhash64("node", F.lit(seed), F.lit(turn)), F.lit(2)) == 0
        new = materialize(found.select("node", F.when(wants & drawn, F.col("to.community")).otherwise(F.col("was")).alias("community"), "k", "inside", wants.alias("wants")))
        state = new.agg(F.sum("inside").alias("inside"), F.count_if("wants").alias("wants")).crossJoin(sums.agg(F.sum(F.pow(F.col("sum") / total, 2)).alias("squares"))).first()
        q = state["inside"] / total - resolution * state["squares"]  # of the labels that the round began with
        best, kept, idle = (q, label, 0) if q > best + 1e-9 else (best, kept, idle + 1)
        if not state["wants"] or idle >= patience:
            break
        label = new.select("node", "community", "k")
    return kept.select("node", "community")


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 0, rounds: int = 60, patience: int = 4, levels: int = 32) -> DataFrame:
    """``node, community`` (its smallest node) by modularity: nodes move to the community of
    highest gain until nothing is gained, communities become the nodes of a smaller graph
    whose links sum up theirs, and so on until none merge; at last single nodes may move
    once more. Weighted; the hash that draws who may move depends on ``seed`` only, so a run
    can be repeated. All steps are joins and grouped sums; links within a community go on as
    its degree alone."""
    n = whole = materialize(_weighted_both_ways(edges))
    total = n.agg(F.sum("weight")).first()[0]
    degree = nodes = materialize(n.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k")))
    label = degree.select("node", F.col("node").alias("community"))
    if not total:
        return label
    many = degree.count()
    for level in range(levels):
        start = degree.select("node", F.col("node").alias("community"), "k")
        step = materialize(_moved(n, start, total, resolution, seed + level, rounds, patience))
        left = step.select("community").distinct().count()
        if left == many:
            break
        many, up = left, step.select(F.col("node").alias("community"), F.col("community").alias("up"))
        label = materialize(label.join(up, "community").select("node", F.col("up").alias("community")))
        to = [step.select(F.col("node").alias(e), F.col("community").alias(f"c{e}")) for e in "ab"]
        n = materialize(n.join(to[0], "a").join(to[1], "b").where("ca <> cb").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")))
        degree = materialize(degree.join(step, "node").groupBy(F.col("community").alias("node")).agg(F.sum("k").alias("k")))
    label = materialize(_moved(whole, label.join(nodes, "node"), total, resolution, seed + levels, rounds, patience))
    low = label.groupBy("community").agg(F.min("node").alias("low"))
    return label.join(low, "community").select("node", F.col("low").alias("community"))


def label_communities(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node, community`` by weighted label propagation: a node takes the label with most
    weight around it, the smallest of equal ones, and leaves its own for a better one only.
    Half of the nodes, drawn by a hash, may move in a round, so neighbours do not swap for
    ever; it ends when no node would move, and fails if that takes more than ``rounds``."""
    w = edges.select("a", "b", F.col("weight").cast("double"))
    n = materialize(w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    label = materialize(n.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct())
    for k in range(rounds):
        # labels are as many as nodes, so they are merged and never sent through the driver
        votes = n.join(label.hint("merge"), F.col("b") == F.col("node")).groupBy("a", "community").agg(F.sum("weight").alias("v"))
        best = votes.join(label.select(F.col("node").alias("a"), F.col("community").alias("was")).hint("merge"), "a").groupBy("a", "was").agg(
            F.min_by("community", F.struct(-F.col("v"), "community")).alias("best"), F.max("v").alias("top"), F.coalesce(F.max(F.when(F.col("community") == F.col("was"), F.col("v"))), F.lit(0.0)).alias("own")
        )
        moves = F.col("top") > F.col("own")
        turn = F.pmod(F.xxhash64("a", F.lit(k)), F.lit(2)) == 0
        new = materialize(best.select(F.col("a").alias("node"), F.when(moves & turn, F.col("best")).otherwise(F.col("was")).alias("community"), moves.alias("moves")))
        label = new.select("node", "community")
        if new.where("moves").isEmpty():
            return label
    raise RuntimeError(f"communities did not settle in {rounds} rounds")
