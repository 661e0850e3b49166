"""Connected components by contraction.

In each round a node goes to that node around it, or itself, which a hash puts first; links
between the nodes gone to are the next round's graph. The hash is another one each round, so
on average a share of the nodes disappears whatever their ids are, and finished components
have no links left: all rounds together cost a multiple of the first. A round is a grouped
minimum and two equi-joins of tables, so no neighbour list is ever gathered, and a hub with a
third of all links only makes a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize


def _first_around(links: DataFrame, turn: int) -> DataFrame:
    """``node, up``: of each node and its neighbours the one that the turn's hash puts first."""

    def place(node: str) -> Column:
        return F.xxhash64(node, F.lit(turn))

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min_by("b", place("b")).alias("b"))
    return first.select(F.col("a").alias("node"), F.when(place("b") < place("a"), F.col("b")).otherwise(F.col("a")).alias("up"))


def _contracted(links: DataFrame, ups: DataFrame) -> DataFrame:
    """The links between the nodes that the ends of links go to, once each."""
    a, b = (ups.select(F.col("node").alias(end), F.col("up").alias(f"up_{end}")) for end in "ab")
    return links.join(a, "a").join(b, "b").where("up_a <> up_b").select(F.greatest("up_a", "up_b").alias("a"), F.least("up_a", "up_b").alias("b")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node with an edge; component = smallest node id.

    Ids are longs. Null ends and self loops are ignored, repeated edges are merged.
    Nodes without an edge are absent: they are their own component. The result is a written
    table, so joins with it are planned by its size.
    """
    links = materialize(
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).cast("long").alias("a"), F.least(src, dst).cast("long").alias("b"))
        .distinct()
    )
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        rounds.append(materialize(_first_around(links, len(rounds))))
        links = materialize(_contracted(links, rounds[-1]))
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # from the last round back: where the nodes gone to in the first round have ended
    first, *later = rounds
    ends = later.pop() if later else first.where("false")
    while later:
        ends = _followed(later.pop(), ends)
    met = first.groupBy("up").agg(F.min("node").alias("low")).select(F.col("up").alias("node"), "up", "low")
    met = materialize(_followed(met, ends))
    low = materialize(met.groupBy("up").agg(F.min("low").alias("component")))
    met = met.join(low, "up").select(F.col("node").alias("up"), "component")
    return materialize(first.join(met, "up").select("node", "component"))


def _followed(ups: DataFrame, ends: DataFrame) -> DataFrame:
    """``ups`` with ``up`` replaced by where that node has ended; one without links stays."""
    end = ends.select(F.col("node").alias("up"), F.col("up").alias("end"))
    return ups.join(end, "up", "left").withColumn("up", F.coalesce("end", "up")).select(*ups.columns)
