"""Tables bucketed and sorted by a key, and the adjacency store built on them.

A lookup of a few keys reads only the buckets that they hash to, and in those only row groups
whose range can hold them. A join of a large set of keys on the bucketed side needs no
exchange of the table. Files lie in a given folder, the session's catalog holds the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_KEYS = 1000


def write_keyed(df: DataFrame, folder: str, key: str, buckets: int = 64) -> DataFrame:
    """``df`` as a table of ``buckets`` buckets by ``key``, read back. Rows of a key lie in
    one bucket; a hub's bucket is the larger for it, and its reads are split by files."""
    name = f"keyed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


def of_keys(table: DataFrame, key: str, keys: list) -> DataFrame:
    """Rows of at most ``MAX_KEYS`` given keys; other buckets are not read."""
    if len(keys) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys: join them")
    return table.where(F.col(key).isin(*keys)) if keys else table.where("false")


class Adjacency:
    """Edges (edge_id, src, dst, ...) by either end, each end a key."""

    def __init__(self, edges: DataFrame, folder: str, buckets: int = 64):
        self.columns = edges.columns
        ends = edges.withColumn("a", F.col("src")).withColumn("b", F.col("dst")).unionByName(edges.where("src <> dst").withColumn("a", F.col("dst")).withColumn("b", F.col("src")))
        self.ends = write_keyed(ends, folder, "a", buckets)

    @property
    def spark(self) -> SparkSession:
        return self.ends.sparkSession

    def around(self, nodes: list[str]) -> DataFrame:
        """``a, b, edge_id, ...`` of the links of these nodes, loops left out."""
        return of_keys(self.ends, "a", nodes).where("a <> b")

    def subgraph(self, seed: str, depth: int = 2, limit: int = 500) -> tuple[DataFrame, DataFrame]:
        """Nodes (node, depth, place) breadth-first from the seed, ``limit`` in all, in the order
        of their finders and edge ids, and the edges among them. As ``network.subgraph``
        finds them, but each level reads the buckets of its own nodes only: at most the limit's
        number of keys is ever asked for or held by the driver."""
        if not 1 <= limit <= MAX_KEYS:
            raise ValueError(f"limit is 1 to {MAX_KEYS}")
        seen, level = {seed: (0, 0)}, [seed]
        for k in range(depth):
            left = limit - len(seen)
            if not left or not level:
                break
            places = self.spark.createDataFrame([(n, seen[n][1]) for n in level], "a string, place int")
            found = self.around(level).join(F.broadcast(places), "a").where(~F.col("b").isin(*seen))
            first = found.groupBy("b").agg(F.min(F.struct("place", "edge_id")).alias("o")).orderBy("o", "b").limit(left)
            level = [r["b"] for r in first.collect()]  # the limit's number at most
            for n in level:
                seen[n] = (k + 1, len(seen))
        nodes = self.spark.createDataFrame([(n, d, p) for n, (d, p) in seen.items()], "node string, depth int, place int")
        among = of_keys(self.ends, "a", list(seen)).where(F.col("a") == F.col("src")).where(F.col("b").isin(*seen))
        return nodes, among.select(*self.columns)
