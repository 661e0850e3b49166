"""Loading discipline: keys, references, null rates, upserts, scopes, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest version of each key wins."""
    all_rows = old.unionByName(new)
    rest = [c for c in all_rows.columns if c not in keys]
    return all_rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*").select(*old.columns)


def split_new_rows(rows: DataFrame, existing: DataFrame, key: str, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted (new keys; of repeats the first by ``order``, without one by the row's text)
    and the number rejected."""
    fresh = rows.where(F.col(key).isNotNull()).join(existing.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    by = F.struct(*order) if order else F.to_json(F.struct(*rows.columns))
    fresh = fresh.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*rows.columns), by).alias("_r")).select("_r.*")
    counts = rows.agg(F.count("*").alias("read")).crossJoin(fresh.agg(F.count("*").alias("accepted")))
    return fresh, counts.select("read", "accepted", (F.col("read") - F.col("accepted")).alias("rejected"))


def dangling(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Values of a reference (as text) that the parent lacks, with their number."""
    p = parent.select(F.col(pk).cast("string").alias("_p"))
    c = child.where(F.col(fk).isNotNull()).select(F.col(fk).cast("string").alias("ref"))
    return c.join(p, F.col("ref") == F.col("_p"), "left_anti").groupBy("ref").agg(F.count("*").alias("n_rows"))


def null_rates(df: DataFrame) -> DataFrame:
    """``column, rate`` in one pass."""
    one = df.agg(*(F.round(F.avg(F.col(c).isNull().cast("double")), 4).alias(c) for c in df.columns))
    return one.unpivot([], list(df.columns), "column", "rate")


def best_by_priority(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def filtered(df: DataFrame, equal: dict | None = None, date: str | None = None, start=None, end=None) -> DataFrame:
    """Text equality on given columns, inclusive date bounds; what is not given is free."""
    out = reduce(lambda d, kv: d.where(F.col(kv[0]).cast("string") == str(kv[1])), (equal or {}).items(), df)
    if start is not None:
        out = out.where(F.to_date(date) >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.to_date(date) <= F.lit(end).cast("date"))
    return out


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def scoped(edges: DataFrame, evidence: str, owners: DataFrame, owner_key: str, owner: str, scope: str | None) -> DataFrame:
    """Edges whose evidence belongs to the caller's scope. No scope: nothing (fails closed)."""
    mine = owners.where(F.col(owner).cast("string") == F.lit(scope)).select(F.col(owner_key).alias("_k"))
    return edges.join(mine, F.col(evidence) == F.col("_k"), "left_semi")


def ancestors(units: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """``id, ancestor, steps, cycle``: self-joins that carry the path, level by level until no
    unit has a parent left; a parent already met ends the walk as a cycle, one that does
    not exist ends it without."""
    u = units.select(F.col(key).alias("id"), F.col(parent).alias("up"))
    hop = u.where("up is not null").select(F.col("id").alias("h"), F.col("up").alias("next"))
    known = u.select(F.col("id").alias("known"))
    hop = materialize(hop.join(known, F.col("next") == F.col("known"), "left_semi"))
    now = hop.select(F.col("h").alias("id"), F.col("next").alias("ancestor"), F.lit(1).alias("steps"), F.array("h", "next").alias("path"), (F.col("h") == F.col("next")).alias("cycle"))
    parts = [now]
    while True:
        nxt = parts[-1].where("not cycle").join(hop, F.col("ancestor") == F.col("h"))
        nxt = nxt.select("id", F.col("next").alias("ancestor"), (F.col("steps") + 1).alias("steps"), F.concat("path", F.array("next")).alias("path"), F.array_contains("path", F.col("next")).alias("cycle"))
        nxt = materialize(nxt)
        if nxt.isEmpty():
            return reduce(DataFrame.unionByName, parts).drop("path")
        parts.append(nxt)


def inherited(units: DataFrame, columns: list[str], key: str = "id", parent: str = "parent") -> DataFrame:
    """``key, columns, chain_length, cycle``: a value that a unit lacks is its nearest
    ancestor's that has one."""
    walk = ancestors(units, key, parent)
    up = walk.join(units.select(F.col(key).alias("_k"), *columns), F.col("ancestor") == F.col("_k"))
    near = up.groupBy(F.col("id").alias("_id")).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("steps"))).alias(f"_{c}") for c in columns), F.max(F.when(~F.col("cycle"), F.col("steps"))).alias("_n"), F.max("cycle").alias("_cycle"))
    j = units.join(near, units[key] == F.col("_id"), "left")
    return j.select(units[key], *(F.coalesce(units[c], F.col(f"_{c}")).alias(c) for c in columns), F.coalesce("_n", F.lit(0)).alias("chain_length"), F.coalesce("_cycle", F.lit(False)).alias("cycle"))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """A number for each row in a global order, in which no two rows may be equal. Rows are
    dealt by ranges of the order and numbered inside them; only the ranges' counts meet."""
    spark = df.sparkSession
    dealt = materialize(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.join(sizes.select(F.col("_part").alias("_p"), F.col("_n").alias("_m")), F.col("_p") < F.col("_part"), "left").groupBy("_part").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn(name, inside).join(F.broadcast(before), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("int")).select(*df.columns, name)


def districts_of_cases(arrests: DataFrame, cases: DataFrame, case: str, district: str) -> DataFrame:
    """``case, districts``: the distinct districts of the arrests of the asked cases, sorted;
    arrests without a district do not count, cases without any are absent."""
    asked = cases.select(F.col(case).alias("_case")).distinct()
    found = arrests.where(F.col(district).isNotNull()).join(asked, F.col(case) == F.col("_case"), "left_semi")
    return found.groupBy(case).agg(F.array_sort(F.collect_set(district)).alias("districts"))
