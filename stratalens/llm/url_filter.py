"""URL filters as a temporal list join, in DataFrame functions only.

A filter list is a log of dated entries that add or remove a pattern: a host (which covers
its subdomains) or a host with a path prefix. Entries become validity intervals by a
look-ahead over each pattern's distinct dates. A capture asks with its host, the host's
parent domains (an IP address has none) and its path prefixes, as long as the longest pattern
at most; dots at a host's end do not matter; an as-of equi-join on the pattern keeps the intervals that hold at the time of
fetching. A hot host only makes a skewed join key, which adaptive
execution splits; nothing is broadcast beyond what Spark's own size check allows.

Of entries of one pattern, list and instant, removal wins; repeated entries count once. An
entry holds from its instant on, up to the next entry's. Null urls, times and patterns match
nothing; such captures are kept unmatched. Repeated captures are kept. Extra columns of the
captures stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def host_of(url: F.Column) -> F.Column:
    """The lower-cased host, an IPv6 address with its brackets, without the dots of a rooted
    name at its end; an empty string where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)", 1)), r"\.+$", "")


def path_of(url: F.Column) -> F.Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def patterns_of(url: F.Column, labels: int, segments: int) -> F.Column:
    """What a capture asks for: its host, parent domains of two up to ``labels`` labels (an
    IP address has none), and the host with up to ``segments`` directories of the path."""
    host = host_of(url)
    names = F.split(host, r"\.")
    fewest, most = F.least(F.lit(2), F.size(names)), F.least(F.size(names), F.lit(max(labels, 2)))
    parents = F.transform(F.sequence(fewest, most), lambda n: F.array_join(F.slice(names, F.size(names) - n + 1, n), "."))
    hosts = F.when(host.rlike(r"^[0-9.]+$|^\["), F.array(host)).otherwise(F.array_union(F.array(host), parents))
    parts = F.slice(F.filter(F.split(path_of(url), "/"), lambda x: x != ""), 1, segments) if segments else F.array().cast("array<string>")
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.when(host != "", F.array_distinct(F.concat(hosts, F.coalesce(paths, F.array().cast("array<string>")))))


def intervals(entries: DataFrame, list_name: str = "list_name", pattern: str = "pattern", action: str = "action", at: str = "at") -> DataFrame:
    """``list_name, pattern, valid_from, valid_to``: half-open, ``valid_to`` null while
    the pattern stands. Equal dates are merged before the look-ahead, so what it sorts for
    a pattern is bounded by its distinct dates."""
    e = entries.where(F.col(pattern).isNotNull() & F.col(at).isNotNull() & F.col(action).isin("add", "remove"))
    e = e.groupBy(F.col(list_name).alias("list_name"), F.regexp_replace(F.lower(F.col(pattern)), r"^([^/]*[^/.])\.+(/|$)", "$1$2").alias("pattern"), F.col(at).alias("valid_from")).agg(F.max(F.col(action) == "remove").alias("gone"))
    w = Window.partitionBy("list_name", "pattern").orderBy("valid_from")
    return e.withColumn("valid_to", F.lead("valid_from").over(w)).where("not gone").select("list_name", "pattern", "valid_from", "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, key: str, url: str = "url", fetched: str = "fetched_at", **columns) -> DataFrame:
    """``captures`` with ``n_active`` (list and pattern pairs that hold), ``lists`` (their
    names, sorted, comma-joined) and ``blocked``. ``key`` names rows; rows with equal keys,
    urls and times are one question."""
    asked = captures.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(fetched).alias("t")).where(F.col("t").isNotNull()).distinct()
    spans = intervals(entries, **columns)
    # nothing longer than the longest pattern can match: two numbers bound what a long url asks
    host = F.substring_index("pattern", "/", 1)
    labels, segments = spans.agg(F.coalesce(F.max(F.size(F.split(host, r"\."))), F.lit(1)), F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0))).first()
    asked = asked.select("k", "u", "t", F.explode(patterns_of(F.col("u"), labels, segments)).alias("ask"))
    spans = spans.withColumn("pattern", F.concat("pattern", F.lit("")))
    met = asked.join(spans, (F.lower("ask") == F.col("pattern")) & (F.col("t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to"))))
    found = met.groupBy("k", "u", "t").agg(F.countDistinct("list_name", "pattern").alias("n"), F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("l"))
    same = F.col(key).eqNullSafe(F.col("k")) & (F.col(url) == F.col("u")) & (F.col(fetched) == F.col("t"))
    joined = captures.join(found, same, "left")
    return joined.select(*(captures[c] for c in captures.columns), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.coalesce("l", F.lit("")).alias("lists"), F.col("n").isNotNull().alias("blocked"))
