"""The analytics operators bound to the relational tables, with their SQL twins.

Every query reads whole tables; limits stand only where a page or a top list is the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import exprs as X
from ..operators import anomalies, association, attributes, components, forest, identity, network, regression, series, space, substring, tables as T
from ..session import materialize, own_dir
from ..sources import keyed
from ..sources.files import read_range, recent_rows, time_range, write_by_month

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """Orders with customer, nation and region: the star lookup the group queries share.
    Spark broadcasts the dimensions where their size allows."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")


STAR = "orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"


@query(f"""SELECT l_orderkey, l_linenumber, o_orderstatus, c_mktsegment, n_name, r_name, p_brand, s_name, l_quantity
FROM lineitem LEFT JOIN ({'SELECT * FROM ' + STAR}) ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def enriched_lookup_join(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    j = table(spark, d, "lineitem").join(enriched(spark, d), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_mktsegment", "n_name", "r_name", "p_brand", "s_name", "l_quantity")


PAGE = f"FROM {STAR} WHERE CAST(c_nationkey AS VARCHAR) = '7' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"


def _page(spark, d):
    return T.filtered(enriched(spark, d), {"c_nationkey": 7}, "o_orderdate", "1996-01-01", "1999-12-31")


@query(f"SELECT o_orderkey, o_orderstatus, n_name, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS ordered {PAGE} ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def filtered_page(spark, d):
    return T.page(_page(spark, d), ["o_orderkey"], 50, 25).select("o_orderkey", "o_orderstatus", "n_name", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("ordered"))


@query(f"SELECT count(*) AS n {PAGE}")
def filtered_count(spark, d):
    return _page(spark, d).agg(F.count("*").alias("n"))


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def time_range_scan(spark, d):
    return time_range(table(spark, d, "events"), "ts", "2024-01-05", "2024-01-12").select("event_id", "ts", "user_id", "event_type")


AGO = "(SELECT *, date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS ago"


@query(f"""SELECT n_name, n_rows, recent, prior, round(recent / nullif(prior, 0), 2) AS velocity FROM (
SELECT n_name, count(*) AS n_rows, CAST(sum(CAST(ago < 180 AS INT)) AS BIGINT) AS recent, CAST(sum(CAST(ago >= 180 AND ago < 360 AS INT)) AS BIGINT) AS prior FROM {AGO} FROM {STAR}) GROUP BY n_name)""")
def group_velocity(spark, d):
    return series.group_velocity(enriched(spark, d), ["n_name"], "o_orderdate", 180)


@query(f"SELECT n_name, count(*) AS n FROM {STAR} WHERE n_name IS NOT NULL GROUP BY 1")
def overview_by_group(spark, d):
    return enriched(spark, d).where("n_name is not null").groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT coalesce(o_orderstatus, 'Unknown') AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.coalesce("o_orderstatus", F.lit("Unknown")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(p_type, 'Unknown') AS kind, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, kind LIMIT 10")
def top10_types(spark, d):
    return table(spark, d, "part").groupBy(F.coalesce("p_type", F.lit("Unknown")).alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(10)


@query("""SELECT CASE WHEN p_size BETWEEN 0 AND 17 THEN '0-17' WHEN p_size <= 25 THEN '18-25' WHEN p_size <= 35 THEN '26-35' WHEN p_size <= 45 THEN '36-45' WHEN p_size <= 60 THEN '46-60' WHEN p_size <= 200 THEN '61+' ELSE 'Unknown' END AS band, count(*) AS n FROM part GROUP BY 1""")
def size_bands(spark, d):
    return table(spark, d, "part").groupBy(X.band(F.col("p_size")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, round(avg(o_totalprice), 4) AS mean_price, count(DISTINCT o_custkey) AS customers, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders")
def dataset_summary(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.countDistinct("o_custkey").alias("customers"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@query(f"SELECT c_mktsegment, n_name, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, min(c_name) AS first_name FROM {STAR} GROUP BY 1, 2")
def ranked_entities(spark, d):
    return enriched(spark, d).groupBy("c_mktsegment", "n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.min("c_name").alias("first_name"))


@query("SELECT c.c_custkey, count(*) AS others FROM customer c JOIN customer o ON c.c_nationkey IS NOT DISTINCT FROM o.c_nationkey AND c.c_mktsegment IS NOT DISTINCT FROM o.c_mktsegment AND c.c_custkey <> o.c_custkey GROUP BY 1")
def entity_other_records(spark, d):
    """How many other records share the attributes, nulls included: group sizes, not pairs."""
    c = table(spark, d, "customer")
    g = c.groupBy(F.col("c_nationkey").alias("gn"), F.col("c_mktsegment").alias("gs")).agg((F.count("*") - 1).alias("others"))
    return c.join(g, F.col("c_nationkey").eqNullSafe(F.col("gn")) & F.col("c_mktsegment").eqNullSafe(F.col("gs"))).where("others > 0").select("c_custkey", "others")


DENSE = """w AS (SELECT o_orderpriority AS k, ago // 7 AS w FROM (SELECT o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS ago FROM orders)),
s AS (SELECT k, r.w, count(x.w) AS n FROM (SELECT DISTINCT k FROM w WHERE w < 10) CROSS JOIN range(10) r(w) LEFT JOIN w x USING (k, w) GROUP BY 1, 2)"""


@query(f"WITH {DENSE} SELECT k AS o_orderpriority, CAST(w AS INT) AS week, n FROM s")
def dense_weekly_series(spark, d):
    s = series.dense_counts(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", 7, 10)
    return s.select("o_orderpriority", F.posexplode("counts").alias("week", "n"))


TREND = f"""WITH {DENSE},
m AS (SELECT k, sum(n) FILTER (w < 2) AS recent_total, median(n) FILTER (w >= 2) AS med FROM s GROUP BY k),
d AS (SELECT k, median(abs(n - med)) AS mad FROM s JOIN m USING (k) WHERE w >= 2 GROUP BY k),
z AS (SELECT k, recent_total, med, mad, round((recent_total / 2 - med) / greatest(1.4826 * mad, 1.0), 2) AS z FROM m JOIN d USING (k))
SELECT k AS o_orderpriority, CAST(recent_total AS BIGINT) AS recent_total, med AS median, mad, z, round((recent_total / 2 - med) / nullif(med, 0) * 100, 1) AS pct_change,
CASE WHEN z >= 5 THEN 'critical' WHEN z >= 3.5 THEN 'serious' WHEN z >= 2.5 THEN 'warning' END AS severity FROM z WHERE recent_total >= 5 AND z >= -5.0"""


def _trends(spark, d):
    return series.trend_alerts(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", min_z=-5.0).drop("weekly")


@query(TREND)
def weekly_trend_alerts(spark, d):
    return _trends(spark, d)


@query(f"SELECT coalesce(severity, 'none') AS severity, count(*) AS n FROM ({TREND}) GROUP BY 1")
def severity_tally(spark, d):
    return _trends(spark, d).groupBy(F.coalesce("severity", F.lit("none")).alias("severity")).agg(F.count("*").alias("n"))


FEATURES = f"""WITH a AS (SELECT n_name, ago // 30 AS w FROM {AGO} FROM {STAR}) WHERE n_name IS NOT NULL),
g AS (SELECT n_name, r.w, count(a.w) AS n FROM (SELECT DISTINCT n_name FROM a) CROSS JOIN range((SELECT max(w) + 1 FROM a)) r(w) LEFT JOIN a USING (n_name, w) GROUP BY 1, 2),
f AS (SELECT n_name, w, n AS recent, lead(n, 1, 0) OVER o AS prior, lead(n, 2, 0) OVER o AS prior2, lag(n) OVER o AS target FROM g WINDOW o AS (PARTITION BY n_name ORDER BY w)),
feat AS (SELECT n_name, CAST(w AS INT) AS w, recent, prior, prior2, round(recent / greatest(prior, 1), 3) AS velocity, round((recent + prior + prior2) / 3, 3) AS rolling_mean_3, round((recent - prior2) / 2, 3) AS trend_slope,
CAST(month((SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - CAST((w - 1) * 30 AS INT)) AS INT) AS month, target FROM f)"""


def _features(spark, d):
    return series.window_features(enriched(spark, d).where("n_name is not null"), ["n_name"], "o_orderdate")


@query(f"{FEATURES} SELECT * EXCLUDE (w, target) FROM feat WHERE w = 0")
def lag_window_features(spark, d):
    return _features(spark, d).where("w = 0").drop("w", "target")


@query(f"{FEATURES} SELECT * FROM feat WHERE w >= 1 AND w <= (SELECT max(w) - 2 FROM feat)")
def training_rows(spark, d):
    f = _features(spark, d)
    last = f.agg(F.max("w").alias("last"))
    return f.crossJoin(F.broadcast(last)).where("w >= 1 and w <= last - 2").drop("last")


@query(f"""{FEATURES} SELECT n_name, rolling_mean_3 AS expected, CASE WHEN rolling_mean_3 >= hi THEN 'high' WHEN rolling_mean_3 >= lo THEN 'medium' ELSE 'low' END AS level
FROM feat, (SELECT quantile_cont(rolling_mean_3, 1.0/3) AS lo, quantile_cont(rolling_mean_3, 2.0/3) AS hi FROM feat WHERE w = 0) WHERE w = 0""")
def risk_tertiles(spark, d):
    return series.forecast(_features(spark, d), lambda f: f.withColumn("expected", F.col("rolling_mean_3"))).select("n_name", "expected", "level")


@query(f"""{FEATURES}, t AS (SELECT * FROM feat WHERE w >= 1 AND w <= (SELECT max(w) - 2 FROM feat) AND target IS NOT NULL),
v AS (SELECT avg(recent) AS m1, avg(prior) AS m2, avg(target) AS my, var_pop(recent) AS s11, var_pop(prior) AS s22, covar_pop(recent, prior) AS s12, covar_pop(recent, target) AS s1, covar_pop(prior, target) AS s2 FROM t),
b AS (SELECT m1, m2, my, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2 FROM v),
e AS (SELECT n_name, round(greatest(my + b1 * (recent - m1) + b2 * (prior - m2), 0), 4) AS expected FROM feat, b WHERE w = 0)
SELECT n_name, expected, CASE WHEN expected >= hi THEN 'high' WHEN expected >= lo THEN 'medium' ELSE 'low' END AS level, true AS available
FROM e, (SELECT quantile_cont(expected, 1.0/3) AS lo, quantile_cont(expected, 2.0/3) AS hi FROM e)""")
def risk_model_forecast(spark, d):
    """Least squares over all training windows, then the forecast of the newest window."""
    model = regression.fit(training_rows(spark, d), ["recent", "prior"], "target")
    expected = lambda f: regression.predictor(model)(f).withColumn("expected", F.round("expected", 4))
    return series.forecast(_features(spark, d), expected).select("n_name", "expected", "level", "available")


@query("""WITH l AS (SELECT o_orderkey, any_value(o_orderpriority) AS p, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
m AS (SELECT p, median(lines) AS med, count(*) AS n FROM l GROUP BY 1), a AS (SELECT p, median(abs(lines - med)) AS mad FROM l JOIN m USING (p) GROUP BY 1)
SELECT o_orderkey, p AS o_orderpriority, lines, round((lines - med) / greatest(1.4826 * mad, 1.0), 4) AS z FROM l JOIN m USING (p) JOIN a USING (p) WHERE n >= 10 AND round((lines - med) / greatest(1.4826 * mad, 1.0), 4) >= 1.5""")
def robust_count_outliers(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    o = table(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderpriority", F.coalesce("lines", F.lit(0)).alias("lines"))
    return series.count_outliers(o, "o_orderpriority", "lines", min_score=1.5).select("o_orderkey", "o_orderpriority", "lines", "z")


@query("""WITH e AS (SELECT event_id, event_type, hour(ts) AS h FROM events),
m AS (SELECT event_type, count(*) AS n, atan2(round(avg(sin(h * (2 * 3.141592653589793 / 24))), 9), round(avg(cos(h * (2 * 3.141592653589793 / 24))), 9)) * (24 / (2 * 3.141592653589793)) AS t FROM e GROUP BY 1),
c AS (SELECT event_type, n, round(CASE WHEN t < 0 THEN t + 24 ELSE t END, 6) AS centre FROM m),
x AS (SELECT event_id, event_type, h, n, centre, least(abs(h - centre), 24 - abs(h - centre)) AS distance FROM e JOIN c USING (event_type)),
a AS (SELECT event_type, median(distance) AS mad FROM x GROUP BY 1)
SELECT event_id, event_type, CAST(h AS INT) AS hour, centre, round(distance / greatest(1.4826 * mad, 1.5), 4) AS score FROM x JOIN a USING (event_type) WHERE n >= 8 AND round(distance / greatest(1.4826 * mad, 1.5), 4) >= 1.2""")
def circular_hour_outliers(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.hour("ts").alias("hour"))
    return series.hour_outliers(e, "event_type", "hour", min_score=1.2).select("event_id", "event_type", "hour", "centre", "score")


@query("""WITH p AS (SELECT c_nationkey, c_mktsegment, count(*) AS observed FROM customer GROUP BY 1, 2), t AS (SELECT c_nationkey, sum(observed) AS total FROM p GROUP BY 1), k AS (SELECT c_mktsegment, sum(observed) / (SELECT count(*) FROM customer) AS share FROM p GROUP BY 1)
SELECT c_nationkey, c_mktsegment, observed, round(total * share, 4) AS expected, round((total * share - observed) / sqrt(total * share), 4) AS z FROM p JOIN t USING (c_nationkey) JOIN k USING (c_mktsegment) WHERE total >= 20 AND share >= 0.01 AND total * share >= 3 AND observed <= 0.8 * total * share""")
def rare_pair(spark, d):
    return series.rare_pairs(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", at_most=0.8)


@query("""WITH s AS (SELECT event_type, round(avg(CAST(hour(ts) IN (21, 22, 23, 0, 1, 2) AS INT)), 3) AS night_share FROM events GROUP BY 1)
SELECT event_type, CAST(hour(ts) AS INT) AS hour, count(*) AS n, any_value(night_share) AS night_share FROM events JOIN s USING (event_type) GROUP BY 1, 2""")
def hour_histogram_share(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.hour("ts"))
    g = e.groupBy("event_type").agg(F.round(F.avg(F.col("hour").isin(21, 22, 23, 0, 1, 2).cast("int")), 3).alias("night_share"), F.array(*(F.sum((F.col("hour") == h).cast("long")) for h in range(24))).alias("h"))
    return g.select("event_type", "night_share", F.posexplode("h").alias("hour", "n")).where("n > 0").select("event_type", "hour", "n", "night_share")


@query("""SELECT c_nationkey, min(c_mktsegment) FILTER (n = top) AS modal, min_by(c_mktsegment, first) FILTER (n = top) AS first_top FROM (SELECT *, max(n) OVER (PARTITION BY c_nationkey) AS top FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1, 2)) GROUP BY 1""")
def mode_and_top(spark, d):
    """The smallest of the commonest values, and the one met first in key order."""
    g = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))
    return g.groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct(-F.col("n"), "c_mktsegment")).alias("modal"), F.min_by("c_mktsegment", F.struct(-F.col("n"), "first")).alias("first_top"))


def _points(spark, d):
    """The tables have no coordinates: key and nation give them, dense in the middle."""
    k = F.col("c_custkey")
    spread = ((k % 7) + 1) / F.lit(7.0)
    return table(spark, d, "customer").select(k.alias("id"), (F.lit(12.0) + F.col("c_nationkey") * 0.1 + ((k * 37) % 101 - 50) / F.lit(5000.0) * spread * spread).alias("lat"), (F.lit(77.0) + F.col("c_nationkey") * 0.1 + ((k * 91) % 103 - 51) / F.lit(5000.0) * spread * spread).alias("lon"), F.col("c_mktsegment").alias("kind"))


POINTS = """p AS (SELECT c_custkey AS id, 12.0::DOUBLE + c_nationkey * 0.1::DOUBLE + ((c_custkey * 37) % 101 - 50) / 5000.0::DOUBLE * (((c_custkey % 7) + 1) / 7.0::DOUBLE) * (((c_custkey % 7) + 1) / 7.0::DOUBLE) AS lat, 77.0::DOUBLE + c_nationkey * 0.1::DOUBLE + ((c_custkey * 91) % 103 - 51) / 5000.0::DOUBLE * (((c_custkey % 7) + 1) / 7.0::DOUBLE) * (((c_custkey % 7) + 1) / 7.0::DOUBLE) AS lon, c_mktsegment AS kind FROM customer)"""
HAV = "2 * 6371000.0 * asin(sqrt(least(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2), 1.0)))"
NEAR = f"{POINTS}, n AS (SELECT a.id AS a, b.id AS b, {HAV.format(a='a.', b='b.')} AS m FROM p a, p b WHERE a.id <> b.id AND abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.02)"


@query(f"WITH {NEAR} SELECT a, b, round(m, 3) AS metres FROM n WHERE a < b AND m <= 150")
def haversine_pairs(spark, d):
    return space.close_pairs(_points(spark, d), 150, digits=3)


@query(f"""WITH RECURSIVE {NEAR}, e AS (SELECT a, b FROM n WHERE m <= 250), core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) + 1 >= 8),
r(id, c) AS (SELECT id, id FROM core UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a JOIN core ON core.id = e.b),
l AS (SELECT id, min(c) AS cluster FROM r GROUP BY id),
al AS (SELECT * FROM l UNION ALL SELECT e.a, min(l.cluster) FROM e JOIN l ON e.b = l.id WHERE e.a NOT IN (SELECT id FROM core) GROUP BY e.a),
c AS (SELECT cluster, count(*) AS n_points, avg(lat) AS lat, avg(lon) AS lon FROM al JOIN p USING (id) GROUP BY 1),
k AS (SELECT cluster, kind, count(*) AS n FROM al JOIN p USING (id) GROUP BY 1, 2)
SELECT cluster, n_points, round(any_value(c.lat), 6) AS lat, round(any_value(c.lon), 6) AS lon, round(max({HAV.format(a='p.', b='c.')}), 1) AS radius_m, (SELECT kind FROM k WHERE k.cluster = c.cluster ORDER BY n DESC, kind LIMIT 1) AS top_kind
FROM c JOIN al USING (cluster) JOIN p USING (id) GROUP BY cluster, n_points""")
def hotspot_clusters(spark, d):
    p = _points(spark, d)
    return space.cluster_summary(p, space.density_clusters(p, 250, 8), "kind")


CO = """i AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS m FROM lineitem), ok AS (SELECT g FROM i GROUP BY g HAVING count(*) BETWEEN 2 AND 20),
e AS (SELECT a.m AS a, b.m AS b, count(*) AS weight FROM i a JOIN i b USING (g) JOIN ok USING (g) WHERE a.m < b.m GROUP BY 1, 2)"""


def _edges(spark, d):
    return network.cooccurrence(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("WITH i AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS m FROM lineitem), ok AS (SELECT g FROM i GROUP BY g HAVING count(*) BETWEEN 2 AND 20) SELECT a.m AS a, b.m AS b, count(*) AS weight FROM i a JOIN i b USING (g) JOIN ok USING (g) WHERE a.m < b.m GROUP BY 1, 2")
def cooccurrence_edges(spark, d):
    return network.cooccurrence(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS members FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 9")
def cooccurrence_over_cap(spark, d):
    return network.over_cap(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 9)


@query(f"WITH {CO}, n AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT a AS node, count(*) AS degree, round(count(*) / greatest((SELECT count(DISTINCT a) FROM n) - 1, 1), 6) AS centrality FROM n GROUP BY a")
def degree_centrality(spark, d):
    return network.degrees(_edges(spark, d))


@query(f"""WITH {CO}, n AS (SELECT a, b FROM e UNION SELECT b, a FROM e), g AS (SELECT a, count(*) AS d FROM n GROUP BY a),
s AS (SELECT e.a, e.b, count(*) AS k FROM e JOIN n x ON e.a = x.a JOIN n y ON e.b = y.a AND x.b = y.b GROUP BY 1, 2)
SELECT e.a, e.b, round(coalesce(k, 0) / (ga.d + gb.d - coalesce(k, 0)), 6) AS jaccard FROM e LEFT JOIN s ON e.a = s.a AND e.b = s.b JOIN g ga ON ga.a = e.a JOIN g gb ON gb.a = e.b""")
def neighbour_jaccard(spark, d):
    return network.jaccard(_edges(spark, d))


# The tables hold no sparse graph with cycles; customers' keys give one: blocks of 40 keys,
# each a path with chords.
BLOCKS = """e AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 40 <> 39
  UNION ALL SELECT c_custkey, c_custkey + 7 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 40 < 33),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""


def _blocks(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("a"))
    path = c.where("a % 40 <> 39").withColumn("b", F.col("a") + 1)
    return path.unionByName(c.where("a % 5 = 0 and a % 40 < 33").withColumn("b", F.col("a") + 7))


@query(f"WITH RECURSIVE {BLOCKS}, r(node, c) AS (SELECT a, a FROM n UNION SELECT n.b, r.c FROM r JOIN n ON r.node = n.a) SELECT node, min(c) AS component FROM r GROUP BY node")
def connected_components(spark, d):
    return components.connected_components(_blocks(spark, d), "a", "b")


@query(f"""WITH RECURSIVE {BLOCKS}, r(node, k) AS (SELECT 10::BIGINT, 0 UNION SELECT n.b, k + 1 FROM r JOIN n ON r.node = n.a WHERE k < 2)
SELECT node, CAST(min(k) AS INT) AS depth FROM r GROUP BY node""")
def bfs_depth2(spark, d):
    return network.within_steps(_blocks(spark, d), 10, 2)


@query("""SELECT DISTINCT 'CASE:' || o_orderkey AS node_id, 'CASE' AS node_type FROM orders UNION ALL SELECT 'PERSON:' || c_custkey, 'PERSON' FROM customer UNION ALL SELECT 'AREA:' || n_nationkey, 'AREA' FROM nation""")
def graph_projection_nodes(spark, d):
    kinds = (("CASE", "orders", "o_orderkey"), ("PERSON", "customer", "c_custkey"), ("AREA", "nation", "n_nationkey"))
    parts = [table(spark, d, t).select(F.concat(F.lit(f"{k}:"), F.col(c).cast("string")).alias("node_id"), F.lit(k).alias("node_type")).dropDuplicates(["node_id"]) for k, t, c in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT 'INVOLVES|CASE:' || o_orderkey || '|PERSON:' || o_custkey || '|' || o_orderkey AS edge_id, 'INVOLVES' AS rel FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'LIVES_IN|PERSON:' || c_custkey || '|AREA:' || c_nationkey || '|' || c_custkey, 'LIVES_IN' FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def graph_projection_edges(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    ref = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    a = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(X.composite_id(F.lit("INVOLVES"), ref("CASE", "o_orderkey"), ref("PERSON", "o_custkey"), F.col("o_orderkey").cast("string")).alias("edge_id"), F.lit("INVOLVES").alias("rel"))
    b = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(X.composite_id(F.lit("LIVES_IN"), ref("PERSON", "c_custkey"), ref("AREA", "c_nationkey"), F.col("c_custkey").cast("string")).alias("edge_id"), F.lit("LIVES_IN").alias("rel"))
    return a.unionByName(b)


@query("SELECT CAST(doc_id AS VARCHAR) AS ref, count(*) AS n_rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def dangling_counts(spark, d):
    return T.dangling(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id")


# A caller's lexicon over product names; precedence decides before length.
COLOURS = [("red", "warm", 1, 0.7), ("rust", "warm", 2, 0.8), ("blue", "cold", 1, 0.7), ("steel", "metal", 3, 0.9), ("gold", "metal", 3, 0.9), ("small", "size", 1, 0.6), ("large", "size", 1, 0.6), ("a", "letter", 0, 0.5)]


@query("SELECT p_partkey, CASE WHEN e IS NULL THEN 'UNKNOWN' ELSE e.v END AS value, CASE WHEN e IS NULL THEN 0.5 ELSE e.s END AS confidence, CASE WHEN e IS NOT NULL THEN CAST(strpos(lower(trim(p_name)), e.w) - 1 AS INT) END AS at FROM (SELECT p_partkey, p_name, list_max(list_filter([" + ", ".join(f"{{'p': {p}, 'l': {len(w)}, 's': {s}::DOUBLE, 'o': {-i}, 'w': '{w}', 'v': '{v}'}}" for i, (w, v, p, s) in enumerate(COLOURS)) + "], lambda x: contains(lower(trim(p_name)), x.w))) AS e FROM part WHERE length(trim(p_name)) >= 3)")
def lexicon_extract(spark, d):
    got = attributes.extract(table(spark, d, "part"), "p_name", {"colour": COLOURS}, min_chars=3)
    return got.select("p_partkey", F.col("colour.value").alias("value"), F.col("colour.confidence").alias("confidence"), F.col("colour.start").alias("at"))


@query("""WITH a AS (SELECT p_partkey, p_brand, p_type, coalesce(CASE WHEN p_size <= 17 THEN 'small' WHEN p_size <= 35 THEN 'mid' ELSE 'big' END, 'UNKNOWN') AS s FROM part), t AS (SELECT * FROM a WHERE p_partkey = 1),
m AS (SELECT a.p_partkey, CAST(a.p_brand = t.p_brand AS INT) AS b, CAST(a.p_type = t.p_type AS INT) AS y, CAST(a.s = t.s AS INT) AS z FROM a, t WHERE a.p_partkey <> 1)
SELECT p_partkey, b + y + z AS matched, round((b * 1.0 + y * 1.6 + z * 0.8) / 3.4, 4) AS score FROM m WHERE b + y + z >= 2 AND round((b * 1.0 + y * 1.6 + z * 0.8) / 3.4, 4) >= 0.35""")
def attribute_similarity(spark, d):
    s = F.coalesce(F.when(F.col("p_size") <= 17, "small").when(F.col("p_size") <= 35, "mid").otherwise("big"), F.lit("UNKNOWN"))
    a = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", s.alias("s"))
    return attributes.similar_to(a, a.where("p_partkey = 1"), {"p_brand": 1.0, "p_type": 1.6, "s": 0.8}, "p_partkey")


@query("SELECT doc_id, lang, substr(text, 1, 160) AS preview FROM documents WHERE lang = 'en' AND (contains(CAST(doc_id AS VARCHAR), 'mit') OR contains(lower(text), 'license')) ORDER BY doc_id LIMIT 20 OFFSET 5")
def text_search_page(spark, d):
    hit = F.contains(F.col("doc_id").cast("string"), F.lit("mit")) | F.contains(F.lower("text"), F.lit("license"))
    return T.page(table(spark, d, "documents").where((F.col("lang") == "en") & hit), ["doc_id"], 5, 20).select("doc_id", "lang", F.substring("text", 1, 160).alias("preview"))


@query("SELECT page_id, nullif(regexp_extract(url, '^([a-z]+)://', 1), '') AS scheme, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number FROM pages")
def regex_extract(spark, d):
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("/([0-9]+)").try_cast("long").alias("number"))


@query("SELECT 'customer' AS role, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def union_roles(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("role"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("role"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("SELECT * FROM (SELECT round(avg(CAST(d.doc_id IS NULL AS INT)), 4) AS doc_id, round(avg(CAST(quality IS NULL AS INT)), 4) AS quality, round(avg(CAST(toxic IS NULL AS INT)), 4) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) UNPIVOT (rate FOR \"column\" IN (doc_id, quality, toxic))")
def null_and_unknown_rates(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")
    return T.null_rates(j)


@query("SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role, arg_min(text, turn) AS text FROM conversations GROUP BY 1")
def dedupe_first_wins(spark, d):
    return T.keep_first(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"])


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def upsert_latest(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return T.upsert(c.where("role = 'user'"), c.where("not role <=> 'user'"), ["conv_id"], "turn")


@query("SELECT o_custkey, arg_min(o_orderkey, row(o_orderpriority, -o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def argmin_priority(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return T.best_by_priority(o, ["o_custkey"], [F.col("o_orderpriority"), -F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def scope_filter(spark, d):
    return T.scoped(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer"), "c_custkey", "c_nationkey", "3")


@query("WITH RECURSIVE u AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'world', NULL), r AS (SELECT id, parent AS ancestor, 1 AS steps FROM u WHERE parent IS NOT NULL UNION ALL SELECT r.id, u.parent, steps + 1 FROM r JOIN u ON r.ancestor = u.id WHERE u.parent IS NOT NULL) SELECT id, ancestor, steps, false AS cycle FROM r")
def hierarchy_walk(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("world").alias("parent"))
    top = spark.range(1).select(F.lit("world").alias("id"), F.lit(None).cast("string").alias("parent"))
    return T.ancestors(n.unionByName(r).unionByName(top))


def _people(spark, d):
    """Distinct product names stand for person names, sizes for ages."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("age"), F.substring("p_type", 1, 1).alias("gender"))


# Ratcliff-Obershelp in SQL: parts of two words are halved around their longest common run.
LONGEST = "list_max(list_filter(flatten([[{'n': k, 'at': -i} for k in range(1, len(a) - i + 2)] for i in range(1, len(a) + 1)]), lambda r: contains(b, substr(a, -r.at, r.n))))"
RATIO = f"""seg(t, u, a, b) AS (SELECT t, u, t, u FROM asked UNION ALL
  SELECT t, u, p.a, p.b FROM (SELECT t, u, unnest([{{'a': substr(a, 1, -m.at - 1), 'b': substr(b, 1, strpos(b, substr(a, -m.at, m.n)) - 1)}}, {{'a': substr(a, -m.at + m.n), 'b': substr(b, strpos(b, substr(a, -m.at, m.n)) + m.n)}}]) AS p
    FROM (SELECT *, {LONGEST} AS m FROM seg) WHERE m IS NOT NULL) WHERE p.a <> '' AND p.b <> ''),
ratio AS (SELECT t, u, 2.0::DOUBLE * coalesce(sum(m.n), 0) / (len(t) + len(u)) AS r FROM (SELECT t, u, {LONGEST} AS m FROM seg) GROUP BY t, u)"""
PEOPLE = "SELECT p_partkey AS id, p_name AS name, CAST(p_size AS INT) AS age, substr(p_type, 1, 1) AS gender, list_filter(string_split(regexp_replace(lower(p_name), '[^a-z ]', ' ', 'g'), ' '), lambda x: x <> '') AS ts FROM part"


@query(f"""WITH RECURSIVE one AS (SELECT min(id) AS id, age, gender, ts FROM ({PEOPLE}) GROUP BY name, age, gender, ts),
p AS (SELECT *, array_to_string(ts, ' ') AS clean, ts[1] AS f FROM one WHERE gender IS NOT NULL AND len(ts) > 0),
names AS (SELECT DISTINCT gender, f, clean, ts FROM p),
pairs AS (SELECT DISTINCT a.f, a.clean AS c1, b.clean AS c2, a.ts[2:] AS x, b.ts[2:] AS y FROM names a JOIN names b USING (gender, f) WHERE a.clean <= b.clean),
sides AS (SELECT c1, c2, x, y FROM pairs UNION ALL SELECT c1, c2, y, x FROM pairs),
asked AS (SELECT DISTINCT t, u FROM (SELECT t, unnest(y) AS u FROM (SELECT unnest(x) AS t, y FROM sides)) WHERE len(t) > 1),
{RATIO},
tm AS (SELECT t, u, CASE WHEN t = u THEN 1.0 WHEN starts_with(t, u) OR starts_with(u, t) THEN CASE WHEN least(len(t), len(u)) = 1 THEN 0.85 ELSE 0.8 END ELSE r END AS s FROM ratio),
best AS (SELECT c1, c2, side, t, max(coalesce(s, 0)) AS s FROM (SELECT c1, c2, x, side, t, unnest(CASE WHEN y = [] THEN [NULL] ELSE y END) AS u FROM (SELECT c1, c2, x, y, x = b.x AS side, unnest(x) AS t FROM sides b) WHERE len(t) > 1) LEFT JOIN tm USING (t, u) GROUP BY ALL),
alike AS (SELECT pairs.c1, pairs.c2, CASE WHEN pairs.c1 = pairs.c2 OR count(s) = 0 THEN 1.0 WHEN min(s) < 0.8 THEN 0.3 ELSE 0.5 + 0.5 * avg(s) END AS s FROM pairs LEFT JOIN best USING (c1, c2) GROUP BY 1, 2),
j AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, abs(a.age - b.age) AS gap, alike.s FROM alike JOIN p a ON a.clean = c1 JOIN p b ON b.clean = c2 AND a.gender = b.gender WHERE alike.s >= 0.82 AND (c1 <> c2 OR a.id < b.id)),
e AS (SELECT DISTINCT a, b, score FROM (SELECT a, b, gap, round(0.65 * s + 0.35 * CASE WHEN gap IS NULL THEN 0.5 WHEN gap <= 1 THEN 1.0 WHEN gap <= 3 THEN 0.85 WHEN gap <= 6 THEN 0.6 WHEN gap <= 10 THEN 0.3 ELSE 0 END, 4) AS score FROM j) WHERE score >= 0.72 AND (gap IS NULL OR gap <= 8)),
near AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, c) AS (SELECT a, a FROM near UNION SELECT near.b, reach.c FROM reach JOIN near ON reach.id = near.a),
m AS (SELECT id, min(c) AS comp, any_value(age) AS age FROM reach JOIN one USING (id) GROUP BY id),
bands(comp, band, f) AS (SELECT comp, 0, min(age) FROM m WHERE age IS NOT NULL GROUP BY comp UNION ALL SELECT bands.comp, band + 1, min(m.age) FROM bands JOIN m ON m.comp = bands.comp AND m.age > f + 10 GROUP BY 1, 2),
banded AS (SELECT m.id, m.comp, coalesce(max(band), 0) AS band FROM m LEFT JOIN bands ON bands.comp = m.comp AND (m.age IS NULL OR f <= m.age) GROUP BY 1, 2),
conf AS (SELECT x.comp, x.band, round(avg(score), 3) AS confidence FROM e JOIN banded x ON e.a = x.id JOIN banded y ON e.b = y.id WHERE x.band = y.band GROUP BY 1, 2),
n AS (SELECT comp, band, count(*) AS members FROM banded GROUP BY 1, 2)
SELECT 'id-' || comp || '-' || band AS cluster, id, CAST(band AS INT) AS band, members, confidence FROM banded JOIN n USING (comp, band) JOIN conf USING (comp, band) WHERE members >= 2""")
def identity_candidates(spark, d):
    """Every record is one name, age and gender, so a link stands for one pair."""
    one = _people(spark, d).groupBy("name", "age", "gender").agg(F.min("id").alias("id"))
    return identity.candidates(one)


@query(f"""WITH RECURSIVE p AS ({PEOPLE}), asked AS (SELECT DISTINCT t, u FROM (SELECT unnest(['red', 'widge']) AS t) CROSS JOIN (SELECT DISTINCT unnest(ts) AS u FROM p)),
{RATIO}, best AS (SELECT ts, t, max(CASE WHEN t = u THEN 1.0 WHEN starts_with(u, t) THEN 0.9 WHEN contains(u, t) THEN 0.75 ELSE r END) AS s FROM (SELECT DISTINCT ts FROM p) JOIN ratio ON list_contains(ts, u) GROUP BY 1, 2),
s AS (SELECT ts, sum(s) / 2 AS score FROM best GROUP BY ts HAVING min(s) >= 0.6 AND count(*) = 2)
SELECT id, name, age, gender, round(score, 4) AS score FROM p JOIN s USING (ts) ORDER BY round(score, 4) DESC, id LIMIT 20""")
def similar_search(spark, d):
    return identity.similar_people(_people(spark, d), "red widge", partial=True, limit=20)


@query(f"""WITH t AS ({TREND}) SELECT 'total' AS part, 'orders' AS label, CAST(count(*) AS DOUBLE) AS value FROM orders
UNION ALL SELECT 'severity', coalesce(severity, 'none'), CAST(count(*) AS DOUBLE) FROM t GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'alert', o_orderpriority, z FROM t ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'serious' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, z DESC, o_orderpriority LIMIT 3)""")
def overview_composition(spark, d):
    """Total, tally of alerts by severity, and the three strongest alerts."""
    alerts = _trends(spark, d)
    order = F.coalesce(F.array_position(F.array(*map(F.lit, ("critical", "serious", "warning"))), F.col("severity")), F.lit(4))
    top = alerts.orderBy(order, F.desc("z"), "o_orderpriority").limit(3).select(F.lit("alert").alias("part"), F.col("o_orderpriority").alias("label"), F.col("z").cast("double").alias("value"))
    tally = severity_tally(spark, d).select(F.lit("severity").alias("part"), F.col("severity").alias("label"), F.col("n").cast("double").alias("value"))
    total = table(spark, d, "orders").agg(F.count("*").cast("double").alias("value")).select(F.lit("total").alias("part"), F.lit("orders").alias("label"), "value")
    return total.unionByName(tally).unionByName(top)


def _as_cases(spark, d):
    """Orders stand for cases, their suppliers for accused and victims."""
    e = enriched(spark, d)
    cases = e.select(F.col("o_orderkey").alias("case_id"), F.col("c_nationkey").alias("station_id"), F.col("n_regionkey").alias("district_id"), F.col("o_orderpriority").alias("subhead_id"), F.to_date("o_orderdate").alias("registered_date"))
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    role = F.when(F.col("l_linestatus") == "F", "accused").otherwise("victim")
    people = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(role.alias("role"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), F.col("l_orderkey").alias("case_id"), F.col("s_name").alias("name"), F.col("l_quantity").cast("int").alias("age"), F.col("l_returnflag").alias("gender"))
    return cases, people


AS_CASES = f"""c AS (SELECT o_orderkey AS case_id, c_nationkey AS station_id, n_regionkey AS district_id, o_orderpriority AS subhead_id, CAST(o_orderdate AS DATE) AS registered_date FROM {STAR}),
p AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'accused' ELSE 'victim' END AS role, l_orderkey * 10 + l_linenumber AS record_id, l_orderkey AS case_id, s_name AS name, CAST(l_quantity AS INT) AS age, l_returnflag AS gender FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"""WITH {AS_CASES}, e AS (
SELECT 'REGISTERED_AT' AS rel, 'CASE:' || case_id AS src, 'POLICE_STATION:' || station_id AS dst FROM c WHERE case_id = 2 UNION ALL SELECT 'OCCURRED_IN', 'CASE:' || case_id, 'DISTRICT:' || district_id FROM c WHERE case_id = 2
UNION ALL SELECT 'CLASSIFIED_AS', 'CASE:' || case_id, 'CRIME_SUBHEAD:' || subhead_id FROM c WHERE case_id = 2
UNION ALL SELECT CASE role WHEN 'accused' THEN 'ACCUSED_IN' ELSE 'VICTIM_IN' END, CASE role WHEN 'accused' THEN 'ACCUSED_RECORD:' ELSE 'VICTIM_RECORD:' END || record_id, 'CASE:' || case_id FROM p WHERE case_id = 2)
SELECT rel, 'FACT' AS classification, src, dst, 1.0::DOUBLE AS weight, 2::BIGINT AS case_id, rel || '|' || src || '|' || dst AS edge_id FROM e""")
def association_overview(spark, d):
    return association.seed_edges(*_as_cases(spark, d), 2)


@query(f"""WITH {AS_CASES} SELECT case_id FROM c WHERE case_id <> 2 AND station_id = (SELECT station_id FROM c WHERE case_id = 2) AND registered_date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'
AND case_id IN (SELECT case_id FROM p WHERE contains(lower(name), '3')) AND case_id IN (SELECT case_id FROM p WHERE role = 'accused' AND gender = 'R') AND case_id IN (SELECT case_id FROM p WHERE role = 'accused' AND age BETWEEN 10 AND 40)""")
def association_same_station(spark, d):
    """The whole channel of one place under all filters; pages are cut from it."""
    cases, people = _as_cases(spark, d)
    none = people.where("false").select(F.col("record_id").alias("id"), F.lit("").alias("cluster"))
    found = association.related_cases(cases, people, none, 2, "POLICE_STATION:0", date_from="1996-01-01", date_to="2000-06-30", name_contains="3", gender="R", age_min=10, age_max=40)
    return found.select("case_id")


@query("""WITH e AS (SELECT 'R|' || o_orderkey || '|' || o_custkey AS edge_id, 'O:' || o_orderkey AS src, 'C:' || o_custkey AS dst FROM orders UNION ALL SELECT 'L|' || c_custkey AS edge_id, 'C:' || c_custkey, 'N:' || c_nationkey FROM customer),
n AS (SELECT edge_id, src AS a, dst AS b FROM e UNION ALL SELECT edge_id, dst, src FROM e),
f1 AS (SELECT b, min(edge_id) AS o FROM n WHERE a = 'N:3' GROUP BY b), one AS (SELECT * FROM (SELECT b AS node, row_number() OVER (ORDER BY o) AS place FROM f1) WHERE place <= 59),
f2 AS (SELECT b, min(row(one.place, edge_id)) AS o FROM one JOIN n ON a = node WHERE b <> 'N:3' AND b NOT IN (SELECT node FROM one) GROUP BY b),
two AS (SELECT * FROM (SELECT b AS node, row_number() OVER (ORDER BY o) + (SELECT count(*) FROM one) AS place FROM f2) WHERE place <= 59)
SELECT 'N:3' AS node, 0 AS depth, 0 AS place UNION ALL SELECT node, 1, CAST(place AS INT) FROM one UNION ALL SELECT node, 2, CAST(place AS INT) FROM two""")
def subgraph_limited(spark, d):
    nodes, _, _ = network.subgraph(_order_edges(spark, d), "N:3", 2, 60)
    return nodes


@query(ORACLE_SQL["subgraph_limited"])
def subgraph_keyed(spark, d):
    """The same from the adjacency store: a level reads the buckets of its own nodes."""
    return keyed.Adjacency(_order_edges(spark, d), own_dir(spark), 16).subgraph("N:3", 2, 60)[0]


def _order_edges(spark, d):
    ref = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    o = table(spark, d, "orders").select(F.concat_ws("|", F.lit("R"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("edge_id"), ref("O", "o_orderkey").alias("src"), ref("C", "o_custkey").alias("dst"))
    c = table(spark, d, "customer").select(F.concat_ws("|", F.lit("L"), F.col("c_custkey").cast("string")).alias("edge_id"), ref("C", "c_custkey").alias("src"), ref("N", "c_nationkey").alias("dst"))
    return o.unionByName(c)


def _phrase_sql(attribute: str) -> str:
    entries = ", ".join(f"{{'p': {p}, 'l': {len(w)}, 's': {s}::DOUBLE, 'o': {-i}, 'w': '{w}', 'v': '{v}'}}" for i, (w, v, p, s) in enumerate(attributes.lexicon(attribute)))
    return f"coalesce(list_max(list_filter([{entries}], lambda x: contains(low, x.w))).v, 'UNKNOWN') AS {attribute}"


@query(f"SELECT p_partkey, {', '.join(map(_phrase_sql, attributes.PHRASES))} FROM (SELECT p_partkey, lower(trim(p_name)) AS low FROM part WHERE length(trim(p_name)) >= 3)")
def narrative_profiles(spark, d):
    """The stated phrases as substrings. Of the tables' texts only product names hold one
    ("rod"), so they stand for narratives."""
    found = attributes.profile_values(attributes.profiles(table(spark, d, "part"), "p_partkey", "p_name", 3), "p_partkey")
    return found.select("p_partkey", *attributes.PHRASES)


@query(f"""WITH c AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, c_nationkey AS place, o_orderpriority AS kind, CAST(coalesce(n, 0) AS INT) AS accused, CAST(8 + o_orderkey % 11 AS INT) AS hour
  FROM {STAR} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderdate IS NOT NULL AND c_nationkey IS NOT NULL),
at_place_m AS (SELECT place, kind, round(CASE WHEN t < 0 THEN t + 24 ELSE t END, 6) AS centre FROM (SELECT place, kind, atan2(round(avg(sin(hour * (2 * 3.141592653589793 / 24))), 9), round(avg(cos(hour * (2 * 3.141592653589793 / 24))), 9)) * (24 / (2 * 3.141592653589793)) AS t FROM c GROUP BY place, kind HAVING count(*) >= 8)),
at_place AS (SELECT place, kind, centre, greatest(1.4826 * median(least(abs(hour - centre), 24 - abs(hour - centre))), 1.5) AS sigma FROM c JOIN at_place_m USING (place, kind) GROUP BY place, kind, centre),
of_kind_m AS (SELECT kind, round(CASE WHEN t < 0 THEN t + 24 ELSE t END, 6) AS centre FROM (SELECT kind, atan2(round(avg(sin(hour * (2 * 3.141592653589793 / 24))), 9), round(avg(cos(hour * (2 * 3.141592653589793 / 24))), 9)) * (24 / (2 * 3.141592653589793)) AS t FROM c GROUP BY kind HAVING count(*) >= 8)),
of_kind AS (SELECT kind, centre, greatest(1.4826 * median(least(abs(hour - centre), 24 - abs(hour - centre))), 1.5) AS sigma FROM c JOIN of_kind_m USING (kind) GROUP BY kind, centre),
med AS (SELECT kind, median(accused) AS median FROM c GROUP BY kind HAVING count(*) >= 10), usual AS (SELECT kind, med.median, median(abs(accused - med.median)) AS mad FROM c JOIN med USING (kind) GROUP BY kind, med.median),
pair AS (SELECT place, kind, count(*) AS observed FROM c GROUP BY 1, 2), tot AS (SELECT place, sum(observed) AS total FROM pair GROUP BY 1), shr AS (SELECT kind, sum(observed) / (SELECT count(*) FROM c) AS share FROM pair GROUP BY 1),
rare AS (SELECT place, kind, observed, round(total * share, 4) AS expected, round((total * share - observed) / sqrt(total * share), 4) AS z FROM pair JOIN tot USING (place) JOIN shr USING (kind) WHERE total >= 20 AND share >= 0.01 AND total * share >= 3 AND observed <= 0.4 * total * share),
j AS (SELECT c.*, usual.median, round((accused - usual.median) / greatest(1.4826 * mad, 1.0), 2) AS many, coalesce(at_place.centre, of_kind.centre) AS mid,
  round(least(abs(hour - mid), 24 - abs(hour - mid)) / coalesce(at_place.sigma, of_kind.sigma), 2) AS odd, observed, expected, round(z, 2) AS rare
  FROM c LEFT JOIN usual USING (kind) LEFT JOIN at_place USING (place, kind) LEFT JOIN of_kind USING (kind) LEFT JOIN rare USING (place, kind) WHERE day > (SELECT max(day) FROM c) - 90),
s AS (SELECT id, place, kind, list_sort(list_filter([CASE WHEN many >= 1.5 THEN {{'o': 0, 'm': -many, 's': 'many_accused', 'r': accused || ' accused where ' || printf('%.1f', round(median, 1)) || ' are usual'}} END,
  CASE WHEN odd >= 1.5 THEN {{'o': 0, 'm': -odd, 's': 'odd_hour', 'r': 'at ' || hour || ' hours, usually near ' || printf('%.1f', round(mid, 1))}} END,
  CASE WHEN rare >= 1.5 THEN {{'o': 1, 'm': -rare, 's': 'rare_offence', 'r': observed || ' at this place where ' || printf('%.1f', round(expected, 1)) || ' are expected'}} END], lambda x: x IS NOT NULL)) AS l FROM j),
hit AS (SELECT id, place, kind, l[1].s AS signal, -l[1].m AS score, array_to_string([x.r for x in l], '; ') AS reason FROM s WHERE len(l) > 0),
flags AS (SELECT id, place, kind, signal, score, reason, CAST(id AS VARCHAR) AS ids FROM hit WHERE signal <> 'rare_offence'
  UNION ALL SELECT min(id), place, kind, 'rare_offence', max(score), min(reason), array_to_string(list_sort(list(id))[:10], ',') FROM hit WHERE signal = 'rare_offence' GROUP BY place, kind)
SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank, id, place, kind, signal, score, CASE WHEN score >= 5 THEN 'critical' WHEN score >= 3.5 THEN 'serious' WHEN score >= 2.5 THEN 'warning' END AS severity, reason, ids FROM flags QUALIFY rank <= 25""")
def anomaly_flags(spark, d):
    """Orders as cases: lines for accused, the key's remainder for the missing hour."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("accused"))
    o = enriched(spark, d).join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cases = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("c_nationkey").alias("place"), F.col("o_orderpriority").alias("kind"), F.coalesce("accused", F.lit(0)).alias("accused"), (8 + F.pmod("o_orderkey", F.lit(11))).cast("int").alias("hour"))
    return anomalies.anomaly_flags(cases, 90, 1.5).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query()
def isolation_forest_flags(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.hour("o_orderdate").alias("hour"), F.month("o_orderdate").alias("month"))
    return forest.isolation_scores(o, ["o_totalprice", "hour", "month"], "o_orderkey").select("o_orderkey", F.round("isolation", 6).alias("isolation"), (F.col("isolation") > 0.5).alias("confirmed"))


@query(f"""WITH RECURSIVE {BLOCKS}, walk(s, t, d) AS (SELECT DISTINCT a, a, 0 FROM n UNION SELECT w.s, n.b, d + 1 FROM walk w JOIN n ON w.t = n.a WHERE d < 39),
dist AS (SELECT s, t, min(d) AS d FROM walk GROUP BY s, t),
paths(s, t, d, k) AS (SELECT s, t, d, 1::DOUBLE FROM dist WHERE d = 0
  UNION ALL SELECT p.s, x.t, x.d, sum(p.k) FROM paths p JOIN n ON p.t = n.a JOIN dist x ON x.s = p.s AND x.t = n.b AND x.d = p.d + 1 GROUP BY p.s, x.t, x.d),
b AS (SELECT u.t AS node, sum(u.k * v.k / w.k) AS x FROM paths u JOIN paths v ON u.t = v.s JOIN paths w ON w.s = u.s AND w.t = v.t AND w.d = u.d + v.d
  WHERE u.s < v.t AND u.s <> u.t AND v.t <> u.t GROUP BY u.t)
SELECT node, round(coalesce(x, 0), 6) AS betweenness FROM (SELECT DISTINCT a AS node FROM n) LEFT JOIN b USING (node)""")
def path_betweenness(spark, d):
    return network.betweenness(_blocks(spark, d))


def _repeated_pairs(spark, d):
    """Parts that share two orders or more: a sparse relation of the tables themselves."""
    return _edges(spark, d).where("weight >= 2")


@query()
def modularity_communities(spark, d):
    """Communities by modularity, with the modularity that they reach."""
    e = materialize(_repeated_pairs(spark, d))
    found = materialize(network.communities(e))
    return found.crossJoin(F.broadcast(network.modularity(e, found)))


@query()
def label_communities(spark, d):
    return network.label_communities(_blocks(spark, d).withColumn("weight", F.lit(1)))


@query("""WITH u AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent, NULL::VARCHAR AS area FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world', CASE WHEN r_regionkey % 2 = 0 THEN r_name END FROM region UNION ALL SELECT 'world', NULL, 'all')
SELECT u.id, coalesce(u.area, p.area, g.area) AS area, CAST((p.id IS NOT NULL)::INT + (g.id IS NOT NULL)::INT AS INT) AS chain_length, false AS cycle FROM u LEFT JOIN u p ON u.parent = p.id LEFT JOIN u g ON p.parent = g.id""")
def inherited_area(spark, d):
    """What a nation lacks it has from its region, what that lacks from the world."""
    none = F.lit(None).cast("string")
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), none.alias("area"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("world").alias("parent"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).alias("area"))
    top = spark.range(1).select(F.lit("world").alias("id"), none.alias("parent"), F.lit("all").alias("area"))
    return T.inherited(n.unionByName(r).unionByName(top), ["area"])


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5) GROUP BY 1")
def sets_of_asked_keys(spark, d):
    """Suppliers of the customers of one nation: case to districts in other words."""
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    asked = table(spark, d, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("o_custkey"))
    found = T.districts_of_cases(rows, asked, "o_custkey", "l_suppkey")
    return found.select("o_custkey", F.array_join(F.col("districts").cast("array<string>"), ",").alias("suppliers"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey FROM orders")
def ranked_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return T.ranked(o, [F.desc("o_totalprice"), F.col("o_orderkey")]).select(F.col("rank").cast("long").alias("rank"), "o_orderkey")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS bad, length(props) AS n FROM events")
def coerced_casts(spark, d):
    """A cell that is not of the wanted type is null, not an error."""
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.col("event_type").try_cast("long").alias("bad"), F.length("props").cast("long").alias("n"))


def _monthly(spark, d) -> str:
    """Orders as a table of one folder a month."""
    path = f"{own_dir(spark)}/orders-{uuid.uuid4().hex}"
    write_by_month(table(spark, d, "orders"), path, "o_orderdate")
    return path


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-10' AND o_orderdate < TIMESTAMP '1997-07-02'")
def range_of_months(spark, d):
    return read_range(spark, _monthly(spark, d), "o_orderdate", "1997-03-10", "1997-07-02").select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) > (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 70 GROUP BY 1")
def recent_by_month(spark, d):
    """The newest seventy days, which is what the trends read, from the last folders only."""
    return recent_rows(spark, _monthly(spark, d), "o_orderdate", 70).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE contains(lower(text), 'apache license')")
def substring_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = substring.build(docs, "doc_id", "text", own_dir(spark))
    return substring.search(docs, index, "doc_id", "text", "Apache License").select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / 8.0::DOUBLE * l_discount AS raw, CAST(printf('%.2f', l_extendedprice / 8.0::DOUBLE * l_discount) AS DOUBLE) AS rounded FROM lineitem")
def rounded_shares(spark, d):
    raw = F.col("l_extendedprice") / F.lit(8.0) * F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"), X.round_half_even(raw, 2).alias("rounded"))
