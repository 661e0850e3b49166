"""Every query with a SQL twin against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from stratalens.plans import bindings as B

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(B.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = B.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    rel = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({B.ORACLE_SQL[name]})")
    want = sorted(tuple(norm(v) for v in r) for r in rel.fetchall())
    assert got == want
    if name not in ("text_search_page", "filtered_page", "rare_pair"):
        assert got


def test_queries_without_a_twin(spark):
    rows = {name: B.QUERIES[name](spark, DIR).collect() for name in set(B.QUERIES) - set(B.ORACLE_SQL)}
    assert set(rows) == {"isolation_forest_flags", "label_communities", "modularity_communities"}
    forest = rows["isolation_forest_flags"]
    assert len(forest) == spark.read.parquet(f"{DIR}/orders.parquet").count() and all(0 < r.isolation < 1 and r.confirmed == (r.isolation > 0.5) for r in forest)
    blocks = {r.node: r.community for r in rows["label_communities"]}
    assert all(c // 40 == k // 40 for k, c in blocks.items()) and len(set(blocks.values())) > len({k // 40 for k in blocks})
    found = rows["modularity_communities"]
    assert len({r.modularity for r in found}) == 1 and found[0].modularity > 0.1 and len(found) > len({r.community for r in found}) > 1
