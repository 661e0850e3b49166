"""Ranked search against plain scoring of every document."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from stratalens.llm import ranked

DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"


def plain(docs, items, k=10):
    """Every document's score for every item."""
    terms = [Counter(ranked.terms_of(t)) for _, t in docs]
    known = [i for i, c in enumerate(terms) if c]
    total, length = len(known), sum(sum(terms[i].values()) for i in known)
    df = Counter(w for c in terms for w in c)
    out = []
    for item_id, text in items:
        asked, scores = Counter(ranked.terms_of(text)), []
        for i in known:
            m = 25 + 75 * sum(terms[i].values()) * total // length
            s = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1000000000 * terms[i][w] // (1000 * terms[i][w] + 8 * m)) for w, n in asked.items() if w in terms[i])
            if s > 0:
                scores.append((-s, docs[i][0]))
        out += [(item_id, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def world(seed, n=300, items=25):
    r = random.Random(seed)
    words = [f"w{min(int(r.paretovariate(0.6)), 400)}" for _ in range(4000)] + ["Über", "naïve", "x9"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice((1, 5, 30, 200))))) for i in range(n)]
    docs += [(n + i, docs[i % 5][1]) for i in range(40)]  # ties
    return docs, [(f"q{i}", " ".join(r.choice(words) for _ in range(r.randint(1, 25)))) for i in range(items)]


def rows(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block", [ranked.BLOCK_TERMS, 40])
def test_same_as_scoring_everything(spark, block):
    docs, items = world(1)
    got = ranked.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), block_terms=block)
    assert rows(got) == plain(docs, items)


def test_terms_by_a_join_where_they_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ASKED_BYTES", 10)
    docs, items = world(2, 80, 6)
    assert rows(ranked.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == plain(docs, items)


def test_small_tiles_and_pruning(spark, monkeypatch):
    docs, items = world(3, 200, 10)
    pruned = []
    kept = ranked.Block.kept_terms
    monkeypatch.setattr(ranked.Block, "kept_terms", lambda self, t: (out := kept(self, t), pruned.append(len(self.tid) - len(out[0])))[0])
    monkeypatch.setattr(ranked, "TILE", 16)
    monkeypatch.setattr(ranked, "STEP", 7)
    found = ranked.postings(spark.createDataFrame(docs, DOCS), ranked.asked_terms(spark.createDataFrame(items, ITEMS))[1])
    assert rows(ranked.search(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(items, ITEMS))) == plain(docs, items)
    # pruning in this process: thresholds of the stored impacts alone leave terms out
    b = ranked.Block(np.zeros(3, np.int64), np.arange(3), np.array([1, 10, 100]), np.array([9, 9, 9]), np.array([1, 1, 8]))
    assert b.seed.tolist() == [800] and len(b.kept_terms(b.seed)[0]) == 1 and b.kept_terms(b.seed)[1].tolist() == [99]
    assert pruned and found.count() == len(docs)


def test_nulls_empty_tables_repeats_and_other_columns(spark):
    docs = [(1, None), (2, ""), (3, "- , ."), (4, "alpha beta"), (4, "alpha beta"), (None, "alpha beta"), (5, "Alpha ALPHA alpha " * 20000), (6, "gamma")]
    items = [("a", "alpha zeta"), ("a", "alpha zeta"), (None, "gamma gamma"), ("b", None), ("c", "zeta")]
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS score", "2 AS item_id", "3 AS n", "4 AS tids")
    got = ranked.search(d, spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS item", "2 AS asked")).collect()
    assert sorted((r.item_id or "", r["rank"]) for r in got) == [("", 1)] + [("a", k) for k in (1, 1, 2, 2, 3, 3, 4, 4)]
    assert [r.doc_id for r in got if r.item_id is None] == [6]
    tied = [r for r in got if r.item_id == "a" and r.doc_id != 5]
    assert len({r.score for r in tied}) == 1 and min(tied, key=lambda r: r["rank"]).doc_id is None
    assert ranked.search(d.limit(0), spark.createDataFrame(items, ITEMS)).collect() == []
    assert ranked.search(d, spark.createDataFrame([], ITEMS)).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_equals_its_sql(spark):
    from stratalens.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(f"SELECT CAST(item_id AS VARCHAR), rank, doc_id, score FROM ({queries.ORACLE_SQL['op11_ranked_search']})").fetchall()
    assert rows(queries.QUERIES["op11_ranked_search"](spark, sf)) == sorted(want)
