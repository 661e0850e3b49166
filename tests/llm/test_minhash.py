"""MinHash near-duplicates against all pairs of full sets."""

import random

import numpy as np
import pytest

from stratalens.llm import minhash

DOCS = "doc_id long, text string"


def plain_sets(docs, size=4):
    out = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        out.append(frozenset(b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    return out


def plain(docs, percent=80):
    """Smallest id over links between all pairs of rows."""
    sets = plain_sets(docs)
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d, len(sets[i]), low[top(i)], d == low[top(i)]) for i, (d, _) in enumerate(docs) if d is not None)


def rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect() if r.doc_id is not None)


def changed(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"z{r.randrange(10**6)}"
    return out


def world(seed):
    """Groups of copies with few to many changes, chains, a passage that many share."""
    r = random.Random(seed)
    texts = []
    for g in range(12):
        base = [f"v{r.randrange(3000)}" for _ in range(r.choice((6, 40, 120)))]
        texts += [" ".join(changed(r, base, r.choice((0, 0, 1, 1, 2, 3, 6)))) for _ in range(12)]
        chain = base
        for _ in range(5):
            chain = changed(r, chain, 1)
            texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(r.choice((10, 20, 60)))) for _ in range(60)]
    texts += ["Alpha beta", "alpha  BETA", "one", "", None, "  "]
    r.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed):
    docs = world(seed)
    assert rows(minhash.near_duplicates(spark.createDataFrame(docs, DOCS).repartition(4))) == plain(docs)


def test_units_of_blocks_give_the_same(spark):
    docs = world(3)
    assert rows(minhash.near_duplicates(spark.createDataFrame(docs, DOCS), block=3)) == plain(docs)


def test_links_near_the_threshold(spark):
    """Pairs of 400 shingles with a similarity of just 0.8 and just less."""
    r, docs = random.Random(5), []
    for k in range(60):
        base = [f"k{k}x{i}" for i in range(403)]
        n = 45 if k % 2 else 44  # words changed at the end: 400 - n of 400 + n shingles are shared
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: 403 - n] + [f"y{r.random()}" for _ in range(n)]))]
    got = rows(minhash.near_duplicates(spark.createDataFrame(docs, DOCS)))
    assert got == plain(docs) and sum(not g[3] for g in got) == 30


def test_table_keys_pair_two_small_collections():
    found = minhash.shingles(" ".join(f"w{i}" for i in range(50)))
    low = minhash.minhashes(found)
    assert len(low) == 84 and len(minhash.half_keys(low)) == 28 and len(set(minhash.half_keys(low))) == 28
    mixed = found[None, :] * minhash.FACTOR[:, None] + minhash.SHIFT[:, None]
    assert np.array_equal(low, (mixed ^ (mixed >> np.uint64(29))).min(axis=1))


def test_sketches_never_say_more_than_differs():
    r = random.Random(8)
    for _ in range(300):
        n = r.choice((1, 3, 60, 128, 129, 700, 2100))
        a = [r.getrandbits(64) for _ in range(n)]
        b = a[r.randrange(n) :] + [r.getrandbits(64) for _ in range(r.choice((0, 1, n // 9, n)))]
        x, y = (np.unique(np.array(v, np.uint64)) for v in (a, b))
        differ = len(np.setxor1d(x, y))
        got = minhash.fewest_differences(minhash.parity(x), minhash.parity(y))
        assert got <= differ and (got >= 0.5 * differ or 4 * differ > min(len(x), len(y)))
        both = len(np.intersect1d(x, y))
        assert minhash.allowed(differ, len(x), len(y), 80) == (100 * both >= 80 * (len(x) + len(y) - both))


def test_nulls_repeats_empty_table_and_other_columns(spark):
    docs = [(7, "a b c d e f"), (7, "a b c d e f"), (7, "quite another text of words"), (None, "a b c d e f"), (3, "a b c d e f"), (9, None), (8, ""), (None, None), (1, "long " * 50000)]
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS node", "2 AS t", "3 AS digest", "4 AS row", "5 AS component")
    got = sorted(minhash.near_duplicates(d).collect(), key=str)
    assert len(got) == len(docs)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(1, 1, True), (3, 3, True), (7, 3, False), (7, 3, False), (7, 7, True), (8, 8, True), (9, 9, True)]
    assert all(r.component_id is None and not r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_query_on_a_whole_table(spark):
    from stratalens.llm import queries
    from stratalens.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert rows(queries.QUERIES["op12_minhash_near_dedup"](spark, sf)) == plain(docs)
