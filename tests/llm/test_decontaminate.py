import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from stratalens.llm import decontaminate as D


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(doc, items, window=13):
    w, hit, ids = words(doc), set(), set()
    for i, t in items:
        x = words(t)
        k = min(window, len(x))
        for s in range(len(x) - k + 1 if k else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == x[s : s + k]:
                    hit |= set(range(p, p + k))
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def world(seed=3):
    r = random.Random(seed)
    say = lambda n, v: " ".join(r.choice(v) for _ in range(n))
    small, big = ["a", "b", "É", "x1"], [f"w{i}" for i in range(300)]
    items = [(i, say(r.choice([1, 3, 12, 13, 14, 40]), r.choice([small, big, big]))) for i in range(12)] + [(90, ""), (91, None), (92, "W1, w2; W3 w1 w2 w3 w1 w2 w3 w1 w2 w3 w1 w2 w3 w1"), (10, "zz yy")]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(r.randint(0, 5)):
            t = r.choice(items)[1] or ""
            ws = t.split()
            a = r.randrange(len(ws) + 1)
            parts += [say(r.randint(0, 8), big + small), " ".join(ws[a:]) if r.random() < 0.5 else t.upper()]
        docs.append((d, "\n".join(parts)))
    return docs + [(100, None), (101, ""), (102, "w1 w2 w3 " * 30), (102, "w1 w2 w3 " * 30)], items


def test_matches_brute_force_in_one_or_many_blocks(spark):
    docs, items = world()
    d = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, item_id string, n_hits int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 100):
        got = D.judged(d, b, block_bytes=size).select("doc_id", "n_words", "n_hit", "items", "contaminated", "text").collect()
        assert len(got) == len(docs)
        for r in got:
            n, hit, ids = slow(r.text, items)
            assert (r.n_words, r.n_hit, r.items) == (n, hit, ids)
            assert r.contaminated == (hit > 0 and 20 * hit >= n)
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns


def test_clashing_columns_keep_their_values(spark):
    docs, items = world()
    d = spark.createDataFrame([(i, t, "MINE", "KEEP", "no", 7, "j") for i, t in docs], "doc_id long, text string, items string, N_HIT string, contaminated string, n_words int, judged_items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, t or "") for i, t in docs if not ((x := slow(t, items))[1] and 20 * x[1] >= x[0]))
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == want
    assert {tuple(r)[2:] for r in kept.collect()} == {("MINE", "KEEP", "no", 7, "j")}
    with pytest.raises(ValueError):
        D.judged(d, b)
    assert D.judged(d, b, prefix="x_").columns == [*d.columns, "x_n_words", "x_n_hit", "x_items", "x_contaminated"]


def test_long_texts_in_small_pieces():
    docs, items = world(8)
    test = D.TestSet([(str(i), t) for i, t in items])
    for size in (20, 90, 1 << 20):
        for (i, t), (n, mask, found) in zip(docs, D.text_hits([t for _, t in docs], test, size)):
            assert (n, int(mask.sum()), sorted({test.item_ids[k] for k in found})) == slow(t, items)


def test_repeated_text_is_bounded():
    import tracemalloc

    test = D.TestSet([(str(k), "same " * 300) for k in range(50)] + [("z", "same other")])
    tracemalloc.start()
    [(n, mask, found)] = D.text_hits(["same " * 1_000_000], test)
    assert n == 1_000_000 and mask.all() and len(found) == 50
    assert tracemalloc.get_traced_memory()[1] < 700 << 20
    tracemalloc.stop()


def test_longest_matches_by_brute_force(spark, monkeypatch):
    docs, items = world(5)
    docs = [(i, t) for i, t in dict(docs).items()]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    all_found = {}
    for i, t in items:
        x, found = words(t), all_found.setdefault(str(i), [])
        for k, text in docs:
            w = words(text)
            for s in range(len(x)):
                for p in range(len(w)):
                    n = 0
                    while s + n < len(x) and p + n < len(w) and x[s + n] == w[p + n]:
                        n += 1
                    if n >= min(13, len(x)) and n:
                        found.append((n, k, p, s))
    want = {(i, *f) for i, found in all_found.items() for f in found if f[0] == max(found)[0]}
    assert {tuple(r) for r in D.longest_matches(d, b).collect()} == want
    assert {tuple(r) for r in D.longest_matches(d, b, block_bytes=90).collect()} == want


def test_longest_match_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "q a b c d q"), (2, "a b c d"), (3, "b c")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "z a b c d")], "item_id long, text string")
    got = {tuple(r) for r in D.longest_matches(d, b, window=2).collect()}
    assert got == {("5", 4, 1, 1, 1), ("5", 4, 2, 0, 1)}
    none = b.where("1 = 0")
    assert [r.n_hit for r in D.judged(d, none).collect()] == [0, 0, 0]
    assert D.judged(d.where("1 = 0"), b).count() == 0


def test_digest_of_items():
    assert hashlib.sha256(b"10,9").hexdigest() == hashlib.sha256(",".join(sorted(["9", "10"])).encode()).hexdigest()
