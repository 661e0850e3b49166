import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from stratalens.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, component_id int"


def slow_fp(text):
    words = []
    for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or ""):
        words.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w))
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows, radius=4):
    fps = [(i, slow_fp(t)) for i, t in rows]
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(fps):
        for j, b in fps[:n]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in fps}


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeÉß") for _ in range(r.randint(1, 6)))
    rows = []
    for g in range(30):
        base = [word() for _ in range(r.choice([1, 2, 30, 400]))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            if r.random() < 0.6:
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n\x0b"), (len(rows) + 3, "   ")]
    return rows


def test_matches_brute_force_and_survives_blocks(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    want = slow_components(rows)
    for block in (2048, 3):
        got = S.near_duplicates(df, block=block).collect()
        assert {r.doc_id: r.fp % (1 << 64) for r in got} == {i: slow_fp(t) for i, t in rows}
        assert {r.doc_id: r.component_id for r in got} == want


def test_repeated_null_and_empty_input(spark):
    df = spark.createDataFrame([(7, "a b c d e", "", 0)] * 3 + [(3, "a b c d e", "", 0), (None, "a b c d e", "", 0)], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id) for r in S.near_duplicates(df).collect())
    assert got == [(-1, None), (3, 3), (7, 3), (7, 3), (7, 3)]
    assert S.near_duplicates(df.where("1 = 0")).count() == 0


def test_bit_sliced_forest_against_pairs():
    r = np.random.default_rng(1)
    centre = r.integers(0, 1 << 63, 8, dtype=np.uint64)
    fps = centre[r.integers(0, 8, 900)]
    for _ in range(3):
        fps ^= np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64)
    group = np.sort(r.integers(0, 5, 900))
    row, root = S.link_forest(group, fps)
    label = np.arange(900)
    label[row] = root
    want = np.arange(900)
    for _ in range(40):
        for i in range(900):
            near = [j for j in range(900) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4] if _ == 0 else near_of[i]
            if _ == 0:
                near_of = {} if i == 0 else near_of
                near_of[i] = near
            want[i] = min(want[j] for j in near)
    assert (label == want).all()


def test_very_long_text():
    assert S.simhash("ab cd " * 200_000) == slow_fp("ab cd " * 50)
