"""Text ratios against difflib, the name filter against all pairs, the forecast's own model."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import exprs as X
from stratalens.operators import identity, regression, series


def match(a, b):
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if long.startswith(short):
        return 0.85 if len(short) == 1 else 0.8
    return difflib.SequenceMatcher(None, a, b).ratio()


def similarity(a, b):
    x, y = a.split(), b.split()
    given = match(x[0], y[0]) if x and y else 0.0
    if given < 0.8:
        return 0.0
    found = [max((match(t, u) for u in other), default=0.0) for own, other in ((x[1:], y[1:]), (y[1:], x[1:])) for t in own if len(t) > 1]
    return 0.3 if min(found, default=1.0) < 0.8 else 0.5 * given + 0.5 * (sum(found) / len(found) if found else given)


def partial(typed, name):
    best = []
    for t in typed.split():
        best.append(max((1.0 if t == u else 0.9 if u.startswith(t) else 0.75 if t in u else difflib.SequenceMatcher(None, t, u).ratio() for u in name.split()), default=0.0))
    return sum(best) / len(best) if best and min(best) >= 0.6 else 0.0


def words(r, n, low=0, high=9, letters="abcr"):
    return ["".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(n)]


def test_ratio_equals_difflib(spark):
    r = random.Random(1)
    pairs = list(zip(words(r, 10000), words(r, 10000))) + [("", ""), ("kumar", "kumaar"), ("mississippi", "misisipi"), ("raví", "ravi"), ("aaaaaaaaaa", "aaaaa")]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", X.text_ratio(F.col("a"), F.col("b")).alias("v")).collect()
    assert {x.i: x.v for x in got} == {i: difflib.SequenceMatcher(None, a, b).ratio() for i, (a, b) in enumerate(pairs)}


def test_names_equal_the_plain_rules(spark):
    r = random.Random(2)
    names = [" ".join(t for t in (r.choice(("ravi", "rav", "ravii", "suresh", "sita")), *words(r, r.randint(0, 2), 1, 5, "akumr")) if t) for _ in range(1500)] + ["", "ravi"]
    pairs = [(i, r.choice(names), r.choice(names)) for i in range(3000)]
    got = spark.createDataFrame(pairs, "i int, a string, b string").select("i", X.name_similarity("a", "b").alias("n"), X.partial_similarity("a", "b").alias("p")).collect()
    for g in got:
        _, a, b = pairs[g.i]
        assert abs(g.n - similarity(a, b)) < 1e-12 and abs(g.p - partial(a, b)) < 1e-12, (a, b)


def test_the_filter_loses_no_pair_and_scores_few(spark):
    r = random.Random(3)
    sur = words(r, 250, 3, 9, "abdeiklmnrstu")
    sur += [s[:-1] + r.choice("xyz") for s in sur[:60]] + [s[0] for s in sur[:10]] + [s[:3] for s in sur[:20]]
    clean = sorted({" ".join(["ravi", *r.sample(sur, r.randint(0, 2))]) for _ in range(900)})
    df = spark.createDataFrame([("M", "ravi", c) for c in clean], "gender string, first string, clean string")
    asked = {(x.clean, x.clean2) for x in identity.name_pairs(df).collect()}
    want = {(a, b) for i, a in enumerate(clean) for b in clean[i:] if a == b or similarity(a, b) >= identity.MIN_NAME}
    assert want <= asked and len(asked) < 0.05 * len(clean) ** 2 / 2
    tokens = spark.createDataFrame([(s,) for s in sorted(set(sur))], "token string")
    pairs = {(x.t, x.u) for x in identity.counterparts(tokens).collect()}
    assert pairs == {(t, u) for t in set(sur) for u in set(sur) if len(t) > 1 and max(match(t, u), match(u, t)) >= 0.8 and (len(u) > 1 or t.startswith(u))}


def test_search_equals_scoring_every_name(spark):
    r = random.Random(4)
    rows = [(i, " ".join(words(r, 2, 1, 7, "aeiknrsv")).title(), r.choice((None, 20, 30)), r.choice("MF")) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, name string, age int, gender string")
    for asked in ("ravi", "ra sin", "vik e"):
        for scorer, part in ((partial, True), (similarity, False)):
            scored = sorted((-round(s, 4), i) for i, n, *_ in rows if (s := scorer(asked, n.lower())) >= 0.5)[:50]
            assert [(-x.score, x.id) for x in identity.similar_people(df, asked, partial=part).collect()] == scored


def test_least_squares(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 3))
    y = 4 + x @ np.array([2.0, -1.0, 0.0]) + r.normal(size=400) * 0.1
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0)], "p double, q double, r double, y double").withColumn("twice", F.col("p") * 2).withColumn("still", F.lit(7))
    model = regression.fit(df, ["p", "q", "r"], "y")
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert np.allclose([model.intercept, *model.coefficients.values()], want) and model.rows == 400 and model.r2 > 0.99
    # a copy of a feature shares its weight, a constant has none; predictions are the same
    more = regression.fit(df, ["p", "q", "twice", "still"], "y", "2")
    assert more.coefficients["still"] == 0 and abs(more.coefficients["p"] + 2 * more.coefficients["twice"] - 2) < 0.05
    path = str(tmp_path / "models")
    assert regression.load(spark, path) is None
    regression.save(spark, model, path)
    regression.save(spark, more, path)
    assert regression.load(spark, path) == more and regression.load(spark, path, "1") == model and regression.load(spark, path, "9") is None
    with pytest.raises(ValueError):
        regression.save(spark, model, path)
    with pytest.raises(ValueError):
        regression.fit(df.limit(0), ["p"], "y")
    out = regression.predictor(model)(df).collect()
    assert min(x.expected for x in out if x.expected is not None) >= 0 and out[-1].expected is None


def test_forecast_with_and_without_a_model(spark):
    f = spark.createDataFrame([(d, w, 3 * d + w, 2 * d) for d in range(6) for w in range(4)], "d int, w int, recent int, target int")
    model = regression.fit(f.where("w > 0"), ["recent", "w"], "target")
    got = series.forecast(f, regression.predictor(model)).collect()
    assert all(x.available and abs(x.expected - 2 * x.d) < 1e-6 for x in got) and {x.level for x in got} == {"low", "medium", "high"}
    assert series.forecast(f).where("available or expected is not null").count() == 0


def test_confidence_does_not_depend_on_the_order_of_links(spark, monkeypatch):
    import random

    import duckdb

    r = random.Random(1)
    scores = [r.choice((0.7225, 0.79, 0.7925, 0.8275, 0.8475, 0.8625, 0.895, 0.93, 0.9475, 1.0)) for _ in range(400 * 6)]
    clusters = [scores[i : i + 6] for i in range(0, len(scores), 6)]
    people = spark.createDataFrame([(10 * c + k, "", 30, "M") for c in range(len(clusters)) for k in range(7)], "id long, name string, age int, gender string")

    def confidence(order):
        links = [(10 * c, 10 * c + 1 + k, s, 1.0) for c, own in enumerate(clusters) for k, s in enumerate(order(own))]
        monkeypatch.setattr(identity, "linked_pairs", lambda _: spark.createDataFrame(links, "a long, b long, score double, pairs double").coalesce(1))
        return {int(x.cluster.split("-")[1]) // 10: x.confidence for x in identity.candidates(people).collect()}

    got = [confidence(order) for order in (sorted, lambda own: sorted(own)[::-1], list)]
    assert got[0] == got[1] == got[2]
    whole = [duckdb.sql(f"SELECT round({sum(round(s * 10000) for s in own)} / 10000.0::DOUBLE / 6, 3)").fetchall()[0][0] for own in clusters]
    assert got[0] == dict(enumerate(whole))
