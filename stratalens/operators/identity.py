"""Identity candidates: blocked name and age scoring, components, age bands.

Names are scored once per distinct pair inside a block (gender, first token), and only such
pairs as can pass: a full surname needs a counterpart on the other side. Counterparts are
found among distinct tokens, beginnings by equal beginnings, alike spellings by postings of
neighbouring characters with a bound on how many must be shared; so the filter loses no
pair. The confidence of a cluster is the mean over its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import age_score, fragment_match, least_common_bigrams, name_similarity, name_tokens, padded_bigrams, partial_similarity, token_match
from ..session import materialize
from .components import connected_components

NAME_WEIGHT, AGE_WEIGHT, MIN_NAME, MIN_SCORE, MAX_GAP, BAND = 0.65, 0.35, 0.82, 0.72, 8, 10
COUNTERPART, FRAGMENT = 0.8, 0.6


def cleaned(people: DataFrame) -> DataFrame:
    """``people`` (id, name, age, gender) with ``clean`` and ``first``."""
    return people.withColumn("clean", F.array_join(name_tokens(F.col("name")), " ")).withColumn("first", F.get(name_tokens(F.col("name")), F.lit(0)))


def counterparts(tokens: DataFrame) -> DataFrame:
    """``t, u``: of the distinct column ``token`` the full tokens t (two characters or more) and
    all tokens u that ``token_match`` puts at ``COUNTERPART`` or above, either way round."""
    full = tokens.where(F.length("token") > 1)
    begins = full.select(F.col("token").alias("t"), F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda n: F.substr("token", F.lit(1), n))).alias("u"))
    begins = begins.join(tokens.select(F.col("token").alias("u")), "u").select("t", "u")
    grams = full.select("token", F.explode(padded_bigrams(F.col("token"))).alias("gram"))
    shared = grams.withColumnRenamed("token", "t").join(grams.withColumnRenamed("token", "u"), "gram").where("t < u").groupBy("t", "u").agg(F.count("*").alias("n"))
    t, u = F.col("t"), F.col("u")
    near = shared.where(F.col("n") >= least_common_bigrams(t, u, COUNTERPART)).where(F.greatest(token_match(t, u), token_match(u, t)) >= COUNTERPART).select("t", "u")
    pairs = begins.unionByName(near)
    return pairs.unionByName(pairs.where(F.length("u") > 1).select(F.col("u").alias("t"), F.col("t").alias("u"))).distinct()


def name_pairs(names: DataFrame) -> DataFrame:
    """``gender, first, clean, clean2`` (clean <= clean2): the pairs of distinct names of a block
    that can reach ``MIN_NAME``. ``names``: gender, first, clean."""
    surnames = F.slice(F.split("clean", " "), F.lit(2), F.greatest(F.size(F.split("clean", " ")) - 1, F.lit(0)))
    full = F.filter(surnames, lambda t: F.length(t) > 1)
    n = materialize(names.withColumn("surnames", surnames).withColumn("probe", F.get(full, F.lit(0))))
    tokens = n.select(F.explode("surnames").alias("token")).distinct()
    holds = n.select("gender", "first", F.col("clean").alias("other"), F.explode(F.array_distinct("surnames")).alias("u"))
    met = n.where("probe is not null").join(materialize(counterparts(tokens)), F.col("probe") == F.col("t")).select("gender", "first", "clean", "u").join(holds, ["gender", "first", "u"])
    # without a full surname on either side every pair is alike
    bare = n.where("probe is null").select("gender", "first", "clean")
    alike = bare.join(bare.withColumnRenamed("clean", "other"), ["gender", "first"])
    own = n.select("gender", "first", "clean", F.col("clean").alias("other"))
    both = met.select("gender", "first", "clean", "other").unionByName(alike).unionByName(own)
    return both.select("gender", "first", F.least("clean", "other").alias("clean"), F.greatest("clean", "other").alias("clean2")).distinct()


def linked_pairs(people: DataFrame) -> DataFrame:
    """``a, b, score, pairs``: links that join the persons of a block who are alike in name and age.
    Persons with one clean name, gender and age are one group: its smallest id stands for
    it, the others are linked to that one. Groups are compared, so a name that many
    records share costs pairs of its ages, not pairs of its records; ``pairs`` says how many
    pairs of records a link stands for."""
    p = cleaned(people).where("gender is not null and first is not null")
    groups = materialize(p.groupBy("gender", "first", "clean", "age").agg(F.min("id").alias("g"), F.count("*").alias("n")))
    names = groups.select("gender", "first", "clean").distinct()
    pairs = name_pairs(names)
    alike = pairs.withColumn("name_score", F.when(F.col("clean") == F.col("clean2"), 1.0).otherwise(name_similarity("clean", "clean2"))).where(F.col("name_score") >= MIN_NAME)
    a = groups.select(F.col("g").alias("a"), F.col("age").alias("age_a"), F.col("n").alias("n_a"), "gender", "clean")
    b = groups.select(F.col("g").alias("b"), F.col("age").alias("age_b"), F.col("n").alias("n_b"), "gender", F.col("clean").alias("clean2"))
    j = alike.join(a, ["gender", "clean"]).join(b, ["gender", "clean2"]).where((F.col("clean") != F.col("clean2")) | (F.col("a") < F.col("b")))
    gap = F.abs(F.col("age_a") - F.col("age_b"))
    score = lambda name, gap: F.round(NAME_WEIGHT * name + AGE_WEIGHT * age_score(gap), 4)
    j = j.withColumn("score", score(F.col("name_score"), gap)).where((F.col("score") >= MIN_SCORE) & (gap.isNull() | (gap <= MAX_GAP)))
    between = j.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", (F.col("n_a") * F.col("n_b")).cast("double").alias("pairs"))
    same = F.col("clean").eqNullSafe(F.col("c2")) & (F.col("gender") == F.col("g2")) & F.col("age").eqNullSafe(F.col("age2"))
    one = groups.select("g", F.col("clean").alias("c2"), F.col("gender").alias("g2"), F.col("age").alias("age2"), "n")
    inside = p.join(one, same).where("id <> g").select(F.col("g").alias("a"), F.col("id").alias("b"), score(F.lit(1.0), F.col("age") - F.col("age")).alias("score"), (F.col("n") / 2).alias("pairs"))
    return between.unionByName(inside.where(F.col("score") >= MIN_SCORE)).distinct()


def candidates(people: DataFrame, min_size: int = 2) -> DataFrame:
    """``cluster, id, band, members, confidence``: components cut into bands of ages, a
    new band where an age is more than ``BAND`` above its band's first. Members without an
    age join the last band. Bands are folded per distinct age, not per person."""
    links = materialize(linked_pairs(people))
    comp = connected_components(links, "a", "b")
    m = comp.join(people.select("id", "age"), comp["node"] == F.col("id")).select("component", "id", "age")
    ages = m.where("age is not null").groupBy("component").agg(F.array_sort(F.collect_set("age")).alias("ages"))
    start = F.struct(F.lit(None).cast("int").alias("first"), F.lit(-1).alias("band"), F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("of"))

    def step(s, x):
        new = s["first"].isNull() | (x - s["first"] > BAND)
        band = F.when(new, s["band"] + 1).otherwise(s["band"])
        return F.struct(F.when(new, x).otherwise(s["first"]).cast("int").alias("first"), band.cast("int").alias("band"), F.map_concat(s["of"], F.create_map(x.cast("int"), band.cast("int"))).alias("of"))

    folded = ages.select("component", F.aggregate(F.transform("ages", lambda x: x.cast("int")), start, step).alias("f"))
    banded = m.join(folded, "component", "left").select("component", "id", F.coalesce(F.element_at("f.of", F.col("age").cast("int")), F.col("f.band"), F.lit(0)).alias("band"))
    own = links.join(banded.select(F.col("id").alias("a"), F.col("component").alias("ca"), F.col("band").alias("ba")), "a").join(banded.select(F.col("id").alias("b"), F.col("band").alias("bb")), "b").where("ba = bb")
    # scores have four decimals and pairs are halves: whole numbers are summed, so a mean does not
    # depend on the order; it is rounded as SQL engines round doubles, after scaling
    own = own.select(F.col("ca").alias("component"), F.col("ba").alias("band"), F.round(F.col("score") * 10000).cast("decimal(5,0)").alias("points"), F.round(F.col("pairs") * 2).cast("decimal(19,0)").alias("halves"))
    conf = own.groupBy("component", "band").agg(F.sum(F.col("points") * F.col("halves")).cast("double").alias("points"), F.sum("halves").cast("double").alias("halves"))
    conf = conf.select("component", "band", (F.round(F.col("points") / 20000 / (F.col("halves") / 2) * 1000) / 1000).alias("confidence"))
    size = banded.groupBy("component", "band").agg(F.count("*").alias("members")).where(F.col("members") >= min_size)
    return banded.join(size, ["component", "band"]).join(conf, ["component", "band"]).select(F.concat_ws("-", F.lit("id"), "component", "band").alias("cluster"), "id", "band", "members", "confidence")


def similar_people(people: DataFrame, name: str, age: int | None = None, gender: str | None = None, limit: int = 50, partial: bool = False, min_name: float = 0.5) -> DataFrame:
    """The best matches of one query, over distinct names."""
    p = cleaned(people)
    asked = " ".join("".join(c if c.isascii() and (c.isalpha() or c == " ") else " " for c in name.lower()).split())
    names = materialize(p.select("clean").distinct())
    typed, told = asked.split(), F.split("clean", " ")
    # each distinct token is scored once; only names that hold a good one for every typed
    # fragment, or whose given name is good, are scored whole
    if partial:
        words = materialize(names.select("clean", F.explode(told).alias("token")))
        distinct = words.select("token").distinct()
        for t in typed:
            good = distinct.where(fragment_match(F.lit(t), F.col("token")) >= FRAGMENT)
            names = names.join(words.join(good, "token", "left_semi").select("clean").distinct(), "clean", "left_semi")
    elif typed:
        names = names.withColumn("token", F.get(told, F.lit(0)))
        good = names.select("token").distinct().where(token_match(F.lit(typed[0]), F.col("token")) >= COUNTERPART)
        names = names.join(good, "token", "left_semi").drop("token")
    scorer = partial_similarity if partial else name_similarity
    s = names.withColumn("name_score", scorer(F.lit(asked), F.col("clean"))).where(F.col("name_score") >= min_name)
    j = p.join(s, "clean")
    if gender:
        j = j.where((F.col("gender") == gender) | F.col("gender").isNull())
    score = F.col("name_score")
    if age is not None:
        gap = F.abs(F.col("age") - age)
        j = j.where(gap.isNull() | (gap <= MAX_GAP))
        score = F.when(gap.isNull(), F.col("name_score")).otherwise(NAME_WEIGHT * F.col("name_score") + AGE_WEIGHT * age_score(gap))
    return j.select("id", "name", "age", "gender", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
