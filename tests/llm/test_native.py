import datetime as dt
import re

from pyspark.sql import functions as F

from stratalens.llm import license_scan as S, queries as Q, url_filter as U


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_scan(text, templates=S.TEMPLATES):
    w = words(text)
    base = sorted((p, lab) for ph, lab in S.PHRASES.items() for p in range(len(w)) if w[p : p + len(ph.split())] == ph.split())
    best = {}
    for lab, sentence in templates:
        t = set(sentence.split())
        if not t:
            continue
        size = next(n for n in (8, 32, 128, 512, 2048, 8192) if len(sentence.split()) <= n // 2)
        for i in range(0, max(1, len(w) - size // 2), size // 2):
            got = len(set(w[i : i + size]) & t)
            if got >= 0.8 * len(t) - 1e-9:
                best[lab] = max(best.get(lab, 0), got / len(t))
    labels = {lab for _, lab in base}
    return (len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | set(best))), 1.0 if base else max(best.values(), default=0.0))


TEXTS = [None, "", " \n..", "Released under the MIT License.", "under the mit license under THE mit-license UNDER the mit licenseX", "cc by nc", "CC BY-NC 4.0 and Apache License, Version 2.0 cc by nc", "x" * 200_000 + " cc by nc", "All rights reserved.\nrights all reserved", "This work is under the GNU General Public License, version 3.", "Kennst under the mİt license", "permission granted free of charge any person obtaining copy of this software and associated documentation", "Éa under the mit license éb", "a\x00under the mit license"]


def test_license_scan_against_brute_force(spark):
    rows = [(i, t, 1.0) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], 0.0), (3, TEXTS[3], 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = S.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = slow_scan(TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[3])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want, r
    assert S.scan(df.where("1 = 0")).count() == 0
    plan = S.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_templates_of_any_length(spark):
    """600 of up to 2,000 words, by joins; one of 70 words as literals."""
    import random

    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(6000)]
    templates = [(f"l{k % 40}", " ".join(r.choices(vocabulary, k=r.choice((2, 5, 20, 70, 300, 2000))))) for k in range(600)] + [("none", "")]
    texts = [None, "", "w1 w2"]
    for k in range(30):
        _, sentence = r.choice(templates[:600])
        own = [w for w in sentence.split() if r.random() > r.choice((0, 0.1, 0.25))]
        texts.append(" ".join(r.choices(vocabulary, k=r.choice((0, 7, 90))) + own + r.choices(vocabulary, k=50)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string")
    for t, some in ((templates, df), ([("long", " ".join(vocabulary[:70])), ("x", "w1 w2")], df)):
        got = S.scan(some, templates=t)
        assert all((x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score) == slow_scan(texts[x.doc_id], t) for x in got.collect())
        assert got.where("labels <> ''").count() >= 1 and not re.search("Python|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_wrapped_and_unwrapped_notices(spark):
    import random
    import textwrap

    r = random.Random(2)
    filler = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "all", "the", "rights"]) for _ in range(n))
    rows = []
    for k, (label, sentence) in enumerate(S.TEMPLATES):
        for n in (0, 3, 17, 61):
            text = f"{filler(n)} {sentence.capitalize()}. {filler(40)}"
            rows.append((label, "\n * ".join(textwrap.wrap(text, 40)) if n % 2 else text))
    rows += [("", "all " + filler(0) + "x " * 9 + "rights " + "x " * 9 + "reserved"), ("", filler(500))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for x in S.scan(df).collect():
        label, text = rows[x.doc_id]
        assert (label in x.labels.split(",")) and (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score) == slow_scan(text), x


def test_scan_equals_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    for name in ("op7_license_scan", "op2_url_filter"):
        df = Q.QUERIES[name](spark, d)
        sql = duckdb.sql(f"SELECT {', '.join(df.columns)} FROM ({Q.ORACLE_SQL[name]})").fetchall()
        key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
        assert key(df.collect()) == key(sql)


def at(day):
    return dt.datetime(2024, 1, day)


def test_validity_of_dated_entries(spark):
    entries = [("a", "Ads.Example.com", "add", at(3)), ("a", "ads.example.com", "add", at(3)), ("a", "ads.example.com", "add", at(5)), ("a", "ads.example.com", "remove", at(8)), ("a", "ads.example.com", "add", at(8)), ("b", "example.com", "add", at(1)), ("b", "example.com", "remove", at(4)), ("c", "other.org/x", "add", at(2)), ("c", None, "add", at(1)), ("c", "other.org", "add", None), ("c", "other.org", "bogus", at(1))]
    e = spark.createDataFrame(entries, "list_name string, pattern string, action string, at timestamp_ntz")
    asks = [(1, "http://u@WWW.ads.example.com:80/p?q", d) for d in (2, 3, 5, 7, 8, 9)] + [(2, "https://example.com", 3), (2, "https://example.com", 4), (3, "http://other.org/x/y#z", 3), (4, "http://other.org/xx", 3), (5, None, 3), (6, "", 3), (7, "mailto:x", 3), (1, "http://u@WWW.ads.example.com:80/p?q", 3)]
    c = spark.createDataFrame([(k, u, at(d), "x") for k, u, d in asks] + [(8, "https://example.com", None, "x")], "page_id long, url string, fetched_at timestamp_ntz, list_name string")
    got = {(r.page_id, r.fetched_at.day if r.fetched_at else None): (r.n_active, r.lists) for r in U.filter_urls(c, e, "page_id").collect()}
    assert got == {(1, 2): (1, "b"), (1, 3): (2, "a,b"), (1, 5): (1, "a"), (1, 7): (1, "a"), (1, 8): (0, ""), (1, 9): (0, ""), (2, 3): (1, "b"), (2, 4): (0, ""), (3, 3): (1, "c"), (4, 3): (0, ""), (5, 3): (0, ""), (6, 3): (0, ""), (7, 3): (0, ""), (8, None): (0, "")}
    assert U.filter_urls(c, e, "page_id").count() == len(asks) + 1
    assert U.filter_urls(c, e.where("1 = 0"), "page_id").where("blocked").count() == 0
    assert U.filter_urls(c.where("1 = 0"), e, "page_id").count() == 0


def test_long_urls_and_addresses(spark):
    e = spark.createDataFrame([("a", "x.org/1/2", "add", at(1)), ("a", "3.4", "add", at(1)), ("a", "1.2.3.4", "add", at(1)), ("a", "b.c.x.org", "add", at(1))], "list_name string, pattern string, action string, at timestamp_ntz")
    long = "/".join(map(str, range(1, 50_000)))
    urls = [f"http://x.org/{long}", "http://1.2.3.4/a", "http://0.1.3.4/a", f"http://{'q.' * 50_000}b.c.x.org", "http://a.b.c.x.org/1/2", "http://x.org/1//2/3"]
    c = spark.createDataFrame([(i, u, at(2)) for i, u in enumerate(urls)], "page_id long, url string, fetched_at timestamp_ntz")
    assert {r.page_id: r.n_active for r in U.filter_urls(c, e, "page_id").collect()} == {0: 1, 1: 1, 2: 0, 3: 1, 4: 1, 5: 1}


def test_addresses_of_version_6_rooted_names_and_empty_tables(spark):
    e = spark.createDataFrame([("a", "[2001:DB8::1]", "add", at(1)), ("a", "ex.com.", "add", at(1)), ("a", "[2001", "add", at(1)), ("a", "dir.org./a", "add", at(1))], "list_name string, pattern string, action string, at timestamp_ntz")
    urls = ["http://[2001:db8::1]/a", "http://u@[2001:db8::1]:80", "http://[2001:ffff::9]/b", "http://ex.com/", "http://www.ex.com.", "http://ex.com../x", "http://dir.org/a/b", "http://dir.org./A"]
    c = spark.createDataFrame([(i, u, at(2)) for i, u in enumerate(urls)], "page_id long, url string, fetched_at timestamp_ntz")
    assert {r.page_id: r.n_active for r in U.filter_urls(c, e, "page_id").collect()} == {0: 1, 1: 1, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    assert U.filter_urls(c.limit(0), e.limit(0), "page_id").collect() == [] and S.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_queries_find_something(spark):
    d = "/root/testdata/sf0.001"
    assert Q.op2_url_filter(spark, d).agg(F.sum("n_active")).first()[0] > 0
    assert Q.op7_license_scan(spark, d).where("labels <> ''").count() > 0
