import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from stratalens.llm import bpe

from .test_classifiers import corpus
from .test_decontaminate import slow
from .test_simhash import slow_components

pytest.importorskip("public_tokenizers")


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels = corpus(400, 9)
    r = random.Random(1)
    clean = [t for (i, t, *_), (_, _, y) in zip(docs, labels) if not y and len(t) > 250]
    item = " ".join(clean[0].split()[:20])
    more = [(1000, clean[1], "en", "s"), (1001, clean[1] + " the", "en", "s"), (1002, "0 0 ! " * 9, None, "s"), (1003, None, "en", "s"), (1004, item + " " + " ".join(clean[2].split()[:30]), "en", "s"), (1005, clean[3] + " idiot moron idiot", "en", "s")]
    rows = docs + more + [more[0]]
    r.shuffle(rows)
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "nothing that occurs anywhere here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, before, str(tmp_path))
        if k < 4:
            assert out.columns == before.columns
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before.collect(), after.collect())
        before = after
    a, b = seen["language_id"]
    ids = lambda rows: [x.doc_id for x in rows]
    assert {1002, 1003} == set(ids(a)) - set(ids(b))
    a, b = seen["toxicity"]
    toxic = {i for i, _, y in labels if y} | {1005}
    gone = set(ids(a)) - set(ids(b))
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) < 5
    a, b = seen["simhash_near_dedup"]
    want = slow_components([(x.doc_id, x.text) for x in {x.doc_id: x for x in a}.values()])
    assert sorted(ids(b)) == sorted({want[i] for i in ids(a)})
    a, b = seen["benchmark_decontamination"]
    bad = set()
    for x in a:
        n, hit, _ = slow(x.text, [(1, item), (2, "nothing that occurs anywhere here")])
        if hit and 20 * hit >= n:
            bad.add(x.doc_id)
    assert set(ids(a)) - set(ids(b)) == bad and bad
    a, b = seen["bpe_encode_decode"]
    v = bpe.Vocabulary(bpe.Vocabulary.load(C.queries.tokenizer_path()))
    assert {x.doc_id: x.n_tokens for x in b} == {x.doc_id: len(v.encode(x.text)) for x in a}
    got = C.run(spark, str(tmp_path))
    assert sorted(ids(got.collect())) == sorted(ids(b))


def test_near_dedup_keeps_one_row_of_each_group(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    a, b = " ".join(long * 3), " ".join(long[::-1] * 3)
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (None, b, "k"), (None, "only here " * 9, "k"), (None, "only here " * 9, "l"), (3, None, "n"), (4, "", "n"), (5, " ".join(long[5:] + long[:5]), "p"), (5, " ".join(long[5:] + long[:5]), "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key_ string").withColumn("_fp", F.lit(1))
    got = C.near_dedup(spark, df, "")
    assert got.columns == df.columns
    seen = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    assert seen == sorted([(1, a), (1, b), (0, "only here " * 9), (3, ""), (5, rows[-1][1])])
    again = C.near_dedup(spark, df.repartition(3), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, got.collect()))
    assert C.near_dedup(spark, df.where("false"), "").count() == 0


def test_stages_keep_clashing_columns(spark, tmp_path):
    docs, labels = corpus(90, 4)
    names = ["said_lang", "_lang", "_score", "n_words", "matches", "items", "n_hit", "contaminated", "fp", "key"]
    df = spark.createDataFrame([(i, t, c, *names) for i, t, c, _ in docs], f"doc_id long, text string, lang string, {', '.join(f'{n} string' for n in names)}")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing that occurs anywhere here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in C.STAGES[:4]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        assert {tuple(r)[3:] for r in out.collect()} == {tuple(names)}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
