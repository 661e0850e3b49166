import random

import pytest

from stratalens.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = P.path("word_bpe_49k.json")
    return tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(bpe.Vocabulary.load(path)), path


TEXTS = [None, "", " \n", "Hello the IT'S we'll<|endoftext|>x<|startoftext|>", "Σας ΑΣ ǅ İstanbul é é 12ab!!…", "a\x1cb\x85c d​e　f", "ﬁ ½ ² Ⅷ 中文字 ไทย हिन्दी 🎉🎉 \U0001f468‍\U0001f469", "don't DON'T 'tis ''s", "x" * 3000, "<|endoftext|", "K Å ﻿"]


def test_same_as_the_library(pair):
    lib, own, _ = pair
    r = random.Random(2)
    chars = "abcdefgh ETAOIN'stre123  \n\t.,!?-éüßñçÉ"
    texts = TEXTS + ["".join(r.choice(chars) for _ in range(r.randint(1, 200))) for _ in range(300)] + ["".join(chr(r.choice([r.randint(32, 0x2FF), r.randint(0x370, 0x1FFF), r.randint(0x2000, 0x33FF)])) for _ in range(12)) for _ in range(300)]
    for t in texts:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == want, t
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_query_over_rows(spark, pair):
    lib, own, path = pair
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(0, "twice", 0), (0, "twice", 0), (None, "no id", 0)], "doc_id long, text string, ids int")
    got = bpe.encode_decode(df, path)
    assert got.columns == ["doc_id", "ids", "decoded"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        assert own.decode(r.ids) == r.decoded
    assert [r.decoded for r in bpe.decode(got.drop("decoded"), path).orderBy("doc_id").collect()] == [r.decoded for r in got.orderBy("doc_id").collect()]
    assert bpe.encode_decode(df.where("1 = 0"), path).count() == 0


def test_files_that_ask_for_more_are_refused(tmp_path, pair):
    import json

    spec = bpe.Vocabulary.load(pair[2])
    for change in ({"decoder": {"type": "ByteLevel"}}, {"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"unk_token": "x"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="not supported"):
            bpe.Vocabulary.load(str(tmp_path / "t.json"))


def test_decoding_does_not_overwrite(spark, pair):
    df = spark.createDataFrame([(1, [1, 2], "mine")], "doc_id long, ids array<int>, decoded string")
    with pytest.raises(ValueError):
        bpe.decode(df, pair[2])
