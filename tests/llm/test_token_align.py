"""Alignment of two tokenizers against whole texts, encoded by the libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from stratalens.llm import token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


def plain(docs):
    """Without segments: each text whole; then counts over all links."""
    tools = token_align.Tokenizers(A, B)
    found, counts = [], Counter()
    for doc_id, text in docs:
        whole = (" " + (text or "")).encode()
        a = tools.a.encode(whole.decode(), add_special_tokens=False).ids if text else []
        b = tools.b.encode(text) if text else []
        ends, place = {}, 0
        for i, t in enumerate(a):
            place += len(tools.bytes_a[t])
            ends[place] = i
        groups, links, place, i, j = [], [], 0, 0, 0
        if text and b"".join(tools.bytes_a[t] for t in a) == whole == b"".join(tools.bytes_b[t] for t in b):
            for k, t in enumerate(b):
                place += len(tools.bytes_b[t])
                if place in ends:
                    groups.append(",".join(map(str, a[i : ends[place] + 1])) + "|" + ",".join(map(str, b[j : k + 1])))
                    links.append((a[ends[place]], t))
                    i, j = ends[place] + 1, k + 1
        else:
            a = b = []
        counts.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    top = {}
    for (_, t), n in counts.items():
        top[t] = max(top.get(t, 0), n)
    return [(d, a, b, len(g), len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), ";".join(g)) for d, a, b, g, ls in found]


TEXTS = [
    "Hello world", " leading and  double   blanks ", "tabs\tand\nlines \n \n here", "Straße, naïve 東京 日本語 🎉🎉 é", "<|endoftext|> <s> </s> <unk> <0x41>", "x", " ", "   ", "\n", "\n ", "a  b　 c   d",
    "it's we'll 12345 67.89%", "def f(x):\n    return  x+1\n", None, "", "mark ▁ inside", "▁", "nul \x00 and \x1c here  \x85 there", "don't  stop" * 50, "abcdefghij" * 300, "word " * 500, "a  " * 300, "ﬁ Å ½ ²",
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("chunk", [token_align.CHUNK_BYTES, 64])
def test_same_as_whole_texts(spark, chunk):
    docs = list(enumerate(TEXTS + TEXTS[:5]))
    got = token_align.align(spark.createDataFrame(docs, DOCS).repartition(3), A, B, chunk_bytes=chunk)
    assert rows(got) == sorted(plain(docs), key=str)
    assert rows(got)[0][1] > 0


def test_counts_by_a_join_where_they_are_too_many_to_look_up(spark, monkeypatch):
    monkeypatch.setattr(token_align, "LOOKED_UP", 1)
    docs = list(enumerate(TEXTS))
    assert rows(token_align.align(spark.createDataFrame(docs, DOCS), A, B)) == sorted(plain(docs), key=str)


def test_packed_numbers_come_back():
    import numpy as np

    x = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 2**31, 2**35, 2**62, 5])
    data, ends = token_align.packed(x)
    assert token_align.unpacked(data.tobytes()).tolist() == x.tolist() and ends[-1] == len(data)
    assert token_align.unpacked(b"").tolist() == []


def test_cuts_lose_nothing_and_stand_before_blanks():
    for t in filter(None, TEXTS):
        found = token_align.segments(t)
        assert "".join(found) == " " + t and all(s[0] == " " for s in found)
        assert all(not s[-1].isspace() for s in found[:-1])


def test_vocabularies_that_reach_over_a_cut_are_refused(tmp_path):
    import json

    spec = json.load(open(A))
    spec["model"]["vocab"]["aĠb"] = 50300
    (tmp_path / "a.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="reach over"):
        token_align.Tokenizers(str(tmp_path / "a.json"), B)
    spec = json.load(open(A)) | {"normalizer": {"type": "NFC"}}
    (tmp_path / "b.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="normaliser"):
        token_align.Tokenizers(str(tmp_path / "b.json"), B)


def test_repeats_null_ids_empty_table_and_other_columns(spark):
    docs = [(1, "one two"), (1, "one two"), (None, "one two"), (2, None)]
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS chunk", "2 AS segment", "3 AS n", "4 AS t")
    got = rows(token_align.align(d, A, B))
    assert got == sorted(plain(docs), key=str) and got[0][6] == got[0][3] * 3
    assert token_align.align(spark.createDataFrame([], DOCS), A, B).collect() == []


def test_query_on_a_whole_table(spark):
    from stratalens.llm import queries
    from stratalens.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = sorted((*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in plain(docs))
    assert sorted(map(tuple, queries.QUERIES["op13_tokenizer_alignment"](spark, sf).collect())) == want
