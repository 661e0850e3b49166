import math
import random
import re
import zlib

import numpy as np

from stratalens.llm import langid as L, queries as Q, toxicity as X

SYL = {"en": "the ing tion er and st".split(), "de": "der ung keit sch ein ü".split(), "fr": "eau tre qui é oi ment".split()}
BAD = ["idiot", "moron", "lowei", "vequ"]


def corpus(n=600, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = r.choice(list(SYL))
        words = ["".join(r.choice(SYL[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 120))]
        toxic = r.random() < 0.25
        for _ in range(2 * toxic):
            bad = r.choice(BAD)
            words.insert(r.randrange(len(words)), bad if bad in ("idiot", "moron") else bad + r.choice(SYL[lang]))
        docs.append((i, " ".join(words).capitalize() + ".", lang if i % 7 else None, "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = corpus()
    extra = [(9001, None, "en", ""), (9002, "", "en", ""), (9003, " 12 !? ", "en", ""), (9004, "the and " * 90_000, "en", ""), (5, docs[5][1], "en", "")]
    write(spark, tmp_path, docs + extra, labels + [(9004, 0, None), (9005, 0, 1)])
    got = Q.op8_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) + len(extra)
    true = {i: max(SYL, key=lambda c: sum(t.lower().count(x) for x in SYL[c])) for i, t, *_ in docs}
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == true[r.doc_id] for r in held]) > 0.97
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id > 9000} == {9001: "und", 9002: "und", 9003: "und", 9004: "en"}
    got = Q.op9_toxicity(spark, str(tmp_path)).collect()
    y = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) for r in got) and len(got) == len(docs) + len(extra)


def test_nothing_to_learn_from(spark, tmp_path):
    docs, _ = corpus(9)
    write(spark, tmp_path, [(i, t, None, "") for i, t, *_ in docs], [])
    assert {(r.lang_pred, r.score) for r in Q.op8_language_id(spark, str(tmp_path)).collect()} == {("und", 0.0)}
    assert {(r.predicted, r.score) for r in Q.op9_toxicity(spark, str(tmp_path)).collect()} == {(0, 0.0)}
    write(spark, tmp_path / "e", [], [])
    assert Q.op8_language_id(spark, f"{tmp_path}/e").count() == 0 and Q.op9_toxicity(spark, f"{tmp_path}/e").count() == 0


def test_temperature_and_ftrl():
    z = np.array([[4.0, 0], [0, 4], [4, 0], [0, 4]] * 20)
    y = np.array([0, 1, 1, 1] * 20)
    t = L.temperature(z, y)
    grid = np.exp(np.linspace(-3, 3, 601))
    loss = [-np.log(L.softmax(z / g)[np.arange(80), y]).mean() for g in grid]
    assert abs(np.log(t) - np.log(grid[int(np.argmin(loss))])) < 0.02
    rows = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0]))] * 30
    w = L.ftrl(rows, np.array([0, 1] * 30), 2)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and not w[2:].any()


def slow_score(m, text):
    """The score from its definition: every window by itself, with compressors of its own."""
    words = [w[:24] + bytes(b ^ 0x80 for b in w[:24]) for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]

    def shorter(found):
        w = X.CARRIER + b"".join(b" " + v for v in found) + X.TAIL
        a, b = (len(X.compressor(own + m.common + X.CARRIER).compress(w)) for own in (m.ordinary, m.toxic))
        return a - b

    fine, coarse = [], []
    for i in range(0, len(words), 7):
        if i and len(words) - i < 2:
            break
        found = words[i : i + 8]
        coarse.append(shorter(found))
        if coarse[-1] >= 2:
            fine += [shorter(found[k : k + 2]) for k in range(max(1, len(found) - 1))]
    x = []
    for d, seen in ((coarse, len(coarse)), (fine, max(1, len(words) - 1) if words else 0)):
        n = [sum(k >= t for k in d) for t in (1, 2, 3, 4, 5, 6, 8, 10, 12)]
        x += [math.log1p(k) for k in n] + [math.log1p(1000 * k / max(20, seen)) / 2 for k in n] + [min(k, 3) / 2 for k in n] + [sum(d) / max(1, seen), math.log1p(seen) / 8, 1.0]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, m.coef))))


def test_scores_equal_windows_one_by_one(monkeypatch):
    docs, labels = corpus(400, 3)
    m = X.fit_texts([t for _, t, *_ in docs], [y for *_, y in labels])
    s = m.scorer()
    texts = [t for _, t, *_ in corpus(12, 8)[0]] + [None, "", "one", "a b c d e", "idiot " * 9, "idiot moron " * 4, "a b c d e f g idiot", "a b c d e f g h idiot"]
    for piece in (X.PIECE, 14):
        monkeypatch.setattr(X, "PIECE", piece)
        for t in texts:
            assert abs(s.score(t) - slow_score(m, t)) < 1e-9, t
    assert s.score(None) == s.score("") < 0.5
    assert len(L.grams("é")) and not len(L.grams("12 　")) and len(L.grams("\U00010400"))


def test_dictionaries_come_from_the_trainer(monkeypatch):
    """Each of windows of two words of its class's texts, and of nothing else."""
    docs, labels = corpus(400, 3)
    made, real = {}, X.zs.train_dictionary
    monkeypatch.setattr(X.zs, "train_dictionary", lambda size, samples, **k: (d := real(size, samples, **k), made.__setitem__(d.as_bytes(), samples))[0])
    m = X.fit_texts([t for _, t, *_ in docs], [y for *_, y in labels])
    pairs = {c: {b" ".join(w[i : i + 2]) for (_, t, *_), (*_, y) in zip(docs, labels) if y == c for w in [X.written(t)] for i in range(len(w) - 1)} for c in (0, 1)}
    for c, content in ((0, m.ordinary), (1, m.toxic), (0, m.common)):
        samples = next(v for k, v in made.items() if k.endswith(content))
        assert content and len(samples) > 10 and all(s[1:] in pairs[c] for s in samples)
    assert all(len(s[1:].split(b" ")) == 2 for v in made.values() for s in v)


def test_too_little_to_train_on():
    assert X.fit_texts(["one", "two words"], [0, 1]) == X.Model() and X.Model().scorer().score("one") == 0.0
    docs, labels = corpus(60, 3)
    m = X.fit_texts([t for _, t, *_ in docs], [y for *_, y in labels])
    assert not m.coef or len(m.toxic) < X.SIZE


def test_two_signs_in_a_text_and_endings_that_were_not_learned():
    """Signs are caught, with other endings in part; ordinary texts stay."""
    docs, labels = corpus(600, 5)
    s = X.fit_texts([t for _, t, *_ in docs], [y for *_, y in labels]).scorer()
    r, right, ended, false = random.Random(6), 0, 0, 0

    def caught(words, *signs):
        words = list(words)
        for sign in signs:
            words.insert(r.randrange(len(words)), sign)
        return s.score(" ".join(words)) >= X.THRESHOLD

    for _, t, *_ in corpus(150, 7)[0]:
        words = [w for w in t.split() if not any(b in w.lower() for b in BAD)]
        false += caught(words)
        right += caught(words, r.choice(BAD[:2]), r.choice(BAD[:2]))
        ended += caught(words, r.choice(BAD) + "qz", r.choice(BAD) + "vo")
    assert right > 0.9 * 150 and ended > 0.2 * 150 and false < 0.05 * 150


def slow_ftrl(rows, y, classes, order, alpha, beta, l1, l2):
    """Coordinate by coordinate, as published."""
    z, n = {}, {}

    def weight(i, c):
        zi, ni = z.get((i, c), 0.0), n.get((i, c), 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(ni)) / alpha + l2)

    for r in order:
        at, x = rows[r]
        w = {(i, c): weight(i, c) for i in at for c in range(classes)}
        logits = [sum(v * w[i, c] for i, v in zip(at, x)) for c in range(classes)]
        e = [math.exp(v - max(logits)) for v in logits]
        for i, v in zip(at, x):
            for c in range(classes):
                g = v * (e[c] / sum(e) - (y[r] == c))
                before = n.get((i, c), 0.0)
                z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[i, c]
                n[i, c] = before + g * g
    return weight


def test_ftrl_equals_the_plain_form_and_is_sparse():
    r = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(40):
        at = np.sort(r.choice(50, 6, replace=False))
        rows.append((at, r.random(6)))
        y.append(int(at[0] % 3))
    for l1 in (1e-4, 0.3):
        draw = np.random.default_rng(7)
        order = [i for _ in range(2) for i in draw.permutation(len(rows))]
        want = slow_ftrl(rows, y, 3, order, 0.5, 1.0, l1, 1e-3)
        got = L.ftrl(rows, np.array(y), 3, epochs=2, l1=l1)
        assert np.allclose(got[:50], [[want(i, c) for c in range(3)] for i in range(50)])
        assert not got[50:].any()
    assert (got[:50] == 0).mean() > 0.1


def test_grams_are_those_of_the_letters():
    assert L.grams("Ab").tolist() == L.grams("aB").tolist() and L.grams("ab 12").tolist() == L.grams("ab?!").tolist() and len(L.grams("ab")) == 4 + 3 + 2
    assert set(L.grams("a")) <= set(L.grams("a b")) and len(set(L.grams("the cat")) & set(L.grams("the dog"))) > 5


def test_toxicity_reads_long_words_whole():
    for text in ("x" * 10 + "y" * 40 + "z" * 3, "字" * 30, "short 字字字 " + "0123456789" * 50):
        halves = [w[: len(w) // 2] for w in X.written(text)]
        assert b"".join(halves) == text.replace(" ", "").encode() and max(map(len, halves)) <= X.LONGEST
    assert X.written("plain words") == [w + w.translate(X.OTHER) for w in (b"plain", b"words")]
