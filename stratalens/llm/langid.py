"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Features are hashed n-grams of one to three characters over the letters of the whole text
(other characters count as one blank). Document frequencies come from every training row,
as per-task count vectors that are summed by Spark. The weights are learned on the driver by
follow-the-regularised-leader (proximal, per-coordinate rates, L1 and L2) on a sample of
at most about ``SAMPLE`` texts a language, none longer than ``SAMPLE_CHARS`` characters;
a fifth of the sample is kept apart to fit the temperature of the softmax. What is broadcast
is the model: ``DIM`` x languages numbers, whatever the input's size.

Null texts and texts without a letter are ``und`` with score 1. Rows without a language are
not learned from. Without any training row every text is ``und``, with score 0 where it
has a letter. Repeated rows and ties: the first language in sorted order. Extra columns
stay; one of the name of a result raises an error. Languages come to the driver, one row each.
A very long text is predicted whole, in memory of a few times its size, in its task alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches

DIM, SAMPLE, SAMPLE_CHARS, EPOCHS = 1 << 15, 600, 20_000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3

_fold: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Lower-case letter of each code point of the first plane, 32 for what is no letter."""
    if not _fold:
        _fold.append(np.array([(ord(chr(c).lower()[0]) if chr(c).isalpha() else 32) for c in range(1 << 16)], np.uint32))
    return _fold[0]


def grams(text: str) -> np.ndarray:
    """Hashed n-grams (with repeats) of a text; empty if it has no letter."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _table()
    if len(cp) and cp.max() >= 1 << 16:
        far = cp >= 1 << 16
        c = np.where(far, 32, table[np.where(far, 32, cp)])
        for v in np.unique(cp[far]):
            if chr(v).isalpha():
                c[cp == v] = v
    else:
        c = table[cp]
    blank = c == 32
    if blank.all():
        return np.zeros(0, np.int64)
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # one blank after each word
    c = np.concatenate(([32], c[keep], [32])).astype(np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ np.uint32(0x9E3779B9)) * np.uint32(31) + c[1:] * np.uint32(40503)
    three = (two[:-1] ^ np.uint32(0x7F4A7C15)) * np.uint32(37) + c[2:] * np.uint32(2246822519)
    h = np.concatenate((one, two, three))
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return (h >> np.uint32(17)).astype(np.int64)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    g = grams(text)
    if not len(g):
        return None
    n = np.bincount(g, minlength=DIM)
    at = np.flatnonzero(n)
    x = (1 + np.log(n[at])) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray | None:
        f = features(text, self.idf)
        return None if f is None else f[1] @ self.weights[f[0]]

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text or "")
        if z is None:
            return "und", 1.0
        if not self.langs:
            return "und", 0.0
        p = softmax(z / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, seed: int = 7) -> np.ndarray:
    """FTRL-proximal over one example at a time; returns the sparse weights."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    return weights(z, n)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The softmax temperature with the least log loss, by golden section over its log."""

    def loss(t):
        p = softmax(z / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Over every row of ``train`` (text t): each task sums its own vector."""

    def run(batches):
        df, n = np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                g = grams(t or "")
                df[:-1] += np.bincount(g, minlength=DIM) > 0
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["gram", "n"])

    out = np.zeros(DIM + 1, np.int64)
    for r in train.select("t").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return out[:-1], int(out[-1])


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """``train``: the rows to learn from; those without a language are left out."""
    rows = train.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("y"), F.col(key).cast("string").alias("k"))
    df, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], idf, np.zeros((DIM, 0)))
    # by a hash of the key, with a rate for each language: no order, no shuffle
    rate = F.element_at(F.create_map(*(x for c in langs for x in (F.lit(c), F.lit(min(1.0, sample / counts[c]))))), F.col("y"))
    drawn = rows.where((F.char_length("t") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64(F.lit("lang"), "k"), F.lit(1 << 20)) < rate * (1 << 20)))
    found = sorted((r["k"] or "", r["y"], r["t"]) for r in drawn.collect())
    x, y = [], []
    for _, c, t in found:
        if (f := features(t, idf)) is not None:
            x.append(f)
            y.append(langs.index(c))
    y = np.array(y, np.int64)
    kept = [i for i in range(len(x)) if i % 5 == 4 and len(x) >= 25]
    used = sorted(set(range(len(x))) - set(kept))
    w = ftrl([x[i] for i in used], y[used], len(langs)) if used else np.zeros((DIM, len(langs)))
    t = temperature(np.array([x[i][1] @ w[x[i][0]] for i in kept]), y[kept]) if kept else 1.0
    return Model(langs, idf, w.astype(np.float32), t)


def predict(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns."""
    taken = {c.lower() for c in docs.columns} & {lang_pred.lower(), score.lower()}
    if taken:
        raise ValueError(f"rename the columns {sorted(taken)} first")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn(lang_pred, F.lit(None).cast("string")).withColumn(score, F.lit(None).cast("double"))
    names, at = out.columns, out.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names)

    return map_batches(out, run, out.schema, text)
