"""Toxicity by compression distance.

Every dictionary is made by zstandard's own trainer, from windows of two words. Two of them
stand for the classes: one is trained on windows of toxic texts, one on windows of ordinary
texts; behind both stands a common one of ordinary language, so that what has nothing to do
with the class compresses to the same length with either. Windows are compressed with both;
what tells is by how many bytes the toxic dictionary is shorter.

The trainer keeps what is frequent, and most of a toxic text is ordinary language. So its
samples are mined: texts are dealt to ``FOLDS``; in each of ``ROUNDS`` a fold's windows are
compressed with the dictionaries of the other folds, and only those that the toxic one
shortens more than it does nearly all ordinary windows are samples of the next round.
Ordinary windows that are shortened so too are samples of the ordinary trainer, beside some
of the rest. A window counts once a text and in the first ``REPEATS`` texts that hold it, so
copies do not lead. A round that leaves the trainer too few is the last, and not used.

Words are runs of ASCII letters, digits and non-ASCII characters; one of more than ``LONGEST``
bytes counts as so many words of at most that length, so that no byte is left out. Each is written twice, the second time in another alphabet: a word that a dictionary holds is still
one match, one that it does not hold costs its letters twice, so bytes of length tell more. A
window stands behind a fixed carrier that all dictionaries hold and before a tail, since
zstandard stores short blocks uncompressed and starts no match in the last 8 bytes.

A text is asked in windows of ``COARSE`` words that share one word with the next. Those that
the toxic dictionary shortens by ``CUT`` bytes or more are asked again in their windows of two
words. How many windows of either kind lie beyond each of ``BOUNDS``, how often, and the sums
of differences go into a logistic regression. It is fitted on the folds' differences, which come from
dictionaries that have not seen the text, with weights that undo the sample's rates; its
probability is the score, and 0.7 the threshold. Sizes, rounds and cuts were chosen by the
errors on the folds of the learning rows, not on held-out texts.

The sample is bounded: about ``SAMPLE`` labelled texts of either label, none longer than
``SAMPLE_CHARS``, drawn by a hash of the id. Prediction reads every word of every whole text;
nothing is shuffled but the labels.

Null and empty texts have no windows and get the score of a text without differences. Null
labels are not learned from. Without toxic or without ordinary rows to learn from, or where the
trainer finds their windows too few even for a dictionary of ``LEAST_BYTES``, every score is 0;
where it only finds them too few for the wanted size, the dictionary is smaller. Repeated rows
score alike; of repeated labels the largest holds. Very long texts are scored in pieces of
``PIECE`` words. Extra columns stay; a column of the name of the result raises an error.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, functions as F

from .common import map_batches
from .decontaminate import words_of

SAMPLE, SAMPLE_CHARS, THRESHOLD = 1500, 20_000, 0.7
FOLDS, LONGEST, COARSE, CUT, FINE = 3, 24, 8, 2, 2
PIECE = (COARSE - 1) << 11  # a piece ends with a window
# bytes of a class's dictionary, and the share of ordinary windows that a toxic one must exceed to be kept
ROUNDS = ((16384, 0.99), (8192, 0.995), (8192, 0.995), (4096, 0.998))
SIZE, COMMON_BYTES, LEAST_BYTES, TRAINER_WINDOWS, REPEATS, SEGMENT, GRAM = 2048, 16384, 256, 60_000, 8, 24, 8
BOUNDS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12])
CARRIER = b"\x01\x02carrier\x03of\x04a\x05window\x06\x07"
TAIL = b" \x08\x0e\x0f\x10\x11\x12\x13\x14\x15\x16"
OTHER = bytes(b ^ 0x80 for b in range(256))
# by the format, what a trained dictionary holds stands behind its three first offsets
OFFSETS = b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00"


class TooFew(ValueError):
    """The trainer finds its samples too few."""


def written(text: str | None) -> list[bytes]:
    """The words, each in both alphabets; a longer one goes on in the next entry."""
    return [w[i : i + LONGEST] + w[i : i + LONGEST].translate(OTHER) for w in words_of(text) for i in range(0, len(w), LONGEST)]


def windows(words: list[bytes], size: int, step: int) -> list[bytes]:
    """All words, the last window shorter; each word stands behind a blank."""
    return [b" " + b" ".join(words[i : i + size]) for i in range(0, max(1, len(words) - size + step), step)] if words else []


def compressor(content: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters(
        format=zs.FORMAT_ZSTD1_MAGICLESS, window_log=17, hash_log=14, chain_log=14, search_log=3, min_match=4, target_length=16, strategy=zs.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=d, compression_params=params)


def trained(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer keeps of at most ``TRAINER_WINDOWS`` drawn windows, in ``size``
    bytes, or in half as many as long as it finds the samples too few."""
    r = random.Random(0)
    samples = r.sample(samples, min(len(samples), TRAINER_WINDOWS))
    while size >= LEAST_BYTES:
        try:
            raw = zs.train_dictionary(size, samples, k=SEGMENT, d=GRAM).as_bytes()
            return raw[raw.index(OFFSETS) + len(OFFSETS) :]
        except (zs.ZstdError, ValueError):
            size //= 2
    raise TooFew(f"{len(samples)} windows")


class Pair:
    """Window lengths under the dictionaries of both classes."""

    def __init__(self, ordinary: bytes, toxic: bytes, common: bytes):
        self.ordinary, self.toxic = (compressor(own + common + CARRIER) for own in (ordinary, toxic))

    def differences(self, found: list[bytes]) -> np.ndarray:
        """Bytes by which each window is shorter with the toxic dictionary."""
        plain, toxic, tail = self.ordinary.compress, self.toxic.compress, TAIL
        return np.array([len(plain(w)) - len(toxic(w)) for w in [CARRIER + w + tail for w in found]], np.int64)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    common: bytes = b""
    coef: list[float] = field(default_factory=list)

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.coef = np.array(model.coef)
        self.pair = Pair(model.ordinary, model.toxic, model.common)

    def features(self, words: list[bytes]) -> np.ndarray:
        """Of a text's coarse windows, and of the fine ones in those that the toxic dictionary
        shortens."""
        n, total, seen, step = np.zeros((2, len(BOUNDS))), [0, 0], 0, COARSE - FINE + 1
        for at in range(0, len(words), PIECE):
            piece = words[at : at + PIECE + FINE - 1]  # windows reach over the end of a piece
            if at and len(piece) < FINE:
                break  # its one word ended the last window already
            coarse = self.pair.differences(windows(piece, COARSE, step))
            seen += len(coarse)
            fine = [w for k in np.flatnonzero(coarse >= CUT).tolist() for w in windows(piece[k * step : k * step + COARSE], FINE, 1)]
            for i, d in enumerate((coarse, self.pair.differences(fine) if fine else coarse[:0])):
                n[i] += (d[:, None] >= BOUNDS).sum(axis=0)
                total[i] += int(d.sum())
        return np.concatenate((features(n[0], total[0], seen), features(n[1], total[1], max(1, len(words) - FINE + 1) if words else 0)))

    def score(self, text: str | None) -> float:
        if not len(self.coef):
            return 0.0
        return float(1 / (1 + math.exp(-max(-40.0, min(40.0, self.features(written(text)) @ self.coef)))))


def features(n: np.ndarray, total: int, seen: int) -> np.ndarray:
    """Windows beyond each bound: how many, their rate, the first three; the mean
    difference, the length, a constant."""
    return np.array([*np.log1p(n), *np.log1p(1000 * n / max(20, seen)) / 2, *np.minimum(n, 3) / 2, total / max(1, seen), math.log1p(seen) / 8, 1.0])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0, ridge: float = 0.3, steps: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Miner:
    """The rounds over a sample in memory; ``kept[i]`` are the windows of text i that are
    samples of the next round."""

    def __init__(self, words: list[list[bytes]], labels: list[int]):
        self.words, y = words, np.array(labels)
        self.texts = {c: np.flatnonzero(y == c).tolist() for c in (0, 1)}
        self.fold = np.zeros(len(words), np.int64)
        for c in (0, 1):
            self.fold[self.texts[c]] = np.arange(len(self.texts[c])) % FOLDS
        met: Counter[bytes] = Counter()
        self.own = []
        for x in words:
            found = list(dict.fromkeys(windows(x, FINE, 1) if len(x) >= FINE else []))  # a text of one word has no window
            met.update(found)
            self.own.append([w for w in found if met[w] <= REPEATS])
        self.kept = self.own
        self.common = trained([w for i in self.texts[0] for w in self.own[i]], COMMON_BYTES)

    def contents(self, fold: int | None, size: int) -> tuple[bytes, bytes]:
        """Ordinary and toxic content, of all folds but one."""
        toxic = [w for i in self.texts[1] if self.fold[i] != fold for w in self.kept[i]]
        fooled = [w for i in self.texts[0] if self.fold[i] != fold for w in self.kept[i]]
        rest = [w for i in self.texts[0] if self.fold[i] != fold for w in self.own[i]]
        rest = random.Random(1).sample(rest, min(len(rest), len(toxic) // 2))
        return trained(fooled + rest, size), trained(toxic, size)

    def round(self, size: int, share: float) -> None:
        d: list = [None] * len(self.words)
        for f in range(FOLDS):
            pair = Pair(*self.contents(f, size), self.common)
            for i in np.flatnonzero(self.fold == f).tolist():
                d[i] = pair.differences(self.own[i])
        cut = max(0, math.ceil(np.quantile(np.concatenate([d[i] for i in self.texts[0]]), share, method="lower")))
        self.kept = [[w for w, n in zip(own, x.tolist()) if n > cut] for own, x in zip(self.own, d)]

    def mine(self) -> "Miner":
        for size, share in ROUNDS:
            before = self.kept
            try:
                self.round(size, share)
                for f in (*range(FOLDS), None):
                    self.contents(f, SIZE)
            except TooFew:
                if before is self.own:
                    raise
                self.kept = before
                break
        return self


def fit_texts(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """From a sample in memory; ``weights``: how many texts an ordinary and a toxic one
    stand for."""
    if len(set(labels)) < 2:
        return Model()
    words = [written(t) for t in texts]
    try:
        miner = Miner(words, labels).mine()
        x: list = [None] * len(words)
        for f in range(FOLDS):
            scorer = Model(*miner.contents(f, SIZE), miner.common).scorer()
            for i in np.flatnonzero(miner.fold == f).tolist():
                x[i] = scorer.features(words[i])
        model = Model(*miner.contents(None, SIZE), miner.common)
    except TooFew:
        return Model()
    y = np.array(labels, float)
    weight = np.where(y == 1, weights[1], weights[0])
    model.coef = logistic(np.array(x), y, weight * len(y) / weight.sum()).tolist()
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """``labels``: the rows to learn from (key, label 0 or 1; of repeated keys the largest
    label holds). The sample is drawn from them first, about ``sample`` keys of either
    label whatever their number, so that it can be broadcast and no text is shuffled."""
    y = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    rates = [min(1.0, sample / counts.get(c, 1)) for c in (0, 1)]
    drawn = y.where(F.pmod(F.xxhash64(F.lit("toxic"), "k"), F.lit(1 << 20)) < F.when(F.col("y") == 1, rates[1]).otherwise(rates[0]) * (1 << 20))
    rows = docs.select(F.col(text).cast("string").alias("t"), F.col(key).alias("id")).where(F.char_length("t") <= SAMPLE_CHARS)
    found = sorted({(r["t"], r["y"]) for r in rows.join(F.broadcast(drawn), F.col("id") == F.col("k")).select("t", "y").collect()})
    return fit_texts([t for t, _ in found], [y for _, y in found], (1 / rates[0], 1 / rates[1]))


def predict(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score."""
    if score.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"rename the column {score} first")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn(score, F.lit(None).cast("double"))
    names, at = out.columns, out.columns.index(text)

    def run(batch: pa.RecordBatch, made=[]) -> pa.RecordBatch:  # noqa: B006  one scorer a task
        if not made:
            made.append(shared.value.scorer())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([made[0].score(t) for t in batch.column(at).to_pylist()], pa.float64())], names)

    return map_batches(out, run, out.schema, text)
