"""Isolation forest (Liu, Ting and Zhou 2008): trees from small seeded samples, scored in
the tasks that hold the rows. Its sample of ``psi`` rows a tree is the method's own."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType


def _norm(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, r: np.random.Generator, limit: int) -> tuple:
    if limit == 0 or len(x) <= 1:
        return (_norm(len(x)),)
    open_ = np.flatnonzero(x.min(0) < x.max(0))
    if not len(open_):
        return (_norm(len(x)),)
    f = int(r.choice(open_))
    cut = r.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < cut
    return (f, cut, _grow(x[left], r, limit - 1), _grow(x[~left], r, limit - 1))


def _depth(tree: tuple, x: np.ndarray, at: np.ndarray, level: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[at] += level + tree[0]
        return
    left = x[at, tree[0]] < tree[1]
    _depth(tree[2], x, at[left], level + 1, out)
    _depth(tree[3], x, at[~left], level + 1, out)


def isolation_scores(df: DataFrame, features: list[str], key: str, trees: int = 200, psi: int = 256, seed: int = 0, min_rows: int = 20, history: DataFrame | None = None) -> DataFrame:
    """``df`` with ``isolation`` (over one half: isolated early); null below ``min_rows``
    complete rows. Rows with a null feature score null. Trees grow from ``history`` if given."""
    x = (df if history is None else history).select(key, *(F.col(c).cast("double") for c in features)).dropna()
    drawn = x.orderBy(F.xxhash64(F.lit(seed), key)).limit(trees * 16 + psi).toPandas()[features].to_numpy()
    if len(drawn) < min_rows:
        return df.withColumn("isolation", F.lit(None).cast("double"))
    r = np.random.default_rng(seed)
    n = min(psi, len(drawn))
    forest = [_grow(drawn[r.choice(len(drawn), n, replace=False)], r, math.ceil(math.log2(n))) for _ in range(trees)]
    shared = df.sparkSession.sparkContext.broadcast((forest, _norm(n)))

    @F.pandas_udf(DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        trees_, c = shared.value
        m = np.column_stack([s.to_numpy(float) for s in cols])
        total = np.zeros(len(m))
        for t in trees_:
            _depth(t, m, np.arange(len(m)), 0, total)
        return pd.Series(2 ** (-total / len(trees_) / c)).where(~np.isnan(m).any(axis=1))

    return df.withColumn("isolation", score(*(F.col(c).cast("double") for c in features)))
