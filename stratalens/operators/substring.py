"""Substring search over an index of trigrams.

The index holds, for each trigram of the lower-cased texts, the keys of the texts that have it,
in lists of the texts that came in one batch; it is bucketed by trigram. A search reads the
buckets of its own trigrams, keeps the keys that have them all, and checks only those texts;
what it returns is exactly what ``contains`` finds. Needles of fewer than three characters have
no trigram and read all texts. Building takes time linear in a text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.keyed import of_keys, write_keyed

GRAM = 3
HELD = 1 << 22  # a list is written after about so many trigrams


def trigrams(text: str) -> np.ndarray:
    """The distinct runs of three characters, each in one number of 21 bits a character."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique((x[:-2] << 42) | (x[1:-1] << 21) | x[2:])


def _lists(found: list[np.ndarray], keys: pa.Array) -> pa.RecordBatch:
    """``gram, keys`` of texts whose trigrams are ``found``."""
    grams = np.concatenate(found)
    places = np.repeat(np.arange(len(found)), [len(g) for g in found])
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    own = grams[starts]
    letters = np.stack((own >> 42, (own >> 21) & 0x1FFFFF, own & 0x1FFFFF), 1).astype(np.uint32).tobytes().decode("utf-32-le")
    offsets = pa.array(np.append(starts, len(grams)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([letters[i : i + GRAM] for i in range(0, len(letters), GRAM)], pa.string()), pa.ListArray.from_arrays(offsets, keys.take(pa.array(places[order])))], ["gram", "keys"])


def _postings(batches):
    for batch in batches:
        found, at, held = [], [], 0
        for i, text in enumerate(batch.column(0)):
            text = text.as_py()
            if text is None or len(text) < GRAM:
                continue
            found.append(trigrams(text))
            at.append(i)
            held += len(found[-1])
            if held >= HELD:
                yield _lists(found, batch.column(1).take(pa.array(at)))
                found, at, held = [], [], 0
        if found:
            yield _lists(found, batch.column(1).take(pa.array(at)))


def build(rows: DataFrame, key: str, text: str, folder: str, buckets: int = 64) -> DataFrame:
    """The index of ``rows``: ``gram, keys``. Null and short texts have no rows in it."""
    low = rows.select(F.lower(text).alias("low"), F.col(key).alias("key"))
    return write_keyed(low.mapInArrow(_postings, f"gram string, keys array<{low.schema['key'].dataType.simpleString()}>"), folder, "gram", buckets)


def candidates(index: DataFrame, needle: str) -> DataFrame | None:
    """``key`` of the texts with every trigram of the needle; None if it has none."""
    low = needle.lower()
    asked = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not asked:
        return None
    held = of_keys(index, "gram", asked).select("gram", F.explode("keys").alias("key"))
    return held.groupBy("key").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(asked)).select("key")


def search(rows: DataFrame, index: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """Rows whose lower-cased text contains the lower-cased needle."""
    found = candidates(index, needle)
    near = rows if found is None else rows.join(found.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left_semi")
    return near.where(F.contains(F.lower(text), F.lit(needle.lower())))
