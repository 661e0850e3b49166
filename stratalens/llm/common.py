"""Helpers shared by the training-data operators."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where crc32 of the id's decimal text leaves remainder 1 on division by 3."""
    return F.coalesce((F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3) == 1, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named text or binary column of each piece stays
    near ``max_bytes``; a longer single value stands alone. Bounds what a task holds."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        start = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(col), 0).to_pylist()):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str, max_bytes: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` over pieces of bounded size."""

    def run(batches):
        for piece in slices(batches, column, max_bytes):
            yield f(piece)

    return df.mapInArrow(run, schema)


def free_name(columns: list[str], base: str) -> str:
    """``base``, with underscores in front until no column's name starts with it."""
    while any(c.lower().startswith(base.lower()) for c in columns):
        base = "_" + base
    return base


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()
