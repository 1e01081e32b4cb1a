"""Pairs of records in doubt, computed again from their exact vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V

#: Pairs in doubt are broadcast up to this many (16 bytes each).
BROADCAST_PAIRS = 500_000


def vectors_of(df: DataFrame, id_col: str, exact: bool) -> DataFrame:
    """(id, vec) of the usable records: the vector itself, or its unit vector in 16 bits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = V.dense(batch.column("embedding"))
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), V.pack(x) if exact else V.pack16(V.unit(x))], ["id", "vec"])

    return df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), "embedding").mapInArrow(read, "id bigint, vec binary")


def verified(df: DataFrame, id_col: str, pairs: DataFrame, n: int, floor: float) -> DataFrame:
    """The pairs (u, v) that are linked, by their exact vectors. Few pairs are broadcast, more are joined by a shuffle."""
    ends = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    vecs = vectors_of(df, id_col, True).join(F.broadcast(ends) if n <= BROADCAST_PAIRS else ends, "id", "left_semi")
    both = pairs.join(vecs.select(F.col("id").alias("u"), F.col("vec").alias("a")), "u").join(vecs.select(F.col("id").alias("v"), F.col("vec").alias("b")), "v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = V.cosine(V.unpack(batch.column("a")), V.unpack(batch.column("b"))) >= floor
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep))

    return both.select("u", "v", "a", "b").mapInArrow(check, "u bigint, v bigint")
