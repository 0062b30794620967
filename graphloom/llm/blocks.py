"""All pairs within a group, as blocks against blocks: each pair meets in one task, and no task holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of each key in turn, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if held and held[-1].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def least_labels(linked: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component, of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while len(label):
        near = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def in_blocks(df: DataFrame, key: str, size: str, block: int, unit: str) -> DataFrame:
    """Each group of df cut into blocks by a hash of unit; a row goes to all pairs of blocks that hold its own.

    Adds task (the pair of blocks), side (0 or 1, or 2 where both are the same block).
    """
    many = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(F.col(unit), F.lit(11)), many).cast("int")
    df = df.withColumn("own_", own).withColumn("other_", F.explode(F.sequence(F.lit(0), many - 1)))
    low, high = F.least("own_", "other_"), F.greatest("own_", "other_")
    side = F.when(F.col("own_") == F.col("other_"), 2).when(F.col("own_") < F.col("other_"), 0).otherwise(1)
    return df.withColumn("task", F.xxhash64(key, low, high)).withColumn("side", side.cast("int")).drop("own_", "other_")
