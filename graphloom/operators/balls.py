"""Nearest vectors without comparing all: vectors stand in balls round pivots, and a query visits those that can matter.

The angle between a query and a vector is at least that between the query and a ball's pivot less the ball's radius. A query
first visits the balls of the greatest bound that hold k vectors together; what it finds there bounds its k-th score, and only
balls whose bound reaches that are visited too. The result is that of comparing with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.retrieval import _best, block_best
from graphloom.tables import written

#: Pivots are the square root of the vectors, these at most, told to all tasks.
PIVOTS = 1024
BLOCK, ASKED = 2048, 256
#: Angles are trusted to so much.
SLACK = 1e-6


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def _by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, places and vectors of the rows of each width."""
    sizes = np.array([len(x) if x.is_valid else 0 for x in column])
    for width in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == width)
        yield int(width), at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class Balls:
    """An index of vectors (id, v) as tables in the shared folder; vectors that are null or empty are left out."""

    def __init__(self, spark: SparkSession, vectors: DataFrame, id_: str = "vec_id", column: str = "embedding", pivots: int = PIVOTS):
        self.spark, self.id = spark, id_
        rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("size(v) > 0")
        many = min(pivots, max(1, int(rows.count() ** 0.5)))
        # written first: a collected limit has `many` vectors of each task sent to the driver
        chosen = written(spark, rows.orderBy(F.xxhash64("id"), "id").limit(many).select("v")).collect()  # `pivots` vectors
        by_width: dict[int, np.ndarray] = {}
        for width in {len(r.v) for r in chosen}:
            found = _unit(np.array([r.v for r in chosen if len(r.v) == width]))
            by_width[width] = np.unique(found[np.abs(found).sum(axis=1) > 0], axis=0)
        self.pivots = spark.sparkContext.broadcast(by_width)
        held = written(spark, self._dealt(rows))
        self.sizes = {(r.width, r.ball): (r.n, r.radius) for r in held.groupBy("width", "ball").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # a row for each pivot
        self.blocks = written(spark, self._packed(held.select("ball", "width", "id", "v"), BLOCK))
        self.total = sum(n for n, _ in self.sizes.values())

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """id, v, width, ball (number of the nearest pivot; -1: no direction or no pivot), angle to it."""
        pivots = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for width, at, v in _by_width(batch.column(1)):
                    near = pivots.value.get(width, np.zeros((0, width)))
                    ball, angle = np.full(len(at), -1), np.full(len(at), np.pi)
                    if len(near):
                        cos = _unit(v) @ near.T
                        best = cos.argmax(axis=1)
                        there = np.isfinite(v).all(axis=1) & (np.abs(v).sum(axis=1) > 1e-6)
                        ball, angle = np.where(there, best, -1), np.where(there, np.arccos(np.clip(cos[np.arange(len(v)), best], -1, 1)), np.pi)
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(at), width), pa.int32()), pa.array(ball, pa.int64()), pa.array(angle)], names=["id", "v", "width", "ball", "angle"])

        return rows.mapInArrow(run, "id long, v array<double>, width int, ball long, angle double")

    def _packed(self, rows: DataFrame, most: int) -> DataFrame:
        """ball, width, ids, flat: rows (ball, width, id, v) of one ball together, `most` at most. A ball's rows are spread over
        tasks: it may hold a third of all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(kept: list[tuple]) -> pa.RecordBatch:
                ball, width = kept[0][:2]
                return pa.RecordBatch.from_pydict({"ball": pa.array([ball], pa.int64()), "width": pa.array([width], pa.int32()), "ids": pa.array([[x[2] for x in kept]], pa.list_(pa.int64())), "flat": pa.array([np.concatenate([x[3] for x in kept])], pa.list_(pa.float64()))})

            kept: list[tuple] = []
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                    row = (*row[:3], row[3].values.to_numpy(zero_copy_only=False))
                    if kept and (kept[0][:2] != row[:2] or len(kept) == most):
                        yield out(kept)
                        kept = []
                    kept.append(row)
            if kept:
                yield out(kept)

        spread = rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "width", "ball", F.pmod(F.xxhash64("id"), F.lit(4)))
        return spread.sortWithinPartitions("width", "ball").mapInArrow(run, "ball long, width int, ids array<long>, flat array<double>")

    def _visits(self, queries: DataFrame, k: int) -> DataFrame:
        """ball, width, id (of the query), v, n (vectors there) of the visits of queries (query_id, v, and least: the k-th score so
        far, null before the first visit)."""
        pivots, sizes = self.pivots, self.spark.sparkContext.broadcast(self.sizes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for width, at, v in _by_width(batch.column(1)):
                    balls = sorted((b, *x) for (w, b), x in sizes.value.items() if w == width)
                    if not balls:
                        continue
                    number, n, radius = (np.array(x) for x in zip(*balls, strict=True))
                    near = pivots.value.get(width, np.zeros((0, width)))
                    angle = np.arccos(np.clip(_unit(v) @ near.T, -1, 1)) if len(near) else np.zeros((len(v), 0))
                    bound = np.ones((len(v), len(number)))
                    known = number >= 0
                    bound[:, known] = np.cos(np.maximum(0, angle[:, number[known]] - radius[known] - SLACK))
                    bound[np.abs(v).sum(axis=1) <= 1e-6] = 1  # no direction: nothing can be told
                    order = np.argsort(-bound, axis=1, kind="stable")
                    held = np.cumsum(n[order], axis=1)
                    first = np.zeros(bound.shape, bool)
                    np.put_along_axis(first, order, (held - n[order]) < k, axis=1)
                    least = batch.column(2).take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.float64)
                    again = ~np.isnan(least)
                    reach = np.floor((bound + SLACK) * 10000.0 + 0.5) / 10000.0 >= np.where(again, least, 0)[:, None]
                    row, col = np.nonzero(np.where(again[:, None], reach & ~first, first))
                    part = batch.take(pa.array(at[row]))
                    yield pa.RecordBatch.from_arrays([pa.array(number[col], pa.int64()), pa.array(np.full(len(row), width), pa.int32()), part.column(0), part.column(1), pa.array(n[col], pa.int64())], names=["ball", "width", "id", "v", "n"])

        return queries.select("query_id", "v", "least").mapInArrow(run, "ball long, width int, id long, v array<double>, n long")

    def _compared(self, visits: DataFrame, k: int) -> DataFrame:
        asked = self._packed(visits.select("ball", "width", "id", "v"), ASKED).select("ball", "width", F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
        return block_best(self.blocks.join(asked.hint("merge"), ["ball", "width"]), k, self.id)

    def top(self, queries: DataFrame, k: int = 10, column: str = "embedding") -> tuple[DataFrame, float]:
        """query_id, id, dense of the k vectors nearest to each query, as `retrieval.dense_top` gives them, and the share of all
        comparisons that was made. queries: query_id, column."""
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(column).cast("array<double>").alias("v")).where("size(v) > 0")
        order = (F.desc("dense"), F.col(self.id))
        visits = written(self.spark, self._visits(asked.withColumn("least", F.lit(None).cast("double")), k))
        found = written(self.spark, _best(self._compared(visits, k), k, *order))
        bounds = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("dense")).otherwise(F.lit(-2.0)).alias("least"))
        more = written(self.spark, self._visits(asked.join(bounds, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))), k))
        made = visits.unionByName(more).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        out = _best(found.unionByName(self._compared(more, k)), k, *order)
        return out, made / max(1, self.total * asked.count())
