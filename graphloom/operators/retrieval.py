"""Hybrid retrieval: chunks, dense and keyword scores, ranking, prompts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as fn
from graphloom.schema import TYPE_KINDS
from graphloom.tables import rounded, written

DENSE_SHARE, KEYWORD_SHARE, BODY_SCORE, OVERSAMPLE = 0.7, 0.3, 0.3, 4


def unit(v: Column | str) -> Column:
    """A vector divided by its length (1e-12 at least), as doubles."""
    v = F.transform(fn.col(v), lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(fn.col(a), fn.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _packed(vectors: DataFrame, id_: str, column: str, most: int) -> DataFrame:
    """ids, flat, width: up to so many vectors of one width in a row; null ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                same = batch.filter(pa.array(widths == width))
                for at in range(0, same.num_rows, most):
                    part = same.slice(at, most)
                    yield pa.RecordBatch.from_pydict({"ids": [part.column(0).to_pylist()], "flat": pa.array([part.column(1).flatten()], pa.list_(pa.float64())), "width": pa.array([int(width)], pa.int32())})

    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("size(v) > 0")
    return rows.mapInArrow(run, "ids array<long>, flat array<double>, width int")


def dense_top(vectors: DataFrame, query: DataFrame, k: int = 10, id_: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, id, dense of the k vectors nearest to each query, by dot product of normalised vectors; ties by id.

    Blocks of queries meet blocks of vectors, and only the best k of each block are shuffled. query: query_id, column.
    """
    asked = _packed(query, "query_id", column, 256).toDF("q_ids", "q_flat", "q_width")
    both = _packed(vectors, id_, column, 2048).join(asked, how="cross").where("width = q_width")

    return _best(block_best(both, k, id_), k, F.desc("dense"), F.col(id_))


def block_best(both: DataFrame, k: int, id_: str = "vec_id") -> DataFrame:
    """query_id, id, dense: the best k of each block of vectors (ids, flat) for each query of a block (q_ids, q_flat); ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit_rows(flat: pa.Scalar, width: int) -> np.ndarray:
            v = flat.values.to_numpy(zero_copy_only=False).reshape(-1, width)
            return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                width, ids, asks = row["width"].as_py(), row["ids"].values.to_numpy(zero_copy_only=False), row["q_ids"].values.to_numpy(zero_copy_only=False)
                score = np.floor(unit_rows(row["q_flat"], width) @ unit_rows(row["flat"], width).T * 10000.0 + 0.5) / 10000.0
                best = np.stack([np.lexsort((ids, -s))[:k] for s in score])
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(asks, best.shape[1]), id_: ids[best].ravel(), "dense": np.take_along_axis(score, best, 1).ravel()})

    return both.select("ids", "flat", "width", "q_ids", "q_flat").mapInArrow(run, f"query_id long, {id_} long, dense double")


def _best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query_id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("place_", place).where(F.col("place_") <= k).drop("place_")


def keyword_scores(chunks: DataFrame, query: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """query_id, id, keyword: mean over the query's terms of 1 if a term is one of the label's or name's, 0.3 if the body
    holds it. chunks: id, label, qualified_name, text; query: query_id, text. Of all pairs, or of those of query_id, id given."""
    asked = query.select("query_id", F.array_distinct(fn.terms("text")).alias("asked")).where("size(asked) > 0")
    own = F.array_distinct(fn.terms(F.concat_ws(" ", "label", "qualified_name")))
    ready = chunks.select("id", own.alias("own"), F.lower("text").alias("body"))
    both = ready.join(asked, how="cross") if pairs is None else ready.join(pairs.select("query_id", "id").distinct(), "id").join(asked, "query_id")
    value = lambda t: F.when(F.array_contains("own", t), F.lit(1.0)).when(F.contains("body", t), F.lit(BODY_SCORE)).otherwise(F.lit(0.0))
    mean = F.aggregate("asked", F.lit(0.0), lambda a, t: a + value(t)) / F.size("asked")
    return both.select("query_id", "id", F.least(F.lit(1.0), rounded(mean, 6)).alias("keyword"))


def hybrid(candidates: DataFrame, k: int = 10) -> DataFrame:
    """The best k of candidates (id, dense, keyword, pinned), of each query_id if there is one: 0.7 dense + 0.3 keyword, 1 more if
    pinned; 4 places, ties by id."""
    base = F.greatest("dense", F.lit(0.0)) * DENSE_SHARE + F.col("keyword") * KEYWORD_SHARE + F.when(F.col("pinned"), F.lit(1.0)).otherwise(F.lit(0.0))
    scored = candidates.withColumn("score", rounded(base, 4))
    return _best(scored, k, F.desc("score"), F.col("id")) if "query_id" in candidates.columns else scored.orderBy(F.desc("score"), "id").limit(k)


def candidates(dense: DataFrame, chunks: DataFrame, query: DataFrame, owned: DataFrame, pinned: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, dense, keyword, pinned: each query's nearest 4 k by dense, chunks that mentioned names own, and pinned ones
    (dense 0). dense: query_id, id, dense; owned, pinned: query_id, id; chunks, query: as in keyword_scores."""
    by = ["query_id", "id"]
    near = _best(dense, OVERSAMPLE * k, F.desc("dense"), F.col("id")).select(*by, "dense")
    more = owned.select(*by).unionByName(pinned.select(*by)).distinct().join(near.select(*by), by, "left_anti")
    pool = near.unionByName(more.select(*by, F.lit(0.0).alias("dense")))
    marks = pinned.select(*by, F.lit(True).alias("pinned")).distinct()
    keyword = keyword_scores(chunks, query, pool)
    return pool.join(keyword, by, "left").join(marks, by, "left").select(*by, "dense", F.coalesce("keyword", F.lit(0.0)).alias("keyword"), F.coalesce("pinned", F.lit(False)).alias("pinned"))


def embed_text(kind: str = "kind", label: str = "label", name: str = "qualified_name", text: str = "text", most: int = 2000) -> Column:
    return F.substring(F.concat(kind, F.lit(" "), label, F.lit("\n"), name, F.lit("\n"), text), 1, most)


def outlines(entity: DataFrame, members: int = 60) -> DataFrame:
    """id, text: each type under its name, with its annotations, and the signatures of its first members by line; bodies are
    left out, types and endpoints inside as well."""
    column = F.col("annotations") if "annotations" in entity.columns else F.lit(None).cast("string")
    entity = entity.withColumn("annotations", column)
    marks = lambda after: F.coalesce(F.array_join(F.transform(F.filter(F.split("annotations", ","), lambda a: F.trim(a) != ""), lambda a: F.concat(F.lit("@"), F.substring_index(a, ".", -1), F.lit(after))), ""), F.lit(""))
    inside = entity.where(~F.col("kind").isin("ENDPOINT", *TYPE_KINDS) & F.col("signature").isNotNull() & F.col("parent_id").isNotNull())
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("start_line", "qualified_name", "id"))
    line = F.concat(F.lit("    "), marks(" "), "signature", F.when(F.col("kind") == "FIELD", ";").otherwise(" { ... }"), F.lit("\n"))
    lists = inside.withColumn("place", place).where(F.col("place") <= members).select("parent_id", F.struct("place", line.alias("line")).alias("x"))
    lists = lists.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list("x")).alias("all"))
    types = entity.where(F.col("kind").isin(*TYPE_KINDS)).join(lists, "id", "left")
    body = F.array_join(F.transform(F.coalesce("all", F.array().cast("array<struct<place:int,line:string>>")), lambda x: x["line"]), "")
    return types.select("id", F.concat(F.lit("// "), "qualified_name", F.lit("\n"), marks("\n"), F.coalesce("signature", "name"), F.lit(" {\n"), body, F.lit("}")).alias("text"))


def bodies(entity: DataFrame, files: DataFrame, lines: int = 150) -> DataFrame:
    """id, text: source of each method and constructor, at most so many lines, under its name. files: file_id, text."""
    m = entity.where(F.col("kind").isin("METHOD", "CONSTRUCTOR")).join(files.select("file_id", F.col("text").alias("source")), "file_id")
    return m.select("id", F.concat(F.lit("// "), "qualified_name", F.lit("\n"), fn.excerpt("source", F.col("start_line"), F.col("end_line"), lines)).alias("text"))


def folded(counts: np.ndarray, used: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From chunks used in the open batch (one number a lane): what is used, and batches begun, after these files; and the
    first lane's batch of each file. A batch with `most` chunks or more is full whatever comes."""
    begun, of = np.zeros(len(used), np.int64), np.empty(len(counts), np.int64)
    for i, n in enumerate(counts.tolist()):
        full = (used > 0) & (used + n > most)
        begun = begun + full
        used = np.minimum(np.where(full, n, used + n), most)
        of[i] = begun[0]
    return used, begun, of


def batches(files: DataFrame, most: int = 300) -> DataFrame:
    """path, batch: whole files packed in order of path, a new batch where the next file would make it more than `most`
    chunks. files: path, chunks; those without chunks are left out.

    A range of paths turns each number of chunks in the open batch into another: ranges are folded side by side for all
    numbers, the ranges' tables are chained, and each range is folded again from where it really begins.
    """
    spark = files.sparkSession
    ranged = files.where("chunks > 0").select("path", F.col("chunks").cast("long").alias("chunks")).repartitionByRange("path").sortWithinPartitions("path")
    ranged = written(spark, ranged.withColumn("range", F.spark_partition_id()))

    def table_of(rows: pd.DataFrame) -> pd.DataFrame:
        used, begun, _ = folded(rows.sort_values("path")["chunks"].to_numpy(), np.arange(most + 1), most)
        return pd.DataFrame({"range": [int(rows["range"].iloc[0])], "used": [used.tolist()], "begun": [begun.tolist()]})

    tables = ranged.groupBy("range").applyInPandas(table_of, "range int, used array<long>, begun array<long>").orderBy("range").collect()  # a row for each range
    used, batch, starts = 0, 0, []
    for t in tables:
        starts.append((t["range"], used, batch))
        batch += t["begun"][used]
        used = t["used"][used]
    begin = spark.createDataFrame(starts, "range int, used long, first long")

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("path")
        of = folded(rows["chunks"].to_numpy(), rows["used"].to_numpy()[:1], most)[2]
        return pd.DataFrame({"path": rows["path"], "batch": of + rows["first"].iloc[0]})

    return ranged.join(F.broadcast(begin), "range").groupBy("range").applyInPandas(place, "path string, batch long")


def packed_prompt(sources: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """Sources (query_id, place, text) that fit the budget of characters in order; the first may be cut to it."""
    w = Window.partitionBy(by).orderBy("place")
    upto = F.sum(F.char_length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = sources.withColumn("upto", upto).withColumn("nth", F.row_number().over(w)).where((F.col("upto") <= budget) | (F.col("nth") == 1))
    return out.select(by, "place", F.substring("text", 1, budget).alias("text"))


def prompt_blocks(sources: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """by, number, block of the sources (by, place, label, kind, path, start_line, end_line, text) that fit the budget of
    characters in order of place: each with its number and heading, which count as well. The first may be cut to it."""
    w = Window.partitionBy(by).orderBy("place")
    numbered = sources.withColumn("number", F.row_number().over(w))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(F.lit("["), text("number"), F.lit("] "), text("label"), F.lit(" ("), text("kind"), F.lit(") - "), text("path"), F.lit(":"), text("start_line"), F.lit("-"), text("end_line"))
    blocks = numbered.withColumn("block", F.concat(head, F.lit("\n```java\n"), text("text"), F.lit("\n```")))
    upto = F.sum(F.char_length("block")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("upto", upto).where((F.col("upto") <= budget) | (F.col("number") == 1)).select(by, "number", F.substring("block", 1, budget).alias("block"))


def prompt_text(blocks: DataFrame, by: str = "query_id") -> DataFrame:
    """by, sources: the blocks of each prompt, one below the other."""
    return blocks.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "block"))), lambda x: x["block"]), "\n\n").alias("sources"))


def usable(max_chars: int) -> tuple[int, int]:
    """Characters for everything, and for facts among them."""
    all_ = max(max_chars - 1500, 1000)
    return all_, int(all_ * 0.35)
