"""The best chunks of many questions by keywords, from inverted lists, without meeting every chunk with every question.

One scan of the chunks for all terms that are asked makes the lists: (term, id, value), 1 where a term is one of the label's or
name's, less where only the body holds it. A question first takes the lists of its rarest terms that hold k chunks together;
their scores bound its k-th one. A chunk in none of the rarest p lists has at most what the others can give: the lists up to
the first p for which that is not enough are read as well, the long ones hardly ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as fn
from graphloom.operators.retrieval import BODY_SCORE, KEYWORD_SHARE, _best
from graphloom.tables import rounded, written

#: Terms that one scan looks for; more questions take more scans.
TERMS = 50_000
#: Questions that one scan scores.
QUESTIONS = 1000
#: Chunks that are taken apart at once.
ROWS = 64


def lists(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """term, id, value of the chunks (id, label, qualified_name, text) that hold any of the terms."""
    shared = chunks.sparkSession.sparkContext.broadcast(terms)  # TERMS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, asked = ahocorasick.Automaton(), set(shared.value)
        for t in shared.value:
            automaton.add_word(t, t)
        automaton.make_automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out: tuple[list, list, list] = ([], [], [])
                for i, own, body in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    mine = asked.intersection(own or ())
                    more = {t for _, t in automaton.iter(body or "") if t != " "} - mine
                    for found, value in ((mine, 1.0), (more, BODY_SCORE)):
                        out[0].extend(found)
                        out[1].extend([i] * len(found))
                        out[2].extend([value] * len(found))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["term", "id", "value"])

    own = F.array_distinct(fn.terms(F.concat_ws(" ", "label", "qualified_name")))
    return chunks.select(F.col("id").cast("long").alias("id"), own.alias("own"), F.lower("text").alias("body")).mapInArrow(run, "term string, id long, value double")


def scores(chunks: DataFrame, query: DataFrame) -> DataFrame:
    """query_id, id, keyword of every chunk for each question, as `retrieval.keyword_scores` gives them: one scan looks for the
    terms of all questions, whose values are then added up question by question, term by term."""
    asked = query.select("query_id", F.array_distinct(fn.terms("text")).alias("asked")).where("size(asked) > 0").orderBy("query_id")
    questions = [(r.query_id, r.asked) for r in asked.collect()]  # a stated query set
    parts = [_scores(chunks, questions[lo : lo + QUESTIONS]) for lo in range(0, max(1, len(questions)), QUESTIONS)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _scores(chunks: DataFrame, questions: list[tuple[int, list[str]]]) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(questions)  # QUESTIONS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        number: dict[str, int] = {}
        for _, asked in shared.value:
            for t in asked:
                number.setdefault(t, len(number))
        automaton = ahocorasick.Automaton()
        for t, i in number.items():
            automaton.add_word(t, i)
        automaton.make_automaton()
        # terms by question, filled up with one that nothing holds
        size = np.array([len(asked) for _, asked in shared.value], np.int64)
        place = np.full((int(size.max(initial=0)), len(size)), len(number))
        for q, (_, asked) in enumerate(shared.value):
            place[: len(asked), q] = [number[t] for t in asked]
        names = pa.array([i for i, _ in shared.value], pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows if len(size) else 0, ROWS):
                part = batch.slice(at, ROWS)
                value = np.zeros((part.num_rows, len(number) + 1))
                for row, own, body in zip(value, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if body and number:
                        row[list({i for _, i in automaton.iter(body)})] = BODY_SCORE
                    row[[number[t] for t in own or () if t in number]] = 1.0
                total = np.zeros((part.num_rows, len(size)))
                for term in place:  # in the order of the question, as a sum of doubles is not the same in each
                    total += value[:, term]
                keyword = np.minimum(1.0, np.floor(total / size * 1e6 + 0.5) / 1e6)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(size))))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.tile(np.arange(len(size)), part.num_rows))), ids, pa.array(keyword.ravel())], names=["query_id", "id", "keyword"])

    own = F.array_distinct(fn.terms(F.concat_ws(" ", "label", "qualified_name")))
    return chunks.select(F.col("id").cast("long").alias("id"), own.alias("own"), F.lower("text").alias("body")).mapInArrow(run, "query_id long, id long, keyword double")


def best(chunks: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """query_id, id, keyword of the k chunks that rank first by `retrieval.hybrid` with nothing but their keywords, for each question
    (query_id, text): also those of 0, and for questions without terms."""
    zero = query.select("query_id", F.array_distinct(fn.terms("text")).alias("asked")).where("size(asked) = 0").select("query_id")
    least = chunks.select(F.col("id").cast("long").alias("id")).orderBy("id").limit(k)
    rows = scores(chunks, query).unionByName(zero.join(least, how="cross").withColumn("keyword", F.lit(0.0)))
    return _best(rows, k, F.desc(rounded(F.col("keyword") * KEYWORD_SHARE, 4)), F.col("id"))


def top(chunks: DataFrame, query: DataFrame, k: int = 10) -> tuple[DataFrame, int]:
    """query_id, id, keyword of the k chunks of the greatest `retrieval.keyword_scores` above 0 for each question (query_id, text),
    ties by id; and how many pairs of question and chunk were scored."""
    spark = chunks.sparkSession
    asked = query.select("query_id", F.array_distinct(fn.terms("text")).alias("asked")).where("size(asked) > 0")
    asked = written(spark, asked.select("query_id", F.explode("asked").alias("term"), F.size("asked").alias("size")))
    terms = [r.term for r in asked.select("term").distinct().orderBy("term").collect()]  # a stated query set
    held = None
    for lo in range(0, max(1, len(terms)), TERMS):
        part = lists(chunks, terms[lo : lo + TERMS] or [" "])  # a term that no question has
        held = part if held is None else held.unionByName(part)
    held = written(spark, held)
    known = held.groupBy("term").agg(F.count("*").alias("n"), F.max("value").alias("most"))  # a row a term
    ranked = asked.join(F.broadcast(known), "term")  # terms that nothing holds give nothing
    w = Window.partitionBy("query_id").orderBy("n", "term")
    ranked = ranked.withColumn("place", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # what the terms behind can give: the bound of a chunk in none of the lists before
    ranked = written(spark, ranked.withColumn("rest", F.sum("most").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)) / F.col("size")))

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(ranked.select("query_id", "term", "size"), "query_id").join(held, ["term", "id"])
        return rows.groupBy("query_id", "id").agg(F.least(F.lit(1.0), rounded(F.sum("value") / F.max("size"), 6)).alias("keyword"))

    order = (F.desc("keyword"), F.col("id"))
    first = written(spark, ranked.where(F.col("before") < k).select("query_id", "term").join(held, "term").select("query_id", "id").distinct())
    found = written(spark, scored(first))
    best = _best(found, k, *order).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("keyword")).otherwise(F.lit(0.0)).alias("least"))
    open_ = ranked.join(best, "query_id", "left").where((F.col("before") >= k) & (rounded(F.col("rest"), 6) >= F.coalesce("least", F.lit(0.0))))
    more = written(spark, open_.select("query_id", "term").join(held, "term").select("query_id", "id").distinct().join(first, ["query_id", "id"], "left_anti"))
    out = _best(found.unionByName(scored(more)), k, *order)
    return out.select("query_id", "id", "keyword"), first.count() + more.count()
