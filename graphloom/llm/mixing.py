"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks, in DataFrame functions only.

Sources by code point, null last, weigh 3, 1, 2, repeating (or as given). They share `share` times all words in those
proportions, none above `most` times its own size; what is above is shared again by weight until nothing is. The mix is
cut into equal blocks of words, short enough that the source of the smallest target gets PER_SHARD of them a shard. Blocks
go to sources by the highest quotients target / (2 j + 1), then a source's blocks to its shards by their sizes. What is
above `most` times a shard's size goes to the source's next shards that have room. Within a shard documents stand in seeded
order as one stream of words, and the shard takes its first ones, going round again after the last document.

Null texts and texts without a word have size 0 and are never taken. Null and repeated ids are fine: rows that are equal
in id, source and size are interchangeable. Empty tables give empty results. No other columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import WORD, unused, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCKS, SHARDS, SEED = 1 << 18, 64, "mix-1"
PER_SHARD = 32
#: Rows of a source that one task puts in order, about: above SHARDS times as many in all there are more shards.
ROWS = 1 << 17


def n_words(text: Column | str = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, rn, target from sizes by source: one row a source, so windows over all of them are small."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rn", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    turn = (F.col("rn") - 1) % len(weights)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, F.lit(w)).otherwise(weight)
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), "rn")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    ranked = ranked.withColumn("at", F.row_number().over(by_cap)).withColumn("level", level)
    # sources stand by cap / weight: the first whose cap isn't below the level of what is left stops the sharing
    found = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("at", "level"))).over(everything)
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), found["level"] * F.col("weight"))).select("source", "source_size", "rn", "target")


def highest(claims: DataFrame, keys: list[str], claim: str, seats: str | int, window: Window) -> DataFrame:
    """Seats of each claim by the highest quotients claim / (2 j + 1).

    With K claims on n seats the divisor that deals all out is within K / (2 n) of total / n, so seats below `low` are
    certain and only those up to `high` are ranked: some K rows in all, however many seats there are.
    """
    seats = F.lit(seats) if isinstance(seats, int) else F.col(seats)
    held = claims.where(F.col(claim) > 0).withColumn("seats_", seats.cast("long"))
    share = F.col(claim).cast("double") * F.col("seats_") / F.sum(claim).over(window)
    slack = share * F.count("*").over(window) / (2 * F.greatest(F.col("seats_"), F.lit(1))) + 2
    held = held.withColumn("low", F.greatest(F.lit(0), F.floor(share - slack)).cast("long")).withColumn("high", F.ceil(share + slack).cast("long"))
    held = held.withColumn("open_", F.col("seats_") - F.sum("low").over(window))
    each = held.withColumn("j", F.explode(F.sequence("low", "high")))
    each = each.withColumn("place", F.row_number().over(window.orderBy((F.col(claim) / (2 * F.col("j") + 1)).desc(), *keys)))
    more = F.count_if(F.col("place") <= F.col("open_"))
    return each.groupBy(*keys).agg((F.first("low") + more).alias("blocks")).where("blocks > 0")


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, blocks: int = BLOCKS, shards: int | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shard of each row of docs, and rk (hash of its id and text).

    A source's taken words are its whole blocks while that is at most `most` times its size, as is each shard's share.
    """
    shards = shards or max(SHARDS, docs.count() // ROWS)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("doc_id", "text").alias("rk")).withColumn("h", order)
    sized = written(spark, sized.withColumn("shard", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % shards).cast("int")))
    cells = written(spark, sized.groupBy("source", "shard").agg(F.sum("size").alias("cell_size")))
    aims = written(spark, targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, most))
    total, least = aims.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target"))), F.lit(0.0))).first()  # two numbers
    block = max(1, min(int(total * share) // blocks, int(least) // (PER_SHARD * shards)))
    won = highest(aims, ["rn"], "target", int(total * share) // block, Window.partitionBy(F.lit(0)))
    inside = cells.join(aims, cells["source"].eqNullSafe(aims["source"])).select("rn", "shard", "cell_size", "source_size", "target", aims["source"].alias("s")).join(won, "rn", "left")
    quota = highest(inside.where("blocks > 0").withColumnRenamed("blocks", "won"), ["rn", "shard"], "cell_size", "won", Window.partitionBy("rn"))
    inside = inside.withColumnRenamed("blocks", "won").join(quota, ["rn", "shard"], "left").fillna(0, ["won", "blocks"])
    inside = inside.withColumn("quota", F.least(F.col("blocks") * block, F.col("cell_size") * most)).withColumn("room", F.col("cell_size") * most - F.col("quota"))
    source, following = Window.partitionBy("rn"), Window.partitionBy("rn").orderBy((F.col("cell_size") / (2 * F.col("blocks") + 1)).desc(), "shard")
    before = F.coalesce(F.sum("room").over(following.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    clipped = F.col("won") * block - F.sum("quota").over(source)
    inside = inside.withColumn("quota", F.col("quota") + F.greatest(F.lit(0), F.least(F.col("room"), clipped - before)))
    cell = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size", "rk")
    sized = sized.withColumn("upto", F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = inside.select(F.col("s").alias("source_"), F.col("shard").alias("shard_"), "cell_size", "source_size", "target", "quota")
    out = sized.join(inside, sized["source"].eqNullSafe(F.col("source_")) & (F.col("shard") == F.col("shard_")))
    rounds = F.when(F.col("cell_size") > 0, F.floor(F.col("quota") / F.greatest("cell_size", F.lit(1)))).otherwise(0)
    rest = F.col("quota") - F.col("rounds") * F.col("cell_size")
    out = out.withColumn("rounds", rounds)
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("upto") - F.col("size"))))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "shard", "rk")


def mixed(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mix itself: docs with a row for each time a document is taken, the last cut after its last word taken.

    taken: doc_id, rk, taken of each row of docs; rows equal in id and text have what those rows have, in turn. Cut texts have a
    space between words. n_chars, where there is one, follows the text.
    """
    own = dict(zip(names := ("did", "rk", "all", "turn", "taken", "size", "time", "text"), unused(docs, *(f"_{c}" for c in names)), strict=True))
    _, _, all_, turn, taken_, size, time, cut = (F.col(own[c]) for c in names)
    same, id_ = [own["did"], own["rk"]], F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    amounts = taken.where("taken > 0").groupBy(id_.alias(own["did"]), F.col("rk").alias(own["rk"])).agg(F.sort_array(F.collect_list("taken"), asc=False).alias(own["all"]))
    out = docs.withColumn(own["did"], id_).withColumn(own["rk"], F.xxhash64("doc_id", "text")).join(amounts, same)
    out = out.withColumn(own["turn"], F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
    out = out.where(turn <= F.size(all_)).withColumn(own["taken"], F.element_at(all_, turn)).withColumn(own["size"], n_words())
    out = out.withColumn(own["time"], F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(taken_ / size))))
    left = taken_ - (time - 1) * size
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    out = out.withColumn(own["text"], F.when(left >= size, F.col("text")).otherwise(first))
    new = {"text": cut, "n_chars": F.char_length(cut).cast("long")}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def oracle(weights=WEIGHTS, share: float = SHARE, most: int = MOST, blocks: int = BLOCKS, shards: int | None = None, seed: str = SEED) -> str:
    """The same rows as DuckDB SQL."""
    parts = f"{shards}" if shards else f"(SELECT greatest({SHARDS}, count(*) // {ROWS}) FROM documents)"
    turns = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
parts AS (SELECT {parts}::BIGINT AS n),
dealt AS (SELECT *, (('0x' || left(h, 8))::BIGINT % (SELECT n FROM parts))::INT AS shard FROM sized),
cells AS (SELECT source, shard, sum(size)::BIGINT AS cell_size FROM dealt GROUP BY ALL),
sizes AS (SELECT source, sum(cell_size)::BIGINT AS source_size FROM cells GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM sizes),
weighed AS (SELECT *, source_size * {most} AS cap, CASE (rn - 1) % {len(weights)} {turns} END AS weight FROM ranked),
levels AS (SELECT *, cap::DOUBLE / weight AS ratio, ({share}::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level, row_number() OVER (ORDER BY cap::DOUBLE / weight, rn) AS spot FROM weighed
    WINDOW before AS (ORDER BY cap::DOUBLE / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT arg_min(level, spot) AS level FROM levels WHERE level <= ratio),
aims AS (SELECT source, source_size, rn, least(cap::DOUBLE, (SELECT level FROM found) * weight) AS target FROM levels),
total AS (SELECT floor(coalesce(sum(source_size), 0)::DOUBLE * {share})::BIGINT AS t FROM aims),
least AS (SELECT floor(coalesce(min(target), 0))::BIGINT AS target FROM aims WHERE target > 0),
size AS (SELECT greatest(1, least(t // {blocks}, (SELECT target FROM least) // ({PER_SHARD} * (SELECT n FROM parts)))) AS block FROM total),
unit AS (SELECT block, t // block AS seats FROM size, total),
quotients AS (SELECT rn, unnest(range(0, (ceil(target * (SELECT seats FROM unit) / (SELECT sum(target) FROM aims)) + 2 + (SELECT count(*) FROM aims))::BIGINT)) AS j, target FROM aims WHERE target > 0),
won AS (SELECT rn, count(*) AS won FROM (SELECT rn FROM quotients ORDER BY target / (2 * j + 1) DESC, rn LIMIT (SELECT seats FROM unit)) GROUP BY ALL),
inside AS (SELECT a.rn, c.source, c.shard, c.cell_size, a.source_size, a.target, w.won FROM cells c JOIN aims a ON c.source IS NOT DISTINCT FROM a.source LEFT JOIN won w USING (rn)),
claims AS (SELECT rn, shard, cell_size, won, unnest(range(0, (ceil(cell_size * won::DOUBLE / source_size) + 2 + (SELECT n FROM parts))::BIGINT)) AS j FROM inside WHERE won > 0 AND cell_size > 0),
placed AS (SELECT rn, shard, won, row_number() OVER (PARTITION BY rn ORDER BY cell_size::DOUBLE / (2 * j + 1) DESC, shard) AS place FROM claims),
quotas AS (SELECT rn, shard, count(*) AS blocks FROM placed WHERE place <= won GROUP BY ALL),
clipped AS (SELECT i.*, coalesce(q.blocks, 0) AS blocks, least(coalesce(q.blocks, 0) * (SELECT block FROM unit), i.cell_size * {most}) AS quota FROM inside i LEFT JOIN quotas q ON i.rn = q.rn AND i.shard = q.shard),
limits AS (SELECT * REPLACE (quota + greatest(0, least(cell_size * {most} - quota, coalesce(won, 0) * (SELECT block FROM unit) - sum(quota) OVER (PARTITION BY rn)
    - coalesce(sum(cell_size * {most} - quota) OVER (PARTITION BY rn ORDER BY cell_size::DOUBLE / (2 * blocks + 1) DESC, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota) FROM clipped),
run AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM dealt)
SELECT r.doc_id, r.source, r.size, l.source_size, l.target,
    (CASE WHEN l.cell_size > 0 THEN l.quota // l.cell_size ELSE 0 END * r.size
     + greatest(0, least(r.size, l.quota - CASE WHEN l.cell_size > 0 THEN l.quota // l.cell_size ELSE 0 END * l.cell_size - (r.upto - r.size))))::BIGINT AS taken, r.shard
FROM run r JOIN limits l ON r.source IS NOT DISTINCT FROM l.source AND r.shard = l.shard"""
