"""Sharding by a hierarchical weighted hash tree: regions hold racks, racks hold shards.

A row descends from the root. At each level every child of the node it has reached draws -ln(u) / weight, u from the hash
of the row's id and the child's path, weight the sum of all shards' below it; the least draw wins, so a node is entered in
proportion to what it weighs. Only children of nodes on the row's own path draw: with thousands of shards a row computes
a few draws a level. Draws fall as weights grow, so a change moves rows only into or out of nodes whose weights change.

The law is `key`: id and number of shards decide. A shard that is added stands in a region of its own beside those that are
settled, so whatever their number it takes rows only into itself. When it is settled later, in the rack and region of its
number, rows move into that region, and there between siblings, but not between other regions.

Null ids draw as one value of their own. Null texts have no bytes. Rows with equal ids go to one shard; equal rows take
neighbouring slots in any order. Empty tables give empty results. No columns but doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import written

RACK, REGION = 2, 4
#: Rows that one task numbers, about.
ROWS = 1 << 17
PARTS = 16


def tree(weights: Sequence[float], settled: int | None = None, rack: int = RACK, region: int = REGION) -> list[dict[int, list[tuple[int, str, float]]]]:
    """By level from the root, each node's children as (number, path, weight of all shards below); none weighs 0. Shards from
    number `settled` on stand in regions of their own."""
    settled = len(weights) if settled is None else settled
    levels: list[dict[int, dict[int, tuple[str, float]]]] = [{}, {}, {}]
    for s, weight in enumerate(weights):
        if s < settled:
            numbers, paths = (s // region, s // rack, s), (f"region {s // region}", f"region {s // region}/rack {s // rack}", f"region {s // region}/rack {s // rack}/shard {s}")
        else:
            numbers, paths = (-(-settled // region) + s - settled, -(-settled // rack) + s - settled, s), (f"added {s}", f"added {s}/rack", f"added {s}/rack/shard")
        for level, above, number, path in zip(levels, (0, *numbers), numbers, paths, strict=False):
            below = level.setdefault(above, {})
            below[number] = (path, below.get(number, (path, 0.0))[1] + float(weight))
    return [{above: [(n, p, w) for n, (p, w) in below.items() if w > 0] for above, below in level.items() if any(w > 0 for _, w in below.values())} for level in levels]


def descend(key: Column, weights: Sequence[float], settled: int | None = None, rack: int = RACK, region: int = REGION) -> Column:
    """The shard of a row among shards with these weights, `settled` of them settled; a shard of weight 0 gets nothing."""
    node = F.lit(0)
    for nodes in tree(weights, settled, rack, region):
        below = F.array(*(F.array(*(F.struct(F.lit(c).alias("child"), F.lit(p).alias("path"), F.lit(w).alias("weight")) for c, p, w in nodes.get(n, []))) if n in nodes else F.lit(None) for n in range(max(nodes) + 1)))

        def draw(c: Column) -> Column:
            u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("@"), c["path"])), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
            return F.struct((-F.ln(u) / c["weight"]).alias("draw"), c["child"].alias("child"))

        node = F.array_min(F.transform(below[node], draw))["child"]
    return node


def shard(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: Sequence[float] | None = None, rows_a_task: int = ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 within a shard), grown_shard (with the weights `grown`).

    Slots are counted in hashed parts of each shard of about `rows_a_task` rows, each after the rows of those before, so no
    task numbers a whole shard.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    rows = rows.withColumn("shard", descend(F.col("key"), weights)).withColumn("grown_shard", descend(F.col("key"), grown or (*weights, 1.0), len(weights)))
    # (equal ids may repeat: the text's checksum spreads them too)
    mark = F.conv(F.substring(F.md5(F.concat_ws("@", "key", F.col("text_crc32").cast("string"), F.col("size").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = written(spark, rows.withColumn("mark", mark).drop("key"))
    blocks = rows.count() // (rows_a_task * len(weights)) + PARTS  # one number
    rows = rows.withColumn("block", (F.col("mark") % blocks).cast("int")).drop("mark")
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")  # a row for each part
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    rows = rows.withColumn("place", place).join(first, ["shard", "block"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def oracle(weights: Sequence[float] = (1.0,) * 8, grown: Sequence[float] | None = None, rows_a_task: int = ROWS) -> str:
    """The same rows as DuckDB SQL, which walks the tree level by level and has a checksum of its own."""
    nodes = ", ".join(
        f"({which}, {level}, {parent}, {child}, '{path}', {weight})"
        for which, w in enumerate((weights, grown or (*weights, 1.0))) for level, found in enumerate(tree(w, len(weights))) for parent, children in found.items() for child, path, weight in children
    )
    step = lambda i: f"""l{i} AS (SELECT r, which, arg_min(child, -ln((('0x' || left(md5(key || '@' || path), 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE) / weight::DOUBLE) AS child
    FROM rows JOIN {f"l{i - 1} USING (r)" if i else "(VALUES (0, 0), (1, 0)) start(which, child) ON true"} JOIN nodes USING (which) WHERE level = {i} AND parent = {"child" if not i else f"l{i - 1}.child"} GROUP BY r, which)"""  # noqa: E731
    levels = ",\n".join(step(i).replace("parent = child", "parent = start.child").replace("arg_min(child", "arg_min(nodes.child") for i in range(3))
    return f"""
WITH nodes AS (SELECT * FROM (VALUES {nodes}) v(which, level, parent, child, path, weight)),
turns AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
rows AS (SELECT r, doc_id, key, (len(h) // 2 + 1)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM texts, turns),
{levels},
placed AS (SELECT r.*, a.child::INT AS shard, b.child::INT AS grown_shard, ('0x' || left(md5(key || '@' || text_crc32 || '@' || size), 8))::BIGINT % ((SELECT count(*) FROM rows) // {rows_a_task * len(weights)} + {PARTS}) AS block
    FROM rows r JOIN l2 a ON r.r = a.r AND a.which = 0 JOIN l2 b ON r.r = b.r AND b.which = 1)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed"""
