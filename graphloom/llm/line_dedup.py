"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier one equals it or is one edit away (a character inserted, deleted or replaced). Lines are what
\\n parts; earlier means a smaller id (null first), then an earlier place. Lines without a word stay. Lines of every length
are compared: a line of one character goes if there is an earlier one.

Tables of lines, hashes and places are joined by shuffles, as the hints say: in compressed form they may look small enough
to be broadcast, and would then pass through the driver's memory many times as large.

Two lines one edit apart share a variant with one character deleted: both at the same place if one was replaced, or one
line whole if one was inserted. So the lines that share a hashed variant and the place of its deletion are one edit
apart, all of them, and an aggregate finds the earliest: no pairs are made. To emit variants only where they can meet,
lines first meet by the half that the edit has left alone, then by all but the block of characters that holds the edit;
the variants of that block follow. What is found is verified with the edit distance.

Null texts have no lines and stay null. Rows that are equal in id and text are one document and fare alike. Empty
tables give empty results. Other columns pass through `drop_lines` unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, row_key, unused, written

BLOCK = 64
#: Lines that more than a 2000th of all places hold, at most 2000 lines, are salted.
HOT = 2000


def _split(docs: DataFrame) -> DataFrame:
    """did, rk, pos, line of each line with a word."""
    return docs.select(*row_key(docs, "doc_id", "text"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(WORD))


def _hash(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(7)).alias("h2"), F.length(line).alias("len")]


def _sub(text: Column | str, start: Column | int, size: Column | int) -> Column:
    text, start, size = (F.col(text) if isinstance(text, str) else text), (F.lit(start) if isinstance(start, int) else start), (F.lit(size) if isinstance(size, int) else size)
    return F.substring(text, start, size)


def _halves(line: Column, size: Column) -> Column:
    """Hashes of both halves, as cut for partners at least as long, and for those one shorter."""
    keys = []
    for less in (0, 1):
        m = size - less
        half = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.lit(1), m, _sub(line, 1, half)), F.xxhash64(F.lit(2), m, _sub(line, size - half + 1, half))]
    return F.array(*keys)


def _shared(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Rows of df (distinct in key and by) whose key others have too."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("n_")).where("n_ > 1").select(key).hint("merge"), key, "left_semi")


def near_lines(spark: SparkSession, lines: DataFrame, distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """h1, h2, len of distinct lines that have an earlier line one edit away. lines: did, rk, pos, line; distinct: h1, h2, len,
    first (did, pos, rk), halves."""
    id_ = ["h1", "h2", "len"]
    halves = distinct.select(*id_, F.explode("halves").alias("key"))
    meet = written(spark, _shared(halves, "key", id_).select(*id_).distinct())
    # each line's text comes from its first place only: a line that a third of all documents hold is one row here
    asked = meet.hint("merge").join(distinct.select(*id_, "first"), id_).select(*id_, "first", F.col("first.did").alias("did"), F.col("first.rk").alias("rk"), F.col("first.pos").alias("pos"))
    texts = lines.select("did", "rk", "pos", "line").join(asked.hint("merge"), ["did", "rk", "pos"])
    texts = written(spark, texts.groupBy(*id_).agg(F.min("line").alias("line"), F.min("first").alias("first")))
    # all but one block: for partners at least as long (m = len) and one shorter (m = len - 1)
    m = F.explode(F.array(F.col("len"), F.col("len") - 1)).alias("m")
    # (blocks of very long lines grow with the root of their length, as both the blocks and their variants do)
    blocks = texts.select(*id_, "first", "line", m).withColumn("b", F.greatest(F.lit(block), F.ceil(F.sqrt("m")).cast("int")))
    blocks = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / F.col("b")).cast("int"))))
    before, after = F.col("j") * F.col("b"), F.greatest(F.lit(0), F.col("m") - (F.col("j") + 1) * F.col("b"))
    head, tail = _sub("line", 1, before), _sub("line", F.col("len") - after + 1, after)
    blocks = blocks.select(*id_, "first", "m", F.xxhash64("m", "j", head, F.lit("|"), tail).alias("key"), _sub("line", before + 1, F.col("len") - after - before).alias("mid"))
    # (lines shorter than a block have no other: they have met by a half already)
    blocks = written(spark, blocks.where(F.col("m") < block).unionByName(_shared(blocks.where(F.col("m") >= block), "key", id_).select(blocks.columns)))
    # the block's variants: the place of the deletion counts where a character was replaced, not where one was inserted
    long_, places = F.col("m") < F.col("len"), F.sequence(F.lit(1), F.length("mid"))
    without = lambda p: F.concat(_sub("mid", 1, p - 1), _sub("mid", p + 1, F.length("mid")))
    replaced = F.transform(places, lambda p: F.xxhash64(F.col("key"), p, without(p)))
    deleted = F.array_distinct(F.transform(places, lambda p: F.xxhash64(F.col("key"), F.lit(0), without(p))))
    whole = F.array(F.xxhash64(F.col("key"), F.lit(0), F.col("mid")))
    some = F.length("mid") > 0
    variants = F.when(long_ & some, deleted).when(~long_ & some, F.concat(replaced, whole)).when(~long_, whole)
    variants = blocks.select(*id_, "first", long_.alias("longer"), F.posexplode(variants).alias("i", "variant"), F.length("mid").alias("size"))
    variants = variants.withColumn("inserted", F.col("longer") | (F.col("i") == F.col("size"))).drop("i", "size")
    earliest = variants.groupBy("variant", "inserted", "longer").agg(F.min(F.struct("first", *id_)).alias("best"), F.count("*").alias("n"))
    # replaced: the earliest of the group; inserted: the earliest of those on the other side
    best = earliest.where("not inserted and n > 1").select("variant", "inserted", "longer", "best")
    inserted = earliest.where("inserted").select("variant", "inserted", (~F.col("longer")).alias("longer"), "best")
    best = best.unionByName(inserted)
    found = variants.join(best.hint("merge"), ["variant", "inserted", "longer"]).where(F.col("best.first") < F.col("first"))
    found = found.groupBy(*id_).agg(F.min("best").alias("best"))
    found = found.hint("merge").join(texts.select(*id_, "line"), id_).select(*id_, "line", *(F.col(f"best.{c}").alias(f"{c}_") for c in id_))
    other = texts.select(*(F.col(c).alias(f"{c}_") for c in id_), F.col("line").alias("line_"))
    found = found.hint("merge").join(other, [f"{c}_" for c in id_])
    return found.where((F.levenshtein("line", "line_", 1) >= 0) & (F.levenshtein("line", "line_", 1) <= 1)).select(*id_)


def removed_lines(spark: SparkSession, docs: DataFrame, block: int = BLOCK, hot: int | None = None) -> DataFrame:
    """did, rk and the places of the lines to remove, for each document that loses any. hot: places of one line beyond
    which it is salted (default: a 2000th of all)."""
    id_ = ["h1", "h2", "len"]
    lines = _split(docs)
    hashed = lines.select(*_hash(F.col("line")), "did", "rk", "pos", _halves(F.col("line"), F.length("line")).alias("halves"))
    distinct = hashed.groupBy(*id_).agg(F.min(F.struct("did", "pos", "rk")).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    distinct = written(spark, distinct)
    near = near_lines(spark, lines, distinct, block).withColumn("near", F.lit(True))
    gone = distinct.join(near.hint("merge"), id_, "left").where("n > 1 or near").select(*id_, "first", "n", F.coalesce("near", F.lit(False)).alias("near"))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one number
    limit = max(1, total // HOT if hot is None else hot)
    heavy = distinct.where(F.col("n") > limit).select(*id_, F.ceil(F.col("n") / limit).cast("int").alias("salts"))
    heavy = F.broadcast(heavy) if total // limit <= HOT else heavy  # fewer than total / limit lines
    salts = F.coalesce("salts", F.lit(1))
    gone = gone.join(heavy, id_, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts", "n")
    places = lines.select(*_hash(F.col("line")), "did", "rk", "pos").join(heavy, id_, "left").withColumn("salt", F.pmod(F.xxhash64("did", "rk", "pos"), salts).cast("int")).drop("salts")
    gone = places.join(gone.hint("merge"), [*id_, "salt"]).where(F.col("near") | (F.struct("did", "pos", "rk") != F.col("first")))
    return written(spark, gone.groupBy("did", "rk").agg(F.collect_set("pos").alias("gone")))


def drop_lines(spark: SparkSession, docs: DataFrame, block: int = BLOCK, counts: bool = True, hot: int | None = None) -> DataFrame:
    """docs with the text of what is left of each, and with counts=True n_lines, n_removed.

    Documents stay, if need be with an empty text. n_chars, where there is one, follows a text that changes.
    """
    own = dict(zip(names := ("did", "rk", "gone", "left"), unused(docs, *names), strict=True))
    gone = removed_lines(spark, docs, block, hot).withColumnsRenamed({c: own[c] for c in ("did", "rk", "gone")})
    did, rk = row_key(docs, "doc_id", "text")
    out = docs.join(gone.hint("merge"), (did == F.col(own["did"])) & (rk == F.col(own["rk"])), "left")
    lines, places, whole = F.split("text", "\n", -1), F.col(own["gone"]), F.col(own["gone"]).isNull()
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    out = out.withColumn(own["left"], F.when(whole, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: lines[i]), "\n")))
    new = {"text": F.col(own["left"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.char_length(own["left"]).cast("long"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.size(lines).cast("long"))
    n_removed = F.when(whole, F.lit(0).cast("long")).otherwise(F.size(places).cast("long"))
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns), *([n_lines.alias("n_lines"), n_removed.alias("n_removed")] if counts else []))


def oracle() -> str:
    """doc_id, n_lines, n_removed, kept_sha256 as DuckDB SQL, for distinct ids. (Its levenshtein counts bytes: not used.)"""
    return f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split WHERE text IS NOT NULL),
firsts AS (SELECT line, length(line) AS n, min((coalesce(doc_id, -9223372036854775808), pos)) AS first FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY line),
cuts AS (SELECT line, n, first, unnest([n, n - 1]) AS m FROM firsts),
halves AS (SELECT *, unnest(['p' || left(line, (m // 2)::INT), 's' || right(line, (m // 2)::INT)]) AS half FROM cuts),
met AS (SELECT DISTINCT a.line AS line, b.line AS other, CASE WHEN a.n > b.n THEN a.line ELSE b.line END AS longer, CASE WHEN a.n > b.n THEN b.line ELSE a.line END AS shorter, a.n, b.n AS k
    FROM halves a JOIN halves b ON a.m = b.m AND a.half = b.half AND b.first < a.first AND a.line <> b.line WHERE abs(a.n - b.n) <= 1),
near AS (SELECT DISTINCT line FROM met WHERE CASE WHEN n = k THEN len(list_filter(range(1, n + 1), lambda i: line[i] <> other[i])) <= 1
    ELSE len(list_filter(range(0, greatest(n, k)), lambda i: left(longer, i) || substr(longer, i + 2) = shorter)) > 0 END),
marked AS (SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AND ((coalesce(l.doc_id, -9223372036854775808), l.pos) <> f.first OR r.line IS NOT NULL) AS gone
    FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near r ON l.line = r.line),
joined AS (SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(j.n_lines, 0)::BIGINT AS n_lines, coalesce(j.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(j.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN joined j ON d.doc_id IS NOT DISTINCT FROM j.doc_id"""
