"""Grouping of spelling variants: forward and reversed sorted dictionaries, whose blocks are scanned and verified.

Words are near if one inserted, deleted or replaced code point is all that sets them apart. One edit leaves half of the
shorter word intact: so near words share a prefix or a suffix of half its length, and stand in one block of the dictionary
sorted by words or of the one sorted by reversed words. Each word is in both, for partners of its own length and longer
and for shorter ones. A block of more than `BLOCK` words is divided again by what follows the shared part: of the rest,
too, one half is intact. What is left after all halvings is one character, so that no block outgrows the alphabet's words
(its letters for each place, and their pairs for the insertions), however many words share an ending. Blocks are counted
before words are sent to them. The words of a block are compared by their shared prefixes and suffixes.

A pair may meet in several blocks, but counts in one: blocks of a length divide the possible lengths of the shared prefix.
Pairs are not written: each word's near words are counted and the most frequent one is kept within tasks first.

Words come from runs of letters of texts, lower-cased in ASCII only; in `extract`, runs that a checksum of document and run
picks lose one code point. Null texts have no words; a null id counts as an empty one. Repeated rows count as such. Very
long texts and words are read whole. Ties of frequency go to the smaller word in code-point order. Empty tables give empty
results; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bounded, written

LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, OFTEN, TIMES, EVERY = 7, 2, 10, 31
BLOCK = 64
#: No shared prefix is longer.
ANY = 2**31 - 1
#: Comparisons at once.
PAIRS = 1 << 17


def extract(docs: DataFrame, shortest: int = SHORTEST, often: int = OFTEN, every: int = EVERY) -> DataFrame:
    """word, n: distinct words of `shortest` code points or more that occur `often` or more, with their occurrences.

    Of a run whose crc32 of `<doc_id>:<run>` every divides, the code point at that number modulo its length is left out."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{shortest},}})"), 1)).alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    h, at = F.crc32(F.concat("id", F.lit(":"), "run")), F.col("h") % F.length("run")
    cut = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the key of their block: the length s of the shorter word, what is shared at both ends, and the shared
    prefixes that count there, from pre to below cap."""
    ends = F.xxhash64("s", "pre", "cap", F.substring("word", F.lit(1), F.col("pre")), F.substring("word", F.length("word") - F.col("suf") + 1, F.col("suf")))
    return rows.select(ends.alias("key"), "s", "pre", "suf", "cap", "word", "n")


def _halves(rows: DataFrame) -> DataFrame:
    """Two rows of each: the first half of what is not yet shared is intact, or only the second one is."""
    half = F.floor((F.col("s") - F.col("pre") - F.col("suf")) / 2).cast("int")
    first = F.struct((F.col("pre") + half).alias("pre"), F.col("suf").alias("suf"), F.col("cap").alias("cap"))
    second = F.struct(F.col("pre").alias("pre"), (F.col("suf") + half).alias("suf"), F.least("cap", F.col("pre") + half).alias("cap"))
    return _keyed(rows.select("s", "word", "n", F.inline(F.array(first, second))))


def blocks(spark: SparkSession, words: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, s, pre, suf, cap, word, n: words of the blocks of both dictionaries, none of them of more than `block` words
    unless a single character is left to differ."""
    start = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("s"))
    rows = written(spark, _halves(start.where("s > 0").select("s", "word", "n", F.lit(0).alias("pre"), F.lit(0).alias("suf"), F.lit(ANY).alias("cap"))))
    done = []
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.first(F.col("s") - F.col("pre") - F.col("suf")).alias("rest"))
        # a key for more than `block` rows: they are handed to all tasks while that is cheap, so that no large block is sent to one
        large = bounded(written(spark, sizes.where((F.col("size") > block) & (F.col("rest") > 1)).select("key")))
        done.append(rows.join(large, "key", "left_anti"))
        if large.isEmpty():
            break
        rows = written(spark, _halves(rows.join(large, "key", "left_semi")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words one behind the other, and where each begins."""
    data = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return data, np.concatenate([[0], np.cumsum([len(w) for w in words])])


def _shared(data: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many code points words a[i] and b[i] share at their start (back: at their end), most[i] at most."""
    found, open_ = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    step = 0
    while len(open_):
        x, y = (at[w[open_] + 1] - 1 - step if back else at[w[open_]] + step for w in (a, b))
        open_ = open_[data[x] == data[y]]
        step += 1
        found[open_] = step
        open_ = open_[most[open_] > step]
    return found


def _pairs(size: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of rows of one block, for blocks of size[b] rows from at[b] on, some PAIRS at a time."""
    left = np.repeat(at + size, size) - np.arange(int(size.sum())) - 1  # partners behind each row
    upto = np.cumsum(left)
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        part = left[lo:hi]
        i = np.repeat(np.arange(lo, hi), part)
        first = np.concatenate([[0], np.cumsum(part)[:-1]])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(first, part)
        lo = hi


def _scan(rows: pa.Table) -> dict[str, tuple[int, int, str]]:
    """Of each word of whole blocks (rows in order of key): near words that count here, the greatest n and its smallest word."""
    key = rows["key"].to_numpy()
    words, n = rows["word"].to_pylist(), rows["n"].to_numpy()
    s, pre, suf, cap = (rows[c].to_numpy().astype(np.int64) for c in ("s", "pre", "suf", "cap"))
    start = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    data, at = _codes(words)
    length = np.diff(at)
    found: dict[str, tuple[int, int, str]] = {}
    for i, j in _pairs(np.diff(np.concatenate([start, [len(key)]])), start):
        shorter = np.minimum(length[i], length[j])
        fits = (shorter == s[i]) & (s[i] == s[j]) & (pre[i] == pre[j]) & (cap[i] == cap[j])  # a longer pair has a block of its own
        i, j, shorter = i[fits], j[fits], shorter[fits]
        front = _shared(data, at, i, j, shorter, False)
        fits = (front >= pre[i]) & (front < cap[i])
        i, j, shorter, front = i[fits], j[fits], shorter[fits], front[fits]
        back = _shared(data, at, i, j, shorter, True)
        fits = (back >= suf[i]) & (front + back >= shorter - (length[i] == length[j]))
        for a, b in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
            for x, y in ((words[a], b), (words[b], a)):
                new = (int(n[y]), words[y])
                count, top, word = found.get(x, (0, -1, ""))
                if new[0] > top or new[0] == top and new[1] < word:
                    top, word = new
                found[x] = (count + 1, top, word)
    return found


def near(spark: SparkSession, words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, best_n, best: of each word that has near words, how many, and the most frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def out(rows: pa.Table) -> pa.RecordBatch:
            found = _scan(rows)
            count, top, word = ([x[i] for x in found.values()] for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(count, pa.int64()), pa.array(top, pa.int64()), pa.array(word, pa.string())], names=["word", "n_near", "best_n", "best"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            if not len(rows):
                continue
            key = rows["key"].to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last block may go on
            rest = rows.slice(whole)
            if whole:
                yield out(rows.slice(0, whole))
        if rest is not None and len(rest):
            yield out(rest)

    sorted_ = blocks(spark, words, block).repartition("key").sortWithinPartitions("key", "word")
    found = sorted_.mapInArrow(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("top")).select("word", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best"))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """word, root: the last word that following form from word to word leads to. forms: word, form, without circles."""
    known = written(spark, forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not known.where("open").isEmpty():  # each round doubles the steps that are taken at once
        on = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = written(spark, known.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
    return known.select("word", "root")


def group(spark: SparkSession, words: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """word, form (the most frequent near word, if `times` as frequent or more), root (the last form of forms), n, n_near,
    form_n. words: distinct words of two code points or more, and n."""
    words = written(spark, words.select("word", "n"))
    found = words.join(near(spark, words, block), "word", "left")
    is_form: Column = F.col("best_n") >= times * F.col("n")
    found = written(spark, found.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")))
    ends = roots(spark, found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(shortest: int = SHORTEST, often: int = OFTEN, times: int = TIMES, every: int = EVERY) -> str:
    """The same rows as DuckDB SQL: words that share a variant with one code point left out, verified; a checksum of its own."""
    return f"""
WITH RECURSIVE turns AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
split AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{shortest},}}')) AS raw FROM documents),
runs AS (SELECT id, translate(raw, '{UPPER}', '{LOWER}') AS run, count(*) AS times FROM split GROUP BY ALL),
hexed AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM runs),
marked AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM hexed, turns),
cut AS (SELECT times, CASE WHEN h % {every} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM marked),
words AS (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= {shortest} GROUP BY word HAVING sum(times) >= {often}),
places AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM words),
variants AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS variant FROM places),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM variants a JOIN variants b ON a.variant = b.variant AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.variant, w.n, a.word, a.n FROM variants a JOIN words w ON w.word = a.variant
    UNION SELECT a.word, a.n, a.variant, w.n FROM variants a JOIN words w ON w.word = a.variant),
best AS (SELECT word, count(*) AS n_near, max(m) AS top, first(other ORDER BY m DESC, other) AS best FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {times} * w.n THEN best END AS form, CASE WHEN top >= {times} * w.n THEN top END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
follow AS (SELECT word, word AS here, 0 AS step FROM forms UNION ALL SELECT f.word, x.form, f.step + 1 FROM follow f JOIN forms x ON x.word = f.here WHERE x.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, step) AS root FROM follow GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
