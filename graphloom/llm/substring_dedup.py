"""Substring dedup: words (an FM-index per shard) or bytes (difference-cover suffix sorting per shard).

Both find windows that occur twice or more anywhere in the corpus, themselves overlapping ones included, judged on the
input, and take out all they cover. `segments.repeated` deals the kinds of segments to shards by content, so a shard
holds two occurrences of each of its windows that repeat; each shard is then indexed and searched exactly, and only what
is found there is taken out. Keys with more than `most` kinds are dealt anew by longer strings (`segments.verdicts_of`),
so no shard grows with the corpus.

Null texts count as empty. Rows that are equal in id and text are copies of one another like any others. Empty tables
give empty results. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import WORD
from graphloom.llm.segments import MOST, ranges_of, repeated, unpacked
from graphloom.llm.suffix import repeats_by_index, repeats_by_suffixes


def _without(text: bytes, ranges: np.ndarray) -> list[bytes]:
    edges = np.concatenate([[0], ranges.reshape(-1), [len(text)]]).tolist()
    return [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def dedup_word_windows(spark: SparkSession, docs: DataFrame, window: int = 35, gram: int = 8, shard: int = 1 << 17, texts: bool = False, most: int = MOST, hot: int | None = None) -> DataFrame:
    """Takes out each word in a window of so many words that also starts elsewhere; kept words are joined by a space.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Gives doc_id, n_words, n_removed, kept_sha256, removed (merged word ranges,
    end exclusive), and with texts=True the kept text. gram: words of an anchor; shard: words of one index.
    """
    ranges, packed = repeated(spark, docs, "word", window, gram, repeats_by_index, shard, most, hot)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for raw, lists in zip(unpacked(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                words, r = raw.split(), ranges_of(lists)
                edges = [0, *r.reshape(-1).tolist(), len(words)]
                kept = b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b])
                for c, v in zip(out, (len(words), int((r[:, 1] - r[:, 0]).sum()), hashlib.sha256(kept).hexdigest(), r.tolist(), kept), strict=True):
                    c.append(v)
            cols = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.list_(pa.int64())))]
            if texts:
                cols.append(pa.array([x.decode("utf-8", "replace") for x in out[4]], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "text"][: len(cols)])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, removed array<array<long>>" + ", text string" * texts
    return packed.join(ranges, ["did", "rk"], "left").select("doc_id", "text", "ranges").mapInArrow(finish, kinds)


def dedup_byte_strings(spark: SparkSession, docs: DataFrame, length: int = 200, gram: int = 32, shard: int = 1 << 17, texts: bool = False, most: int = MOST, hot: int | None = None) -> DataFrame:
    """Takes out each byte in a string of so many bytes that also starts elsewhere.

    Gives doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte ranges, end exclusive), and with texts=True the
    kept bytes (they need not be UTF-8: a cut may fall inside a character).
    """
    ranges, packed = repeated(spark, docs, "byte", length, gram, repeats_by_suffixes, shard, most, hot)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for raw, lists in zip(unpacked(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                r = ranges_of(lists)
                kept = b"".join(_without(raw, r))
                for c, v in zip(out, (len(raw), len(raw) - len(kept), len(r), hashlib.sha256(kept).hexdigest(), r.tolist(), kept), strict=True):
                    c.append(v)
            cols = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.list_(pa.int64())))]
            if texts:
                cols.append(pa.array(out[5], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "text"][: len(cols)])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>" + ", text binary" * texts
    return packed.join(ranges, ["did", "rk"], "left").select("doc_id", "text", "ranges").mapInArrow(finish, kinds)


def oracle_words(window: int = 35) -> str:
    """`dedup_word_windows` as DuckDB SQL that lists every window: doc_id, n_words, n_removed, kept_sha256."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + {window - 1}], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + j AS p FROM windows JOIN twice USING (k) CROSS JOIN range({window}) t(j)),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN kept k USING (r)"""


def oracle_bytes(length: int = 200) -> str:
    """`dedup_byte_strings` as DuckDB SQL that lists every string, in hexadecimal: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT r, i, substr(h, 2 * i + 1, {2 * length}) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {length - 1})) AS i FROM d)),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS g FROM windows JOIN twice USING (k)),
runs AS (SELECT r, min(i) AS a, max(i) + {length} AS b FROM hit GROUP BY r, g),
marked AS (SELECT *, a > coalesce(max(b) OVER (PARTITION BY r ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new FROM runs),
spans AS (SELECT r, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY r ORDER BY a) AS g FROM marked) GROUP BY r, g),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT r, max(b), max(len(h)) // 2 FROM spans JOIN d USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (r) GROUP BY r),
total AS (SELECT r, sum(b - a) AS n, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN total USING (r) LEFT JOIN kept USING (r)"""
