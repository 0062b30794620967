"""Embedding near-dedup with randomised-rotation binary codes.

Every vector is normalised, turned by one random rotation and stored as the signs of its coordinates, with the inner
product of the turned vector and its code as correction factor. Inner product of code and a turned query, divided by
that factor, estimates the cosine without bias; the error of a pair at cosine c has standard deviation
sqrt(1 - c * c) * sqrt(1 - f * f) / f / sqrt(d - 1) for factor f and dimension d. The turned query is rounded to BITS bits a
coordinate, so that the product is counted: bits that code and each bit plane of the query share. Rounding by steps s adds
s * sqrt(1 / 12) / f to the deviation. A pair whose estimate plus `errors` deviations reaches the threshold, from either side,
is computed again exactly in double precision.

Only vectors with equal labels are compared, in blocks of a label against blocks, each pair once. Through the blocks go codes,
bit planes and factors, (BITS + 1) * d bits a vector; the vectors themselves follow to those blocks only where a pair of theirs
may reach the threshold. A block gives counts of links and a spanning forest. Vectors that are equal bit by bit count as one
with copies; rows of vectors with more than `hot` copies are salted when they take their results.

Null labels, null or empty vectors, null or non-finite components, and zero vectors link with nothing and stand alone,
as do vectors of another dimension towards each other. Repeated rows are copies of one another. Empty tables give empty
results. No columns but vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.blocks import groups, in_blocks, least_labels
from graphloom.llm.common import bounded, written
from graphloom.llm.components import components

THRESHOLD, BLOCK, ERRORS, SEED = 0.93, 1024, 6.0, 7
BITS, HOT = 4, 100_000
#: Numbers of vectors of so many labels are told to all tasks.
LABELS = 100_000
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    if (d, seed) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
        _rotations[d, seed] = q * np.sign(np.diag(r))
    return _rotations[d, seed]


def encode(unit: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction factors of unit vectors (rows)."""
    turned = unit @ rotation(unit.shape[1], seed).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def rounded(unit: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors (rows) as queries: the turned coordinates as BITS packed bit planes (rows of BITS * ceil(d / 8) bytes), the
    least coordinate, the step between levels, and the sum of the rounded coordinates."""
    turned = unit @ rotation(unit.shape[1], seed).T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << BITS) - 1), 1e-12)
    level = np.floor((turned - low[:, None]) / step[:, None] + 0.5).astype(np.uint8)
    planes = np.concatenate([np.packbits(level >> p & 1, axis=1) for p in range(BITS)], axis=1)
    return planes, low, step, low * unit.shape[1] + step * level.sum(axis=1)


def _words(packed: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words."""
    rest = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, rest)))).view(np.uint64)


def estimate(codes: np.ndarray, factors: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, total: np.ndarray, d: int) -> np.ndarray:
    """Unbiased estimates of the cosine of each coded vector (rows) and each rounded query (columns), by counting bits."""
    code, width = _words(codes), planes.shape[1] // BITS
    shared = np.zeros((len(codes), len(planes)), np.float32)
    for p in range(BITS):
        plane = _words(planes[:, p * width : (p + 1) * width])
        for w in range(code.shape[1]):
            shared += np.bitwise_count(code[:, None, w] & plane[None, :, w]).astype(np.float32) * (1 << p)
    ones = np.bitwise_count(code).sum(axis=1).astype(np.float32)
    return (2 * (low[None, :] * ones[:, None] + step[None, :] * shared) - total[None, :]) / np.sqrt(d) / factors[:, None]


def slack(factors: np.ndarray, d: int, cosine: float, errors: float = ERRORS, step: np.ndarray | float = 0.0) -> np.ndarray:
    """Of coded vectors (rows) and queries rounded by steps (columns)."""
    f = np.minimum(factors, 1.0)[:, None]
    code = np.sqrt(1 - cosine * cosine) * np.sqrt(1 - f * f) / f / np.sqrt(max(1, d - 1))
    return errors * np.sqrt(code**2 + (np.asarray(step) ** 2 / 12)[None, ...] / f**2) + 1e-6


def _vectors(column: pa.Array) -> np.ndarray:
    """Vectors as rows, scaled by powers of two, which is exact, so that squares neither underflow nor overflow."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds code, factor and what the vector is as a query to rows of one dimension each."""
    for batch in batches:
        for d in np.unique(batch.column("d").to_numpy()):
            part = batch.filter(pa.array(batch.column("d").to_numpy() == d))
            x = _vectors(part.column("embedding"))
            unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
            codes, factors = encode(unit)
            planes, *query = rounded(unit)
            raw = [pa.array([c.tobytes() for c in m], pa.binary()) for m in (codes, planes)]
            yield pa.RecordBatch.from_arrays([*part.columns, *raw, pa.array(factors), *map(pa.array, query)], names=[*part.schema.names, *CODED])


CODED = ("code", "planes", "factor", "low", "step", "total")


def _maybe(threshold: float, errors: float) -> Callable:
    """Of each block, the sets with pairs that may reach the threshold: task, set, and its partners behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "task"):
            ids = group.column("set").to_numpy()
            order = np.argsort(ids)
            ids, d = ids[order], int(group.column("d")[0].as_py())
            side, factors, low, step, total = (group.column(c).to_numpy()[order] for c in ("side", "factor", "low", "step", "total"))
            codes, planes = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint8).reshape(len(ids), -1)[order] for c in ("code", "planes"))
            upper = estimate(codes, factors, planes, low, step, total, d) + slack(factors, d, threshold, errors, step)
            maybe = (upper >= threshold) | (upper.T >= threshold)
            maybe &= (side[:, None] == 2) | (side[:, None] != side[None, :])
            maybe = np.triu(maybe, 1)
            needed = np.flatnonzero(maybe.any(axis=1) | maybe.any(axis=0))
            if len(needed):
                a, b = np.nonzero(maybe[needed])
                at = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(needed)))]).astype(np.int32)
                task = pa.array(np.full(len(needed), group.column("task")[0].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([task, pa.array(ids[needed]), pa.ListArray.from_arrays(pa.array(at), pa.array(ids[b]))], names=["task", "set", "partners"])

    return run


def _links(threshold: float) -> Callable:
    """Of each block, by exact products of the pairs that may reach the threshold: counts of links and a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "task"):
            ids = group.column("set").to_numpy()
            order = np.argsort(ids)
            partners = group.column("partners").combine_chunks()
            a = np.repeat(np.argsort(order), partners.value_lengths().to_numpy(zero_copy_only=False))
            ids, copies = ids[order], group.column("copies").to_numpy()[order]
            b = np.searchsorted(ids, partners.flatten().to_numpy(zero_copy_only=False))
            x = _vectors(group.column("embedding").combine_chunks())[order]
            norm = np.sqrt((x * x).sum(axis=1))
            linked = np.zeros((len(ids), len(ids)), bool)
            for lo in range(0, len(a), 65536):
                i, j = a[lo : lo + 65536], b[lo : lo + 65536]
                linked[i, j] = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
            linked |= linked.T
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked @ copies), pa.array(ids[least_labels(linked)]), pa.array(np.bincount(a, minlength=len(ids)).astype(np.int64))], names=["set", "links", "root", "exact"])

    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, errors: float = ERRORS, hot: int = HOT) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label)."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0) & F.col("label").isNotNull()
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    same = ("h1", "h2")  # 128 bits
    hashes = (F.xxhash64("label", "embedding", F.size("embedding")), F.xxhash64(F.lit(1), "embedding", "label"))
    rows = rows.select("vec_id", *(F.when(F.col("sound"), h).alias(c) for c, h in zip(same, hashes, strict=True)), "label", "embedding")
    sets = rows.where("h1 is not null").groupBy(*same).agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    sets = sets.withColumn("d", F.size("embedding"))
    kinds = ", ".join(f"{c} {t}" for c, t in sets.dtypes)
    coded = "code binary, planes binary, factor double, low double, step double, total double"
    sets = written(spark, sets.mapInArrow(_encoded, f"{kinds}, {coded}").withColumn("set", F.monotonically_increasing_id()))  # as written, ids no longer change
    sizes = sets.groupBy("label", "d").agg(F.count("*").alias("n"))
    cut = in_blocks(sets.select("set", "label", "d", *CODED).join(F.broadcast(sizes) if sizes.count() < LABELS else sizes, ["label", "d"]).withColumn("group", F.xxhash64("label", "d")), "group", "n", block, "set")
    cut = cut.select("task", "set", "side", "d", *CODED).repartition("task").sortWithinPartitions("task")
    maybe = cut.mapInArrow(_maybe(threshold, errors), "task long, set long, partners array<long>")
    full = maybe.join(sets.select("set", "copies", "embedding"), "set").select("task", "set", "partners", "copies", "embedding")
    found = written(spark, full.repartition("task").sortWithinPartitions("task").mapInArrow(_links(threshold), "set long, links long, root long, exact long"))
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    labels = components(spark, found.where("links > 0").select(F.col("root").alias("a"), F.col("set").alias("b")).distinct()).withColumnsRenamed({"id": "set", "label": "part"})
    of_set = sets.select("set", "copies", "first").join(links, "set", "left").join(labels, "set", "left").withColumn("part", F.coalesce("part", "set"))
    of_set = of_set.join(of_set.groupBy("part").agg(F.min("first").alias("component")), "part")
    of_set = of_set.select("set", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    results = sets.select("set", *same, F.ceil(F.col("copies") / hot).cast("int").alias("salts")).join(of_set, "set")
    heavy = bounded(results.where("salts > 1").select(*same, "salts"))  # a row for more than `hot` copies
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.where("h1 is not null").select("vec_id", *same).join(heavy, list(same), "left").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts).cast("int")).drop("salts")
    results = results.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*same, "salt", "links", "component")
    out = dealt.join(results, [*same, "salt"]).select("vec_id", "links", "component")
    out = out.unionByName(rows.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component")))  # these meet nothing
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def oracle(threshold: float = THRESHOLD) -> str:
    """All pairs of a label as DuckDB SQL, for distinct ids."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {threshold}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN counts USING (vec_id) JOIN parts USING (vec_id)"""
