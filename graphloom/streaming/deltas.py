"""The chunk index of all projects as a base and deltas, by embedder, merged at reading.

A change writes the rows that it brings and nothing else; a pointer file, swapped last, says which files count. Of a chunk
(project, path, id) the row of the highest `seq` stands; one that says `drop` takes it out. When deltas outgrow the base they
are merged into a new one.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.versions import Pointer

KEY = ("project_id", "path", "id")
SCHEMA = "project_id long, path string, id string, seq long, action string, hash string, text string, vector array<float>"
#: Deltas of more than this share of the base, and more than LEAST rows, are merged into it.
SHARE, LEAST = 0.5, 10_000


class DeltaIndex:
    """Chunks with the vectors of one embedder: those of another are of no use to it, and are not seen. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, embedder: str, share: float = SHARE, least: int = LEAST):
        self.spark, self.share, self.least = spark, share, least
        self.root = f"{root.rstrip('/')}/embedder={quote(embedder, safe='')}"
        self.pointer = Pointer(spark, self.root)

    def _write(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{name}")
        return {"name": name, "rows": self._read([name]).count()}

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.root}/{n}" for n in names))

    def apply(self, changes: DataFrame, number: int) -> bool:
        """Adds changes (SCHEMA) as delta `number`; False if it, or a later one, is there already (a batch that is run again)."""
        now = self.pointer.read()
        if number <= now.get("last", -1):
            return False
        delta = self._write(changes.select(*(c.split()[0] for c in SCHEMA.split(", "))))
        self.pointer.swap(now | {"last": number, "deltas": [*now.get("deltas", []), delta]})
        if sum(d["rows"] for d in now.get("deltas", [])) + delta["rows"] > max(self.least, self.share * now.get("base", {"rows": 0})["rows"]):
            self.compact()
        return True

    def read(self) -> DataFrame:
        """project_id, path, id, seq, hash, text, vector of the chunks that stand. Rows of the base meet the deltas' keys only."""
        now = self.pointer.read()
        deltas = self._read([d["name"] for d in now.get("deltas", [])])
        base = self._read([now["base"]["name"]] if "base" in now else [])
        rest = [c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] not in KEY]
        latest = deltas.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("seq", (F.col("action") == "put").cast("int"))).alias("x")).select(*KEY, "x.*")
        # an older row of a delta does not hide a newer one of the base
        met = base.join(latest.select(*KEY, F.col("seq").alias("seq_")), list(KEY), "left").where("seq_ is null or seq > seq_").drop("seq_")
        newer = latest.join(base.select(*KEY, F.col("seq").alias("seq_")), list(KEY), "left").where("seq_ is null or seq >= seq_").drop("seq_")
        return met.select(*latest.columns).unionByName(newer).where("action = 'put'").drop("action")

    def compact(self) -> None:
        """One base of what stands now. Drops go with the rows that they took out: changes older than those must not come later."""
        now = self.pointer.read()
        base = self._write(self.read().withColumn("action", F.lit("put")))
        self.pointer.swap({"last": now.get("last", -1), "base": base, "deltas": []})

    def vacuum(self) -> int:
        """Takes away what the pointer no longer names, when no reader is left that began before; how many folders."""
        now = self.pointer.read()
        kept = {d["name"] for d in now.get("deltas", [])} | ({now["base"]["name"]} if "base" in now else set())
        gone = [x for x in self.pointer.listed() if not x.startswith((".", "CURRENT")) and x not in kept]
        for x in gone:
            self.pointer.delete(f"{self.root}/{x}")
        return len(gone)

    def counts(self) -> dict[str, int]:
        """Rows of the base and of the deltas, as written."""
        now = self.pointer.read()
        return {"base": now.get("base", {"rows": 0})["rows"], "deltas": sum(d["rows"] for d in now.get("deltas", []))}
