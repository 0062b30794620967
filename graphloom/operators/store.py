"""Stored tables of all projects, in buckets of files, and what has been run on them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators.versions import Pointer
from graphloom.tables import written

TABLES = ("source_file", "parsed", "entity", "edge", "entity_metric", "module_metric")
RUNS = "run_id long, project_id long, mode string, status string, started_at timestamp, finished_at timestamp, duration_ms long, error string"
ABANDONED = "interrupted"
BUCKETS, BUCKET = 64, "bucket_"


class Store:
    """Tables under a folder that driver and executors share. Each project's tables with a file_id are cut into buckets by it,
    each in a folder of its own; a pointer file says which folders make up the project now and is swapped last. So readers see
    all tables before a change or all after it, an edit of few files writes their buckets only, and a writer that fails leaves
    the old version. A project has one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _at(self, project: int) -> str:
        return f"{self.root}/project_id={project}"

    def _pointer(self, project: int) -> Pointer:
        return Pointer(self.spark, self._at(project))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("file_id"), F.lit(self.buckets)).cast("int")

    def _paths(self, project: int, table: str) -> list[str]:
        """Folders of a table; none if it has no rows."""
        parts = self._pointer(project).read().get(table, {}).get("parts", {})
        return [f"{self._at(project)}/{x}" for x in sorted(parts.values())]

    def has(self, table: str, project: int) -> bool:
        return table in self._pointer(project).read()

    def load(self, table: str, project: int, schema: StructType | str | None = None) -> DataFrame:
        """A project's rows; none, of the schema given or stored with it, where there are none."""
        if paths := self._paths(project, table):
            known = StructType.fromJson(self._pointer(project).read()[table]["schema"])
            return self.spark.read.schema(known).parquet(*paths)
        known = self._pointer(project).read().get(table)
        return self.spark.createDataFrame([], StructType.fromJson(known["schema"]) if known else schema or StructType())

    def _write(self, project: int, table: str, df: DataFrame) -> dict:
        """Writes df beside what is there; its entry for the pointer. Buckets without rows have no folder."""
        name = f"{table}/v={uuid.uuid4().hex}"
        at = f"{self._at(project)}/{name}"
        keyed = df.withColumn(BUCKET, self._bucket() if "file_id" in df.columns else F.lit(0))
        (keyed.repartition(BUCKET) if "file_id" in df.columns else keyed).write.partitionBy(BUCKET).parquet(at)
        pointer = Pointer(self.spark, at)
        parts = {x.split("=")[1]: f"{name}/{x}" for x in pointer.listed() if x.startswith(BUCKET)}
        return {"parts": parts, "schema": df.schema.jsonValue()}

    def replace(self, project: int, **tables: DataFrame) -> None:
        """Stores these tables of a project, over whatever it had. They may have been read from here."""
        fresh = {name: self._write(project, name, df) for name, df in tables.items()}
        pointer = self._pointer(project)
        pointer.swap(pointer.read() | fresh)

    def patch(self, project: int, files: DataFrame, **fresh: DataFrame) -> list[int]:
        """Stores the rows that these files (file_id) have now, in place of those they had; tables have a file_id and are stored
        already. Only the files' buckets are read and written; their numbers are returned."""
        pointer = self._pointer(project)
        now = pointer.read()
        hit = sorted(r[0] for r in files.select(self._bucket()).distinct().collect())  # at most `buckets` numbers
        for table, df in fresh.items():
            old = now[table]["parts"]
            paths = [f"{self._at(project)}/{old[str(b)]}" for b in hit if str(b) in old]
            schema = StructType.fromJson(now[table]["schema"])
            rows = df.select(*schema.names)
            if paths:
                kept = self.spark.read.schema(schema).parquet(*paths).join(files.select("file_id").distinct(), "file_id", "left_anti")
                rows = kept.select(*schema.names).unionByName(rows)
            parts = {b: x for b, x in old.items() if int(b) not in hit} | self._write(project, table, rows)["parts"]
            now = now | {table: {"parts": parts, "schema": schema.jsonValue()}}
        pointer.swap(now)
        return hit

    def vacuum(self, project: int) -> int:
        """Takes away folders that the pointer no longer names, when no reader is left that began before; how many."""
        pointer, gone = self._pointer(project), 0
        kept = {x for t in pointer.read().values() for x in t["parts"].values()}
        for table in TABLES:
            for version in Pointer(self.spark, f"{self._at(project)}/{table}").listed():
                for part in Pointer(self.spark, f"{self._at(project)}/{table}/{version}").listed():
                    if part.startswith(BUCKET) and f"{table}/{version}/{part}" not in kept:
                        pointer.delete(f"{self._at(project)}/{table}/{version}/{part}")
                        gone += 1
        return gone

    def delete(self, project: int) -> None:
        """Takes away all that is stored of a project, runs as well: the pointer first, so that nobody sees a half."""
        pointer = self._pointer(project)
        pointer.delete(pointer.at)
        pointer.delete(self._at(project))

    def runs(self, project: int) -> DataFrame:
        """Each run of a project as it stands now: of its rows the one written last."""
        pointer = Pointer(self.spark, f"{self._at(project)}/run")
        rows = self.spark.read.schema(RUNS).parquet(pointer.root) if pointer.listed() else self.spark.createDataFrame([], RUNS)
        last = F.max_by(F.struct(*(c for c in rows.columns if c != "run_id")), F.coalesce("finished_at", F.lit("1970-01-01").cast("timestamp")))
        return rows.groupBy("run_id").agg(last.alias("x")).select("run_id", "x.*")

    def _put(self, project: int, run: DataFrame) -> None:
        run.coalesce(1).write.mode("append").parquet(f"{self._at(project)}/run")

    def begin(self, project: int, mode: str) -> int:
        """A new run's id; runs that were left running are marked as failed first."""
        self.abandon(project)
        run = (self.runs(project).agg(F.max("run_id")).first()[0] or 0) + 1
        self._put(project, self.spark.range(1).select(
            F.lit(run).cast("long").alias("run_id"), F.lit(project).cast("long").alias("project_id"), F.lit(mode).alias("mode"), F.lit("RUNNING").alias("status"), F.current_timestamp().alias("started_at"),
            F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("error"),
        ))
        return run

    def _end(self, project: int, runs: DataFrame, status: str, error: str | None) -> None:
        now = F.current_timestamp()
        ms = (F.unix_millis(now) - F.unix_millis("started_at")).alias("duration_ms")
        self._put(project, written(self.spark, runs.select("run_id", "project_id", "mode", F.lit(status).alias("status"), "started_at", now.alias("finished_at"), ms, F.lit(error).cast("string").alias("error"))))

    def finish(self, project: int, run: int, error: str | None = None) -> None:
        self._end(project, self.runs(project).where(F.col("run_id") == run), "FAILED" if error else "SUCCESS", error)

    def abandon(self, project: int) -> None:
        """Runs that are still marked as running failed: nobody is running them."""
        left = self.runs(project).where("status = 'RUNNING'")
        if not left.isEmpty():
            self._end(project, left, "FAILED", ABANDONED)
