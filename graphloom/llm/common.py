"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: \x20 and \x09-\x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A word, as a Java and DuckDB regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session with a local master may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/graphloom-shared"
    return at.rstrip("/")


_made: list[str] = []


def _clean() -> None:
    """Deletes the tables of this application when it ends; results that were returned have been read by then."""
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the JVM may be gone
        for at in _made if spark else ():
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


atexit.register(_clean)


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts lineage, survives lost executors."""
    at = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    _made.append(at)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def row_key(df: DataFrame, *cols: str) -> list[Column]:
    """Two columns that identify a row by its id and content without nulls: identical rows share them."""
    first = F.coalesce(F.col(cols[0]).cast("long"), F.lit(-(2**63)))
    return [first.alias("did"), F.xxhash64(*cols).alias("rk")]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A table of at most so many short rows is broadcast to meet texts; a larger one is joined by shuffling both.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, width: int = 1) -> DataFrame:
    return F.broadcast(df) if df.count() * width <= BROADCAST_ROWS else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores behind it as set it apart from df's columns."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out
