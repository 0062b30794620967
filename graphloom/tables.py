"""Reading, writing and rounding shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] = []


def _clean() -> None:
    """Deletes the tables of this application when it ends; results that were returned have been read by then."""
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the JVM may be gone
        for at in _made if spark else ():
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


atexit.register(_clean)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session with a local master may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/graphloom-shared"
    return at.rstrip("/")


def fresh_folder(spark: SparkSession) -> str:
    """A new name in the shared folder; what is put there goes when the application ends."""
    at = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    _made.append(at)
    return at


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a table in the folder that driver and executors share: cuts lineage between rounds of a loop."""
    at = fresh_folder(spark)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def rounded(x: Column, places: int = 3) -> Column:
    """Half up, as floor(x * 10^places + 0.5) / 10^places in double precision."""
    unit = float(10**places)
    return F.floor(x * F.lit(unit) + F.lit(0.5)).cast("double") / F.lit(unit)


def mean(x: Column, unit: int = 1) -> Column:
    """Mean of numbers that are whole multiples of 1 / unit, the same in whatever order rows come: whole numbers are summed."""
    return F.sum(F.round(x * unit).cast("long")).cast("double") / (F.count(x).cast("double") * unit)


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))
