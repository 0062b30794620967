"""Source trees as tables: scanning, archives, modules, decoding."""

from __future__ import annotations

import os
import re
import subprocess
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as fn

# fixed values: folders that hold no sources, files that mark a module
SKIPPED = (".git", ".svn", ".hg", ".idea", ".vscode", ".gradle", ".mvn", "target", "build", "out", "bin", "node_modules", "dist")
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts")
ROOT, MAX_BYTES = "root", 1_048_576
MAX_UNPACKED, MAX_ENTRIES = 500 * 1024 * 1024, 100_000


def modules(files: DataFrame, builds: DataFrame, path: str = "path") -> DataFrame:
    """files with module: the nearest folder above that holds a build file, `root` if none but the top one does.

    builds: path of every build file. Each file meets the folders above it by equality; the longest one wins.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = builds.select(F.regexp_replace("path", r"/?[^/]+$", "").alias("folder")).where("folder <> ''").distinct()
    asked = files.select(path).distinct().select(path, F.explode(above).alias("folder"))
    near = asked.join(folders, "folder").groupBy(path).agg(F.max_by("folder", F.length("folder")).alias("module"))
    return files.join(near, path, "left").withColumn("module", F.coalesce("module", F.lit(ROOT)))


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path (under root), module, sha256, size, test, text of the sources of a tree that Spark can read."""
    top = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    scheme = r"^[a-z0-9]+:/*"
    begin = len(re.sub(scheme, "/", top)) + 1
    # the reader passes over empty files: they come from its own listing
    listed = [(unquote(re.sub(r"^[a-z0-9]+:/*", "/", f))[begin:],) for f in raw.inputFiles()]
    raw = raw.select(F.substring(F.regexp_replace("path", scheme, "/"), begin + 1, 1 << 20).alias("path"), "length", "content")
    raw = spark.createDataFrame(listed, "path string").join(raw, "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("content", F.lit(b"")).alias("content"))
    return sources(raw, max_bytes)


def sources(raw: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, module, sha256, size, test, text of the sources among files (path, length, content)."""
    skipped = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda d: d.isin(*SKIPPED))
    raw = raw.where(~skipped)
    name = F.element_at(F.split("path", "/"), -1)
    files = raw.where(fn.is_source("path") & (F.col("length") <= max_bytes)).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), fn.is_test("path").alias("test"), fn.decoded("content").alias("text"))
    return modules(files, raw.where(name.isin(*BUILD_FILES)).select("path"))


def numbered(files: DataFrame) -> DataFrame:
    """files with file_id: a hash of the path, the same in every run."""
    return files.withColumn("file_id", F.xxhash64("path"))


def first_of_each(rows: DataFrame, key: str, by: str = "path") -> DataFrame:
    """The first row of each key, by path: what is declared twice counts once."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(by))).where("n_ = 1").drop("n_")


def checkout(url: str, into: str) -> str:
    """Shallow clone, or fetch and reset; gives the id of the head."""
    if os.path.isdir(os.path.join(into, ".git")):
        subprocess.run(["git", "-C", into, "fetch", "--depth", "1", "origin"], check=True, capture_output=True)
        subprocess.run(["git", "-C", into, "reset", "--hard", "FETCH_HEAD"], check=True, capture_output=True)
    else:
        subprocess.run(["git", "clone", "--depth", "1", url, into], check=True, capture_output=True)
    return subprocess.run(["git", "-C", into, "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()
