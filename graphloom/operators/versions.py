"""A pointer file that is swapped last: what it names is one consistent version, however many files make it up."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Pointer:
    """A small JSON file under a folder that driver and executors share, replaced by an atomic rename. Whoever reads it sees the
    version before or the one after, never a part of either; a writer that fails before the swap has changed nothing."""

    def __init__(self, spark: SparkSession, root: str, name: str = "CURRENT"):
        self.spark, self.root, self.at = spark, root.rstrip("/"), f"{root.rstrip('/')}/{name}"

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self) -> dict:
        """What was swapped in last; empty where nothing was."""
        path = self._path(self.at)
        fs = self._fs(path)
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def swap(self, content: dict) -> None:
        jvm, fresh, path = self.spark._jvm, self._path(f"{self.at}.{uuid.uuid4().hex}"), self._path(self.at)
        out = self._fs(fresh).create(fresh, True)
        try:
            out.write(json.dumps(content, sort_keys=True).encode())
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, path, options)

    def delete(self, at: str) -> None:
        path = self._path(at)
        self._fs(path).delete(path, True)

    def listed(self) -> list[str]:
        """Names in the folder."""
        path = self._path(self.root)
        fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
