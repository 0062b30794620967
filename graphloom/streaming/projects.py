"""A stream of project events that keeps the chunk index: one at a time for each project, whatever their order.

Events carry a number that grows within a project (`seq`). The state of a project holds, for each path, the number of the
last event and the hashes of its chunks. An event older than what its path, or the project's deletion, has seen changes
nothing, so late and repeated events give the index that the right order gives. What comes out are the chunks to put and to
drop, which `deltas.DeltaIndex` keeps; chunks with the hash that they had are neither.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphloom.streaming.deltas import SCHEMA, DeltaIndex

#: kind: `update` (all chunks of a path; none: the path is gone) or `delete` (the project, all paths).
EVENTS = "project_id long, seq long, at timestamp, kind string, path string, chunks array<struct<id: string, hash: string, text: string>>"
CHANGES = "project_id long, path string, id string, seq long, action string, hash string, text string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds by which an event (its `at`) may be late; so long deleted projects, and paths that are gone, turn away older events.
REMEMBERED = 24 * 3600


class ProjectIndex(StatefulProcessor):
    """Of each project: what its paths hold, and the number of its last deletion."""

    def __init__(self, remembered: int = REMEMBERED):
        self.remembered = remembered * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "seq long, hashes string")
        self.deleted = handle.getValueState("deleted", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        project, changes = int(key[0]), []
        gone = self.deleted.get()[0] if self.deleted.exists() else -1
        forget = 0
        for part in rows:
            for event in part.itertuples(index=False):
                seq = int(event.seq)
                if seq <= gone:
                    continue
                if event.kind == "delete":
                    gone, forget = seq, max(forget, int(event.at.timestamp() * 1000))
                    for (path,), (last, hashes) in list(self.paths.iterator()):
                        if last < seq:
                            changes += [(project, path, i, seq, "drop", None, None) for i in json.loads(hashes)]
                            self.paths.removeKey((path,))
                    continue
                known = self.paths.getValue((event.path,)) if self.paths.containsKey((event.path,)) else None
                last, old = (known[0], json.loads(known[1])) if known else (-1, {})
                if seq <= last:
                    continue
                chunks = {} if event.chunks is None else {c["id"]: c for c in event.chunks}
                changes += [(project, event.path, i, seq, "put", c["hash"], c["text"]) for i, c in chunks.items() if old.get(i) != c["hash"]]
                changes += [(project, event.path, i, seq, "drop", None, None) for i in old if i not in chunks]
                forget = forget if chunks else max(forget, int(event.at.timestamp() * 1000))
                self.paths.updateValue((event.path,), (seq, json.dumps({i: c["hash"] for i, c in chunks.items()}, sort_keys=True)))
            if changes:
                yield self._frame(changes)
                changes = []
        if gone >= 0:
            self.deleted.update((gone,))
        if forget:
            self.handle.registerTimer(forget + self.remembered)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        """Forgets what is gone, when no event that is older can come any more; a later timer, of a later event, stands for that."""
        if not list(self.handle.listTimers()):
            for (path,), (_, hashes) in list(self.paths.iterator()):
                if hashes == "{}":
                    self.paths.removeKey((path,))
            self.deleted.clear()
        yield self._frame([])

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(changes: list[tuple]) -> pd.DataFrame:
        columns = [c.split()[0] for c in CHANGES.split(", ")]
        return pd.DataFrame(changes, columns=columns).astype({"project_id": "int64", "seq": "int64"})


def changes(events: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """The chunks to put and to drop (CHANGES) of a stream of events (EVENTS)."""
    return events.withWatermark("at", f"{remembered} seconds").groupBy("project_id").transformWithStateInPandas(ProjectIndex(remembered), CHANGES, "Update", "EventTime")


def maintain(events: DataFrame, index: DeltaIndex, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None, remembered: int = REMEMBERED, **trigger) -> StreamingQuery:  # noqa: ANN003
    """Starts the stream into the index. embed gives rows (CHANGES) their vector; trigger: as for DataStreamWriter.trigger, all
    that is there by default. The session's state store must be PROVIDER."""

    def write(batch: DataFrame, number: int) -> None:
        rows = embed(batch) if embed else batch.withColumn("vector", F.lit(None).cast("array<float>"))
        index.apply(rows.select(*(c.split()[0] for c in SCHEMA.split(", "))), number)

    return changes(events, remembered).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
