"""The life of documents as a stateful stream (T1, T3, T5): one state a document, refusals, and a timer for runs that never end.

A stream of requests (start, finish, fail) is keyed by document. A start is refused while a run is on (T5); a finish or
fail is refused where none is. A run that is on for longer than ``patience`` in event time fails, by a timer when the
watermark passes, or at once when the document's next request is that late. The state lies in the state store, so a restart from
the checkpoint goes on where the last batch ended, and every request is answered once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.workers import ship

REQUESTS = "document long, request long, action string, at timestamp"
#: accepted is false for a refusal; reason says why, and of a run that timed out that it did.
ANSWERS = "document long, request long, action string, status string, accepted boolean, reason string"
ANSWER = Row(*(f.split()[0] for f in ANSWERS.split(", ")))
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Where a document stands after an action that is allowed (fixed values).
ENDS = {"finish": "completed", "fail": "failed"}


class LifeCycle(StatefulProcessor):
    """States: no row is "uploaded"; request and since (milliseconds) are those of the run that is on."""

    def __init__(self, patience: int) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("life", "status string, request long, since long")

    def _keep(self, before: tuple, now: tuple) -> None:
        """State and timer as they stand after all of a document's requests: calls that leave Python are made once, not for each request."""
        if now == before:
            return
        if before[2] != now[2]:
            if before[2] is not None:
                self.handle.deleteTimer(before[2] + self.patience)
            if now[2] is not None:
                self.handle.registerTimer(now[2] + self.patience)
        self.state.update(now)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        (document,) = key
        before = tuple(self.state.get() or ("uploaded", None, None))
        status, run, since = before
        for millis, request, action in sorted(((r["millis"], r["request"], r["action"]) for r in rows), key=lambda r: r[:2]):
            if run is not None and millis > since + self.patience:
                yield ANSWER(document, run, "fail", "failed", True, "timed out")
                status, run, since = "failed", None, None
            on = status == "extracting"
            if action == "start" and not on:
                status, run, since = "extracting", request, millis
            elif action in ENDS and on:
                status, run, since = ENDS[action], None, None
            else:
                yield ANSWER(document, request, action, status, False, "already extracting" if on else "not extracting")
                continue
            yield ANSWER(document, request, action, status, True, None)
        self._keep(before, (status, run, since))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        before = tuple(self.state.get())
        if before[1] is not None:
            yield ANSWER(key[0], before[1], "fail", "failed", True, "timed out")
            self._keep(before, ("failed", None, None))


def answers(requests: DataFrame, patience: int = 1_800_000, delay: str = "0 seconds") -> DataFrame:
    """A stream of REQUESTS to one of ANSWERS. patience: milliseconds that a run may take; delay: how late requests may come."""
    spark = requests.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own = requests.withColumn("at", F.col("at").cast("timestamp")).select("document", "request", "action", "at", F.unix_millis("at").alias("millis")).withWatermark("at", delay)
    return own.groupBy("document").transformWithState(LifeCycle(patience), ANSWERS, "Update", "EventTime")


def stream_path(spark: SparkSession, path: str) -> str:
    """A path as a stream takes it: folders as they are, one file as a pattern that only it fits."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    return path if folder else f"{path[:-1]}[{path[-1]}]"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="foliant-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run(answered: DataFrame, folder: str) -> None:
    """Answer all requests there are, add the answers to ``folder``/answers, and stop."""

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/answers/batch={number}")

    answered.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def answered(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{ANSWERS}, batch int").parquet(f"{folder}/answers").drop("batch")
