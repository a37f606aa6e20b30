"""Incremental, idempotent ingestion (T1, T2, T4, S11): new files in bounded micro-batches, upserted by document."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

FILES_PER_BATCH = 4
#: The other bound of a batch: files of this many bytes in all, or one that is larger; few small files would leave most cores idle.
BYTES_PER_BATCH = 1 << 29


def watch(spark: SparkSession, folder: str, schema: str, form: str = "parquet", most: int = FILES_PER_BATCH) -> DataFrame:
    """At most ``most`` files in a micro-batch."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", most).load(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str, process=lambda df: df) -> StreamingQuery:
    """Process what is new and stop. A batch that runs twice overwrites its own folder, so it counts once."""

    def batch(df: DataFrame, number: int) -> None:
        rows = process(df)
        # of rows with one key the last in the order of their columns stays, whatever the order they come in
        once = rows.groupBy(key).agg(F.max(F.struct(*[c for c in rows.columns if c != key])).alias("v")).select(key, "v.*")
        once.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The newest row of each key over all batches; combined before the shuffle."""
    rows = spark.read.parquet(target)
    value = F.struct(*[c for c in rows.columns if c not in (key, "batch")])
    return rows.groupBy(key).agg(F.max_by(value, "batch").alias("v")).select(key, "v.*")


class Progress(StreamingQueryListener):
    """Tells ``callback(message, rows)`` how an ingestion goes; add it with spark.streams.addListener. Its errors are logged, and end nothing."""

    def __init__(self, callback: Callable[[str, int], None]) -> None:
        self.callback, self.rows = callback, 0

    def tell(self, message: str) -> None:
        try:
            self.callback(message, self.rows)
        except Exception as why:  # noqa: BLE001  a report must not end the work
            logging.getLogger(__name__).warning("progress callback: %s", why)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell("started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        self.tell(f"batch {event.progress.batchId}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.tell("idle")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell("failed" if event.exception else "finished")
