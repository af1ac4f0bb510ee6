"""Job events as a stream: last phase by job, endings merged into the job table, stale jobs evicted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import JobStore, settled
from ..schema import EVENTS

PHASES = "job_id string, seq long, phase string, progress float"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON files arrive in ``folder``."""
    return spark.readStream.schema(EVENTS).json(folder)


def phases(events: DataFrame) -> DataFrame:
    """Each job's last phase and progress by sequence; the state is one row a job."""
    return events.groupBy("job_id").agg(F.max(F.struct("seq", "phase", "progress")).alias("s")).select("job_id", "s.*")


def counts(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by kind in windows of event time; what comes later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "kind").agg(F.count("*").alias("n"))


def monitor(events: DataFrame, store: JobStore, checkpoint: str, after: Callable[[DataFrame], None] = lambda done: None) -> StreamingQuery:
    """Merges the endings of each batch into ``store``; a batch that runs twice after a loss gives the same jobs."""

    def merge(batch: DataFrame, _: int) -> None:
        ends = batch.filter("kind in ('Completed', 'Error')")
        known = store.load().join(ends.select("job_id").distinct(), "job_id", "left_semi")
        if not known.isEmpty():
            done = settled(known, ends)
            store.update(done)
            after(done)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
