"""The job table: a keyed store over Parquet, and the rules of its states."""

from __future__ import annotations

import json
import os
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import JOBS

# Messages.
INTERRUPTED = "Interrumpido: la aplicacion se cerro durante el procesamiento"
ACTIVE, FINISHED = ("Queued", "Processing"), ("Completed", "Failed", "Cancelled")


class JobNotFound(KeyError):
    pass


class LockTimeout(TimeoutError):
    pass


class BadStore(ValueError):
    """The stored jobs cannot be read."""


def upserted(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """``jobs`` with the rows of ``changes`` in place of those with the same id."""
    return jobs.join(changes.select("job_id"), "job_id", "left_anti").select(*jobs.columns).unionByName(changes.select(*jobs.columns))


def removed(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids.select("job_id"), "job_id", "left_anti").select(*jobs.columns)


def retained(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids.select("job_id"), "job_id", "left_semi").select(*jobs.columns)


def repaired(jobs: DataFrame) -> DataFrame:
    """Jobs that a stop left in processing have failed."""
    gone = F.col("status") == "Processing"
    return jobs.withColumns({"error_message": F.when(gone, INTERRUPTED).otherwise(F.col("error_message")), "status": F.when(gone, "Failed").otherwise(F.col("status"))})


def unfinished(jobs: DataFrame) -> DataFrame:
    """``jobs`` without the finished."""
    return jobs.filter(~F.col("status").isin(*FINISHED))


def admitted(new: DataFrame, jobs: DataFrame) -> DataFrame:
    """New jobs whose source has no queued or running job; the first of several for one source."""
    busy = jobs.filter(F.col("status").isin(*ACTIVE)).select("source_path").distinct()
    turn = F.row_number().over(Window.partitionBy("source_path").orderBy("created_at", "job_id"))
    return new.join(busy, "source_path", "left_anti").withColumn("_turn", turn).filter("_turn = 1").drop("_turn").select(*new.columns)


def last_phase(events: DataFrame) -> DataFrame:
    """Each job's last phase and progress by sequence."""
    top = F.max(F.struct("seq", "phase", "progress")).alias("s")
    return events.groupBy("job_id").agg(top).select("job_id", "s.seq", "s.phase", "s.progress")


def page_suffix(phase: Column, page: Column, total: Column) -> Column:
    return F.concat(phase, F.lit(" (pagina "), page.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))


def settled(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """``jobs`` after the ends among ``events``: completed with its time, cancelled without a message, or failed with it."""
    ends = events.filter("kind in ('Completed', 'Error')").groupBy("job_id").agg(F.max(F.struct("seq", "ts", "kind", "error")).alias("e"))
    cancelled = F.lower(F.coalesce("e.error", F.lit(""))).contains("cancel")
    status = F.when(F.col("e.kind") == "Completed", "Completed").when(cancelled, "Cancelled").otherwise("Failed")
    rows = jobs.join(ends, "job_id", "left")
    done = F.col("e").isNotNull()
    return rows.withColumns({
        "completed_at": F.when(done & (F.col("e.kind") == "Completed"), F.col("e.ts")).otherwise(F.col("completed_at")),
        "error_message": F.when(done & (F.col("e.kind") == "Error") & ~cancelled, F.col("e.error")).otherwise(F.col("error_message")),
        "status": F.when(done, status).otherwise(F.col("status")),
    }).select(*jobs.columns)


class JobStore:
    """Jobs in a folder: each change writes a new version and then moves the pointer to it, under a lock."""

    def __init__(self, spark: SparkSession, folder: str, lock_seconds: float = 5.0):
        self.spark, self.folder, self.lock_seconds = spark, folder, lock_seconds
        os.makedirs(folder, mode=0o700, exist_ok=True)

    @contextmanager
    def locked(self):
        path, start = os.path.join(self.folder, "jobs.lock"), time.monotonic()
        while True:
            try:
                os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600))
                break
            except FileExistsError:
                if time.monotonic() - start > self.lock_seconds:
                    raise LockTimeout(path) from None
                time.sleep(0.01)
        try:
            yield
        finally:
            os.unlink(path)

    def _pointer(self) -> str:
        return os.path.join(self.folder, "jobs.json")

    def load(self) -> DataFrame:
        if not os.path.exists(self._pointer()):
            return self.spark.createDataFrame([], JOBS)
        try:
            with open(self._pointer(), encoding="utf-8") as f:
                version = json.load(f)["version"]
        except (ValueError, KeyError) as e:
            raise BadStore(f"parseando jobs.json: {e}") from e
        return self.spark.read.schema(JOBS).parquet(os.path.join(self.folder, version))

    def _store(self, jobs: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        jobs.write.parquet(os.path.join(self.folder, version))
        part = self._pointer() + ".tmp"
        with open(os.open(part, os.O_CREAT | os.O_TRUNC | os.O_WRONLY, 0o600), "w", encoding="utf-8") as f:
            json.dump({"version": version}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, self._pointer())

    def save(self, jobs: DataFrame) -> None:
        with self.locked():
            self._store(upserted(self.load(), jobs))

    def get(self, job_id: str) -> DataFrame:
        found = self.load().filter(F.col("job_id") == job_id)
        if found.isEmpty():
            raise JobNotFound(job_id)
        return found

    def update(self, jobs: DataFrame) -> None:
        with self.locked():
            now = self.load()
            missing = jobs.join(now.select("job_id"), "job_id", "left_anti").limit(1).collect()
            if missing:
                raise JobNotFound(missing[0]["job_id"])
            self._store(upserted(now, jobs))

    def list(self) -> DataFrame:
        return self.load().orderBy("created_at", "job_id")

    def delete(self, job_id: str) -> None:
        with self.locked():
            now = self.load()
            if now.filter(F.col("job_id") == job_id).isEmpty():
                raise JobNotFound(job_id)
            self._store(now.filter(F.col("job_id") != job_id))

    def start(self) -> tuple[DataFrame, int]:
        """All jobs after repair, and how many had been interrupted."""
        with self.locked():
            now = self.load()
            n = now.filter("status = 'Processing'").count()
            if n:
                self._store(repaired(now))
        return self.list(), n
