"""Jobs in the background: one thread a job, its events in a queue, cancelled between stages and in Spark."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.refine import Cancelled
from .pipeline import Pipeline

# What users are told.
STARTING = "Iniciando..."
STATUS_SECONDS, LOG_LINES, POLL_SECONDS = 3.0, 100, 0.1


@dataclass
class Running:
    """What is known of a job that runs."""

    events: queue.SimpleQueue = field(default_factory=queue.SimpleQueue)
    cancelled: threading.Event = field(default_factory=threading.Event)
    group: str = field(default_factory=lambda: f"job-{uuid.uuid4().hex}")
    phase: str = STARTING
    progress: float = 0.0
    thread: threading.Thread | None = None


class JobRuntime:
    """Starts jobs, hands on their events, and keeps phase and progress of each until it is forgotten."""

    def __init__(self, spark: SparkSession, pipeline: Callable[[], Pipeline] = Pipeline):
        self.spark, self.pipeline = spark, pipeline
        self.jobs: dict[str, Running] = {}

    def start(self, job_id: str, read: Callable[[], DataFrame], profile: str = "Balanced", finish: Callable[[DataFrame], object] = lambda rows: rows.count(), blueprint: bool = True) -> None:
        """Runs the pipeline over what ``read`` returns; ``finish`` uses its result, which is when Spark works. The last event is
        Completed with what ``finish`` returned, or Error."""
        own = self.jobs[job_id] = Running()
        sc = self.spark.sparkContext

        def work():
            sc.setJobGroup(own.group, f"job {job_id}", True)
            pipe = self.pipeline()
            pipe.listener = lambda event: own.events.put(event) if event["kind"] == "Progress" else None
            try:
                rows = pipe.run(read(), profile, own.cancelled.is_set, blueprint)
                if own.cancelled.is_set():
                    raise Cancelled()
                result = finish(rows)
                own.events.put({"kind": "Completed", "ts": time.time(), "result": result})
            except Exception as e:  # whatever goes wrong is the job's last event
                stopped = own.cancelled.is_set() or isinstance(e, Cancelled)
                own.events.put({"kind": "Error", "ts": time.time(), "error": "cancelled" if stopped else str(e)})

        own.thread = threading.Thread(target=work, daemon=True)
        own.thread.start()

    def cancel(self, job_id: str) -> bool:
        """Asks a job to stop; whether it is known."""
        own = self.jobs.get(job_id)
        if own is None:
            return False
        own.cancelled.set()
        self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(own.group)  # what it was about to start is stopped too
        return True

    def events_of(self, job_id: str) -> list[dict]:
        """What has happened since; none for a job that is not known. Phase and progress follow."""
        out, own = [], self.jobs.get(job_id)
        while own is not None:
            try:
                event = own.events.get_nowait()
            except queue.Empty:
                break
            out.append(event)
            if event["kind"] == "Progress":
                self.update(job_id, event["phase"], event["progress"])
        return out

    def events(self) -> dict[str, list[dict]]:
        """Events of all jobs that have any, without waiting."""
        found = {job: self.events_of(job) for job in list(self.jobs)}
        return {job: e for job, e in found.items() if e}

    def update(self, job_id: str, phase: str, progress: float) -> None:
        own = self.jobs.get(job_id)
        if own is not None:
            own.phase, own.progress = phase, progress

    def page(self, job_id: str, page: int, total: int) -> None:
        """Adds the page to the phase."""
        own = self.jobs.get(job_id)
        if own is not None:
            own.phase = f"{own.phase} (pagina {page}/{total})"

    def phase(self, job_id: str) -> str | None:
        return self.jobs[job_id].phase if job_id in self.jobs else None

    def progress(self, job_id: str) -> float | None:
        return self.jobs[job_id].progress if job_id in self.jobs else None

    def active(self) -> bool:
        """Whether any job is still followed."""
        return bool(self.jobs)

    def forget(self, job_id: str) -> None:
        self.jobs.pop(job_id, None)

    def retain(self, ids: list[str]) -> None:
        """Forgets all jobs but ``ids``."""
        self.jobs = {job: own for job, own in self.jobs.items() if job in set(ids)}


class Messages:
    """A log of the last lines, and a status that is seen for a while."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock = clock
        self.lines: deque[str] = deque(maxlen=LOG_LINES)
        self._status: tuple[str, float] | None = None

    def log(self, text: str) -> None:
        self.lines.append(f"[{time.strftime('%H:%M:%S')}] {text}")

    def recent(self, n: int = 5) -> list[str]:
        """The last lines, newest first."""
        return list(self.lines)[::-1][:n]

    def show(self, text: str) -> None:
        self._status = (text, self.clock())

    def status(self) -> str | None:
        return self._status[0] if self._status and self.clock() - self._status[1] < STATUS_SECONDS else None


def cancel_job(runtime: JobRuntime, jobs: DataFrame, job_id: str, messages: Messages) -> bool:
    """Cancels a job of the table that is being worked on, and says so."""
    if jobs.filter((F.col("job_id") == job_id) & (F.col("status") == "Processing")).isEmpty() or not runtime.cancel(job_id):
        return False
    messages.log(f"Cancelacion solicitada: {job_id[:8]}")
    messages.show(f"Cancelando job {job_id[:8]}...")
    return True


def poll(runtime: JobRuntime, handle: Callable[[str, dict], None], ticks: int, bootstrap=None, on_step: Callable = lambda step: None, wait: float = POLL_SECONDS) -> None:
    """``ticks`` rounds: one event of the engine's start, all events of all jobs, a pause."""
    for _ in range(ticks):
        step = bootstrap.step() if bootstrap is not None else None
        if step is not None:
            on_step(step)
        for job, events in runtime.events().items():
            for event in events:
                handle(job, event)
        time.sleep(wait)


def recent_events(events: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` events of a table, newest first."""
    return events.orderBy(F.desc("ts"), F.desc("seq"), "job_id").limit(n)


def scrolled(rows: DataFrame, by: list[str], skip: int) -> DataFrame:
    """``rows`` in order without the first ``skip``."""
    return rows.orderBy(*by).offset(skip)


def page_counts(blocks: DataFrame, keywords: list[str] = ()) -> DataFrame:
    """doc_id, pages, blocks, blocks_per_page and keyword_rate (the share of ``keywords`` that its text holds, in any case; null without keywords)."""
    out = blocks.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"), F.count("*").alias("blocks"), *[F.max(F.lower("content").contains(k.lower()).cast("int")).alias(f"_k{i}") for i, k in enumerate(keywords)])
    rate = sum((F.col(f"_k{i}") for i in range(len(keywords))), F.lit(0)) / F.lit(float(len(keywords))) if keywords else F.lit(None).cast("double")
    return out.select("doc_id", "pages", "blocks", (F.col("blocks") / F.col("pages")).alias("blocks_per_page"), rate.alias("keyword_rate"))
