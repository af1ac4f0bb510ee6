"""The chain from blocks to a blueprint, with progress, cancellation and refinement passes."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cleaned
from ..operators.compose import compose
from ..operators.engine import Engine, stub_engine, table_text
from ..operators.refine import Budget, Cancelled, Pass, StageError, run_passes
from ..sources.files import DocumentNotFound, scan

# Progress by stage, and by refinement stage.
PROGRESS = {"parseo": 0.0, "raster": 0.15, "ocr": 0.50, "tablas": 0.75, "texto": 0.90, "composicion": 0.97, "fin": 1.0}
REFINING = {"BeforeOcr": 0.22, "AfterOcr": 0.62, "BeforeBlueprint": 0.93, "AfterBlueprint": 0.985}


class Pipeline:
    """``run`` takes blocks through the engine, tables, clean-up and composition. Stages are transforms of a DataFrame:
    cancellation is looked for between them, and nothing runs until the result is used: a failure while Spark works names no stage,
    unless ``store`` (for instance ``operators.refine.stored``) makes each stage's rows before the next. Tables are touched only in table blocks."""

    def __init__(self, engine: Engine = stub_engine, passes: list[Pass] | None = None, budget: Budget = Budget(), preprocess: Callable[[DataFrame], DataFrame] | None = None, clean: dict | None = None, tables: Callable[[DataFrame], DataFrame] = table_text, store: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        self.engine, self.passes, self.budget, self.preprocess = engine, passes or [], budget, preprocess
        self.clean, self.tables, self.store = clean or {}, tables, store
        self.events: list[dict] = []
        self.listener: Callable[[dict], object] = lambda event: None

    def _notify(self, phase: str, progress: float, kind: str = "Progress", error: str | None = None) -> None:
        self.events.append({"seq": len(self.events), "ts": time.time(), "kind": kind, "phase": phase, "progress": progress, "error": error})
        try:
            self.listener(self.events[-1])
        except Exception:  # whoever listened is gone: the run goes on
            pass

    def run_path(self, spark: SparkSession, path: str, profile: str = "Balanced", renderer=None, cancelled: Callable[[], bool] = lambda: False, blueprint: bool = True) -> tuple[DataFrame, DataFrame]:
        """``run`` over the pages of the files under ``path``, which the engine turns into blocks; and the files and pages that could not be read
        (doc_id, error). A path without anything is an error of the stage that reads."""
        try:
            pages = scan(spark, path, renderer)
        except DocumentNotFound as e:
            self._notify("parseo", PROGRESS["parseo"], "Error", str(e))
            raise StageError("parseo", f"NotFound: {e}") from e
        good = pages.filter("error is null").select("doc_id", "page_no", "width", "height", "png")
        return self.run(good, profile, cancelled, blueprint), pages.filter("error is not null").select("doc_id", "error")

    def run(self, blocks: DataFrame, profile: str = "Balanced", cancelled: Callable[[], bool] = lambda: False, blueprint: bool = True) -> DataFrame:
        """The blueprint's elements, or the blocks without it. Failures carry the stage's name."""
        used = 0

        def stage(name: str, step: Callable[[DataFrame], DataFrame], rows: DataFrame) -> DataFrame:
            if cancelled():
                self._notify(name, PROGRESS[name], "Error", "cancelled")
                raise Cancelled()
            self._notify(name, PROGRESS[name])
            try:
                return self.store(step(rows))
            except Exception as e:
                self._notify(name, PROGRESS[name], "Error", str(e))
                raise StageError(name, str(e)) from e

        def refine(at: str, rows: DataFrame) -> DataFrame:
            nonlocal used
            rows, used = run_passes(at, rows, self.passes, used, self.budget, lambda phase, _: self._notify(phase, REFINING[at]), cancelled)
            return rows

        rows = stage("parseo", lambda b: b, blocks)
        rows = stage("raster", self.preprocess or (lambda b: b), rows)
        rows = refine("BeforeOcr", rows)
        rows = stage("ocr", lambda b: self.engine(b, profile), rows)
        rows = refine("AfterOcr", rows)
        rows = stage("tablas", self.tables, rows)
        rows = stage("texto", lambda b: b.withColumn("content", cleaned(F.col("content"), **self.clean)), rows)
        rows = refine("BeforeBlueprint", rows)
        if blueprint:
            rows = stage("composicion", compose, rows)
            rows = refine("AfterBlueprint", rows)
        self._notify("fin", PROGRESS["fin"], "Completed")
        return rows
