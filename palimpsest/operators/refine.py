"""Refinement: retries of weak pages, merged block by block, and the passes around them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..schema import PAGE, REFINEMENT_STAGES, RETRY_GAIN, RETRY_SCORE, RETRY_THRESHOLD, SAME_ORDER_BONUS
from .blocks import weak

ELIGIBLE = ("Text", "Title", "List", "Table")


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` as a checkpoint, where the session names a folder for it: an engine then runs once, and what is read of it
    twice agrees. Without a folder they stay a plan, and an engine that is not deterministic may not agree with itself."""
    sc = rows.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            return rows
        sc.setCheckpointDir(named)
    return rows.checkpoint()


def weak_pages(blocks: DataFrame, threshold: float = RETRY_THRESHOLD) -> DataFrame:
    """All blocks of pages with a weak block."""
    return blocks.withColumn("_weak", F.max(weak(threshold)).over(Window.partitionBy(*PAGE))).filter("_weak").drop("_weak")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def takes(threshold: float, gain: float) -> Column:
    """Which block of _own takes which of _new: (block_idx, taken) in the order of the blocks."""
    box = lambda b: {k: b[k] for k in "xywh"}

    def add(acc, own):
        free = F.filter("_new", lambda n: (n["block_type"] == own["block_type"]) & ~F.exists(acc, lambda t: t["taken"] == n["block_idx"]))
        bonus = lambda n: F.when(own["reading_order"] == n["reading_order"], SAME_ORDER_BONUS).otherwise(0.0)
        rated = F.transform(free, lambda n: F.struct((iou(box(own), box(n)) + bonus(n)).alias("score"), n["block_idx"].alias("idx"), (n["confidence"] >= own["confidence"] + F.lit(gain)).alias("gains"), (F.trim(n["content"]) != "").alias("filled")))
        best = F.array_max(F.filter(rated, lambda r: r["score"] >= RETRY_SCORE))
        pick = lambda n: F.when(n["gains"] & n["filled"], F.concat(acc, F.array(F.struct(own["block_idx"].alias("block_idx"), n["idx"].alias("taken"))))).otherwise(acc)
        return F.when(own["block_type"].isin(*ELIGIBLE) & (own["confidence"] < F.lit(threshold)), let(best, pick)).otherwise(acc)

    return F.aggregate("_own", F.array().cast("array<struct<block_idx:int,taken:int>>"), add)


def merge_retry(blocks: DataFrame, retried: DataFrame, threshold: float = RETRY_THRESHOLD, gain: float = RETRY_GAIN) -> DataFrame:
    """``blocks`` with content, confidence and table of the retry where it is better.

    Weak blocks in order take the most similar unused block of the same type and page (overlap, and a bonus for the same
    reading order), the last of equals; the take holds only if confidence grows by ``gain`` and there is text. Pages meet by
    number. A fold over a page's few blocks says which takes which. Each side is read once.
    """
    listed = lambda: F.array_sort(F.collect_list(F.struct("block_idx", F.struct(*blocks.columns).alias("b"))))
    plain = lambda name: F.transform(name, lambda s: s["b"])
    own = blocks.groupBy(*PAGE).agg(listed().alias("_own")).withColumn("_own", plain("_own"))
    new = retried.select(*blocks.columns).groupBy(*PAGE).agg(listed().alias("_new")).withColumn("_new", plain("_new"))
    none = F.array().cast("array<struct<block_idx:int,taken:int>>")
    rows = own.join(new, PAGE, "left").withColumn("_takes", F.when(F.col("_new").isNull(), none).otherwise(takes(threshold, gain)))
    rows = rows.select("_new", "_takes", F.explode("_own").alias("o"))
    taken = F.get(F.filter("_takes", lambda t: t["block_idx"] == F.col("o.block_idx")), F.lit(0))["taken"]
    rows = rows.withColumn("_n", F.get(F.filter("_new", lambda n: n["block_idx"] == taken), F.lit(0))).withColumn("_got", taken.isNotNull())
    pick = lambda c: F.when(F.col("_got"), F.col(f"_n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    better = {"content": pick("content"), "confidence": pick("confidence"), "table": pick("table"), "layout_confidence": F.coalesce("o.layout_confidence", "_n.layout_confidence").alias("layout_confidence")}
    return rows.select(*[better.get(c, F.col(f"o.{c}")) for c in blocks.columns])


class StageError(RuntimeError):
    """A failure with the stage it came from."""

    def __init__(self, stage: str, message: str):
        super().__init__(f"{stage}: {message}")
        self.stage = stage


class Cancelled(RuntimeError):
    """The run was asked to stop between stages."""


@dataclass(frozen=True)
class Budget:
    most: int = 4

    def allows(self, used: int) -> bool:
        return used < self.most

    def remaining(self, used: int) -> int:
        return max(0, self.most - used)


@dataclass(frozen=True)
class Pass:
    """A named transform of blocks at one of ``REFINEMENT_STAGES``; ``refine`` takes (blocks, context)."""

    name: str
    stage: str = "AfterBlueprint"
    refine: Callable[[DataFrame, dict], DataFrame] = field(default=lambda blocks, context: blocks)

    def __post_init__(self):
        if self.stage not in REFINEMENT_STAGES:
            raise ValueError(f"no such stage: {self.stage}")


def confidence_boost(engine: Callable[[DataFrame, str], DataFrame], threshold: float = RETRY_THRESHOLD, gain: float = RETRY_GAIN) -> Pass:
    """Weak pages go through ``engine`` again in the accurate profile and are merged back."""

    def refine(blocks: DataFrame, context: dict) -> DataFrame:
        blocks = stored(blocks)
        return merge_retry(blocks, stored(engine(weak_pages(blocks, threshold), "Accurate")), threshold, gain)

    return Pass("confidence_boost", "AfterOcr", refine)


def run_passes(stage: str, blocks: DataFrame, passes: list[Pass], used: int, budget: Budget, notify=lambda *a: None, cancelled=lambda: False) -> tuple[DataFrame, int]:
    """The passes of ``stage`` in order while the budget lasts; (blocks, passes used)."""
    for p in passes:
        if p.stage != stage:
            continue
        if cancelled():
            raise Cancelled()
        if not budget.allows(used):
            break
        notify("refinamiento", p.name)
        try:
            blocks = p.refine(blocks, {"used": used, "remaining": budget.remaining(used)})
        except Exception as e:
            raise StageError("refinamiento", f"{p.name}: {e}") from e
        used += 1
    return blocks, used
