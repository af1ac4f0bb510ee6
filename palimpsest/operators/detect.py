"""Decoding of what detectors and recognisers put out: boxes, overlaps, tables, characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import f32, iou

BOX = "struct<x:float,y:float,w:float,h:float,score:float,cls:int,idx:int>"


def first_max(values: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def last_max(values: Column) -> Column:
    """0-based place of the last largest value."""
    return (F.size(values) - F.array_position(F.reverse(values), F.array_max(values))).cast("int")


def softmax_at(values: Column, place: Column) -> Column:
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp((v - top).cast("double")))
    return F.exp((F.get(values, place) - top).cast("double")) / total


def anchor_boxes(tensor: Column, n_classes: int, threshold: float) -> Column:
    """Boxes above the threshold of a tensor [4 + classes][n] of centres, sizes and class scores."""
    n = F.size(F.get(tensor, F.lit(0)))
    at = lambda k, i: F.get(F.get(tensor, F.lit(k)), i).cast("float")
    scores = lambda i: F.array(*[at(4 + c, i) for c in range(n_classes)])
    box = lambda i: F.struct(
        (at(0, i) - at(2, i) / 2).cast("float").alias("x"), (at(1, i) - at(3, i) / 2).cast("float").alias("y"), at(2, i).alias("w"), at(3, i).alias("h"),
        F.array_max(scores(i)).cast("float").alias("score"), first_max(scores(i)).alias("cls"), i.cast("int").alias("idx"),
    )
    boxes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), box)).otherwise(F.array().cast(f"array<{BOX}>"))
    return F.filter(boxes, lambda b: b["score"] >= f32(threshold))


def by_score(boxes: Column) -> Column:
    """Boxes by falling score; equals keep their order."""
    return F.transform(F.array_sort(F.transform(boxes, lambda b: F.struct((-b["score"]).alias("k"), b["idx"].alias("i"), b.alias("b")))), lambda s: s["b"])


def suppressed(boxes: Column, overlap: float) -> Column:
    """Boxes that survive: from the best down, those of the same class that overlap a kept one too much go."""
    none = F.filter(boxes, lambda b: F.lit(False))
    step = lambda kept, b: F.when(F.exists(kept, lambda k: (k["cls"] == b["cls"]) & (iou(k, b) > F.lit(overlap))), kept).otherwise(F.concat(kept, F.array(b)))
    return F.aggregate(by_score(boxes), none, step)


# What the layout model's classes are.
LAYOUT_CLASSES = {0: "Title", 1: "Text", 3: "Image", 4: "Image", 5: "Table", 6: "Table", 7: "Table", 8: "Formula", 9: "Formula"}


def layout_blocks(detections: DataFrame, scale_x: Column, scale_y: Column) -> DataFrame:
    """Blocks from ``detections`` (doc_id, page_no, boxes after suppression): class 2 is dropped, sides are scaled and
    truncated, order is from the top down."""
    rows = detections.select("doc_id", "page_no", F.posexplode("boxes").alias("rank", "b")).filter("b.cls <> 2")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in LAYOUT_CLASSES.items() for v in kv]), F.col("b.cls")), F.lit("Unknown"))
    whole = lambda v, s: F.greatest((F.col(f"b.{v}") * s).cast("bigint"), F.lit(0).cast("bigint"))
    rows = rows.select("doc_id", "page_no", "rank", kind.alias("block_type"), whole("x", scale_x).alias("x"), whole("y", scale_y).alias("y"), whole("w", scale_x).alias("w"), whole("h", scale_y).alias("h"), F.col("b.score").cast("double").alias("confidence"))
    place = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("y", "rank")) - 1
    return rows.withColumns({"block_idx": place.cast("int"), "reading_order": place.cast("bigint"), "layout_confidence": F.col("confidence")}).drop("rank")


def table_lines(logits: Column, boxes: Column, width: Column, height: Column, threshold: float = 0.5) -> Column:
    """Rows (class 2) and columns (class 1) of a table from queries' class logits (the last, no object, left out) and
    normalized centre boxes."""
    def one(l, i):
        own = F.slice(l, 1, F.size(l) - 1)
        b = F.get(boxes, i)
        at = lambda k: F.get(b, F.lit(k)).cast("double")
        whole = lambda v, side: F.greatest((v * side).cast("bigint"), F.lit(0).cast("bigint"))
        return F.struct(first_max(own).alias("cls"), softmax_at(own, first_max(own)).alias("score"), whole(at(0) - at(2) / 2, width).alias("x"), whole(at(1) - at(3) / 2, height).alias("y"), whole(at(2), width).alias("w"), whole(at(3), height).alias("h"), i.cast("int").alias("idx"))

    return F.filter(F.transform(logits, one), lambda c: (c["score"] >= threshold) & c["cls"].isin(1, 2))


def grid(lines: Column) -> Column:
    """A table from its lines: a cell where each row meets each column; the first row is the header. Without rows or without
    columns there is none."""
    def sorted_by(cls, key):
        kept = F.filter(lines, lambda c: c["cls"] == cls)
        return F.transform(F.array_sort(F.transform(kept, lambda c: F.struct(c[key].alias("k"), c["idx"].alias("i"), c.alias("c")))), lambda s: s["c"])

    rows, columns = sorted_by(2, "y"), sorted_by(1, "x")

    def cell(r, i, c):
        return F.struct(F.lit("").alias("content"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), c["x"].alias("x"), r["y"].alias("y"), c["w"].alias("w"), r["h"].alias("h"), F.when(i == 0, "Center").otherwise("Left").alias("alignment"), (i == 0).alias("is_emphasized"))

    body = F.transform(rows, lambda r, i: F.transform(columns, lambda c: cell(r, i, c)))
    some = (F.size(rows) > 0) & (F.size(columns) > 0)
    widths = F.transform(columns, lambda c: c["w"].cast("int"))
    empty = F.struct(F.filter(body, lambda r: F.lit(False)).alias("rows"), F.lit(0).alias("num_rows"), F.lit(0).alias("num_cols"), F.array().cast("array<int>").alias("header_row_indices"), F.array().cast("array<int>").alias("column_widths"))
    full = F.struct(body.alias("rows"), F.size(rows).alias("num_rows"), F.size(columns).alias("num_cols"), F.array(F.lit(0)).alias("header_row_indices"), widths.alias("column_widths"))
    return F.when(some, full).otherwise(empty)


def ctc(steps: Column, dictionary: Column, logits: bool = True) -> Column:
    """text and confidence of a recogniser's steps: runs of the same best symbol are one character, symbol 0 is none, symbols
    beyond the dictionary are skipped; confidence is the mean chance of the characters, 0 without any."""
    best = F.transform(steps, last_max)
    chance = lambda i, k: softmax_at(F.get(steps, i), k) if logits else F.get(F.get(steps, i), k).cast("double")
    start = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0).alias("last"), F.lit(0).alias("i"))

    def add(acc, k):
        seen = (k != 0) & (k != acc["last"]) & (k <= F.size(dictionary))
        return F.struct(
            F.when(seen, F.concat(acc["text"], F.coalesce(F.get(dictionary, k - 1), F.lit("")))).otherwise(acc["text"]).alias("text"),
            F.when(seen, acc["total"] + chance(acc["i"], k)).otherwise(acc["total"]).alias("total"), F.when(seen, acc["n"] + 1).otherwise(acc["n"]).alias("n"), k.alias("last"), (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(best, start, add, lambda acc: F.struct(acc["text"].alias("text"), F.when(acc["n"] > 0, acc["total"] / acc["n"]).otherwise(0.0).alias("confidence")))


def text_rows(regions: DataFrame) -> DataFrame:
    """``regions`` (doc_id, page_no, x, y, idx) with place: bands of 20 from the top, left to right in each."""
    return regions.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy(F.expr("y div 20"), "x", "idx")) - 1)


def clipped(width: Column, height: Column) -> Column:
    """The part of a box (x, y, w, h) within an image; null where it starts outside or is narrower than 2 either way."""
    w, h = F.least(F.col("w"), width - F.col("x")), F.least(F.col("h"), height - F.col("y"))
    return F.when((F.col("x") < width) & (F.col("y") < height) & (w >= 2) & (h >= 2), F.struct("x", "y", w.alias("w"), h.alias("h")))


def otsu(histogram: Column) -> Column:
    """The threshold that parts a histogram of 256 counts best; 128 where none does."""
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, v: a + v)
    weighted = F.aggregate(F.transform(histogram, lambda v, i: v * i), F.lit(0).cast("long"), lambda a, v: a + v)
    zero = F.lit(0).cast("long")
    start = F.struct(total.alias("total"), weighted.alias("weighted"), zero.alias("n"), zero.alias("s"), F.lit(0.0).alias("best"), F.lit(128).alias("at"), F.lit(0).alias("i"))

    def add(acc, v):
        n, s = acc["n"] + v, acc["s"] + v * acc["i"]
        rest = acc["total"] - n
        apart = s.cast("double") / F.when(n > 0, n) - (acc["weighted"] - s).cast("double") / F.when(rest > 0, rest)
        spread = F.coalesce(n.cast("double") * rest.cast("double") * apart * apart, F.lit(-1.0))
        better = spread > acc["best"]
        return F.struct(acc["total"].alias("total"), acc["weighted"].alias("weighted"), n.alias("n"), s.alias("s"), F.when(better, spread).otherwise(acc["best"]).alias("best"), F.when(better, acc["i"]).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"))

    return F.aggregate(histogram, start, add, lambda acc: acc["at"])
