"""Pages to blocks with text: models run over Arrow batches and put out tensors; what these mean is decided in Spark.

``load`` makes the models, once a task: callables orientation, layout, detect, recognise and table from a tensor to an array (table: to class
logits and boxes). Each step reads the page's picture by a join; pictures are as many as pages, blocks are only boxes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_table
from ..schema import BLOCKS, PAGE, TABLE_TYPE
from . import detect as D
from . import raster as R
from .engine import block_text, thresholds

Loader = Callable[[], SimpleNamespace]
TEXTUAL, PICTURES = ("Text", "Title", "List"), ("Image", "Signature", "Stamp")
# What the orientation model's classes are.
ORIENTATIONS = ("Normal", "Rotado90", "Rotado180", "Rotado270")
CLASSES = 10


def region(pixels: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray | None:
    """The part of a box in an image; none if it starts outside or is narrower than two pixels either way."""
    high, wide = pixels.shape[:2]
    if x >= wide or y >= high or min(w, wide - x) < 2 or min(h, high - y) < 2:
        return None
    return R.cropped(pixels, x, y, w, h)


def lists(a: np.ndarray) -> list:
    return [row.tolist() for row in np.asarray(a, dtype=np.float32)]


def detected(pages: DataFrame, load: Loader, profile: str) -> DataFrame:
    """doc_id, page_no, png, page_w, page_h of upright ``pages`` (doc_id, page_no, png) with the layout model's tensor and scales."""
    turn = thresholds(profile)["orientation"]

    def run(batches: Iterator[pd.DataFrame]):
        models = load()
        for rows in batches:
            out = []
            for r in rows.itertuples():
                pixels = R.decode_png(bytes(r.png))
                if turn:
                    best = int(np.argmax(np.asarray(models.orientation(R.orientation_tensor(pixels))).ravel()))
                    pixels = np.ascontiguousarray(R.upright(pixels, ORIENTATIONS[best]))
                tensor, sx, sy = R.layout_tensor(pixels)
                found = np.asarray(models.layout(tensor))
                out.append((r.doc_id, r.page_no, R.encode_png(pixels), pixels.shape[1], pixels.shape[0], lists(found.reshape(found.shape[-2:])), sx, sy))
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "png", "page_w", "page_h", "tensor", "sx", "sy"])

    kind = dict(pages.dtypes)["doc_id"]
    return pages.filter("png is not null").select("doc_id", "page_no", "png").mapInPandas(run, f"doc_id {kind}, page_no int, png binary, page_w long, page_h long, tensor array<array<float>>, sx double, sy double")


def laid_out(found: DataFrame, profile: str) -> DataFrame:
    """Blocks of ``detected`` pages, without text."""
    settings = thresholds(profile)
    boxes = D.suppressed(D.anchor_boxes(F.col("tensor"), CLASSES, settings["layout"]), settings["overlap"])
    side = lambda b, v, s: (b[v] * F.col(s)).alias(v)
    scaled = F.transform(boxes, lambda b: F.struct(side(b, "x", "sx"), side(b, "y", "sy"), side(b, "w", "sx"), side(b, "h", "sy"), b["score"].alias("score"), b["cls"].alias("cls")))
    return D.layout_blocks(found.select(*PAGE, scaled.alias("boxes")), F.lit(1.0), F.lit(1.0))


def on_pages(boxes: DataFrame, found: DataFrame) -> DataFrame:
    return boxes.join(found.select(*PAGE, "png"), PAGE)


def recognised(lines: DataFrame, dictionary: list[str]) -> DataFrame:
    """``lines`` (with steps) with text and confidence."""
    read = D.ctc(F.col("steps"), F.array(*map(F.lit, dictionary)), logits=True)
    return lines.withColumn("_read", read).withColumns({"text": F.col("_read.text"), "confidence": F.col("_read.confidence")}).drop("_read", "steps")


def lines_of(blocks: DataFrame, found: DataFrame, load: Loader, dictionary: list[str], profile: str) -> DataFrame:
    """doc_id, page_no, block_idx, place, text, confidence: lines of textual blocks; a block in which none are found is one."""
    settings = thresholds(profile)

    def run(batches: Iterator[pd.DataFrame]):
        models = load()
        for rows in batches:
            out = []
            for r in rows.itertuples():
                crop = region(R.decode_png(bytes(r.png)), r.x, r.y, r.w, r.h)
                if crop is None:
                    continue
                tensor = R.detection_tensor(crop)
                fx, fy = crop.shape[1] / tensor.shape[3], crop.shape[0] / tensor.shape[2]
                scores = np.asarray(models.detect(tensor))
                found_ = R.regions(scores.reshape(scores.shape[-2:]), settings["binarize"], settings["smallest"])
                found_ = [(int(x * fx), int(y * fy), int(w * fx), int(h * fy)) for x, y, w, h in found_]
                order = sorted(range(len(found_)), key=lambda k: (found_[k][1] // 20, found_[k][0], k))
                parts = [p for p in (region(crop, *found_[k]) for k in order) if p is not None] if found_ else [crop]
                if parts:
                    steps = np.asarray(models.recognise(R.recognition_batch(parts)))
                    out += [(r.doc_id, r.page_no, r.block_idx, k, lists(s)) for k, s in enumerate(steps)]
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "block_idx", "place", "steps"])

    kind = dict(blocks.dtypes)["doc_id"]
    rows = on_pages(blocks.filter(F.col("block_type").isin(*TEXTUAL)).select(*PAGE, "block_idx", "x", "y", "w", "h"), found)
    return recognised(rows.mapInPandas(run, f"doc_id {kind}, page_no int, block_idx int, place int, steps array<array<float>>"), dictionary)


def tables_of(blocks: DataFrame, found: DataFrame, load: Loader, dictionary: list[str]) -> DataFrame:
    """doc_id, page_no, block_idx and table: the structure of table blocks with the text of their cells."""
    kind = dict(blocks.dtypes)["doc_id"]

    def structure(batches: Iterator[pd.DataFrame]):
        models = load()
        for rows in batches:
            out = []
            for r in rows.itertuples():
                crop = region(R.decode_png(bytes(r.png)), r.x, r.y, r.w, r.h)
                if crop is not None:
                    logits, boxes = models.table(R.table_tensor(crop))
                    out.append((r.doc_id, r.page_no, r.block_idx, R.encode_png(crop), crop.shape[1], crop.shape[0], lists(np.asarray(logits).reshape(-1, np.asarray(logits).shape[-1])), lists(np.asarray(boxes).reshape(-1, 4))))
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "block_idx", "crop", "wide", "high", "logits", "boxes"])

    rows = on_pages(blocks.filter("block_type = 'Table'").select(*PAGE, "block_idx", "x", "y", "w", "h"), found)
    rows = rows.mapInPandas(structure, f"doc_id {kind}, page_no int, block_idx int, crop binary, wide int, high int, logits array<array<float>>, boxes array<array<float>>")
    grids = rows.select(*PAGE, "block_idx", "crop", D.grid(D.table_lines(F.col("logits"), F.col("boxes"), F.col("wide"), F.col("high"))).cast(TABLE_TYPE).alias("table"))

    def cells(batches: Iterator[pd.DataFrame]):
        models = load()
        for rows in batches:
            out = []
            for r in rows.itertuples():
                part = region(R.decode_png(bytes(r.crop)), r.x, r.y, r.w, r.h)
                if part is not None:
                    out.append((r.doc_id, r.page_no, r.block_idx, r.i, r.j, lists(np.asarray(models.recognise(R.recognition_batch([part])))[0])))
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "block_idx", "i", "j", "steps"])

    each = grids.select(*PAGE, "block_idx", "crop", F.posexplode("table.rows").alias("i", "r")).select(*PAGE, "block_idx", "crop", "i", F.posexplode("r").alias("j", "c"))
    each = each.select(*PAGE, "block_idx", "crop", "i", "j", "c.x", "c.y", "c.w", "c.h")
    read = recognised(each.mapInPandas(cells, f"doc_id {kind}, page_no int, block_idx int, i int, j int, steps array<array<float>>"), dictionary)
    texts = read.groupBy(*PAGE, "block_idx").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", F.col("i").cast("string"), F.col("j").cast("string")), "text"))).alias("texts"))
    text = lambda i, j: F.coalesce(F.try_element_at("texts", F.concat_ws(",", i.cast("string"), j.cast("string"))), F.lit(""))
    fill = F.transform("table.rows", lambda r, i: F.transform(r, lambda c, j: c.withField("content", text(i, j))))
    return grids.join(texts, [*PAGE, "block_idx"], "left").select(*PAGE, "block_idx", F.col("table").withField("rows", fill).alias("table"))


def page_ocr(pages: DataFrame, load: Loader, dictionary: list[str], profile: str = "Balanced") -> DataFrame:
    """``BLOCKS`` of ``pages`` (doc_id, page_no, png): layout, lines of text, and, but for the fast profile, tables. Pages without a picture give none."""
    from .refine import stored

    found = stored(detected(pages, load, profile))
    blocks = stored(laid_out(found, profile))
    key = [*PAGE, "block_idx"]
    text = block_text(lines_of(blocks, found, load, dictionary, profile))
    rows = blocks.withColumnRenamed("confidence", "_layout").join(text, key, "left").withColumn("confidence", F.coalesce("confidence", "_layout"))
    if thresholds(profile)["tables"]:
        rows = rows.join(tables_of(blocks, found, load, dictionary), key, "left")
    else:
        rows = rows.withColumn("table", F.lit(None).cast(TABLE_TYPE))
    rows = rows.withColumn("content", F.when(F.col("table").isNotNull(), markdown_table(F.col("table"))).otherwise(F.coalesce("content", F.lit(""))))
    rows = rows.join(found.select(*PAGE, "page_w", "page_h"), PAGE).withColumn("has_image", F.lit(True))
    return rows.select(*[c.split()[0] for c in BLOCKS.replace(TABLE_TYPE, "t").split(", ")])


def embedded(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, block_idx and png of the blocks that are pictures; those without a part on their page are left out."""
    rows = on_pages(blocks.filter(F.col("block_type").isin(*PICTURES)).select(*PAGE, "block_idx", "x", "y", "w", "h"), pages.filter("png is not null"))

    def run(batches: Iterator[pd.DataFrame]):
        for part in batches:
            crops = [region(R.decode_png(bytes(r.png)), r.x, r.y, r.w, r.h) for r in part.itertuples()]
            yield part[["doc_id", "page_no", "block_idx"]].assign(png=[None if c is None else R.encode_png(c) for c in crops])

    return rows.mapInPandas(run, f"doc_id {dict(blocks.dtypes)['doc_id']}, page_no int, block_idx int, png binary").filter("png is not null")


def over_document(blocks: DataFrame, pages: DataFrame, load: Loader, dictionary: list[str], profile: str = "Balanced") -> DataFrame:
    """``blocks`` with those of pages that have a picture replaced by what is read there."""
    seen = pages.filter("png is not null").select(*PAGE).distinct()
    return blocks.join(seen, PAGE, "left_anti").select(*blocks.columns).unionByName(page_ocr(pages, load, dictionary, profile).select(*blocks.columns))
