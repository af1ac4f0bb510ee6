"""Boxes, points and style as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import POINTS_PER_PIXEL


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def points(pixels: Column) -> Column:
    return pixels.cast("double") * F.lit(POINTS_PER_PIXEL)


def half(x) -> Column:
    return F.floor(col(x) / F.lit(2)).cast("bigint")


def centre(x="x", w="w") -> Column:
    return col(x) + half(w)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, w, h); 0 if they are apart or empty."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = F.when((wide > 0) & (high > 0), (wide * high).cast("double")).otherwise(F.lit(0.0))
    union = (a["w"] * a["h"] + b["w"] * b["h"]).cast("double") - inter
    return F.when((inter <= 0) | (union <= 0), F.lit(0.0)).otherwise(inter / F.when(union > 0, union))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, f32(low)), f32(high))


def share(part="w", whole="page_w") -> Column:
    """Single-precision share of a page's side."""
    return f32(col(part)) / f32(F.greatest(col(whole), F.lit(1)))


def alignment() -> Column:
    off = F.abs(f32(centre()) - (f32(F.col("page_w")) / f32(2.0)).cast("float"))
    return (
        F.when(share() >= f32(0.85), "FullWidth")
        .when((F.col("role") == "Title") & (off <= (f32(F.col("page_w")) * f32(0.12)).cast("float")), "Center")
        .when((F.col("x") >= F.floor(F.col("page_w") * 55 / F.lit(100))) & (share() < f32(0.40)), "Right")
        .otherwise("Left")
    )


def emphasis() -> Column:
    return F.when(F.col("role") == "Title", "Strong").when(F.col("role").isin("Separator", "Stamp"), "Neutral").otherwise("Regular")


def font_scale() -> Column:
    tall = share("h", "page_h")
    title = clamp((f32(1.2) + (f32(14.0) * tall).cast("float")).cast("float"), 1.4, 2.4)
    body = clamp((f32(0.9) + (f32(6.0) * tall).cast("float")).cast("float"), 0.9, 1.2)
    role = F.col("role")
    return F.when(role == "Title", title).when(role.isin("Paragraph", "ListItem"), body).when(role == "Table", f32(0.95)).when(role == "Formula", f32(1.1)).otherwise(f32(1.0)).cast("float")


def keep_with_next() -> Column:
    return F.col("role").isin("Title", "Separator")


def preserve_positioning() -> Column:
    return (
        (F.col("mode") == "VisualPreservation")
        | F.col("content_kind").isin("Image", "Raster", "Table")
        | F.col("role").isin("Figure", "Formula", "Signature", "Stamp", "Separator")
        | (F.col("total_columns") > 1)
    )
