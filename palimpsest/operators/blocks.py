"""Acceptance of detected blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import f32
from ..functions.text import WHITE, mapping
from ..schema import ACCEPT_CONFIDENCE, ROLE_OF_TYPE


def trimmed(text="content") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rf"^{WHITE}|{WHITE}$", "")


def sure(confidence="confidence") -> Column:
    """Single-precision confidence at the acceptance threshold."""
    return f32(F.col(confidence)) >= f32(ACCEPT_CONFIDENCE)


def role() -> Column:
    return F.coalesce(F.try_element_at(mapping(ROLE_OF_TYPE), F.col("block_type")), F.col("block_type"))


def content_kind() -> Column:
    """What a block's content is taken as: Text, Table, Image, Raster or Empty."""
    kind, filled = F.col("block_type"), F.length(trimmed()) > 0
    text = F.when(filled & sure(), "Text").otherwise("Raster")
    table = F.when(F.col("table").isNotNull() & sure(), "Table").otherwise(text)
    return F.when(kind.isin("Text", "Title", "List", "Formula"), text).when(kind == "Table", table).when(kind.isin("Image", "Signature", "Stamp"), "Image").otherwise("Empty")


def resolve(blocks: DataFrame) -> DataFrame:
    """``blocks`` with role, content_kind, text (of Text), ocr_confidence (single precision) and fallback_used.

    Crops of Image and Raster are the block's own box on its page.
    """
    out = blocks.withColumns({"role": role(), "content_kind": content_kind(), "ocr_confidence": f32(F.col("confidence")), "layout_confidence": f32(F.col("layout_confidence"))})
    return out.withColumns({"text": F.when(F.col("content_kind") == "Text", trimmed()), "fallback_used": F.col("content_kind") == "Raster"})


def weak(threshold: float) -> Column:
    """Blocks that a retry may improve."""
    return F.col("block_type").isin("Text", "Title", "List", "Table") & (F.col("confidence") < F.lit(threshold))
