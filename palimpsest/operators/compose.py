"""Composition of pages: mode, reading order, columns, gaps, style, running heads.

All windows are within a page or a document's pages, on the one partitioning by document that ``compose`` deals
out; a page has tens of blocks, so no partition of a window grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import plain_table, repeat_key, similarity
from ..schema import MODE_TOKENS, MODES, PAGE, REPEAT_SIMILARITY
from .blocks import resolve

DOCUMENT, VISUAL = MODES
ORDER = ["y", "x", "reading_order", "block_idx"]
FLOWING = ("Text", "List", "Table", "Formula")


def percent(x, p: int) -> Column:
    """Whole percent of a side, rounded down."""
    return F.expr(f"({x} * {p}) div 100")


# -- modes ------------------------------------------------------------------------------------------------------------
def page_modes(blocks: DataFrame) -> DataFrame:
    """doc_id, page_no and mode of every page, by what its blocks look like."""
    area = (F.col("w") * F.col("h")).cast("double")
    whole = F.max((F.greatest("page_w", F.lit(1)) * F.greatest("page_h", F.lit(1))).cast("double"))
    texts = F.col("block_type").isin("Text", "List", "Formula", "Title", "Table")
    count = lambda c: F.count_if(c)
    zero = F.lit(0.0)
    wide = F.col("w").cast("double") / F.greatest(F.col("page_w"), F.lit(1)).cast("double") >= 0.55
    pages = blocks.groupBy(*PAGE).agg(
        whole.alias("whole"), F.max("has_image").alias("raster"),
        F.coalesce(F.max(F.when(F.col("block_type") == "Image", area)), zero).alias("image_max"),
        F.coalesce(F.sum(F.when(F.col("block_type") == "Image", area)), zero).alias("image_sum"),
        F.coalesce(F.sum(F.when(texts, area)), zero).alias("text_area"),
        count(texts).alias("n"), count(texts & wide).alias("n_wide"),
        (count(F.col("block_type").isin("Title", "Table")) == 0).alias("no_sem"),
    )
    c = F.col
    prominent = (c("image_max") / c("whole") >= 0.12) | (c("image_sum") / c("whole") >= 0.18)
    low = c("text_area") / c("whole") <= 0.33
    few = c("n_wide") <= 1
    visual = (
        (prominent & c("no_sem") & (((c("n") >= 2) & few) | low))
        | (c("raster") & (c("n") >= 3) & (c("n_wide") == 0) & low)
        | (c("raster") & c("no_sem") & (c("n") >= 4) & few)
        | (c("raster") & prominent & ((c("n") == 0) | (c("n_wide") == 0)))
    )
    return pages.select(*PAGE, F.when(visual, VISUAL).otherwise(DOCUMENT).alias("mode"))


def mode_of_token(token: Column) -> Column:
    return F.when(token == "document", DOCUMENT).when(token == "visual", VISUAL)


def token_of_mode(mode: Column) -> Column:
    return F.when(mode == DOCUMENT, "document").when(mode == VISUAL, "visual")


def persisted_modes(tokens: Column, n_pages: Column) -> Column:
    """Modes from a comma list; unknown tokens go, and the list counts only if it has one for each page."""
    kept = F.filter(F.split(tokens, ","), lambda t: F.trim(t).isin(*MODE_TOKENS))
    return F.when(F.size(kept) == n_pages, F.transform(kept, lambda t: mode_of_token(F.trim(t))))


def with_modes(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """``pages`` (doc_id, page_no, mode) with the mode that the documents' metadata force, or persist, before the inferred."""
    known = documents.select("doc_id", "metadata")
    place = Window.partitionBy("doc_id")
    n, k = F.count("*").over(place), F.row_number().over(place.orderBy("page_no"))
    joined = pages.join(known, "doc_id", "left").withColumns({"_n": n, "_k": k})
    forced = mode_of_token(F.try_element_at("metadata", F.lit("processing_mode_preference")))
    kept = persisted_modes(F.try_element_at("metadata", F.lit("page_processing_modes")), F.col("_n"))
    return joined.withColumn("mode", F.coalesce(forced, F.get(kept, F.col("_k") - 1), "mode")).select(*PAGE, "mode")


def persist_modes(documents: DataFrame, modes: DataFrame) -> DataFrame:
    """``documents`` with their pages' modes in the metadata."""
    lists = modes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", token_of_mode(F.col("mode")).alias("t")))), lambda s: s["t"]), ",").alias("_modes"))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "page_processing_modes")
    joined = documents.join(lists, "doc_id", "left")
    return joined.withColumn("metadata", F.when(F.col("_modes").isNull(), F.col("metadata")).otherwise(F.map_concat(kept, F.create_map(F.lit("page_processing_modes"), "_modes")))).drop("_modes")


def document_modes(modes: DataFrame) -> DataFrame:
    """Visual only where every page is."""
    return modes.groupBy("doc_id").agg(F.when(F.every(F.col("mode") == VISUAL), VISUAL).otherwise(DOCUMENT).alias("mode"))


# -- order ------------------------------------------------------------------------------------------------------------
def anchor() -> Column:
    return F.col("block_type").isin("Title", "Separator") | (G.share() >= G.f32(0.70))


def right() -> Column:
    return G.centre() > G.half("page_w")


def two_columns(over: Window) -> Column:
    """Whether the flowing blocks of a partition stand in two columns: two or more on either side, a gutter of 4 % of the
    page between them, tops no further apart than 220."""
    flow = ~F.col("_anchor") & F.col("block_type").isin(*FLOWING)
    is_left, is_right = flow & ~F.col("_right"), flow & F.col("_right")
    gutter = F.greatest(F.min(F.when(is_right, F.col("x"))).over(over) - F.max(F.when(is_left, F.col("x") + F.col("w"))).over(over), F.lit(0))
    tops = F.abs(F.min(F.when(is_left, F.col("y"))).over(over) - F.min(F.when(is_right, F.col("y"))).over(over))
    enough = (F.count_if(is_left).over(over) >= 2) & (F.count_if(is_right).over(over) >= 2)
    return F.coalesce(enough & (gutter >= percent("page_w", 4)) & (tops <= 220), F.lit(False))


def marked(blocks: DataFrame) -> DataFrame:
    page = Window.partitionBy(*PAGE)
    return blocks.withColumns({"_anchor": anchor(), "_right": right()}).withColumn("_two", two_columns(page))


def column_stats(blocks: DataFrame) -> DataFrame:
    """doc_id, page_no, total_columns and the columns' left edges."""
    rows = marked(blocks)
    edge = lambda side, default: F.coalesce(F.nullif(F.min(F.when(~F.col("_anchor") & side, F.col("x"))), F.max("page_w")), default)
    return rows.groupBy(*PAGE).agg(F.when(F.max("_two"), 2).otherwise(1).alias("total_columns"), edge(~F.col("_right"), F.lit(0).cast("bigint")).alias("left_base"), edge(F.col("_right"), G.half(F.max("page_w"))).alias("right_base"))


def ordered(blocks: DataFrame) -> DataFrame:
    """``blocks`` (with mode) with position, 0 to n - 1 in each page, and _anchor, _right, _two.

    Visual pages keep (reading order, y, x). Others go by (y, x, reading order); on two-column pages anchors part the
    page into segments. A block belongs to the first segment whose start is not below its top and whose anchor is;
    one whose top lies within the anchor above the last segment comes at the end. Ties go by block_idx.
    """
    page = Window.partitionBy(*PAGE)
    rows = marked(blocks)
    cut = F.array_sort(F.collect_list(F.when(F.col("_anchor"), F.struct(*ORDER, "h"))).over(page))
    starts = F.transform(F.sequence(F.lit(1), F.size("_cut")), lambda i: F.struct(F.when(i > 1, F.get("_cut", i - 2)["y"] + F.get("_cut", i - 2)["h"]).otherwise(0).alias("start"), F.get("_cut", i - 1).alias("a"), i.alias("i")))
    rows = rows.withColumn("_cut", F.when(F.col("_two"), cut).otherwise(F.array().cast(f"array<struct<{','.join(f'{c}:bigint' if c != 'block_idx' else f'{c}:int' for c in ORDER)},h:bigint>>")))
    rows = rows.withColumn("_starts", F.when(F.size("_cut") > 0, starts))
    own = F.array_position("_cut", F.struct(*ORDER, "h")).cast("int")
    inside = F.get(F.filter("_starts", lambda s: (s["start"] <= F.col("y")) & (F.col("y") < s["a"]["y"])), F.lit(0))["i"]
    segment = F.when(F.col("_two") & F.col("_anchor"), own).when(F.col("_two"), F.coalesce(inside, F.size("_cut") + 1)).otherwise(0)
    rows = rows.withColumn("_segment", segment)
    part = Window.partitionBy(*PAGE, "_segment")
    split = F.when(F.col("_two") & ~F.col("_anchor") & two_columns(part), F.col("_right").cast("int")).otherwise(0)
    rows = rows.withColumn("_side", split)
    by_mode = [F.when(F.col("mode") == VISUAL, F.struct(*[F.col(c).cast("bigint").alias(f"k{i}") for i, c in enumerate(["reading_order", "y", "x", "block_idx"])]))]
    flow = F.struct("_segment", (F.col("_two") & F.col("_anchor")).cast("int").alias("a"), "_side", *ORDER)
    place = F.row_number().over(page.orderBy(*by_mode, F.when(F.col("mode") != VISUAL, flow))) - 1
    return rows.withColumn("position", place).drop("_cut", "_starts", "_segment", "_side")


# -- elements ---------------------------------------------------------------------------------------------------------
def elements(blocks: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """The elements of every page in reading order, with columns, gaps, indents and style. A page without width or height is an error of
    the run that reads it."""
    flat = (F.col("page_w") <= 0) | (F.col("page_h") <= 0)
    wide = F.when(flat, F.raise_error(F.lit("a page without width or height cannot be composed")).cast("bigint")).otherwise(F.col("page_w"))
    blocks = blocks.withColumn("page_w", wide).repartition("doc_id")
    modes = page_modes(blocks) if modes is None else modes
    rows = ordered(resolve(blocks.join(modes, PAGE)))
    page = Window.partitionBy(*PAGE)
    document = F.col("mode") == DOCUMENT
    total = F.when(document & F.col("_two"), 2).otherwise(1)
    free = ~F.col("_anchor")
    edge = lambda side, default: F.coalesce(F.nullif(F.min(F.when(free & side, F.col("x"))).over(page), F.col("page_w")), default)
    rows = rows.withColumns({"_left": edge(~F.col("_right"), F.lit(0)), "_base": edge(F.col("_right"), G.half("page_w"))})
    rows = rows.withColumn("total_columns", F.when((total == 2) & free, 2).otherwise(1)).withColumn("column_index", F.when((F.col("total_columns") == 2) & F.col("_right"), 1).otherwise(0))
    turn = page.orderBy("position")
    before = F.lag(F.col("y") + F.col("h")).over(turn)
    above = F.lag(F.col("y") + F.col("h")).over(Window.partitionBy(*PAGE, "_anchor", "_right").orderBy("position"))
    last = F.when(F.col("total_columns") == 2, above).otherwise(before)
    gap = F.least(F.greatest(G.points(F.greatest(F.col("y") - last, F.lit(0))), F.lit(0.0)), F.lit(32.0)).cast("float")
    base = F.when(F.col("column_index") == 1, F.col("_base")).otherwise(F.col("_left"))
    rows = rows.withColumns({
        "reading_order": F.col("position").cast("bigint"),
        "spacing_before_pt": F.when(F.col("position") == 0, 0.0).otherwise(F.coalesce(gap, F.lit(0.0))).cast("float"),
        "left_indent_pt": F.when(F.col("total_columns") == 2, G.points(F.greatest(F.col("x") - base, F.lit(0)))).otherwise(0.0).cast("float"),
        "text": F.when(F.col("content_kind") == "Table", plain_table(F.col("table"))).otherwise(F.col("text")),
    })
    rows = rows.withColumns({"alignment": G.alignment(), "emphasis": G.emphasis(), "font_scale": G.font_scale(), "keep_with_next": G.keep_with_next(), "preserve_positioning": G.preserve_positioning()})
    return rows.drop("_anchor", "_right", "_two", "_left", "_base", "position")


def with_running_heads(rows: DataFrame) -> DataFrame:
    """``rows`` (elements) with suspected_header and suspected_footer: an element near the page's edge that stands much the
    same on the nearest page before or after in document mode."""
    key = repeat_key(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("_key", key)
    near = F.col("role").isin("Title", "Paragraph", "ListItem", "Separator") & (F.col("_key") != "") & (F.col("mode") == DOCUMENT)
    spots = rows.withColumns({"_head": near & (F.col("y") <= percent("page_h", 14)), "_foot": near & (F.col("y") + F.col("h") >= percent("page_h", 88))})
    turn = Window.partitionBy("doc_id").orderBy("page_no")
    pages = rows.filter(F.col("mode") == DOCUMENT).select(*PAGE).distinct()
    pages = pages.withColumn("_near", F.array_compact(F.array(F.lag("page_no").over(turn), F.lead("page_no").over(turn)))).select(*PAGE, F.explode("_near").alias("other"))
    shape = ["role", "column_index", "total_columns"]
    small = spots.filter("_head or _foot").select(*PAGE, "block_idx", *shape, "x", "y", "w", "page_w", "_key", "_head", "_foot")
    left = small.join(pages, PAGE)
    there = small.select("doc_id", F.col("page_no").alias("other"), *shape, *[F.col(c).alias(f"o{c}") for c in ("x", "y", "w", "page_w", "_key", "_head", "_foot")])
    close = "abs(x - ox) <= (opage_w * 5) div 100 and abs(w - ow) <= (opage_w * 8) div 100 and abs(y - oy) <= 36"
    pairs = left.join(there, ["doc_id", "other", *shape]).filter(close).filter("(_head and o_head) or (_foot and o_foot)")
    alike = (F.col("_key") == F.col("o_key")) | (similarity(F.col("_key"), F.col("o_key")) >= G.f32(REPEAT_SIMILARITY))
    found = pairs.filter(alike).groupBy(*PAGE, "block_idx").agg(F.max(F.col("_head") & F.col("o_head")).alias("suspected_header"), F.max(F.col("_foot") & F.col("o_foot")).alias("suspected_footer"))
    no = F.lit(False)
    out = rows.drop("_key").join(found, [*PAGE, "block_idx"], "left")
    return out.withColumns({"suspected_header": F.coalesce("suspected_header", no), "suspected_footer": F.coalesce("suspected_footer", no)})


def compose(blocks: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """The blueprint: elements with running heads marked."""
    return with_running_heads(elements(blocks, modes))


def reordered(blocks: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """``blocks`` with reading_order by position."""
    modes = page_modes(blocks) if modes is None else modes
    rows = ordered(blocks.join(modes, PAGE))
    return rows.withColumn("reading_order", F.col("position").cast("bigint")).select(*blocks.columns)
