"""PDF of composed documents: text is laid out in Spark, files are put together a document at a time."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import points
from ..functions.text import winansi_hex
from .latex import low_confidence_image

# Widths of the Helvetica glyphs from the blank to the tilde, in thousandths; 556 for all others.
GLYPHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556,
    556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667,
    611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667,
    667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500,
    222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
OTHER = 556


def text_width(text: Column, size: Column) -> Column:
    """The width of a line in points."""
    table = F.array(*map(F.lit, GLYPHS))
    wide = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.get(table, F.ascii(c) - 32), F.lit(OTHER)).cast("long"))
    return F.aggregate(wide, F.lit(0).cast("long"), lambda a, w: a + w).cast("double") * size / F.lit(1000.0)


def wrapped(text: Column, width: Column, size: Column) -> Column:
    """Lines of words that fit ``width`` points, at least one word each; an empty line stays."""

    def fill(line: Column) -> Column:
        words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
        start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"))

        def add(acc, word):
            longer = F.when(acc["now"] == "", word).otherwise(F.concat(acc["now"], F.lit(" "), word))
            fits = (acc["now"] == "") | (text_width(longer, size) <= width)
            return F.struct(F.when(fits, acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["now"]))).alias("lines"), F.when(fits, longer).otherwise(word).alias("now"))

        return F.aggregate(words, start, add, lambda acc: F.concat(acc["lines"], F.array(acc["now"])))

    return F.flatten(F.transform(F.split(text, "\n"), fill))


def text_lines(elements: DataFrame) -> DataFrame:
    """One row a line of text on the page: where it starts, its size, and its bytes in hexadecimal."""
    size = F.least(F.greatest(0.8 * points(F.col("h")), F.lit(6.0)), F.lit(72.0))
    rows = elements.withColumns({"_text": F.trim(F.coalesce("text", F.lit(""))), "size": size}).filter("_text <> ''")
    rows = rows.withColumns({"leading": F.greatest(1.18 * F.col("size"), F.lit(8.0)), "usable": F.greatest(points(F.col("w")) - 4, F.lit(10.0))})
    rows = rows.withColumn("_lines", wrapped(F.col("_text"), F.col("usable"), F.col("size")))
    rows = rows.select("*", F.posexplode("_lines").alias("line", "value"))
    top = points(F.col("page_h") - F.col("y")) - F.col("size")
    rows = rows.withColumn("baseline", top - F.col("line") * F.col("leading")).filter("baseline > 0")
    free = F.greatest(F.col("usable") - text_width(F.col("value"), F.col("size")), F.lit(0.0))
    shift = F.when(F.col("alignment") == "Center", free / 2).when(F.col("alignment") == "Right", free).otherwise(0.0)
    rows = rows.withColumns({"left": points(F.col("x")) + 2 + shift, "hex": winansi_hex(F.col("value"))})
    keep = ["doc_id", "page_no", "page_w", "page_h", "reading_order", "line", "left", "baseline", "size", "value", "hex"]
    return rows.select(*keep, "mode", "has_image")


def table_grid(elements: DataFrame) -> DataFrame:
    """Lines of the grids of tables, in points: one row a line."""
    rows = elements.filter("content_kind = 'Table'").withColumns({"_r": F.greatest(F.col("table.num_rows"), F.lit(1)), "_c": F.greatest(F.col("table.num_cols"), F.lit(1))})
    across = rows.select("doc_id", "page_no", "reading_order", F.lit("row").alias("kind"), F.explode(F.sequence(F.lit(0), "_r")).alias("i"), "x", "y", "w", "h", "page_h", F.col("_r").alias("n"))
    down = rows.select("doc_id", "page_no", "reading_order", F.lit("column").alias("kind"), F.explode(F.sequence(F.lit(0), "_c")).alias("i"), "x", "y", "w", "h", "page_h", F.col("_c").alias("n"))
    at = F.when(F.col("kind") == "row", points(F.col("page_h")) - points(F.col("y")) - points(F.col("h")) * F.col("i") / F.col("n")).otherwise(points(F.col("x")) + points(F.col("w")) * F.col("i") / F.col("n"))
    return across.union(down).select("doc_id", "page_no", "reading_order", "kind", "i", at.alias("at"), points(F.col("x")).alias("left"), points(F.col("w")).alias("wide"), (points(F.col("page_h")) - points(F.col("y"))).alias("top"), points(F.col("h")).alias("high"))


def operations(elements: DataFrame) -> DataFrame:
    """doc_id, page_no, reading_order, line and op: the content stream's operators of every element. Text of visual pages that
    have an image is invisible; weak text on pages with an image is left to the picture."""
    hidden = (F.col("mode") == "VisualPreservation") & F.col("has_image")
    shown = elements.filter(~(low_confidence_image() & F.col("has_image")) & ~F.col("role").isin("Figure", "Signature", "Stamp"))
    lines = text_lines(shown)
    text = F.concat(F.lit("BT "), F.when(hidden, "3 Tr ").otherwise(""), F.format_string("/F1 %.2f Tf %.2f %.2f Td <", F.col("size"), F.col("left"), F.col("baseline")), "hex", F.lit("> Tj ET"))
    out = lines.select("doc_id", "page_no", "page_w", "page_h", "reading_order", F.col("line").cast("int").alias("line"), text.alias("op"))
    rules = elements.filter("role = 'Separator'").withColumn("at", points(F.col("page_h")) - points(F.col("y")) - 1)
    rule = F.format_string("%.2f %.2f m %.2f %.2f l S", points(F.col("x")), F.col("at"), points(F.col("x") + F.col("w")), F.col("at"))
    out = out.union(rules.select("doc_id", "page_no", "page_w", "page_h", "reading_order", F.lit(0).alias("line"), rule.alias("op")))
    grid = table_grid(elements).join(elements.select("doc_id", "page_no", "reading_order", "page_w", "page_h"), ["doc_id", "page_no", "reading_order"])
    stroke = F.when(F.col("kind") == "row", F.format_string("%.2f %.2f m %.2f %.2f l S", F.col("left"), F.col("at"), F.col("left") + F.col("wide"), F.col("at"))).otherwise(F.format_string("%.2f %.2f m %.2f %.2f l S", F.col("at"), F.col("top"), F.col("at"), F.col("top") - F.col("high")))
    return out.union(grid.select("doc_id", "page_no", "page_w", "page_h", "reading_order", (1000 + F.col("i")).cast("int").alias("line"), stroke.alias("op")))


def placed_images(elements: DataFrame) -> DataFrame:
    """doc_id, page_no and boxes: the parts of a page's image to draw, in pixels. A visual page is drawn whole; else pictures,
    raster content and weak text are cut out."""
    visual = F.col("mode") == "VisualPreservation"
    cut = F.col("role").isin("Figure", "Signature", "Stamp") | (F.col("content_kind") == "Raster") | low_confidence_image()
    whole = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.col("page_w").alias("w"), F.col("page_h").alias("h"))
    box = F.when(visual, whole).when(cut, F.struct("x", "y", "w", "h"))
    return elements.filter("has_image").groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_set(box)).alias("boxes"))


def drawn(png: bytes | None, boxes: list, page_high: int) -> tuple[str, list[tuple[int, int, bytes]]]:
    """Operators that draw the boxes' parts of an image, and their pixels as compressed RGB. No bytes, nothing drawn."""
    if png is None or boxes is None:
        return "", []
    from ..operators.raster import cropped, decode_png, rgb
    from ..schema import POINTS_PER_PIXEL as pt

    pixels, out, ops = rgb(decode_png(bytes(png))), [], []
    for b in boxes:
        part = cropped(pixels, b["x"], b["y"], b["w"], b["h"])
        ops.append(f"q {b['w'] * pt:.2f} 0 0 {b['h'] * pt:.2f} {b['x'] * pt:.2f} {(page_high - b['y'] - b['h']) * pt:.2f} cm /Im{len(out)} Do Q")
        out.append((part.shape[1], part.shape[0], zlib.compress(part.tobytes())))
    return "\n".join(ops), out


def serialize(pages: list[tuple[float, float, str, list[tuple[int, int, bytes]]]]) -> bytes:
    """A PDF 1.5 file of pages (width, height, content, images), one font. Images are lossless, not JPEG."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    stream = lambda head, body: b"<< %s/Length %d /Filter /FlateDecode >>\nstream\n" % (head, len(body)) + body + b"\nendstream"
    for wide, high, content, images in pages:
        names = []
        for k, (w, h, body) in enumerate(images):
            objects.append(stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 " % (w, h), body))
            names.append(b"/Im%d %d 0 R" % (k, len(objects)))
        objects.append(stream(b"", zlib.compress(content.encode("latin-1", "replace"))))
        pictures = b" /XObject << " + b" ".join(names) + b" >>" if names else b""
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /Font << /F1 3 0 R >>%s >> /Contents %d 0 R >>" % (wide, high, pictures, len(objects)))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    out, places = bytearray(b"%PDF-1.5\n"), []
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + o + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def files(elements: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """doc_id and pdf: the file of every document. ``images`` (doc_id, page_no, png) are drawn under the text."""
    ops = operations(elements)
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "line", "op"))), lambda s: s["op"]), "\n")
    key = ["doc_id", "page_no"]
    pages = elements.select(*key, "page_w", "page_h").distinct().join(ops.groupBy(*key).agg(content.alias("content")), key, "left")
    if images is None:
        pages = pages.withColumns({"boxes": F.lit(None).cast("array<struct<x:bigint,y:bigint,w:bigint,h:bigint>>"), "png": F.lit(None).cast("binary")})
    else:
        pages = pages.join(placed_images(elements), key, "left").join(images.select(*key, "png"), key, "left")
    rows = pages.select(*key, F.col("page_h").alias("tall"), points(F.col("page_w")).alias("wide"), points(F.col("page_h")).alias("high"), F.coalesce("content", F.lit("")).alias("content"), "boxes", "png")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in group.sort_values("page_no").itertuples():
            ops, pictures = drawn(r.png, r.boxes, r.tall)
            out.append((r.wide, r.high, "\n".join(x for x in (ops, r.content) if x), pictures))
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]], "pdf": [serialize(out)]})

    return rows.groupBy("doc_id").applyInPandas(one, f"doc_id {dict(elements.dtypes)['doc_id']}, pdf binary")
