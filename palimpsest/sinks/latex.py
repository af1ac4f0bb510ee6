"""LaTeX of composed documents: semantic, positioned, or page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import points
from ..functions.text import escape_latex
from ..schema import ACCEPT_CONFIDENCE

IMAGES = ("Figure", "Signature", "Stamp")


def runs(elements: DataFrame) -> DataFrame:
    """``elements`` with run: list items that follow each other share one number."""
    page = Window.partitionBy("doc_id", "page_no").orderBy("reading_order")
    kind = Window.partitionBy("doc_id", "page_no", F.col("role") == "ListItem").orderBy("reading_order")
    return elements.withColumn("run", F.row_number().over(page) - F.row_number().over(kind))


def low_confidence_image() -> Column:
    """Textual elements that a positioned export shows as pictures."""
    return F.col("role").isin("Title", "Paragraph", "Table", "Formula", "ListItem", "Unknown") & F.col("ocr_confidence").isNotNull() & (F.col("ocr_confidence") < F.lit(ACCEPT_CONFIDENCE).cast("float"))


def paragraph(text: Column) -> Column:
    """Size and leading from the font scale, alignment, and bold where emphasis is strong."""
    size = F.least(F.greatest(11 * F.col("font_scale").cast("double"), F.lit(9.0)), F.lit(24.0))
    leading = F.least(F.greatest(1.18 * size, F.lit(10.0)), F.lit(28.0))
    side = F.when(F.col("alignment") == "Center", "\\centering\n").when(F.col("alignment") == "Right", "\\raggedleft\n").otherwise("\\RaggedRight\n")
    body = F.when(F.col("emphasis") == "Strong", F.concat(F.lit(r"\textbf{"), text, F.lit("}"))).otherwise(text)
    return F.concat(F.format_string("\\fontsize{%.2fpt}{%.2fpt}\\selectfont\n", size, leading), side, body, F.lit("\n"))


def column_widths(total: float, n: Column, widths: Column) -> Column:
    """Points for each of ``n`` columns: by the widths given, or the same where they do not fit or are all 0."""
    total_ = F.lit(float(total))
    whole = F.aggregate(widths, F.lit(0).cast("long"), lambda a, w: a + w)
    even = F.array_repeat(F.greatest(total_ / n.cast("double"), F.lit(48.0)), n.cast("int"))
    shared = F.transform(widths, lambda w: F.least(F.greatest(total_ * w.cast("double") / whole.cast("double"), F.lit(48.0)), total_))
    return F.when((F.size(widths) != n) | (whole == 0), even).otherwise(shared)


def table_body(table: Column, total: float = 480.0) -> Column:
    """A tabular of the table's rows; header rows and emphasized cells are bold."""
    def cell(c, header):
        text = escape_latex(c["content"])
        bold = F.when(header | F.coalesce(c["is_emphasized"], F.lit(False)), F.concat(F.lit(r"\textbf{"), text, F.lit("}"))).otherwise(text)
        side = F.coalesce(c["alignment"], F.when(header, "Center").otherwise("Left"))
        return F.concat(F.when(side == "Center", r"\centering\arraybackslash ").when(side == "Right", r"\raggedleft\arraybackslash ").otherwise(r"\raggedright\arraybackslash "), bold)

    rows = F.transform(table["rows"], lambda r, i: F.concat(F.array_join(F.transform(r, lambda c: cell(c, F.array_contains(table["header_row_indices"], i.cast("int")))), " & "), F.lit(" \\\\\n\\hline\n")))
    widths = F.array_join(F.transform(column_widths(total, table["num_cols"], table["column_widths"]), lambda w: F.format_string("|p{%.2fpt}", w)), "")
    body = F.concat(F.lit("\\renewcommand{\\arraystretch}{1.05}\n\\begin{tabular}{"), widths, F.lit("|}\n\\hline\n"), F.array_join(rows, ""), F.lit("\\end{tabular}\n"))
    return F.when((F.size(table["rows"]) <= 0) | (table["num_cols"] == 0), F.lit("[Tabla vacia]\n")).otherwise(body)


def figure(name: Column) -> Column:
    return F.concat(F.lit("\\begin{figure}[h]\n\\centering\n\\includegraphics["), F.format_string("width=%.2fpt,height=%.2fpt", points(F.col("w")), points(F.col("h"))), F.lit("]{"), name, F.lit("}\n\\end{figure}\n"))


def document(nodes: Column, packages: tuple[str, ...]) -> Column:
    head = "\n".join([r"\documentclass{article}", *[rf"\usepackage{{{p}}}" for p in packages], r"\begin{document}"])
    return F.concat(F.lit(head + "\n"), nodes, F.lit("\\end{document}\n"))


def asset(page: Column, place: Column) -> Column:
    """The file name of an element's picture."""
    return F.concat(F.lit("page"), page.cast("string"), F.lit("_element"), place.cast("string"), F.lit(".png"))


def page_asset(page: Column) -> Column:
    return F.concat(F.lit("page"), page.cast("string"), F.lit("_full.png"))


def folder(stem: Column | None = None) -> Column:
    """The folder of a document's pictures, beside its source: named after the source, by default the document's id."""
    return F.concat(F.coalesce(F.nullif(F.col("doc_id").cast("string") if stem is None else stem, F.lit("")), F.lit("documento")), F.lit("_assets"))


def path(name: Column) -> Column:
    return F.concat(folder(), F.lit("/"), name)


def pictures(elements: DataFrame, documents: DataFrame, images: DataFrame, positions: bool = False) -> DataFrame:
    """doc_id, name and png of the pictures that ``exported`` names: crops of elements, whole pages of visual documents. ``images`` is
    (doc_id, page_no, png); what cannot be cut out has none."""
    from ..operators.raster import crops

    key = ["doc_id", "page_no"]
    visual = documents.filter("mode = 'VisualPreservation'").select("doc_id")
    rest = elements.join(visual, "doc_id", "left_anti")
    if positions:
        cut = rest.filter((F.col("role").isin(*IMAGES, "Formula") | low_confidence_image()) & F.col("has_image")).withColumn("place", F.col("reading_order") + 1)
    else:
        place = F.row_number().over(Window.partitionBy(*key).orderBy("reading_order"))
        seen = rest.filter("not suspected_header and not suspected_footer").withColumn("place", place)
        cut = seen.filter(F.col("role").isin(*IMAGES, "Formula") & F.col("content_kind").isin("Image", "Raster"))
    parts = crops(cut, images).filter("png is not null").join(cut.select(*key, "block_idx", "place"), [*key, "block_idx"])
    whole = images.join(visual, "doc_id", "left_semi").filter("png is not null").select("doc_id", page_asset(F.col("page_no")).alias("name"), "png")
    return parts.select("doc_id", asset(F.col("page_no"), F.col("place")).alias("name"), "png").unionByName(whole)


def _by_page(rows: DataFrame, packages: tuple[str, ...] = ("graphicx", "geometry", "ragged2e", "array")) -> DataFrame:
    """doc_id and source from nodes (doc_id, page_no, place, node); pages with nodes are parted by breaks."""
    def pile(by, of, name, sep):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, of))), lambda s: s[name]), sep)

    pages = rows.groupBy("doc_id", "page_no").agg(pile("place", "node", "node", "").alias("page"))
    docs = pages.groupBy("doc_id").agg(pile("page_no", "page", "page", "\\newpage\n").alias("nodes"))
    return docs.select("doc_id", document(F.col("nodes"), packages).alias("source"))


def semantic(elements: DataFrame) -> DataFrame:
    """Sections, paragraphs, lists, tables and figures; running heads and rules are left out."""
    seen = elements.filter("not suspected_header and not suspected_footer")
    place = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("reading_order"))
    seen = seen.withColumn("place", place).filter("role <> 'Separator'")
    role, text = F.col("role"), F.trim(F.coalesce("text", F.lit("")))
    plain = F.when(text != "", F.concat(paragraph(escape_latex(text)), F.lit("\\par\n")))
    crop = F.when(F.col("content_kind").isin("Image", "Raster"), figure(path(asset(F.col("page_no"), F.col("place")))))
    node = (
        F.when((role == "Title") & (text != ""), F.concat(F.lit(r"\section*{"), escape_latex(text), F.lit("}\n")))
        .when((role == "ListItem") & (text != ""), F.concat(F.lit(r"\item "), escape_latex(text), F.lit("\n")))
        .when((role == "Table") & (F.col("content_kind") == "Table"), table_body(F.col("table")))
        .when(role.isin(*IMAGES, "Formula"), F.coalesce(crop, plain))
        .when(~role.isin("Title", "ListItem"), plain)
    )
    rows = runs(seen.withColumn("node", node).filter("node is not null"))
    is_list = (F.col("role") == "ListItem").alias("is_list")
    group = F.when(F.col("role") == "ListItem", F.concat(F.lit("l"), F.col("run").cast("string"))).otherwise(F.col("place").cast("string"))
    parts = rows.groupBy("doc_id", "page_no", group.alias("g"), is_list).agg(F.min("place").alias("place"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda s: s["node"]), "").alias("node"))
    body = F.when(F.col("is_list"), F.concat(F.lit("\\begin{itemize}\n"), "node", F.lit("\\end{itemize}\n"))).otherwise(F.col("node"))
    return _by_page(parts.withColumn("node", body))


def positioned(elements: DataFrame) -> DataFrame:
    """Every element at its place; weak text as a crop of the page."""
    name = path(asset(F.col("page_no"), F.col("reading_order") + 1))
    text = F.trim(F.coalesce("text", F.lit("")))
    role = F.col("role")
    picture = F.concat(F.format_string(r"\includegraphics[width=%.2fpt,height=%.2fpt]{", points(F.col("w")), points(F.col("h"))), name, F.lit("}\n"))
    missing = F.when(role == "Formula", "\\fbox{Formula no disponible en memoria}\n").otherwise("\\fbox{Imagen no disponible en memoria}\n")
    words = F.when(text != "", paragraph(escape_latex(text)))
    shown = (
        F.when(role.isin(*IMAGES, "Formula") | low_confidence_image(), F.when(F.col("has_image"), picture).when(role.isin(*IMAGES, "Formula"), missing).otherwise(words))
        .when((role == "Table") & (F.col("content_kind") == "Table"), table_body(F.col("table")))
        .when(role == "Separator", F.lit("\\hrule\n"))
        .otherwise(words)
    )
    block = F.concat(F.format_string("\\begin{textblock*}{%.2fpt}(%.2fpt,%.2fpt)\n", points(F.col("w")), points(F.col("x")), points(F.col("y"))), shown, F.lit("\\end{textblock*}\n"))
    rows = elements.withColumns({"place": F.col("reading_order"), "_shown": shown}).filter("_shown is not null").withColumn("node", block)
    return _by_page(rows, packages=("graphicx", "geometry", "ragged2e", "array", "textpos"))


def page_images(elements: DataFrame) -> DataFrame:
    """One picture of each page that has one."""
    pages = elements.filter("has_image").select("doc_id", "page_no", "page_w", "page_h").distinct()
    node = F.concat(F.format_string(r"\includegraphics[width=%.2fpt,height=%.2fpt]{", points(F.col("page_w")), points(F.col("page_h"))), path(page_asset(F.col("page_no"))), F.lit("}\n"))
    return _by_page(pages.withColumns({"place": F.lit(0), "node": node}))


def exported(elements: DataFrame, documents: DataFrame, positions: bool = False) -> DataFrame:
    """doc_id and source: page images for documents whose mode is visual (documents: doc_id, mode), else by ``positions``."""
    visual = documents.filter("mode = 'VisualPreservation'").select("doc_id")
    rest = elements.join(visual, "doc_id", "left_anti")
    plan = positioned(rest) if positions else semantic(rest)
    return plan.unionByName(page_images(elements.join(visual, "doc_id", "left_semi")))
