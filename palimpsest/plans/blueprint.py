"""Queries over the fixture layout of ``documents``, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import blocks as B
from ..operators import compose as C
from ..operators.refine import weak_pages as weak_blocks_pages
from ..sources.fixtures import layout_blocks, layout_sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def laid_out(spark: SparkSession, sf_dir: str, images: bool = False, sure_heads: bool = False) -> DataFrame:
    return layout_blocks(documents(spark, sf_dir).select("doc_id", "text"), images, sure_heads)


def resolve_blocks(spark, sf_dir):
    rows = B.resolve(laid_out(spark, sf_dir))
    return rows.select("doc_id", "page_no", "block_idx", "role", "content_kind", "text", "fallback_used")


def page_modes(spark, sf_dir):
    return C.page_modes(laid_out(spark, sf_dir))


def page_modes_images(spark, sf_dir):
    return C.page_modes(laid_out(spark, sf_dir, True))


def document_modes(spark, sf_dir):
    return C.document_modes(C.page_modes(laid_out(spark, sf_dir)))


def document_order(spark, sf_dir):
    rows = laid_out(spark, sf_dir)
    out = C.ordered(rows.withColumn("mode", F.lit(C.DOCUMENT)))
    return out.select("doc_id", "page_no", "block_idx", F.col("position").cast("bigint").alias("position"))


def visual_order(spark, sf_dir):
    out = C.ordered(laid_out(spark, sf_dir).withColumn("mode", F.lit(C.VISUAL)))
    return out.select("doc_id", "page_no", "block_idx", F.col("position").cast("bigint").alias("position"))


def column_stats(spark, sf_dir):
    out = C.column_stats(laid_out(spark, sf_dir))
    return out.select("doc_id", "page_no", F.col("total_columns").cast("bigint").alias("total_columns"), "left_base", "right_base")


def elements(spark, sf_dir):
    return C.elements(laid_out(spark, sf_dir))


def element_spacing(spark, sf_dir):
    e = elements(spark, sf_dir)
    exact = lambda c: F.round(F.col(c).cast("double"), 3).alias(c)
    return e.select("doc_id", "page_no", "block_idx", "reading_order", F.col("column_index").cast("bigint").alias("column_index"), F.col("total_columns").cast("bigint").alias("total_columns"), exact("spacing_before_pt"), exact("left_indent_pt"))


def element_style(spark, sf_dir):
    e = elements(spark, sf_dir)
    return e.select("doc_id", "page_no", "block_idx", "alignment", "emphasis", F.round(F.col("font_scale").cast("double"), 3).alias("font_scale"), "keep_with_next", "preserve_positioning")


def header_footer(spark, sf_dir):
    out = C.compose(laid_out(spark, sf_dir, sure_heads=True))
    return out.filter("suspected_header or suspected_footer").select("doc_id", "page_no", "block_idx", "suspected_header", "suspected_footer")


def txt_export(spark, sf_dir):
    from ..sinks.txt import bodies

    return bodies(elements(spark, sf_dir))


def list_runs(spark, sf_dir):
    from ..sinks.latex import runs

    return runs(elements(spark, sf_dir).filter("role <> 'Separator'")).filter("role = 'ListItem'").groupBy("doc_id", "page_no", "run").agg(F.count("*").alias("items"), F.min("reading_order").alias("first_order")).drop("run")


def block_confidence(spark, sf_dir):
    """Content and mean confidence of a page's filled lines."""
    rows = laid_out(spark, sf_dir).filter("trim(content) <> ''").withColumn("place", F.col("block_idx"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda s: s["content"]), "\n")
    return rows.groupBy("doc_id", "page_no").agg(F.md5(lines).alias("content_md5"), F.round(F.avg("confidence"), 9).alias("confidence"))


def weak_pages(spark, sf_dir):
    rows = laid_out(spark, sf_dir)
    return weak_blocks_pages(rows).select("doc_id", "page_no").distinct()


def noisy(spark, sf_dir) -> DataFrame:
    """Texts with the noise that cleaning is for: ligatures, quotes, runs of blanks, decomposed accents, wrong words."""
    t = F.replace(F.replace(F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit("é"), F.lit("é")), F.lit(", "), F.lit("  ’ ")), F.lit(" the "), F.lit(" tbe "))
    return documents(spark, sf_dir).select("doc_id", t.alias("text"))


NOISY = "SELECT doc_id, replace(replace(replace(replace(text, 'fi', 'ﬁ'), 'é', 'é'), ', ', '  ’ '), ' the ', ' tbe ') AS text FROM documents"


def clean_text(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.md5(T.cleaned(F.col("text"))).alias("clean_md5"))


def dictionary_fix(spark, sf_dir):
    rows = noisy(spark, sf_dir)
    return rows.select("doc_id", F.md5(T.corrected(F.col("text"), "eng")).alias("eng_md5"), F.md5(T.corrected(F.col("text"), "fra")).alias("other_md5"))


def repeat_keys(spark, sf_dir):
    rows = laid_out(spark, sf_dir).filter("block_idx in (0, 11)")
    return rows.select("doc_id", "page_no", "block_idx", T.repeat_key(F.col("content")).alias("key"))


def text_similarity(spark, sf_dir):
    rows = laid_out(spark, sf_dir).filter("block_idx = 11 and content like 'Page %'")
    nxt = F.lead("content").over(Window.partitionBy("doc_id").orderBy("page_no"))
    rows = rows.withColumn("other", nxt).filter("other is not null")
    return rows.select("doc_id", "page_no", F.round(T.similarity(F.col("content"), F.col("other")).cast("double"), 4).alias("similarity"))


def latex_escape(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.escape_latex(F.col("text"))).alias("latex_md5"))


def centres(spark, sf_dir):
    rows = laid_out(spark, sf_dir)
    return rows.select("doc_id", "page_no", "block_idx", G.centre().alias("centre_x"), F.round(G.points(F.col("x")), 6).alias("x_pt"))


def iou_pairs(spark, sf_dir):
    """Overlap of neighbouring boxes on a page, widened so that some meet."""
    box = F.struct("x", "y", (F.col("w") + 200).alias("w"), (F.col("h") + 150).alias("h"))
    rows = laid_out(spark, sf_dir).withColumn("a", box)
    rows = rows.withColumn("b", F.lead("a").over(Window.partitionBy("doc_id", "page_no").orderBy("block_idx"))).filter("b is not null")
    return rows.select("doc_id", "page_no", "block_idx", F.round(G.iou(F.col("a"), F.col("b")), 9).alias("iou"))


def mode_tokens(spark, sf_dir):
    """Modes kept in metadata and read back: a list counts only with as many known tokens as pages."""
    lists = C.page_modes(laid_out(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", C.token_of_mode(F.col("mode")).alias("t")))), lambda s: s["t"]), ",").alias("tokens"))
    broken = F.when(F.col("doc_id") % 7 == 0, F.concat("tokens", F.lit(",other"))).when(F.col("doc_id") % 7 == 1, F.concat("tokens", F.lit(",visual"))).otherwise(F.col("tokens"))
    lists = lists.withColumn("modes", C.persisted_modes(broken, F.col("pages")))
    return lists.select("doc_id", "tokens", F.array_join("modes", ",").alias("modes"))


# -- SQL --------------------------------------------------------------------------------------------------------------
BLOCKS = f"WITH b AS ({layout_sql()})"
TRIM = "trim(coalesce({0}, ''))"
SURE = "CAST(confidence AS FLOAT) >= CAST(0.74 AS FLOAT)"
RESOLVED = f""", r AS (SELECT *, CASE block_type WHEN 'Text' THEN 'Paragraph' WHEN 'Image' THEN 'Figure' WHEN 'List' THEN 'ListItem' ELSE block_type END AS role,
  CASE WHEN block_type IN ('Text', 'Title', 'List', 'Formula', 'Table') THEN CASE WHEN trim(content) <> '' AND {SURE} THEN 'Text' ELSE 'Raster' END
       WHEN block_type IN ('Image', 'Signature', 'Stamp') THEN 'Image' ELSE 'Empty' END AS content_kind FROM b)"""
MODES = """, a AS (SELECT doc_id, page_no, max(greatest(page_w, 1) * greatest(page_h, 1))::DOUBLE AS whole, bool_or(has_image) AS raster,
  coalesce(max(CASE WHEN block_type = 'Image' THEN w * h END), 0)::DOUBLE AS im, coalesce(sum(CASE WHEN block_type = 'Image' THEN w * h END), 0)::DOUBLE AS isum,
  coalesce(sum(CASE WHEN block_type IN ('Text', 'List', 'Formula', 'Title', 'Table') THEN w * h END), 0)::DOUBLE AS ta,
  count(*) FILTER (block_type IN ('Text', 'List', 'Formula', 'Title', 'Table')) AS n,
  count(*) FILTER (block_type IN ('Text', 'List', 'Formula', 'Title', 'Table') AND w::DOUBLE / greatest(page_w, 1)::DOUBLE >= 0.55) AS wide,
  count(*) FILTER (block_type IN ('Title', 'Table')) = 0 AS nosem FROM b GROUP BY 1, 2),
 m AS (SELECT doc_id, page_no, CASE WHEN ((im / whole >= 0.12 OR isum / whole >= 0.18) AND nosem AND ((n >= 2 AND wide <= 1) OR ta / whole <= 0.33))
   OR (raster AND n >= 3 AND wide = 0 AND ta / whole <= 0.33) OR (raster AND nosem AND n >= 4 AND wide <= 1)
   OR (raster AND (im / whole >= 0.12 OR isum / whole >= 0.18) AND (n = 0 OR wide = 0)) THEN 'VisualPreservation' ELSE 'DocumentReconstruction' END AS mode FROM a)"""
ANCHORS = """, f AS (SELECT *, block_type IN ('Title', 'Separator') OR w::FLOAT / greatest(page_w, 1)::FLOAT >= 0.70::FLOAT AS anchor, x + w // 2 > page_w // 2 AS rgt,
  block_type IN ('Text', 'List', 'Table', 'Formula') AS flow FROM b),
 t AS (SELECT doc_id, page_no, count(*) FILTER (flow AND NOT anchor AND NOT rgt) >= 2 AND count(*) FILTER (flow AND NOT anchor AND rgt) >= 2
   AND greatest(min(x) FILTER (flow AND NOT anchor AND rgt) - max(x + w) FILTER (flow AND NOT anchor AND NOT rgt), 0) >= max(page_w) * 4 // 100
   AND abs(min(y) FILTER (flow AND NOT anchor AND NOT rgt) - min(y) FILTER (flow AND NOT anchor AND rgt)) <= 220 AS two,
   coalesce(nullif(min(x) FILTER (NOT anchor AND NOT rgt), max(page_w)), 0) AS lb, coalesce(nullif(min(x) FILTER (NOT anchor AND rgt), max(page_w)), max(page_w) // 2) AS rb FROM f GROUP BY 1, 2)"""
ORDERED = """, g AS (SELECT f.*, coalesce(t.two, FALSE) AS two, t.lb, t.rb FROM f JOIN t USING (doc_id, page_no)),
 c AS (SELECT doc_id, page_no, block_idx, y AS ay, row_number() OVER p AS i, lag(y + h, 1, 0) OVER p AS s FROM g WHERE anchor AND two
   WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY y, x, reading_order, block_idx)),
 q AS (SELECT g.*, CASE WHEN NOT two THEN 0 WHEN anchor THEN (SELECT i FROM c WHERE c.doc_id = g.doc_id AND c.page_no = g.page_no AND c.block_idx = g.block_idx)
   ELSE coalesce((SELECT min(i) FROM c WHERE c.doc_id = g.doc_id AND c.page_no = g.page_no AND c.s <= g.y AND g.y < c.ay),
     (SELECT count(*) + 1 FROM c WHERE c.doc_id = g.doc_id AND c.page_no = g.page_no)) END AS seg FROM g),
 v AS (SELECT doc_id, page_no, seg, count(*) FILTER (flow AND NOT anchor AND NOT rgt) >= 2 AND count(*) FILTER (flow AND NOT anchor AND rgt) >= 2
   AND greatest(min(x) FILTER (flow AND NOT anchor AND rgt) - max(x + w) FILTER (flow AND NOT anchor AND NOT rgt), 0) >= max(page_w) * 4 // 100
   AND abs(min(y) FILTER (flow AND NOT anchor AND NOT rgt) - min(y) FILTER (flow AND NOT anchor AND rgt)) <= 220 AS two_s FROM q GROUP BY 1, 2, 3),
 o AS (SELECT q.*, row_number() OVER (PARTITION BY q.doc_id, q.page_no ORDER BY q.seg, CASE WHEN q.two AND anchor THEN 1 ELSE 0 END,
   CASE WHEN q.two AND NOT anchor AND coalesce(two_s, FALSE) THEN CAST(rgt AS INT) ELSE 0 END, y, x, reading_order, block_idx) - 1 AS position
   FROM q JOIN v ON q.doc_id = v.doc_id AND q.page_no = v.page_no AND q.seg = v.seg)"""
PLACED = """, z AS (SELECT o.* EXCLUDE (position, reading_order), m.mode, CASE WHEN m.mode = 'VisualPreservation' THEN
    row_number() OVER (PARTITION BY o.doc_id, o.page_no ORDER BY o.reading_order, o.y, o.x, o.block_idx) - 1 ELSE o.position END AS ro,
   CASE WHEN m.mode <> 'VisualPreservation' AND o.two AND NOT o.anchor THEN 2 ELSE 1 END AS tc FROM o JOIN m USING (doc_id, page_no)),
 e AS (SELECT z.*, CASE WHEN tc = 2 AND rgt THEN 1 ELSE 0 END AS ci,
   CASE WHEN tc = 2 THEN lag(y + h) OVER (PARTITION BY doc_id, page_no, anchor, rgt ORDER BY ro) ELSE lag(y + h) OVER (PARTITION BY doc_id, page_no ORDER BY ro) END AS prev FROM z)"""
PLACES = MODES + ANCHORS + ORDERED + PLACED
ALL = BLOCKS + PLACES
ROLE = "CASE block_type WHEN 'Text' THEN 'Paragraph' WHEN 'Image' THEN 'Figure' WHEN 'List' THEN 'ListItem' ELSE block_type END"
KIND = f"""CASE WHEN block_type IN ('Text', 'Title', 'List', 'Formula', 'Table') THEN CASE WHEN trim(content) <> '' AND {SURE} THEN 'Text' ELSE 'Raster' END
  WHEN block_type IN ('Image', 'Signature', 'Stamp') THEN 'Image' ELSE 'Empty' END"""
KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s\-–—_/:]', '', 'g'), '[0-9]', '#', 'g'), '[\s\-–—_/:]+', ' ', 'g'))"
SURE_BLOCKS = f"WITH b AS ({layout_sql(sure_heads=True)})"
HEAD_STEPS = f""", k AS (SELECT doc_id, page_no, block_idx, {ROLE} AS role, ci, tc, x, y, w, page_w, {KEY.format("CASE WHEN " + KIND + " = 'Text' THEN trim(content) ELSE '' END")} AS key,
   y <= page_h * 14 // 100 AS head, y + h >= page_h * 88 // 100 AS foot FROM e WHERE mode = 'DocumentReconstruction'),
 s AS (SELECT * FROM k WHERE role IN ('Title', 'Paragraph', 'ListItem', 'Separator') AND key <> '' AND (head OR foot)),
 pg AS (SELECT doc_id, page_no, lag(page_no) OVER w AS p, lead(page_no) OVER w AS n FROM (SELECT DISTINCT doc_id, page_no FROM e WHERE mode = 'DocumentReconstruction') WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)),
 hf AS (SELECT l.doc_id, l.page_no, l.block_idx, bool_or(l.head AND r.head) AS suspected_header, bool_or(l.foot AND r.foot) AS suspected_footer
FROM s l JOIN pg USING (doc_id, page_no) JOIN s r ON r.doc_id = l.doc_id AND (r.page_no = pg.p OR r.page_no = pg.n) AND r.role = l.role AND r.ci = l.ci AND r.tc = l.tc
WHERE abs(l.x - r.x) <= r.page_w * 5 // 100 AND abs(l.w - r.w) <= r.page_w * 8 // 100 AND abs(l.y - r.y) <= 36 AND ((l.head AND r.head) OR (l.foot AND r.foot))
  AND (l.key = r.key OR (1 - (levenshtein(l.key, r.key)::FLOAT / greatest(length(l.key), length(r.key))::FLOAT))::FLOAT >= 0.86::FLOAT)
GROUP BY 1, 2, 3)"""
HEADS = SURE_BLOCKS + PLACES + HEAD_STEPS + " SELECT * FROM hf"
SHARE = "w::FLOAT / greatest(page_w, 1)::FLOAT"
STYLE = f"""SELECT doc_id, page_no, block_idx,
  CASE WHEN {SHARE} >= 0.85::FLOAT THEN 'FullWidth' WHEN {ROLE} = 'Title' AND abs((x + w // 2)::FLOAT - page_w::FLOAT / 2::FLOAT) <= page_w::FLOAT * 0.12::FLOAT THEN 'Center'
    WHEN x >= page_w * 55 // 100 AND {SHARE} < 0.40::FLOAT THEN 'Right' ELSE 'Left' END AS alignment,
  CASE WHEN {ROLE} = 'Title' THEN 'Strong' WHEN {ROLE} IN ('Separator', 'Stamp') THEN 'Neutral' ELSE 'Regular' END AS emphasis,
  round(CASE WHEN {ROLE} = 'Title' THEN least(greatest(1.2 + 14.0 * (h::DOUBLE / page_h), 1.4), 2.4) WHEN {ROLE} IN ('Paragraph', 'ListItem') THEN least(greatest(0.9 + 6.0 * (h::DOUBLE / page_h), 0.9), 1.2)
    WHEN {ROLE} = 'Table' THEN 0.95 WHEN {ROLE} = 'Formula' THEN 1.1 ELSE 1.0 END::DOUBLE, 3) AS font_scale,
  {ROLE} IN ('Title', 'Separator') AS keep_with_next,
  mode = 'VisualPreservation' OR {KIND} IN ('Image', 'Raster', 'Table') OR {ROLE} IN ('Figure', 'Formula', 'Signature', 'Stamp', 'Separator') OR tc > 1 AS preserve_positioning FROM e"""
ETEXT = f"CASE WHEN {KIND} = 'Text' THEN trim(content) END"
TXT = f""", x AS (SELECT doc_id, page_no, ro, {ROLE} AS role, coalesce({ETEXT}, '') AS text FROM e),
 fr AS (SELECT doc_id, page_no, ro, CASE WHEN role = 'Title' THEN upper(replace(text, 'ß', 'SS')) || chr(10) || chr(10)
   WHEN role = 'Table' THEN coalesce(nullif(text, ''), '[Tabla sin contenido]') || chr(10) || chr(10)
   WHEN role IN ('Figure', 'Signature', 'Stamp') THEN '[Activo visual preservado en exportadores ricos]' || chr(10) || chr(10)
   WHEN text = '' THEN '' WHEN role = 'Formula' THEN 'Formula: ' || text || chr(10) || chr(10) ELSE text || chr(10) || chr(10) END AS part FROM x),
 pp AS (SELECT doc_id, page_no, '===== PAGINA ' || page_no || ' =====' || chr(10) || chr(10) || string_agg(part, '' ORDER BY ro) AS page FROM fr GROUP BY 1, 2)
SELECT doc_id, string_agg(page, '' ORDER BY page_no) AS body FROM pp GROUP BY 1"""

QUERIES = {
    "txt_export": txt_export, "resolve_blocks": resolve_blocks, "page_modes": page_modes, "page_modes_images": page_modes_images, "document_modes": document_modes,
    "document_order": document_order, "visual_order": visual_order, "column_stats": column_stats, "element_spacing": element_spacing, "element_style": element_style,
    "header_footer": header_footer, "list_runs": list_runs, "block_confidence": block_confidence, "weak_pages": weak_pages, "clean_text": clean_text,
    "dictionary_fix": dictionary_fix, "repeat_keys": repeat_keys, "text_similarity": text_similarity, "latex_escape": latex_escape, "centres": centres,
    "iou_pairs": iou_pairs, "mode_tokens": mode_tokens,
}
ORACLES = {
    "txt_export": ALL + TXT,
    "resolve_blocks": BLOCKS + RESOLVED + " SELECT doc_id, page_no, block_idx, role, content_kind, CASE WHEN content_kind = 'Text' THEN trim(content) END AS text, content_kind = 'Raster' AS fallback_used FROM r",
    "page_modes": BLOCKS + MODES + " SELECT * FROM m",
    "page_modes_images": f"WITH b AS ({layout_sql(True)})" + MODES + " SELECT * FROM m",
    "document_modes": BLOCKS + MODES + " SELECT doc_id, CASE WHEN bool_and(mode = 'VisualPreservation') THEN 'VisualPreservation' ELSE 'DocumentReconstruction' END AS mode FROM m GROUP BY 1",
    "document_order": BLOCKS + ANCHORS + ORDERED + " SELECT doc_id, page_no, block_idx, position FROM o",
    "visual_order": BLOCKS + " SELECT doc_id, page_no, block_idx, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY reading_order, y, x, block_idx) - 1 AS position FROM b",
    "column_stats": BLOCKS + ANCHORS + " SELECT doc_id, page_no, CAST(CASE WHEN two THEN 2 ELSE 1 END AS BIGINT) AS total_columns, lb AS left_base, rb AS right_base FROM t",
    "element_spacing": ALL + """ SELECT doc_id, page_no, block_idx, ro AS reading_order, ci::BIGINT AS column_index, tc::BIGINT AS total_columns,
  round(CASE WHEN ro = 0 OR prev IS NULL THEN 0.0 ELSE least(greatest(y - prev, 0) * 0.48, 32.0) END::DOUBLE, 3) AS spacing_before_pt,
  round(CASE WHEN tc = 2 THEN greatest(x - CASE WHEN ci = 1 THEN rb ELSE lb END, 0) * 0.48 ELSE 0.0 END::DOUBLE, 3) AS left_indent_pt FROM e""",
    "element_style": ALL + " " + STYLE,
    "header_footer": HEADS,
    "list_runs": ALL + f""", x AS (SELECT *, {ROLE} AS role FROM e WHERE {ROLE} <> 'Separator'),
 y1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ro) - row_number() OVER (PARTITION BY doc_id, page_no, role = 'ListItem' ORDER BY ro) AS run FROM x)
 SELECT doc_id, page_no, count(*) AS items, min(ro) AS first_order FROM y1 WHERE role = 'ListItem' GROUP BY doc_id, page_no, run""",
    "block_confidence": BLOCKS + " SELECT doc_id, page_no, md5(string_agg(content, chr(10) ORDER BY block_idx)) AS content_md5, round(avg(confidence), 9) AS confidence FROM b WHERE trim(content) <> '' GROUP BY 1, 2",
    "weak_pages": BLOCKS + " SELECT DISTINCT doc_id, page_no FROM b WHERE block_type IN ('Text', 'Title', 'List', 'Table') AND confidence < 0.78",
    "clean_text": f"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS clean_md5 FROM ({NOISY})",
    "dictionary_fix": f"""WITH n AS (SELECT doc_id, translate(replace(text, 'ﬁ', 'fi'), '’', '''') AS t FROM ({NOISY})),
 w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS ws FROM n)
SELECT doc_id, md5(array_to_string(list_transform(ws, lambda x: CASE lower(x) WHEN 'tbe' THEN 'the' WHEN 'tlie' THEN 'the' WHEN 'arid' THEN 'and' WHEN 'lias' THEN 'has' WHEN 'liave' THEN 'have' WHEN 'witli' THEN 'with' WHEN 'wliich' THEN 'which' ELSE x END), ' ')) AS eng_md5, md5(t) AS other_md5 FROM w""",
    "repeat_keys": BLOCKS + f" SELECT doc_id, page_no, block_idx, {KEY.format('content')} AS key FROM b WHERE block_idx IN (0, 11)",
    "text_similarity": BLOCKS + """, p AS (SELECT doc_id, page_no, content, lead(content) OVER (PARTITION BY doc_id ORDER BY page_no) AS other FROM b WHERE block_idx = 11 AND content LIKE 'Page %')
 SELECT doc_id, page_no, round(CASE WHEN content = other THEN 1 WHEN content = '' OR other = '' THEN 0 ELSE 1 - levenshtein(content, other)::DOUBLE / greatest(length(content), length(other)) END::DOUBLE, 4) AS similarity FROM p WHERE other IS NOT NULL""",
    "latex_escape": r"""SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: CASE c WHEN '\' THEN '\textbackslash{}' WHEN '{' THEN '\{' WHEN '}' THEN '\}' WHEN '$' THEN '\$' WHEN '&' THEN '\&' WHEN '%' THEN '\%'
  WHEN '#' THEN '\#' WHEN '_' THEN '\_' WHEN '^' THEN '\^{}' WHEN '~' THEN '\~{}' ELSE c END), '')) AS latex_md5 FROM documents""",
    "centres": BLOCKS + " SELECT doc_id, page_no, block_idx, x + w // 2 AS centre_x, round(x * 0.48::DOUBLE, 6) AS x_pt FROM b",
    "iou_pairs": BLOCKS + """, n AS (SELECT doc_id, page_no, block_idx, x, y, w + 200 AS w, h + 150 AS h, lead(x) OVER p AS x2, lead(y) OVER p AS y2, lead(w + 200) OVER p AS w2, lead(h + 150) OVER p AS h2 FROM b WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY block_idx)),
 i AS (SELECT *, greatest(least(x + w, x2 + w2) - greatest(x, x2), 0) * greatest(least(y + h, y2 + h2) - greatest(y, y2), 0) AS inter FROM n WHERE x2 IS NOT NULL)
 SELECT doc_id, page_no, block_idx, round(inter::DOUBLE / (w * h + w2 * h2 - inter)::DOUBLE, 9) AS iou FROM i""",
    "mode_tokens": BLOCKS + MODES + """, l AS (SELECT doc_id, string_agg(CASE mode WHEN 'VisualPreservation' THEN 'visual' ELSE 'document' END, ',' ORDER BY page_no) AS tokens,
  string_agg(mode, ',' ORDER BY page_no) AS modes FROM m GROUP BY 1) SELECT doc_id, tokens, CASE WHEN doc_id % 7 = 1 THEN NULL ELSE modes END AS modes FROM l""",
}
