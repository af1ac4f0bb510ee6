"""Queries over what is exported, and the same in SQL."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.geometry import points
from ..operators import compose as C
from ..sinks import json as json_sink
from ..sinks import latex, pdf
from ..sinks import txt as txt_sink
from ..sources.fixtures import layout_sql
from .blueprint import ALL, BLOCKS, ETEXT, HEAD_STEPS, KIND, PLACES, ROLE, SHARE, SURE_BLOCKS, laid_out


def latex_semantic(spark, sf_dir):
    return latex.semantic(C.compose(laid_out(spark, sf_dir, sure_heads=True)))


def latex_positioned(spark, sf_dir):
    return latex.positioned(C.elements(laid_out(spark, sf_dir, True)))


def latex_export(spark, sf_dir):
    """What the export writes: page images for visual documents, else places."""
    e = C.compose(laid_out(spark, sf_dir, True))
    modes = C.document_modes(e.select("doc_id", "page_no", "mode").distinct())
    return latex.exported(e, modes, positions=True).select("doc_id", F.md5("source").alias("source_md5"), F.regexp_count("source", F.lit("_full.png")).cast("bigint").alias("full_pages"))


def pdf_lines(spark, sf_dir):
    return pdf.text_lines(C.elements(laid_out(spark, sf_dir))).select("doc_id", "page_no", "reading_order", F.col("line").cast("bigint").alias("line"), "value", "hex", F.round("left", 6).alias("left_pt"), F.round("baseline", 6).alias("baseline_pt"))


def read_back(raw: bytes) -> tuple[int, int, int, str]:
    """Pages, lines of text, rules, and all text in hexadecimal, as a reader finds them by the cross-reference table."""
    start = int(raw.rsplit(b"startxref\n", 1)[1].split()[0])
    n = int(raw[start:].split(b"\n", 2)[1].split()[1])
    at = [int(raw[start:].split(b"\n")[2 + k][:10]) for k in range(n)]
    body = lambda k: raw[at[k] : raw.index(b"\nendobj", at[k])]
    kids = [int(k) for k in re.search(rb"/Kids \[(.*?)\]", body(2))[1].split()[::3]]
    lines, rules, text = 0, 0, []
    for kid in kids:
        content = body(int(re.search(rb"/Contents (\d+) 0 R", body(kid))[1]))
        size = int(re.search(rb"/Length (\d+)", content)[1])
        stream = content.index(b"stream\n") + 7
        ops = zlib.decompress(content[stream : stream + size]).decode("latin-1")
        shown = re.findall(r"<([0-9A-F]*)> Tj", ops)
        lines, rules, text = lines + len(shown), rules + len(re.findall(r" l S$", ops, re.M)), text + shown
    return len(kids), lines, rules, "|".join(text)


def pdf_files(spark, sf_dir):
    """Every file, read again."""

    def run(batches):
        for batch in batches:
            rows = [read_back(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows]) for k in range(4))], names=["doc_id", "pages", "lines", "rules", "text"])

    rows = pdf.files(C.elements(laid_out(spark, sf_dir))).mapInArrow(run, "doc_id long, pages long, lines long, rules long, text string")
    return rows.select("doc_id", "pages", "lines", "rules", F.md5("text").alias("text_md5"))


def json_export(spark, sf_dir):
    """Every job's JSON, read again: one row a block."""
    rows = laid_out(spark, sf_dir)
    jobs = rows.select(F.col("doc_id").cast("string").alias("job_id")).distinct().select("job_id", F.col("job_id").alias("doc_id"), F.lit("Completed").alias("status"))
    block = "struct<block_idx:int,block_type:string,x:bigint,y:bigint,w:bigint,h:bigint,content:string,confidence:double,reading_order:bigint>"
    read = F.from_json("value", f"job_id string, doc_id string, status string, pages array<struct<number:int,width:bigint,height:bigint,blocks:array<{block}>>>")
    out = json_sink.snapshots(jobs, rows).select("job_id", read.alias("j")).select("job_id", "j.doc_id", "j.status", F.posexplode("j.pages").alias("place", "p"))
    out = out.select("job_id", "doc_id", "status", F.col("place").cast("bigint").alias("place"), "p.number", "p.width", "p.height", F.posexplode("p.blocks").alias("block_place", "b"))
    return out.select("job_id", "doc_id", "status", "place", "number", "width", "height", F.col("block_place").cast("bigint").alias("block_place"), "b.*")


def txt_files(spark, sf_dir):
    """Texts under the lines that name a job's document, source, profile and status."""
    bodies = txt_sink.bodies(C.elements(laid_out(spark, sf_dir)))
    doc = F.col("doc_id").cast("string")
    jobs = bodies.select(F.concat(F.lit("j"), doc).alias("job_id"), doc.alias("doc_id"), F.concat(F.lit("/in/"), doc, F.lit(".pdf")).alias("source_path"), F.lit("Balanced").alias("profile"), F.lit("Completed").alias("status"))
    return txt_sink.with_headers(bodies, jobs).select("job_id", F.md5("value").alias("value_md5"))


def page_assets(spark, sf_dir):
    """Names of the pictures that a positioned export needs."""
    e = C.elements(laid_out(spark, sf_dir, True))
    cut = e.filter((F.col("role").isin(*latex.IMAGES, "Formula") | latex.low_confidence_image()) & F.col("has_image"))
    return cut.select("doc_id", latex.asset(F.col("page_no"), F.col("reading_order") + 1).alias("name"), latex.folder().alias("folder"), F.round(points(F.col("w")), 6).alias("wide"), F.round(points(F.col("h")), 6).alias("high"))


# -- SQL --------------------------------------------------------------------------------------------------------------
ESCAPED = r"""array_to_string(list_transform(string_split({0}, ''), lambda c: CASE c WHEN '\' THEN '\textbackslash{{}}' WHEN '{{' THEN '\{{' WHEN '}}' THEN '\}}' WHEN '$' THEN '\$' WHEN '&' THEN '\&'
  WHEN '%' THEN '\%' WHEN '#' THEN '\#' WHEN '_' THEN '\_' WHEN '^' THEN '\^{{}}' WHEN '~' THEN '\~{{}}' ELSE c END), '')"""
SCALE = f"""CASE WHEN {ROLE} = 'Title' THEN least(greatest(1.2::FLOAT + 14.0::FLOAT * (h::FLOAT / page_h::FLOAT), 1.4::FLOAT), 2.4::FLOAT)
  WHEN {ROLE} IN ('Paragraph', 'ListItem') THEN least(greatest(0.9::FLOAT + 6.0::FLOAT * (h::FLOAT / page_h::FLOAT), 0.9::FLOAT), 1.2::FLOAT) WHEN {ROLE} = 'Table' THEN 0.95::FLOAT WHEN {ROLE} = 'Formula' THEN 1.1::FLOAT ELSE 1.0::FLOAT END"""
SIDE = f"""CASE WHEN {SHARE} >= 0.85::FLOAT THEN 'FullWidth' WHEN {ROLE} = 'Title' AND abs((x + w // 2)::FLOAT - page_w::FLOAT / 2::FLOAT) <= page_w::FLOAT * 0.12::FLOAT THEN 'Center'
    WHEN x >= page_w * 55 // 100 AND {SHARE} < 0.40::FLOAT THEN 'Right' ELSE 'Left' END"""
DRAWN = f""", d1 AS (SELECT *, {ROLE} AS role, {KIND} AS kind, coalesce({ETEXT}, '') AS text, least(greatest(11 * ({SCALE})::DOUBLE, 9.0), 24.0) AS pt, {SIDE} AS side FROM e),
 d AS (SELECT *, {ESCAPED.format('text')} AS esc, printf('\\fontsize{{%.2fpt}}{{%.2fpt}}\\selectfont', pt, least(greatest(1.18 * pt, 10.0), 28.0)) || chr(10)
   || CASE side WHEN 'Center' THEN '\\centering' WHEN 'Right' THEN '\\raggedleft' ELSE '\\RaggedRight' END || chr(10)
   || CASE WHEN role = 'Title' THEN '\\textbf{{' || {ESCAPED.format('text')} || '}}' ELSE {ESCAPED.format('text')} END || chr(10) AS para FROM d1)""".replace("\\\\", "\\").replace("{{", "{").replace("}}", "}")
HEAD = r"'\documentclass{{article}}' || chr(10) || {0} || '\begin{{document}}' || chr(10) || string_agg(page, '\newpage' || chr(10) ORDER BY page_no) || '\end{{document}}' || chr(10)"
PACKAGES = " || ".join(rf"'\usepackage{{{p}}}' || chr(10)" for p in ("graphicx", "geometry", "ragged2e", "array"))
SEMANTIC = SURE_BLOCKS + PLACES + HEAD_STEPS + DRAWN + rf""",
 s1 AS (SELECT d.*, row_number() OVER (PARTITION BY d.doc_id, d.page_no ORDER BY ro) AS place FROM d LEFT JOIN hf ON hf.doc_id = d.doc_id AND hf.page_no = d.page_no AND hf.block_idx = d.block_idx WHERE hf.doc_id IS NULL),
 s2 AS (SELECT doc_id, page_no, place, role, CASE WHEN role = 'Title' THEN CASE WHEN text <> '' THEN '\section*{{' || esc || '}}' || chr(10) END
   WHEN role = 'ListItem' THEN CASE WHEN text <> '' THEN '\item ' || esc || chr(10) END
   WHEN role IN ('Figure', 'Signature', 'Stamp', 'Formula') AND kind IN ('Image', 'Raster') THEN '\begin{{figure}}[h]' || chr(10) || '\centering' || chr(10)
     || printf('\includegraphics[width=%.2fpt,height=%.2fpt]', w * 0.48, h * 0.48) || '{{' || doc_id || '_assets/page' || page_no || '_element' || place || '.png}}' || chr(10) || '\end{{figure}}' || chr(10)
   WHEN text <> '' THEN para || '\par' || chr(10) END AS node FROM s1 WHERE role <> 'Separator'),
 s3 AS (SELECT *, role = 'ListItem' AS li, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY place) - row_number() OVER (PARTITION BY doc_id, page_no, role = 'ListItem' ORDER BY place) AS run FROM s2 WHERE node IS NOT NULL),
 s4 AS (SELECT doc_id, page_no, li, min(place) AS place, string_agg(node, '' ORDER BY place) AS node FROM s3 GROUP BY doc_id, page_no, li, CASE WHEN li THEN -run ELSE place END),
 s5 AS (SELECT doc_id, page_no, string_agg(CASE WHEN li THEN '\begin{{itemize}}' || chr(10) || node || '\end{{itemize}}' || chr(10) ELSE node END, '' ORDER BY place) AS page FROM s4 GROUP BY 1, 2)
 SELECT doc_id, """.replace("{{", "{").replace("}}", "}") + HEAD.format(PACKAGES) + " AS source FROM s5 GROUP BY 1"
SHOWN = rf""", p1 AS (SELECT *, CASE WHEN role IN ('Figure', 'Signature', 'Stamp', 'Formula') OR (role IN ('Title', 'Paragraph', 'Table', 'ListItem', 'Unknown') AND confidence::FLOAT < 0.74::FLOAT)
   THEN CASE WHEN has_image THEN printf('\includegraphics[width=%.2fpt,height=%.2fpt]', w * 0.48, h * 0.48) || '{{' || doc_id || '_assets/page' || page_no || '_element' || (ro + 1) || '.png}}' || chr(10)
     WHEN role = 'Formula' THEN '\fbox{{Formula no disponible en memoria}}' || chr(10) WHEN role IN ('Figure', 'Signature', 'Stamp') THEN '\fbox{{Imagen no disponible en memoria}}' || chr(10) WHEN text <> '' THEN para END
   WHEN role = 'Separator' THEN '\hrule' || chr(10) WHEN text <> '' THEN para END AS shown FROM d),
 p2 AS (SELECT doc_id, page_no, string_agg(printf('\begin{{textblock*}}{{%.2fpt}}(%.2fpt,%.2fpt)', w * 0.48, x * 0.48, y * 0.48) || chr(10) || shown || '\end{{textblock*}}' || chr(10), '' ORDER BY ro) AS page FROM p1 WHERE shown IS NOT NULL GROUP BY 1, 2)""".replace("{{", "{").replace("}}", "}")
TEXTPOS = PACKAGES + r" || '\usepackage{textpos}' || chr(10)"
IMAGE_BLOCKS = f"WITH b AS ({layout_sql(True)})"
POSITIONED = IMAGE_BLOCKS + PLACES + DRAWN + SHOWN + " SELECT doc_id, " + HEAD.format(TEXTPOS) + " AS source FROM p2 GROUP BY 1"
EXPORTED = IMAGE_BLOCKS + PLACES + DRAWN + SHOWN + r""", vis AS (SELECT doc_id FROM m GROUP BY 1 HAVING bool_and(mode = 'VisualPreservation')),
 v2 AS (SELECT DISTINCT doc_id, page_no, printf('\includegraphics[width=%.2fpt,height=%.2fpt]', page_w * 0.48, page_h * 0.48) || '{' || doc_id || '_assets/page' || page_no || '_full.png}' || chr(10) AS page FROM b WHERE has_image AND doc_id IN (SELECT doc_id FROM vis)),
 u AS (SELECT doc_id, """ + HEAD.format(TEXTPOS) + " AS source FROM p2 WHERE doc_id NOT IN (SELECT doc_id FROM vis) GROUP BY 1 UNION ALL SELECT doc_id, " + HEAD.format(PACKAGES) + """ FROM v2 GROUP BY 1)
 SELECT doc_id, md5(source) AS source_md5, ((length(source) - length(replace(source, '_full.png', ''))) // 9)::BIGINT AS full_pages FROM u"""
GLYPHS = "[" + ", ".join(map(str, pdf.GLYPHS)) + "]"
WIDE = "list_sum(list_transform(string_split({0}, ''), lambda c: coalesce(CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN " + GLYPHS + "[unicode(c) - 31] END, 556)))::DOUBLE"
# The characters of cp1252 from 128 on; blanks stand for places without one.
CP1252 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"
HEX = f"""array_to_string(list_transform(string_split({{0}}, ''), lambda c: CASE WHEN c = '' THEN '' WHEN unicode(c) < 128 OR unicode(c) BETWEEN 160 AND 255 THEN printf('%02X', unicode(c))
  WHEN c <> ' ' AND strpos('{CP1252}', c) > 0 THEN printf('%02X', 127 + strpos('{CP1252}', c)) WHEN unicode(strip_accents(c)) < 128 THEN printf('%02X', unicode(strip_accents(c))) ELSE '3F' END), '')"""
LINES = rf""", t1 AS (SELECT doc_id, page_no, ro, x, y, w, page_h, {SIDE} AS side, least(greatest(0.8 * (h * 0.48::DOUBLE), 6.0), 72.0) AS size, greatest(w * 0.48::DOUBLE - 4, 10.0) AS usable,
   list_filter(string_split_regex({ETEXT}, '\s+'), lambda x: x <> '') AS ws FROM e WHERE {ETEXT} <> ''),
 w1 AS (SELECT doc_id, page_no, ro, size, usable, ws, 1 AS i, 0 AS line, ws[1] AS now FROM t1
   UNION ALL SELECT doc_id, page_no, ro, size, usable, ws, i + 1, CASE WHEN {WIDE.format("now || ' ' || ws[i + 1]")} * size / 1000.0 <= usable THEN line ELSE line + 1 END,
     CASE WHEN {WIDE.format("now || ' ' || ws[i + 1]")} * size / 1000.0 <= usable THEN now || ' ' || ws[i + 1] ELSE ws[i + 1] END FROM w1 WHERE i < len(ws)),
 w2 AS (SELECT doc_id, page_no, ro, line, arg_max(now, i) AS value FROM w1 GROUP BY 1, 2, 3, 4),
 w3 AS (SELECT w2.*, t1.size, side, (page_h - y) * 0.48::DOUBLE - t1.size - line * greatest(1.18 * t1.size, 8.0) AS baseline, x * 0.48::DOUBLE + 2 AS lft, greatest(t1.usable - {WIDE.format('value')} * t1.size / 1000.0, 0.0) AS free
   FROM w2 JOIN t1 USING (doc_id, page_no, ro)),
 ln AS (SELECT doc_id, page_no, ro AS reading_order, line::BIGINT AS line, value, {HEX.format('value')} AS hex, round(lft + CASE side WHEN 'Center' THEN free / 2 WHEN 'Right' THEN free ELSE 0 END, 6) AS left_pt, round(baseline, 6) AS baseline_pt FROM w3 WHERE baseline > 0)"""
RECURSIVE = ALL.replace("WITH b AS", "WITH RECURSIVE b AS", 1)
FILES = RECURSIVE + LINES + f""", sep AS (SELECT doc_id, page_no, ro AS reading_order, 0 AS line FROM e WHERE {ROLE} = 'Separator'),
 pg AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM e GROUP BY 1),
 tx AS (SELECT doc_id, count(*) AS lines, string_agg(hex, '|' ORDER BY page_no, reading_order, line) AS text FROM ln JOIN (SELECT doc_id, page_no, ro AS reading_order, {ROLE} AS role FROM e) USING (doc_id, page_no, reading_order)
   WHERE role NOT IN ('Figure', 'Signature', 'Stamp') GROUP BY 1)
 SELECT doc_id, pages, coalesce(tx.lines, 0) AS lines, (SELECT count(*) FROM sep WHERE sep.doc_id = pg.doc_id) AS rules, md5(coalesce(text, '')) AS text_md5 FROM pg LEFT JOIN tx USING (doc_id)"""
JSON = BLOCKS + """ SELECT doc_id::VARCHAR AS job_id, doc_id::VARCHAR AS doc_id, 'Completed' AS status, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS place, page_no AS number, page_w AS width, page_h AS height,
 row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block_idx) - 1 AS block_place, block_idx, block_type, x, y, w, h, content, confidence, reading_order FROM b"""


def txt_sql() -> str:
    from .blueprint import TXT

    head = "'Documento: ' || doc_id || chr(10) || 'Archivo fuente: /in/' || doc_id || '.pdf' || chr(10) || 'Perfil: Balanced' || chr(10) || 'Estado: Completed' || chr(10) || chr(10)"
    return f"SELECT 'j' || doc_id AS job_id, md5({head} || body) AS value_md5 FROM ({ALL + TXT})"


ASSETS = IMAGE_BLOCKS + PLACES + f""" SELECT doc_id, 'page' || page_no || '_element' || (ro + 1) || '.png' AS name, doc_id || '_assets' AS folder, round(w * 0.48::DOUBLE, 6) AS wide, round(h * 0.48::DOUBLE, 6) AS high FROM e
 WHERE has_image AND ({ROLE} IN ('Figure', 'Signature', 'Stamp', 'Formula') OR ({ROLE} IN ('Title', 'Paragraph', 'Table', 'ListItem', 'Unknown') AND confidence::FLOAT < 0.74::FLOAT))"""

QUERIES = {
    "latex_semantic": latex_semantic, "latex_positioned": latex_positioned, "latex_export": latex_export, "pdf_lines": pdf_lines, "pdf_files": pdf_files, "json_export": json_export,
    "txt_files": txt_files, "page_assets": page_assets,
}
ORACLES = {
    "latex_semantic": SEMANTIC, "latex_positioned": POSITIONED, "latex_export": EXPORTED, "pdf_lines": RECURSIVE + LINES + " SELECT * FROM ln", "pdf_files": FILES, "json_export": JSON,
    "txt_files": txt_sql(), "page_assets": ASSETS,
}
