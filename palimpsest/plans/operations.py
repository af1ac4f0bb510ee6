"""Queries over detectors, tables, jobs and exports, on rows derived from the tables by whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import markdown_table, nfc, plain_table
from ..operators import detect as D
from ..operators import jobs as J
from ..operators.engine import block_text, stub_engine
from ..operators.refine import merge_retry
from ..schema import TABLE_TYPE
from ..sources.files import routed
from ..sources.fixtures import layout_sql
from .blueprint import laid_out

B = f"WITH b AS ({layout_sql()})"


# -- detectors --------------------------------------------------------------------------------------------------------
def page_boxes(spark, sf_dir) -> DataFrame:
    """The blocks of a page as detections, widened so that many overlap."""
    box = F.struct(F.col("x").cast("float").alias("x"), (F.col("y") * 0.5).cast("float").alias("y"), (F.col("w") + 100).cast("float").alias("w"), (F.col("h") + 60).cast("float").alias("h"), F.col("confidence").cast("float").alias("score"), (F.col("doc_id") % 2 + F.col("block_idx") % 2).cast("int").alias("cls"), F.col("block_idx").alias("idx"))
    return laid_out(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", box.alias("b")))), lambda s: s["b"]).alias("boxes"))


def nms(spark, sf_dir):
    kept = D.suppressed(F.col("boxes"), 0.2)
    return page_boxes(spark, sf_dir).select("doc_id", "page_no", F.explode(F.transform(kept, lambda b: b["idx"])).alias("block_idx"))


NMS = B + """, d AS (SELECT doc_id, page_no, block_idx, x::FLOAT AS x, (y * 0.5)::FLOAT AS y, (w + 100)::FLOAT AS w, (h + 60)::FLOAT AS h, (doc_id % 2 + block_idx % 2)::INT AS cls,
   row_number() OVER (PARTITION BY doc_id, page_no ORDER BY confidence::FLOAT DESC, block_idx) AS r FROM b),
 e AS (SELECT p.doc_id, p.page_no, p.r AS better, q.r AS worse FROM d p JOIN d q ON p.doc_id = q.doc_id AND p.page_no = q.page_no AND p.r < q.r AND p.cls = q.cls
   WHERE (SELECT i / (p.w * p.h + q.w * q.h - i) FROM (SELECT greatest(least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x), 0)::DOUBLE * greatest(least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y), 0)::DOUBLE AS i)) > 0.2),
 k AS (SELECT doc_id, page_no, max(r) AS n FROM d GROUP BY 1, 2)"""
NMS = NMS.replace("WITH b AS", "WITH RECURSIVE b AS", 1) + """, f AS (
  SELECT doc_id, page_no, 0 AS step, n, []::BIGINT[] AS kept FROM k
  UNION ALL
  SELECT f.doc_id, f.page_no, f.step + 1, f.n, CASE WHEN len(list_intersect(f.kept, (SELECT coalesce(list(better), []) FROM e WHERE e.doc_id = f.doc_id AND e.page_no = f.page_no AND e.worse = f.step + 1))) > 0 THEN f.kept ELSE list_append(f.kept, f.step + 1) END
  FROM f WHERE f.step < f.n)
SELECT d.doc_id, d.page_no, d.block_idx FROM f JOIN d ON d.doc_id = f.doc_id AND d.page_no = f.page_no WHERE f.step = f.n AND list_contains(f.kept, d.r)"""


def ctc_decode(spark, sf_dir):
    """Steps from ids: symbol (doc * step) % 7 is best at each of 12 steps; five characters, so one symbol is beyond the dictionary."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    symbol = lambda t: ((F.col("doc_id") * (t + 1) + F.floor(t / F.lit(3))) % 7).cast("int")
    steps = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.when(k == symbol(t), F.lit(4.0)).otherwise(F.lit(0.0))))
    out = D.ctc(steps, F.array(*map(F.lit, "abcde")))
    return docs.select("doc_id", out["text"].alias("text"), F.round(out["confidence"], 9).alias("confidence"))


CTC = """WITH s AS (SELECT doc_id, t, ((doc_id * (t + 1) + t // 3) % 7)::INT AS k FROM documents, unnest(range(12)) AS u(t)),
 l AS (SELECT *, lag(k, 1, 0) OVER (PARTITION BY doc_id ORDER BY t) AS p FROM s)
SELECT doc_id, coalesce(string_agg(substr('abcde', k, 1), '' ORDER BY t) FILTER (k <> 0 AND k <> p AND k <= 5), '') AS text,
  round(CASE WHEN count(*) FILTER (k <> 0 AND k <> p AND k <= 5) > 0 THEN exp(4.0::DOUBLE) / (exp(4.0::DOUBLE) + 6) ELSE 0 END, 9) AS confidence FROM l GROUP BY 1"""


def anchor_decode(spark, sf_dir):
    """Boxes from a tensor [6][4] of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    tensor = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(k < 4, 100 + ((F.col("doc_id") + 13 * k + 7 * i) % 50) * 2).otherwise(((F.col("doc_id") + 3 * k + i) % 10)).cast("float")))
    rows = docs.select("doc_id", F.explode(D.anchor_boxes(tensor, 2, 5.0)).alias("b"))
    return rows.select("doc_id", F.col("b.idx").alias("idx"), F.col("b.cls").alias("cls"), F.col("b.score").cast("double").alias("score"), F.col("b.x").cast("double").alias("x"), F.col("b.y").cast("double").alias("y"), F.col("b.w").cast("double").alias("w"), F.col("b.h").cast("double").alias("h"))


ANCHOR = """WITH t AS (SELECT doc_id, i, 100 + ((doc_id + 7 * i) % 50) * 2 AS cx, 100 + ((doc_id + 13 + 7 * i) % 50) * 2 AS cy, 100 + ((doc_id + 26 + 7 * i) % 50) * 2 AS w, 100 + ((doc_id + 39 + 7 * i) % 50) * 2 AS h,
  (doc_id + 12 + i) % 10 AS s0, (doc_id + 15 + i) % 10 AS s1 FROM documents, unnest(range(4)) AS u(i))
SELECT doc_id, i::INT AS idx, (CASE WHEN s1 > s0 THEN 1 ELSE 0 END)::INT AS cls, greatest(s0, s1)::DOUBLE AS score, cx - w / 2.0::DOUBLE AS x, cy - h / 2.0::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM t WHERE greatest(s0, s1) >= 5"""


def structured(spark, sf_dir) -> DataFrame:
    """A table a document from detected lines: 1 to 3 rows, 0 to 2 columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    rows = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda i: F.struct(F.lit(2).alias("cls"), F.lit(0).cast("bigint").alias("x"), (100 * (2 - i) + F.col("doc_id") % 7).cast("bigint").alias("y"), F.lit(500).cast("bigint").alias("w"), F.lit(40).cast("bigint").alias("h"), i.cast("int").alias("idx")))
    columns = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.struct(F.lit(1).alias("cls"), (150 * i).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), (140 + F.col("doc_id") % 5).cast("bigint").alias("w"), F.lit(300).cast("bigint").alias("h"), (10 + i).cast("int").alias("idx")))
    lines = F.concat(rows, F.slice(columns, F.lit(1), (F.col("doc_id") % 3).cast("int")))
    return docs.select("doc_id", D.grid(lines).cast(TABLE_TYPE).alias("table"))


def table_grid(spark, sf_dir):
    rows = structured(spark, sf_dir).select("doc_id", F.posexplode("table.rows").alias("r", "row"))
    cells = rows.select("doc_id", "r", F.posexplode("row").alias("c", "cell"))
    return cells.select("doc_id", "r", "c", *[F.col(f"cell.{k}").alias(k) for k in ("x", "y", "w", "h", "alignment", "is_emphasized")])


GRID = """WITH d AS (SELECT doc_id, i, (100 * (2 - i) + doc_id % 7)::BIGINT AS y FROM documents, unnest(range(0, 3)) AS u(i) WHERE i <= doc_id % 3),
 r AS (SELECT doc_id, y, (row_number() OVER (PARTITION BY doc_id ORDER BY y, i) - 1)::INT AS r FROM d),
 c AS (SELECT doc_id, i::INT AS c, (150 * i)::BIGINT AS x, (140 + doc_id % 5)::BIGINT AS w FROM documents, unnest(range(0, 2)) AS u(i) WHERE i < doc_id % 3)
SELECT r.doc_id, r.r, c.c, c.x, r.y, c.w, 40::BIGINT AS h, CASE WHEN r.r = 0 THEN 'Center' ELSE 'Left' END AS alignment, r.r = 0 AS is_emphasized FROM r JOIN c ON r.doc_id = c.doc_id"""


def filled(spark, sf_dir) -> DataFrame:
    named = F.transform("table.rows", lambda r, i: F.transform(r, lambda c, j: c.withField("content", F.concat(F.lit("c"), i.cast("string"), F.lit("_"), j.cast("string")))))
    return structured(spark, sf_dir).withColumn("table", F.col("table").withField("rows", named))


def table_plain_text(spark, sf_dir):
    return filled(spark, sf_dir).select("doc_id", plain_table(F.col("table")).alias("plain"))


def table_markdown(spark, sf_dir):
    return filled(spark, sf_dir).select("doc_id", markdown_table(F.col("table")).alias("markdown"))


CELLS = "WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (doc_id % 3 + 1) END AS rows, doc_id % 3 AS cols FROM documents), c AS (SELECT doc_id, r, c, 'c' || r || '_' || c AS t FROM n, unnest(range(0, 3)) AS u(r), unnest(range(0, 2)) AS v(c) WHERE r < rows AND c < cols)"
PLAIN = CELLS + ", l AS (SELECT doc_id, r, string_agg(t, chr(9) ORDER BY c) || chr(10) AS line FROM c GROUP BY 1, 2) SELECT n.doc_id, coalesce(string_agg(line, '' ORDER BY r), '') AS plain FROM n LEFT JOIN l ON n.doc_id = l.doc_id GROUP BY 1"
MARKDOWN = CELLS + ", l AS (SELECT doc_id, r, '| ' || string_agg(t, ' | ' ORDER BY c) || ' |' || chr(10) || CASE WHEN r = 0 THEN '| ' || string_agg('---', ' | ' ORDER BY c) || ' |' || chr(10) ELSE '' END AS line FROM c GROUP BY 1, 2) SELECT n.doc_id, coalesce(string_agg(line, '' ORDER BY r), '') AS markdown FROM n LEFT JOIN l ON n.doc_id = l.doc_id GROUP BY 1"


def otsu_threshold(spark, sf_dir):
    """The level that parts a histogram made of each document's id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    histogram = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: ((i * (F.col("doc_id") % 11 + 1) + F.col("doc_id")) % 97).cast("bigint"))
    return docs.select("doc_id", D.otsu(histogram).cast("bigint").alias("threshold"))


OTSU = """WITH h AS (SELECT doc_id, i, ((i * (doc_id % 11 + 1) + doc_id) % 97)::BIGINT AS v FROM documents, unnest(range(256)) AS u(i)),
 s AS (SELECT doc_id, i, sum(v) OVER p AS n, sum(v * i) OVER p AS s, sum(v) OVER (PARTITION BY doc_id) AS tn, sum(v * i) OVER (PARTITION BY doc_id) AS ts FROM h WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
 w AS (SELECT doc_id, i, CASE WHEN n > 0 AND tn > n THEN n::DOUBLE * (tn - n)::DOUBLE * (s::DOUBLE / n::DOUBLE - (ts - s)::DOUBLE / (tn - n)::DOUBLE) * (s::DOUBLE / n::DOUBLE - (ts - s)::DOUBLE / (tn - n)::DOUBLE) ELSE -1 END AS spread FROM s),
 r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY spread DESC, i) AS k FROM w)
SELECT doc_id, i::BIGINT AS threshold FROM r WHERE k = 1"""


def text_rows(spark, sf_dir):
    rows = laid_out(spark, sf_dir).select("doc_id", "page_no", "x", F.expr("y + block_idx % 3").alias("y"), F.col("block_idx").alias("idx"))
    return D.text_rows(rows).select("doc_id", "page_no", "idx", F.col("place").cast("bigint").alias("place"))


ROWS = B + " SELECT doc_id, page_no, block_idx AS idx, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY (y + block_idx % 3) // 20, x, block_idx) - 1 AS place FROM b"


def clip_regions(spark, sf_dir):
    rows = laid_out(spark, sf_dir).withColumn("_c", D.clipped(F.lit(900), F.lit(1000))).filter("_c is not null")
    return rows.select("doc_id", "page_no", "block_idx", F.col("_c.w").alias("w"), F.col("_c.h").alias("h"))


CLIP = B + " SELECT doc_id, page_no, block_idx, least(w, 900 - x) AS w, least(h, 1000 - y) AS h FROM b WHERE x < 900 AND y < 1000 AND least(w, 900 - x) >= 2 AND least(h, 1000 - y) >= 2"


# -- engine and retries -----------------------------------------------------------------------------------------------
def stub_text(spark, sf_dir):
    return stub_engine(laid_out(spark, sf_dir), "Accurate").select("doc_id", "page_no", "block_idx", "content", "confidence")


STUB = B + """ SELECT doc_id, page_no, block_idx, CASE block_type WHEN 'Title' THEN 'Documento de Prueba - Stub OCR'
  WHEN 'Text' THEN 'Este es un texto de ejemplo generado por el StubOcrEngine. El contenido es simulado para testing de la interfaz TUI.'
  ELSE '[' || block_type || '] Contenido simulado' END AS content, 0.95::DOUBLE AS confidence FROM b"""


def line_merge(spark, sf_dir):
    lines = laid_out(spark, sf_dir).select("doc_id", "page_no", F.expr("block_idx div 4").cast("int").alias("block_idx"), F.col("block_idx").alias("place"), F.trim("content").alias("text"), "confidence")
    return block_text(lines).select("doc_id", "page_no", "block_idx", F.md5("content").alias("content_md5"), F.round("confidence", 9).alias("confidence"))


LINES = B + """ SELECT doc_id, page_no, (block_idx // 4)::INT AS block_idx, md5(coalesce(string_agg(trim(content), chr(10) ORDER BY block_idx) FILTER (trim(content) <> ''), '')) AS content_md5,
  round(coalesce(avg(confidence) FILTER (trim(content) <> ''), 0), 9) AS confidence FROM b GROUP BY 1, 2, 3"""


def retry_merge(spark, sf_dir):
    """A second reading of every block at its place: better by 0.3 where the block is even."""
    rows = laid_out(spark, sf_dir)
    again = rows.withColumns({"content": F.concat(F.lit("retry "), F.col("block_idx").cast("string")), "confidence": F.least(F.col("confidence") + F.when(F.col("block_idx") % 2 == 0, 0.3).otherwise(0.01), F.lit(1.0))})
    return merge_retry(rows, again).select("doc_id", "page_no", "block_idx", "content", F.round("confidence", 6).alias("confidence"))


RETRY = B + """, n AS (SELECT *, least(confidence + CASE WHEN block_idx % 2 = 0 THEN 0.3 ELSE 0.01 END, 1.0)::DOUBLE AS c2 FROM b),
 t AS (SELECT *, block_type IN ('Text', 'Title', 'List', 'Table') AND confidence < 0.78 AND c2 >= confidence + 0.05 AS take FROM n)
SELECT doc_id, page_no, block_idx, CASE WHEN take THEN 'retry ' || block_idx ELSE content END AS content, round(CASE WHEN take THEN c2 ELSE confidence END, 6) AS confidence FROM t"""


# -- jobs -------------------------------------------------------------------------------------------------------------
def jobs(spark, sf_dir) -> DataFrame:
    """Orders as jobs: the customer is the source, the status goes by the order's key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.get(F.array(*map(F.lit, ("Queued", "Processing", "Completed", "Failed", "Cancelled"))), (F.col("o_orderkey") % 5).cast("int"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("/in/"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("source_path"), status.alias("status"),
        F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit("Balanced").alias("profile"), F.lit(None).cast("string").alias("error_message"), F.lit("Txt").alias("output_format"), F.lit("auto").alias("mode_preference"),
    )


JOBS = """WITH j AS (SELECT o_orderkey::VARCHAR AS job_id, '/in/' || o_custkey || '.pdf' AS source_path, o_orderdate AS created_at, o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN 'Queued' WHEN 1 THEN 'Processing' WHEN 2 THEN 'Completed' WHEN 3 THEN 'Failed' ELSE 'Cancelled' END AS status FROM orders)"""


def job_list(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("status").orderBy("created_at", F.col("job_id").cast("long")))
    return jobs(spark, sf_dir).select("job_id", "status", place.cast("bigint").alias("place"))


def job_repair(spark, sf_dir):
    return J.repaired(jobs(spark, sf_dir)).select("job_id", "status", "error_message")


def job_cleanup(spark, sf_dir):
    return J.unfinished(jobs(spark, sf_dir)).select("job_id", "status")


def job_dedup(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    return J.admitted(rows.filter("cast(job_id as bigint) % 3 = 0 and status = 'Completed'"), rows.filter("cast(job_id as bigint) % 3 <> 0")).select("job_id", "source_path")


def job_upsert(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    changes = rows.filter("cast(job_id as bigint) % 10 = 1").withColumn("status", F.lit("Failed"))
    return J.removed(J.upserted(rows, changes), rows.filter("cast(job_id as bigint) % 10 = 2")).groupBy("status").agg(F.count("*").alias("n"))


def job_events(spark, sf_dir) -> DataFrame:
    """The table of events as job events: one job a user and 20 events, phases by type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "purchase", "Completed").when(F.col("event_type") == "error", "Error").otherwise("Progress")
    return e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), F.col("event_type").alias("phase"), (F.col("event_id") % 100 / 100).cast("float").alias("progress"), F.when(F.col("event_id") % 2 == 0, "cancelled").otherwise("broken").alias("error"))


EVENTS = "WITH e AS (SELECT user_id::VARCHAR AS job_id, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Error' ELSE 'Progress' END AS kind, event_type AS phase, CASE WHEN event_id % 2 = 0 THEN 'cancelled' ELSE 'broken' END AS error FROM events)"


def job_last_phase(spark, sf_dir):
    return J.last_phase(job_events(spark, sf_dir)).select("job_id", "seq", "phase", F.round(F.col("progress").cast("double"), 2).alias("progress"))


def job_settled(spark, sf_dir):
    return J.settled(jobs(spark, sf_dir), job_events(spark, sf_dir)).groupBy("status", "error_message").agg(F.count("*").alias("n"), F.count("completed_at").alias("n_completed"))


SETTLED = EVENTS + ", l AS (SELECT job_id, kind, error, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS r FROM e WHERE kind IN ('Completed', 'Error'))" + JOBS.replace("WITH j", ", j") + """,
 s AS (SELECT CASE WHEN l.kind IS NULL THEN j.status WHEN l.kind = 'Completed' THEN 'Completed' WHEN l.error = 'cancelled' THEN 'Cancelled' ELSE 'Failed' END AS status,
   CASE WHEN l.kind = 'Error' AND l.error <> 'cancelled' THEN l.error END AS error_message, l.kind = 'Completed' AS done FROM j LEFT JOIN l ON j.job_id = l.job_id AND l.r = 1)
SELECT status, error_message, count(*) AS n, count(*) FILTER (done) AS n_completed FROM s GROUP BY 1, 2"""


def event_counts(spark, sf_dir):
    """Events by kind in windows of five minutes."""
    rows = job_events(spark, sf_dir).groupBy(F.window("ts", "5 minutes").alias("w"), "kind").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "kind", "n")


# -- sources and exports ----------------------------------------------------------------------------------------------
def source_routing(spark, sf_dir):
    names = F.array(*map(F.lit, (".pdf", ".TIFF", ".jpeg", ".doc", "", ".tar.webp")))
    paths = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("/data/a.b/f"), F.col("doc_id").cast("string"), F.get(names, (F.col("doc_id") % 6).cast("int"))).alias("path"))
    return routed(paths).select("doc_id", "filename", "source_format", "error")


ROUTING = """WITH p AS (SELECT doc_id, 'f' || doc_id || ['.pdf', '.TIFF', '.jpeg', '.doc', '', '.tar.webp'][doc_id % 6 + 1] AS filename FROM documents)
SELECT doc_id, filename, ['pdf', 'tiff', 'image', NULL, NULL, 'image'][doc_id % 6 + 1] AS source_format, ['', '', '', 'UnsupportedFormat: doc', 'UnsupportedFormat: desconocido', ''][doc_id % 6 + 1] AS e FROM p"""
ROUTING = f"SELECT doc_id, filename, source_format, nullif(e, '') AS error FROM ({ROUTING})"


def block_preview(spark, sf_dir):
    """The first 97 characters of a long block, under its type."""
    text = F.when(F.length("content") > 100, F.concat(F.substring("content", 1, 97), F.lit("..."))).otherwise(F.col("content"))
    return laid_out(spark, sf_dir).select("doc_id", "page_no", "block_idx", F.concat(F.lit("["), F.col("block_type"), F.lit("] "), text).alias("preview"))


PREVIEW = B + " SELECT doc_id, page_no, block_idx, '[' || block_type || '] ' || CASE WHEN length(content) > 100 THEN content[:97] || '...' ELSE content END AS preview FROM b"


def nfc_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(nfc(F.replace("text", F.lit("é"), F.lit("é")))).alias("nfc_md5"))


QUERIES = {
    "nms": nms, "ctc_decode": ctc_decode, "anchor_decode": anchor_decode, "table_grid": table_grid, "table_plain_text": table_plain_text, "table_markdown": table_markdown,
    "otsu_threshold": otsu_threshold, "text_rows": text_rows, "clip_regions": clip_regions, "stub_text": stub_text, "line_merge": line_merge, "retry_merge": retry_merge,
    "job_list": job_list, "job_repair": job_repair, "job_cleanup": job_cleanup, "job_dedup": job_dedup, "job_upsert": job_upsert, "job_last_phase": job_last_phase,
    "job_settled": job_settled, "event_counts": event_counts, "source_routing": source_routing, "block_preview": block_preview, "nfc_text": nfc_text,
}
ORACLES = {
    "nms": NMS, "ctc_decode": CTC, "anchor_decode": ANCHOR, "table_grid": GRID, "table_plain_text": PLAIN, "table_markdown": MARKDOWN, "otsu_threshold": OTSU, "text_rows": ROWS,
    "clip_regions": CLIP, "stub_text": STUB, "line_merge": LINES, "retry_merge": RETRY, "source_routing": ROUTING, "block_preview": PREVIEW,
    "job_list": JOBS + " SELECT job_id, status, row_number() OVER (PARTITION BY status ORDER BY created_at, o_orderkey) AS place FROM j",
    "job_repair": JOBS + " SELECT job_id, CASE WHEN status = 'Processing' THEN 'Failed' ELSE status END AS status, CASE WHEN status = 'Processing' THEN 'Interrumpido: la aplicacion se cerro durante el procesamiento' END AS error_message FROM j",
    "job_cleanup": JOBS + " SELECT job_id, status FROM j WHERE status IN ('Queued', 'Processing')",
    "job_dedup": JOBS + """, n AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY created_at, job_id) AS k FROM j WHERE o_orderkey % 3 = 0 AND status = 'Completed'
  AND source_path NOT IN (SELECT source_path FROM j WHERE o_orderkey % 3 <> 0 AND status IN ('Queued', 'Processing'))) SELECT job_id, source_path FROM n WHERE k = 1""",
    "job_upsert": JOBS + " SELECT CASE WHEN o_orderkey % 10 = 1 THEN 'Failed' ELSE status END AS status, count(*) AS n FROM j WHERE o_orderkey % 10 <> 2 GROUP BY 1",
    "job_last_phase": EVENTS + " SELECT job_id, max(seq) AS seq, arg_max(phase, seq) AS phase, round((max(seq) % 100) / 100.0::DOUBLE, 2) AS progress FROM e GROUP BY 1",
    "job_settled": SETTLED,
    "event_counts": EVENTS + " SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, kind, count(*) AS n FROM e GROUP BY 1, 2",
    "nfc_text": "SELECT doc_id, md5(nfc_normalize(replace(text, 'é', 'é'))) AS nfc_md5 FROM documents",
}
