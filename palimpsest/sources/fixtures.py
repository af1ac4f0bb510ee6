"""Deterministic page geometry for a table of texts: each line is a block, twelve blocks are a page.

Whole-number arithmetic only, so any SQL engine lays out the same pages. ``STEPS`` are the same
expressions for Spark and, with ``//`` for ``div``, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TABLE_TYPE

STEPS = [
    [("page_no", "CAST(line_no DIV 12 + 1 AS INT)"), ("slot", "CAST(line_no % 12 AS INT)"), ("confidence", "CASE WHEN {SURE} AND CAST(line_no % 12 AS INT) IN (0, 11) THEN CAST(95 AS DOUBLE) ELSE CAST((doc_id * 37 + line_no * 11) % 101 AS DOUBLE) END / CAST(100 AS DOUBLE)")],
    [("k", "CASE WHEN page_no % 3 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 ELSE 3 END")],
    [
        ("block_type", """CASE k
  WHEN 0 THEN CASE WHEN slot = 0 THEN 'Title' WHEN slot = 5 THEN 'List' WHEN slot = 9 THEN 'Formula' ELSE 'Text' END
  WHEN 1 THEN CASE WHEN slot IN (0, 11) THEN 'Text' WHEN slot % 4 = 1 THEN 'Text' WHEN slot % 4 = 2 THEN 'List' WHEN slot % 4 = 3 THEN 'Formula' ELSE 'Table' END
  WHEN 2 THEN CASE WHEN slot = 0 THEN 'Image' ELSE 'Text' END
  ELSE CASE slot WHEN 0 THEN 'Title' WHEN 1 THEN 'Table' WHEN 2 THEN 'Separator' WHEN 3 THEN 'Signature' WHEN 4 THEN 'Stamp' WHEN 5 THEN 'Unknown' ELSE 'Text' END END"""),
        ("x", "CAST(CASE k WHEN 0 THEN CASE WHEN slot BETWEEN 6 AND 10 THEN 660 ELSE 120 END WHEN 1 THEN 110 WHEN 2 THEN CASE WHEN slot = 0 THEN 60 ELSE 760 END ELSE 100 END AS BIGINT)"),
        ("y", """CAST(CASE k
  WHEN 0 THEN CASE WHEN slot = 0 THEN 80 WHEN slot <= 5 THEN 280 + (slot - 1) * 240 WHEN slot <= 10 THEN 300 + (slot - 6) * 240 ELSE 1650 END
  WHEN 1 THEN CASE WHEN slot = 0 THEN 55 WHEN slot = 11 THEN 1650 ELSE 210 + (slot - 1) * 140 END
  WHEN 2 THEN CASE WHEN slot = 0 THEN 220 ELSE 250 + (slot - 1) * 130 END
  ELSE CASE slot WHEN 0 THEN 80 WHEN 1 THEN 240 WHEN 2 THEN 660 ELSE 690 + (slot - 3) * 110 END END AS BIGINT)"""),
        ("w", """CAST(CASE k WHEN 0 THEN CASE WHEN slot IN (0, 11) THEN 960 ELSE 420 END WHEN 1 THEN CASE WHEN slot IN (0, 11) THEN 980 ELSE 900 END
  WHEN 2 THEN CASE WHEN slot = 0 THEN 620 ELSE 420 END ELSE CASE slot WHEN 3 THEN 300 WHEN 4 THEN 200 ELSE 1000 END END AS BIGINT)"""),
        ("h", """CAST(CASE k WHEN 0 THEN CASE WHEN slot = 0 THEN 120 WHEN slot = 11 THEN 45 ELSE 180 END WHEN 1 THEN CASE WHEN slot = 0 THEN 55 WHEN slot = 11 THEN 45 ELSE 120 END
  WHEN 2 THEN CASE WHEN slot = 0 THEN 680 ELSE 90 END ELSE CASE slot WHEN 0 THEN 100 WHEN 1 THEN 400 WHEN 2 THEN 8 ELSE 90 END END AS BIGINT)"""),
        ("content", """CASE WHEN k = 1 AND slot = 0 THEN concat('Running head ', CAST(doc_id AS {STRING}))
  WHEN k IN (0, 1) AND slot = 11 THEN concat('Page ', CAST(page_no AS {STRING})) ELSE line END"""),
        ("reading_order", "CAST((slot * 7) % 12 AS BIGINT)"),
        ("page_w", "CAST(1200 AS BIGINT)"), ("page_h", "CAST(1800 AS BIGINT)"), ("has_image", "{IMAGE}"),
    ],
]
COLUMNS = ["doc_id", "page_no", "slot", "block_type", "x", "y", "w", "h", "content", "confidence", "reading_order", "page_w", "page_h", "has_image"]
#: Pages have an image on every fifth document in the second variant.
IMAGE = {False: "FALSE", True: "doc_id % 5 = 0"}


def layout_blocks(documents: DataFrame, with_images: bool = False, sure_heads: bool = False) -> DataFrame:
    """The blocks of ``documents`` (doc_id, text); texts that are null have none. ``sure_heads`` raises the confidence of each page's first and
    last block, so that running heads are read."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    for step in STEPS:
        rows = rows.selectExpr("*", *[f"{e.format(STRING='STRING', IMAGE=IMAGE[with_images], SURE=sure_heads)} AS {n}" for n, e in step])
    rows = rows.select(*COLUMNS).withColumnRenamed("slot", "block_idx")
    return rows.withColumn("layout_confidence", F.lit(None).cast("double")).withColumn("table", F.lit(None).cast(TABLE_TYPE))


def layout_sql(with_images: bool = False, sure_heads: bool = False) -> str:
    """The same for the oracle, as the body of a common table expression."""
    sql = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line_no FROM documents"
    for step in STEPS:
        sql = f"SELECT *, {', '.join(f'{e.format(STRING="VARCHAR", IMAGE=IMAGE[with_images], SURE=sure_heads)} AS {n}' for n, e in step)} FROM ({sql})"
    return f"SELECT {', '.join(COLUMNS)} FROM ({sql})".replace(" DIV ", " // ").replace("slot,", "slot AS block_idx,", 1)
