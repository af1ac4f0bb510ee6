"""Jobs as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshots(jobs: DataFrame, blocks: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """job_id and value: the job with its document's pages and blocks (without image bytes), and the blueprint if given."""
    inner = F.struct(*[c for c in blocks.columns if c not in ("doc_id", "page_no", "page_w", "page_h", "has_image")])
    pages = blocks.groupBy("doc_id", "page_no").agg(F.first("page_w").alias("width"), F.first("page_h").alias("height"), F.array_sort(F.collect_list(F.struct("block_idx", inner.alias("block")))).alias("b"))
    pages = pages.select("doc_id", F.struct(F.col("page_no").alias("number"), "width", "height", F.transform("b", lambda x: x["block"]).alias("blocks")).alias("p"))
    documents = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))
    documents = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "pages")
    out = jobs.join(documents, "doc_id", "left")
    if elements is not None:
        rows = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "reading_order", "role", "text"))).alias("blueprint"))
        out = out.join(rows.select(F.col("doc_id").cast("string").alias("doc_id"), "blueprint"), "doc_id", "left")
    return out.select("job_id", F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))
