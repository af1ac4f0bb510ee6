"""From a blueprint to files: each job in its own format, or all in one that is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.compose import compose, document_modes
from ..schema import FORMATS
from ..sinks import files, json, latex, pdf, txt


class ExportError(ValueError):
    """What cannot be exported, and why."""


def blueprint(blocks: DataFrame) -> DataFrame:
    """The composed elements that every format but JSON is made of; composed anew at each export."""
    return compose(blocks)


def contents(kind: str, jobs: DataFrame, blocks: DataFrame, elements: DataFrame, images: DataFrame | None = None, positions: bool = False) -> DataFrame:
    """job_id and content (binary) of ``jobs`` (job_id, doc_id, source_path, profile, status, ...) in one of ``FORMATS``."""
    if kind not in FORMATS:
        raise ExportError(f"no such format: {kind}")
    ids = jobs.select("job_id", "doc_id")
    by_doc = lambda rows, c: rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(c).cast("binary").alias("content")).join(ids, "doc_id").select("job_id", "content")
    if kind == "Json":
        return json.snapshots(jobs, blocks).select("job_id", F.col("value").cast("binary").alias("content"))
    if kind == "Txt":
        return txt.with_headers(txt.bodies(elements), jobs).select("job_id", F.col("value").cast("binary").alias("content"))
    if kind == "Pdf":
        return by_doc(pdf.files(elements, images), "pdf")
    modes = document_modes(elements.select("doc_id", "page_no", "mode").distinct())
    return by_doc(latex.exported(elements, modes, positions), "source")


def export(jobs: DataFrame, blocks: DataFrame, folder: str, images: DataFrame | None = None, kind: str | None = None, positions: bool = False) -> DataFrame:
    """Writes every job to ``folder`` as ``<doc_id>.<extension>``, by its own output_format or, for all, ``kind``; LaTeX's pictures go to
    ``<doc_id>_assets/`` beside it. Returns path and bytes of the files, which are written when that is read."""
    if kind is not None:
        if kind not in FORMATS:
            raise ExportError(f"no such format: {kind}")
        jobs = jobs.withColumn("output_format", F.lit(kind))
    elements, written = blueprint(blocks), None
    own = blocks.withColumn("_doc", F.col("doc_id").cast("string"))
    for name, extension in FORMATS.items():
        if kind not in (None, name):
            continue
        some = jobs.filter(F.col("output_format") == name)
        docs = some.select(F.col("doc_id").alias("_doc")).distinct()
        of = lambda rows: rows.withColumn("_doc", F.col("doc_id").cast("string")).join(docs, "_doc", "left_semi").drop("_doc")  # noqa: E731, B023
        rows = contents(name, some, own.join(docs, "_doc", "left_semi").drop("_doc"), of(elements), images, positions).join(some.select("job_id", "doc_id"), "job_id")
        rows = rows.select(files.under(folder, F.col("doc_id"), F.lit(f".{extension}")).alias("path"), "content")
        if name == "Latex" and images is not None:
            seen = of(elements)
            modes = document_modes(seen.select("doc_id", "page_no", "mode").distinct())
            pictures = latex.pictures(seen, modes, of(images), positions)
            rows = rows.unionByName(pictures.select(files.under(folder, latex.folder(), F.lit("/"), F.col("name")).alias("path"), F.col("png").alias("content")))
        written = rows if written is None else written.unionByName(rows)
    return files.write_files(written)


def page_size(elements: DataFrame, page_no: int) -> DataFrame:
    """doc_id, page_w and page_h of a page by its number; a document without it is an error of the run that reads it."""
    pages = elements.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("page_no") == page_no, F.struct("page_w", "page_h")))).alias("p"))
    missing = F.raise_error(F.lit(f"No existe la pagina {page_no} en el documento"))
    there = F.when(F.size("p") > 0, F.get("p", F.lit(0))).otherwise(missing.cast("struct<page_w:bigint,page_h:bigint>"))
    return pages.select("doc_id", there.alias("p")).select("doc_id", "p.*")
