"""Plain text of composed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for parts without text.
PICTURE = "[Activo visual preservado en exportadores ricos]"
NO_TABLE = "[Tabla sin contenido]"


def fragment() -> Column:
    """An element as lines of text."""
    role, text = F.col("role"), F.coalesce("text", F.lit(""))
    end = F.lit("\n\n")
    filled = F.trim(text) != ""
    line = F.when(filled, F.concat(text, end)).otherwise(F.lit(""))
    grid = F.when((F.col("content_kind") == "Table") & (text != ""), F.concat(text, F.lit("\n"))).when(F.col("content_kind") == "Table", "")
    return (
        F.when(role == "Title", F.concat(F.upper(text), end))
        .when(role == "Table", F.coalesce(grid, F.when(filled, line).otherwise(F.lit(NO_TABLE + "\n\n"))))
        .when(role == "Formula", F.when(filled, F.concat(F.lit("Formula: "), line)).otherwise(F.lit("")))
        .when(role.isin("Figure", "Signature", "Stamp"), F.lit(PICTURE + "\n\n"))
        .otherwise(line)
    )


def joined(part: str, by: str, of: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, of.alias(part)))), lambda s: s[part]), "")


def bodies(elements: DataFrame) -> DataFrame:
    """doc_id and body: pages in order, each under its heading."""
    pages = elements.groupBy("doc_id", "page_no").agg(joined("part", "reading_order", fragment()).alias("parts"))
    head = F.concat(F.lit("===== PAGINA "), F.col("page_no").cast("string"), F.lit(" =====\n\n"), F.col("parts"))
    return pages.groupBy("doc_id").agg(joined("page", "page_no", head).alias("body"))


def with_headers(bodies: DataFrame, jobs: DataFrame) -> DataFrame:
    """``bodies`` under the lines that name a job's document, source, profile and status."""
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.col(c)) for name, c in (("Documento", "doc_id"), ("Archivo fuente", "source_path"), ("Perfil", "profile"), ("Estado", "status"))])
    return jobs.join(bodies.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id").select("job_id", F.concat(head, F.lit("\n\n"), "body").alias("value"))


def write(bodies: DataFrame, path: str) -> None:
    """One text a document, under its id."""
    bodies.select("doc_id", F.col("body").alias("value")).write.partitionBy("doc_id").mode("overwrite").text(path, lineSep="")
