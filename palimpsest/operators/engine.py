"""Engines that fill blocks with text, and the stub that stands in where no model is at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_table
from ..schema import PROFILE_THRESHOLDS

Engine = Callable[[DataFrame, str], DataFrame]

# The stub's texts and confidences.
STUB_TEXTS = {
    "Title": "Documento de Prueba - Stub OCR",
    "Text": "Este es un texto de ejemplo generado por el StubOcrEngine. El contenido es simulado para testing de la interfaz TUI.",
}
STUB_CONFIDENCE = {"Fast": 0.80, "Balanced": 0.90, "Accurate": 0.95}


def stub_engine(blocks: DataFrame, profile: str = "Balanced") -> DataFrame:
    """``blocks`` with the stub's content and confidence."""
    text = F.concat(F.lit("["), F.col("block_type"), F.lit("] Contenido simulado"))
    for kind, words in STUB_TEXTS.items():
        text = F.when(F.col("block_type") == kind, words).otherwise(text)
    return blocks.withColumns({"content": text, "confidence": F.lit(STUB_CONFIDENCE[profile])})


def thresholds(profile: str) -> dict[str, float]:
    """Layout confidence, overlap, binarization and smallest region of a profile, and whether it straightens and reads tables."""
    layout, overlap, level, smallest = PROFILE_THRESHOLDS[profile]
    return {"layout": layout, "overlap": overlap, "binarize": level, "smallest": smallest, "orientation": profile != "Fast", "tables": profile != "Fast"}


def block_text(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, block_idx, content and confidence from recognised ``lines`` (…, place, text, confidence): filled lines
    joined, their confidences' mean, 0 without any."""
    filled = F.col("text") != ""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(filled, F.struct("place", "text")))), lambda s: s["text"]), "\n")
    return lines.groupBy("doc_id", "page_no", "block_idx").agg(joined.alias("content"), F.coalesce(F.avg(F.when(filled, F.col("confidence"))), F.lit(0.0)).alias("confidence"))


def table_text(blocks: DataFrame) -> DataFrame:
    """Table blocks with a structure get its Markdown as content; their confidence stays the layout's."""
    return blocks.withColumn("content", F.when((F.col("block_type") == "Table") & F.col("table").isNotNull(), markdown_table(F.col("table"))).otherwise(F.col("content")))


def onnx_engine(model_path: str, prepare: Callable, decode: Callable) -> Engine:
    """An engine around an ONNX model: ``prepare`` makes a tensor of a page's PNG, ``decode`` makes rows of blocks of the output. The
    session is made once a task; the model's path must be readable by executors."""

    def run(pages: DataFrame, profile: str) -> DataFrame:
        settings = thresholds(profile)

        def work(batches):
            import onnxruntime

            session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
            name = session.get_inputs()[0].name
            for batch in batches:
                for row in batch.itertuples():
                    yield decode(row, session.run(None, {name: prepare(row.png)}), settings)

        from ..schema import BLOCKS

        return pages.mapInPandas(work, BLOCKS)

    return run
