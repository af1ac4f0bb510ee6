"""The corpus pipeline: quality rules, near-duplicate removal, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns the columns of
``documents``; the last returns tokens. ``run`` writes each stage as Parquet in the folder all executors
share and reads it again, so a lost executor costs no more than a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, mixing, pii, quality, setsketch
from palimpsest.llm.common import WORD, saved, table

#: Stages that learn, and a byte-level tokenizer, are beyond SQL: tests hold them against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the learned rules keep. Null and empty texts have no words and go; texts of any length are
    judged whole; repeated rows are judged alike. Rules are learned from the rows whose id has one label. An empty table stays empty."""
    learned = quality.fit(saved(quality.statistics(docs, ["doc_id"]), "quality"), table(spark, sf_dir, "labels"))
    return quality.kept(docs, learned)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies, on five-word shingles at a similarity of 0.8; texts of any length are compared whole.
    Rows of one id with different texts are documents of their own; equal rows stay once. A document without an id stays if its group has none
    with an id, once for each text. Texts without words are nobody's copies. An empty table stays empty."""
    kept = setsketch.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept"), "text_hash").distinct()
    named = docs.withColumn("_hash", F.xxhash64("text"))
    left = named.join(kept, named["doc_id"].eqNullSafe(kept["_kept"]) & (named["_hash"] == kept["text_hash"]), "left_semi")
    return left.dropDuplicates(["doc_id", "_hash"]).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their whole texts replaced by its kind. Null texts stay null; repeated rows are treated alike; an
    empty table stays empty."""
    found = pii.scanned(docs, ["doc_id"]).select("found").filter("size(found) > 0")
    return pii.redacted(docs, pii.accepted(saved(found, "candidates")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken whole, and one with its first words where it is taken in part."""
    rows = mixing.mix(docs.withColumn("_words", mixing.word_count(F.col("text"))), "doc_id", "_words", "source")
    rows = rows.filter("taken > 0").withColumn("_part", F.expr("taken % _words").cast("int"))
    times = F.concat(F.array_repeat(F.lit(0), F.expr("taken div _words").cast("int")), F.when(F.col("_part") > 0, F.array("_part")).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("_first", F.explode(times))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_first")), " ")
    rows = rows.withColumn("text", F.when(F.col("_first") > 0, part).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.when(F.col("_first") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix."""
    import public_tokenizers

    out = bpe.encode_decode(docs, "text", public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "lang", "source"])
    return out.drop("decoded")


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
    ("tokens", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
