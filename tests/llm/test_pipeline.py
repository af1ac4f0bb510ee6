"""The pipeline's stages take effect and keep the columns of documents."""

import collections

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import bpe, mixing
from palimpsest.llm.common import saved, table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], DIR), "test"))
        if name != "tokens":
            assert out[-1].columns == docs.columns
    raw, quality, near, clean, mixed, tokens = out
    good = {r.doc_id for r in table(spark, DIR, "labels").filter("quality = 1").collect()}
    long = {r.doc_id for r in raw.filter(mixing.word_count(F.col("text")) >= 50).collect()}
    kept = {r.doc_id for r in quality.collect()}
    assert len(good & long - kept) <= 0.03 * len(good & long) and kept < {r.doc_id for r in raw.collect()}
    assert near.count() < quality.count() and near.groupBy("text").count().filter("count > 1").isEmpty()
    assert clean.count() == near.count() and clean.filter(F.col("text").rlike(r"[0-9]@mail[0-9]\.example\.com")).isEmpty()
    words = collections.Counter({r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()})
    sizes = clean.withColumn("size", mixing.word_count(F.col("text")))
    target = {r.source: r.target for r in mixing.mix(sizes, "doc_id", "size", "source").collect()}
    assert all(abs(words[s] - t) <= 1 for s, t in target.items())
    texts = collections.Counter(r.text for r in mixed.collect())
    import public_tokenizers

    codec = bpe.Codec(bpe.tokenizer_content(public_tokenizers.path("byte_bpe_50k.json")))
    assert collections.Counter(codec.decode(bytes(r.ids)) for r in tokens.collect()) == texts
    assert all(r.n_tokens == len(np.frombuffer(bytes(r.ids), "<u4")) for r in tokens.collect())
