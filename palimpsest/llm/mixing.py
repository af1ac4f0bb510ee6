"""Mixing sources to target weights by capped water-filling.

Every source gets a share of all words by its weight. A source cannot give more than
``max_epochs`` times what it has; the excess is shared again among the others by weight until no
target is above its cap. Sorted by cap over weight, the capped sources come first, so the level is
found by sums over the sorted sources, without a loop. Sums are whole numbers: results do not depend
on the order of rows.

Within a source each document is taken ``whole`` times, and the rest of the target is filled from
documents in the order of a seeded hash; the one at the edge gives part of its words. Hash prefixes
split a source into bins whose sums tell which bin holds the edge, so only that bin is sorted.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Hex digits of the hash that name a bin.
BIN_DIGITS = 3


def word_count(text) -> F.Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size) with target (double), and whole and rest (long): how often
    every document is taken, and the words to take besides.

    Sources go by code point with null last; ``weights`` repeat over that order. Sources without
    words, and tables without rows, give targets of 0.
    """
    unit = lcm(*weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    by_level = Window.orderBy(F.col("source_size") * F.expr(f"{unit}L div _w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    up_to, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    cap = F.lit(max_epochs) * F.col("source_size")
    out = (
        sources.withColumn("_w", weight)
        .withColumn("_cap", cap)
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(up_to), F.lit(0)))
        .withColumn("_open", F.sum("_w").over(onward))
        .withColumn("_full", F.col("_cap") * F.col("_open") <= F.col("_w") * (F.col("_all") - F.col("_before")))
        .withColumn("_left", F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(every))
        .withColumn("_free", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(every))
    )
    share = F.col("_w") * F.col("_left")
    out = out.withColumn("target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share.cast("double") / F.col("_free").cast("double")))
    words = F.when(F.col("_full"), F.col("_cap")).otherwise(F.expr("(_w * _left) div if(_free = 0, null, _free)"))
    out = out.withColumn("_words", words).withColumn("whole", F.when(F.col("source_size") > 0, F.expr("_words div if(source_size = 0, null, source_size)")).otherwise(0))
    return out.select("source", "source_size", "target", "whole", (F.col("_words") - F.col("whole") * F.col("source_size")).alias("rest"))


def mix(df: DataFrame, doc_id: str, size: str, source: str, weights=(5, 2, 1), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """``df`` with source_size, target and taken: the words the mix takes from each row, repeats counted.

    Every source's ``taken`` adds up to its target rounded down; no row gives more than
    ``max_epochs`` times its size. Null ids hash as the empty one; repeated rows are rows of their
    own and take by turns; a null size counts 0; an empty table gives an empty one. Columns of the
    input stay, except that its own source_size, target and taken are replaced.
    """
    df = df.drop("source_size", "target", "taken")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_id).cast("string")))
    rows = df.withColumns({"_size": F.coalesce(F.col(size), F.lit(0)).cast("long"), "_src": F.col(source), "_key": key})
    rows = rows.withColumn("_bin", F.substring("_key", 1, BIN_DIGITS))
    bins = rows.groupBy(F.col("_src").alias("source"), "_bin").agg(F.sum("_size").alias("_sum"))
    goal = targets(bins.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_epochs)
    joined = bins.alias("b").join(goal.alias("g"), F.expr("b.source <=> g.source")).select("g.*", "_bin", "_sum")
    in_source = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = joined.withColumn("_to", F.sum("_sum").over(in_source)).groupBy("source", "source_size", "target", "whole", "rest").agg(
        F.min(F.when(F.col("_to") > F.col("rest"), F.struct("_bin", (F.col("_to") - F.col("_sum")).alias("before")))).alias("edge")
    )
    edge = edge.select(F.col("source").alias("_s"), "source_size", "target", F.col("whole").alias("_whole"), F.col("rest").alias("_rest"), F.col("edge._bin").alias("_edge"), F.col("edge.before").alias("_before"))
    rows = rows.join(edge, F.expr("_src <=> _s"))
    at_edge = F.coalesce(F.col("_bin") == F.col("_edge"), F.lit(False))
    off = rows.filter(~at_edge).withColumn("_more", F.when(F.col("_bin") < F.col("_edge"), F.col("_size")).otherwise(0))
    turn = Window.partitionBy("_src", "_bin").orderBy("_key", doc_id, "_size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_rest") - F.col("_before") - F.coalesce(F.sum("_size").over(turn), F.lit(0))
    on = rows.filter(at_edge).withColumn("_more", F.greatest(F.lit(0), F.least(F.col("_size"), room)))
    return off.unionByName(on).select(*df.columns, "source_size", "target", (F.col("_whole") * F.col("_size") + F.col("_more")).alias("taken"))


def op10_mixing(spark, sf_dir):
    """The mix of all documents by the number of words."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs, "doc_id", "size", "source").select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 3 * source_size AS cap,
             CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
l AS (SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
             CAST(sum(w) OVER (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open FROM w),
f AS (SELECT *, cap * open <= w * (total - before) AS capped FROM l),
g AS (SELECT *, total - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT) AS rest_all,
             CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS BIGINT) AS free FROM f),
t AS (SELECT source, source_size,
             CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w * rest_all AS DOUBLE) / CAST(free AS DOUBLE) END AS target,
             CASE WHEN capped THEN cap ELSE (w * rest_all) // free END AS words FROM g),
u AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM t)
SELECT d.doc_id, d.size, u.source_size, u.target,
       CAST(u.whole * d.size + greatest(0, least(d.size, u.words - u.whole * u.source_size
         - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
"""
