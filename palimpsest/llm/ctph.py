"""Context-triggered piecewise hashing.

A rolling hash over the last ``WINDOW`` bytes ends a chunk wherever its low bits are all ones, so an edit
moves only the boundaries near it. Each chunk gives one character of the signature. Boundaries for the
block size 2b are some of those for b; a fingerprint is "b:signature at b:signature at 2b", with b
the largest block size that still gives ``LEAST`` characters. Two fingerprints are compared by edit distance
between signatures of the same block size, so texts whose lengths differ up to about four times meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import groups_of, table

WINDOW, LEAST, SMALLEST = 7, 32, 4
#: Longest signature; of more chunks than this, each 2, 4, 8 ... that follow each other become one.
LONGEST = 128
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
#: An odd multiplier for chunk hashes, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def rolling(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A mixed hash of the ``WINDOW`` bytes that end at each place; bytes before a text's start count 0."""
    padded = np.zeros(len(data) + (WINDOW - 1), dtype=np.uint32)
    padded[WINDOW - 1 :] = data
    padded[WINDOW - 1 :] += 1
    h = np.zeros(len(data), dtype=np.uint32)
    for k in range(WINDOW):
        h *= np.uint32(0x01000193)
        h ^= padded[k : k + len(data)]
    for s in starts:  # the few places whose window reaches into the text before
        for p in range(s, min(s + WINDOW - 1, len(data))):
            x = 0
            for c in [*[0] * (WINDOW - 1 - (p - s)), *(int(b) + 1 for b in data[s : p + 1])]:
                x = x * 0x01000193 & 0xFFFFFFFF ^ c
            h[p] = x
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


TABLES: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, from the 0th on; kept for texts to come."""
    if len(TABLES.get("up", ())) <= n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(max(n + 1, 1 << 20), base, dtype=np.uint64)
            steps[0] = 1
            TABLES[name] = np.cumprod(steps)
    return TABLES["up"], TABLES["down"]


def fingerprints(texts: list[str]) -> list[str]:
    """A fingerprint for each text; the empty text gives "4::"."""
    out = []
    for a, b in groups_of(texts):
        raw = [t.encode() for t in texts[a:b]]
        ends = np.cumsum([len(r) for r in raw])
        starts = np.concatenate([[0], ends[:-1]])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        if not len(data):
            out += [f"{SMALLEST}::" for _ in raw]
            continue
        h = rolling(data, starts[starts < len(data)])
        low = np.flatnonzero((h & np.uint32(SMALLEST - 1)) == SMALLEST - 1)
        level = h[low]
        powers, inverse = power_tables(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        cuts = np.searchsorted(low, np.concatenate([starts, [len(data)]]))
        for s, e, c, d in zip(starts.tolist(), ends.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            out.append(one(s, e, low[c:d], level[c:d], sums, inverse))
    return out


def one(s: int, e: int, low: np.ndarray, level: np.ndarray, sums: np.ndarray, inverse: np.ndarray) -> str:
    b = SMALLEST
    while b * LONGEST // 2 < e - s:
        b *= 2
    cuts = lambda size: low[(level & np.uint32(size - 1)) == size - 1] + 1
    while b > SMALLEST and len(cuts(b)) < LEAST:
        b //= 2
    ends = cuts(b)
    while len(ends) >= LONGEST and len(more := cuts(2 * b)) >= LEAST:
        b, ends = 2 * b, more
    joined = 1  # where a passage repeats, the next block size may have no boundary left
    while len(ends) // joined >= LONGEST:
        joined *= 2
    parts = []
    for ends in (ends[joined - 1 :: joined], cuts(2 * b) if joined == 1 else ends[2 * joined - 1 :: 2 * joined]):
        ends = np.append(ends, e) if e > s and (not len(ends) or ends[-1] < e) else ends
        begin = np.concatenate([[s], ends[:-1]]).astype(np.int64)
        # each chunk's sum, as if the chunk began at the first power: the same wherever it lies
        total = (sums[ends] - sums[begin]) * inverse[begin]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        parts.append(LETTERS[(total >> np.uint64(58)).astype(np.int64)].tobytes().decode() if len(ends) else "")
    return f"{b * joined}:{parts[0]}:{parts[1]}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints: 1 less the edit distance over the longer signature, the best over block
    sizes that both have; 0 if they have none in common or one is empty. Equal fingerprints give 1."""
    pa, pb = F.split(a, ":"), F.split(b, ":")
    size = lambda p: p[0].cast("long")

    def alike(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1.0 - F.levenshtein(x, y).cast("double") / longest.cast("double"))

    best = (
        F.when(size(pa) == size(pb), F.greatest(alike(pa[1], pb[1]), alike(pa[2], pb[2])))
        .when(size(pa) == 2 * size(pb), alike(pa[1], pb[2]))
        .when(2 * size(pa) == size(pb), alike(pa[2], pb[1]))
        .otherwise(0.0)
    )
    return F.when(a == b, 1.0).otherwise(best)


@F.pandas_udf(StringType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """The fingerprint of each text; null counts as empty."""
    return pd.Series(fingerprints([t or "" for t in texts]))


def beside_next(df: DataFrame, order: str, buckets: int) -> tuple[DataFrame, Window]:
    """``df`` in buckets of ranges of ``order``, with ``_copy``: the first rows of each bucket stand again
    at the end of the bucket before (the first of all at the end of the last), so a window over
    a bucket sees every row's successor. The driver holds only the buckets' bounds.

    Rows with the same ``order`` value lie in one bucket. Nulls come first.
    """
    spark = df.sparkSession
    ids = df.select(F.col(order).cast("long").alias("v"))
    cuts = sorted(set(ids.approxQuantile("v", [k / buckets for k in range(1, buckets)], 0.1 / buckets))) if buckets > 1 else []
    edges = spark.sparkContext.broadcast([int(x) for x in cuts])  # at most one number a bucket

    if cuts:
        bounds = F.array(*[F.lit(x).cast("long") for x in edges.value])
        bucket = F.when(F.col(order).isNull(), 0).otherwise(F.size(F.filter(bounds, lambda x: x <= F.col(order).cast("long"))))
    else:
        bucket = F.lit(0)
    rows = df.withColumn("_bucket", bucket)
    firsts = rows.groupBy("_bucket").agg(F.min(F.struct(F.col(order).isNotNull().alias("known"), F.col(order).cast("long").alias("v"))).alias("first")).collect()
    firsts = sorted((r["_bucket"], r["first"]["v"]) for r in firsts)
    before = [(v, firsts[k - 1][0]) for k, (_, v) in enumerate(firsts)]
    copies = F.array(*[F.struct(F.lit(b).cast("int").alias("b"), F.lit(v).cast("long").alias("v")) for v, b in before]) if before else None
    own = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("copy")))
    if copies is not None:
        extra = F.transform(F.filter(copies, lambda c: c["v"].eqNullSafe(F.col(order).cast("long"))), lambda c: F.struct(c["b"].alias("b"), F.lit(1).alias("copy")))
        own = F.concat(own, extra)
    rows = rows.withColumn("_at", F.explode(own)).withColumn("_bucket", F.col("_at.b")).withColumn("_copy", F.col("_at.copy")).drop("_at")
    return rows, Window.partitionBy("_bucket")


def op4_ctph(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and what they are like.

    Null texts count as empty; documents of one id follow each other in the order of their texts; a sole
    document is its own successor; an empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = max(1, min(1024, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows, part = beside_next(docs, "doc_id", buckets)
    by = part.orderBy("_copy", F.col("doc_id").asc_nulls_first(), "text")
    n = F.char_length("text").cast("long")
    quarter = F.expr("n_chars div 4").cast("int")
    rows = rows.withColumn("n_chars", n).withColumn("_next", F.lead("text").over(by)).withColumn("_place", F.row_number().over(by))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), quarter))
    rows = rows.select("_bucket", "_copy", "_place", "doc_id", "text", "n_chars", edited.alias("edited"))
    made = (F.sha2("edited", 256).alias("edited_sha256"), fingerprint("text").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"))
    rows = rows.select("_bucket", "_copy", "_place", "doc_id", "n_chars", *made)  # what is shuffled again has no texts
    rows = rows.withColumn("_after", F.lead("fingerprint").over(part.orderBy("_place"))).filter(F.col("_copy") == 0)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_after")).alias("near_next"))
