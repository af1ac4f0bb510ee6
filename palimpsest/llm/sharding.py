"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in buckets (a hash of the row). The driver holds only the buckets' sizes and draws, bucket
by bucket, how many of its rows go to each block of each shard: a multivariate hypergeometric draw
from the room that is left, so all ways to deal the rows to the slots are equally likely. Each bucket
orders its rows by a seeded hash, deals consecutive runs to the blocks, and each block orders what it
got by a second hash. Everything is a function of the rows, the seed and the sizes, so a task that runs
again after a loss gives the same rows. No task holds more than a bucket or a block; both are
bounded by ``bucket_rows`` until their number reaches ``MOST``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets, and blocks over all shards, at most: the matrix stays under 2,048 x 2,048 numbers.
MOST = 2048


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn without replacement are good. Beyond the range of numpy's sampler, by
    inversion over 12 standard deviations around the mode, from ratios of neighbouring probabilities."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if good + bad else 0
    lo, hi = max(0, n - bad), min(n, good)
    total = good + bad
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (total + 2)))
    spread = int(12 * (n * (good / total) * (bad / total)) ** 0.5) + 10
    k = np.arange(max(lo, mode - spread), min(hi, mode + spread) + 1, dtype=np.float64)
    if len(k) == 1:
        return int(k[0])
    step = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[1:]) - np.log(bad - n + k[1:])
    logs = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(len(k) - 1, int(np.searchsorted(mass, rng.random() * mass[-1])))])


def matrix(counts: list[int], rooms: list[int], seed: int) -> np.ndarray:
    """Rows dealt from each bucket to each destination; rows sum to ``counts``, columns to ``rooms``."""
    rng, left = np.random.default_rng(seed), [int(x) for x in rooms]
    out = np.zeros((len(counts), len(rooms)), dtype=np.int64)
    for i, n in enumerate(counts):
        n, rest = int(n), sum(left)
        for j, room in enumerate(left):
            rest -= room
            got = hypergeometric(rng, room, rest, n)
            out[i, j], left[j], n = got, room - got, n - got
            if not n:
                break
    return out


def shards(df: DataFrame, key: list[str], n_shards: int = 24, seed: int = 7, bucket_rows: int = 20_000) -> DataFrame:
    """``df`` with shard (0 to ``n_shards`` - 1) and slot (gapless from 0 in each shard): shard sizes differ
    by one at most, and every order of rows is as likely as any other over seeds.

    ``key`` names the columns that tell rows apart; rows equal in them are interchangeable and
    spread like any others only if they lie in different buckets, so a key that many rows share should be
    joined by a column that differs. Nulls are values of their own. An empty table stays empty.
    Columns named shard or slot are replaced; others stay.
    """
    df = df.drop("shard", "slot")
    spark = df.sparkSession
    hashed = [F.hash(F.lit(seed), *[F.col(k) for k in key]).cast("string")] + [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key]
    first, second = F.xxhash64(F.lit(seed), *hashed), F.xxhash64(F.lit(~seed), *hashed)
    n = df.count()
    m = max(1, min(MOST, -(-n // bucket_rows)))
    rows = df.withColumns({"_bucket": F.pmod(first, F.lit(m)).cast("int"), "_first": F.xxhash64(first, F.lit(1)), "_second": second})
    counts = {r[0]: r[1] for r in rows.groupBy("_bucket").count().collect()}
    n = sum(counts.values())
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    k = max(1, min(MOST // n_shards, -(-n // (n_shards * bucket_rows))))
    blocks = [[size // k + (b < size % k) for b in range(k)] for size in sizes]
    dealt = matrix([counts.get(i, 0) for i in range(m)], [x for shard in blocks for x in shard], seed).reshape(m, n_shards, k)
    plan = spark.createDataFrame(
        [(i, np.cumsum(dealt[i].sum(axis=1)).tolist(), [[0, *np.cumsum(dealt[i, s]).tolist()] for s in range(n_shards)]) for i in range(m)],
        "_bucket int, _ends array<long>, _inner array<array<long>>",
    )
    starts = F.array(*[F.array(*[F.lit(int(x)) for x in np.cumsum([0, *shard[:-1]])]) for shard in blocks])
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_first", *key)).cast("long") - 1
    out = rows.withColumn("_rank", rank).join(F.broadcast(plan), "_bucket")
    out = out.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int"))
    within = F.col("_rank") - F.when(F.col("shard") > 0, F.get("_ends", F.col("shard") - 1)).otherwise(0)
    out = out.withColumn("_within", within)
    out = out.withColumn("_block", (F.size(F.filter(F.get("_inner", F.col("shard")), lambda e: e <= F.col("_within"))) - 1).cast("int"))
    again = Window.partitionBy("shard", "_block").orderBy("_second", *key)
    slot = F.row_number().over(again).cast("long") - 1 + F.get(F.get(starts, F.col("shard")), F.col("_block"))
    return out.withColumn("slot", slot).select(*df.columns, "shard", "slot")


def op2_sharding(spark, sf_dir):
    """All documents in 24 shards whose row counts differ by one at most."""
    from .common import table

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = shards(docs, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
