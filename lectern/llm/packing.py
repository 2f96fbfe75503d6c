"""Problem 8: items in containers of fixed capacity.

Bounded-space online best-fit: items come in hashed order; at most `open_bins` containers are open, and a bitset keyed by free space finds
the fullest that still takes the item with two shifts. If none does, a container is opened; if too many are open, the fullest closes.
Items are hashed into shards of bounded size that are packed independently; what is still open at a shard's end is an item of the
next level, until one shard is left, so the waste of open containers doesn't grow with the number of shards.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.tokens import VOCABULARY, token_counts
from lectern.plans.runtime import cut, table

CAPACITY = 2048


def best_fit(sizes: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """(the bin of each item, the bins still open at the end)."""
    free_of: dict[int, list[int]] = {}
    bits = opened = count = 0
    placed = []
    for size in sizes:
        above = bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            b = free_of[free].pop()
            if not free_of[free]:
                bits &= ~(1 << free)
            opened -= 1
        else:
            free, b = capacity, count
            count += 1
        placed.append(b)
        free -= size
        if free:
            free_of.setdefault(free, []).append(b)
            bits |= 1 << free
            opened += 1
            if opened > open_bins:
                fullest = (bits & -bits).bit_length() - 1
                free_of[fullest].pop(0)
                if not free_of[fullest]:
                    bits &= ~(1 << fullest)
                opened -= 1
    return placed, sorted(b for bins in free_of.values() for b in bins)


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, open_bins: int = 64, shard_size: int = 1024) -> DataFrame:
    """(key, piece, first, n, container): what part of each item is in which container.

    An item larger than the capacity is split into full containers and a rest; any other stays whole. Items of null or no size are in
    one row with n = 0 and no container; repeated rows are items of their own; another layout of the table gives another packing as good; an empty table gives no
    rows. A shard takes about `shard_size` containers' worth, and `open_bins` are open at a time.
    """
    kind = dict(items.dtypes)[key]
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    cuts = F.when(n == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(capacity).cast("long")))
    pieces = items.select(F.col(key).alias("key"), n.alias("size"), F.posexplode(cuts).alias("piece", "first")).withColumn("n", F.least(F.col("size") - F.col("first"), F.lit(capacity)).cast("int"))
    # equal rows get different numbers, which hold because they are written
    pieces = cut(pieces.select("key", "piece", "first", "n").withColumn("no", F.monotonically_increasing_id()))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total / (capacity * shard_size)))
    loose = pieces.where((F.col("n") > 0) & (F.col("n") < capacity))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "no"])
        placed, still = best_fit(part["n"].tolist(), capacity, open_bins)
        left = set(still)
        return pd.DataFrame({"no": part["no"], "n": part["n"], "shard": part["shard"], "bin": placed, "open": [b in left for b in placed]})

    level = 0
    current = loose.select("no", "n", F.xxhash64("key", "piece").alias("h")).withColumn("shard", F.pmod(F.xxhash64("no", F.lit("shard")), F.lit(shards)))
    name = lambda: F.lit(level << 56) + F.col("shard") * (1 << 28) + F.col("bin")
    moves: list[DataFrame] = []
    while True:
        packed = cut(current.groupBy("shard").applyInPandas(run, "no long, n int, shard long, bin long, open boolean"))
        last = shards == 1
        moves.append(packed.select("no", name().alias("container"), (F.lit(False) if last else F.col("open")).alias("open")))
        if last:
            break
        bins = packed.where("open").groupBy(name().alias("no")).agg(F.sum("n").cast("int").alias("n"), F.min("shard").alias("was"))
        shards, level = max(1, shards // 32), level + 1
        current = bins.select("no", "n", F.xxhash64("no").alias("h"), F.pmod("was", F.lit(shards)).alias("shard"))
    where = moves[-1].select("no", "container")
    for earlier in reversed(moves[:-1]):
        moved = where.select(F.col("no").alias("container"), F.col("container").alias("to"))
        where = earlier.join(moved, "container", "left").select("no", F.coalesce("to", "container").alias("container"))
    full = pieces.where(F.col("n") == capacity).select("no", (-F.col("no") - 1).alias("container"))
    out = pieces.join(where.unionByName(full), "no", "left")
    return out.select(F.col("key").cast(kind).alias(key), "piece", "first", "n", "container")


def _packed(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    counted = cut(token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", vocabulary))
    return pack(counted, "doc_id", "n_tokens")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or of every piece of a text longer than a container."""
    return _packed(spark, sf_dir)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, share of space used, and the least number of containers that could hold the tokens."""
    c = _packed(spark, sf_dir).where("container is not null").groupBy("container").agg(F.sum("n").alias("n"))
    return c.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.round(F.sum("n") / (F.count("*") * CAPACITY), 6).alias("used"), F.ceil(F.sum("n") / CAPACITY).alias("at_least"), F.max("n").alias("fullest"))
