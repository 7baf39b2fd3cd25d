"""The longest known prefix of names made of parts: dotted module names, folders of paths.

Distinct names walk a trie of the known ones, a level for each part; no row is made for a prefix of a name. Where the
known names are small, which is measured, their levels are broadcast and a name passes all of them in one stage.
Otherwise the trie's nodes are a table and a name is joined level by level, leaving as soon as the trie has no node for
it, so that names of other packages go in the first round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut

#: Known names of no more bytes in all, and of no more levels, are broadcast.
BROADCAST_BYTES, BROADCAST_LEVELS = 8 << 20, 16


def normal(name: Column, mark: str) -> Column:
    """The name without empty parts."""
    return F.array_join(F.filter(F.split(name, f"[{mark}]"), lambda p: p != ""), mark)


def depth_of(name: Column, mark: str) -> Column:
    return F.when(name == "", 0).otherwise(F.size(F.split(name, f"[{mark}]")))


def longest_known(names: DataFrame, known: DataFrame, mark: str = ".", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """name and the longest of known(name) that is a prefix of it in whole parts, as `prefix`; names without one are left out.

    Empty parts count for nothing, null names are left out, repeated rows count once, and an empty known name is a
    prefix of every name. A known name comes back as it is without empty parts.
    """
    asked = names.where("name is not null").select("name", normal(F.col("name"), mark).alias("walked")).distinct()
    held = known.where("name is not null").select(normal(F.col("name"), mark).alias("known")).distinct()
    held = cut(held.withColumn("depth", depth_of(F.col("known"), mark)))
    size = held.agg(F.coalesce(F.sum(F.octet_length("known") + 32), F.lit(0)).alias("bytes"), F.coalesce(F.max("depth"), F.lit(0)).alias("levels")).first()
    if size["bytes"] <= most_bytes and size["levels"] <= BROADCAST_LEVELS:
        return through_broadcasts(asked, held, size["levels"], mark)
    return level_by_level(asked, held, size["levels"], mark)


def rooted(held: DataFrame) -> Column:
    """What a name has before its first part: the empty known name, or null."""
    return F.lit(None).cast("string") if held.where("depth = 0").isEmpty() else F.lit("")


def through_broadcasts(asked: DataFrame, held: DataFrame, levels: int, mark: str) -> DataFrame:
    deep, root = depth_of(F.col("walked"), mark), rooted(held)
    for d in range(1, levels + 1):
        level = F.broadcast(held.where(F.col("depth") == d).select(F.col("known").alias(f"known_{d}")))
        asked = asked.join(level, F.when(deep >= d, F.substring_index("walked", mark, d)) == F.col(f"known_{d}"), "left")
    return asked.select("name", F.coalesce(*(F.col(f"known_{d}") for d in range(levels, 0, -1)), root).alias("prefix")).where("prefix is not null")


def level_by_level(asked: DataFrame, held: DataFrame, levels: int, mark: str) -> DataFrame:
    parts = F.split("known", f"[{mark}]")
    starts = held.where("depth > 0").select("known", "depth", F.explode(F.sequence(F.lit(1), "depth")).alias("d"))
    starts = starts.select(F.array_join(F.slice(parts, F.lit(1), F.col("d")), mark).alias("node"), "d", (F.col("d") == F.col("depth")).alias("ends"))
    trie = cut(starts.groupBy("d", "node").agg(F.max("ends").alias("ends"), F.max(~F.col("ends")).alias("goes_on")))
    now = cut(asked.withColumn("prefix", rooted(held)))
    done = []
    for d in range(1, levels + 1):
        deep = depth_of(F.col("walked"), mark)
        stay = now.withColumn("start", F.when(deep >= d, F.substring_index("walked", mark, d)))
        level = trie.where(F.col("d") == d).select(F.col("node").alias("start"), "ends", "goes_on")
        met = stay.join(level, "start", "left").withColumn("prefix", F.when(F.col("ends"), F.col("start")).otherwise(F.col("prefix")))
        met = cut(met.select("name", "walked", "prefix", (F.coalesce("goes_on", F.lit(False)) & (deep > d)).alias("walks")))
        done.append(met.where("not walks").select("name", "prefix"))
        now = met.where("walks").drop("walks")
    found = now.select("name", "prefix")
    for part in done:
        found = found.unionByName(part)
    return found.where("prefix is not null")
