"""Which rows a join can need at all, by a bitmap that is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked_by(df: DataFrame, column: str, keys: DataFrame, key: str, name: str, most_bits: int = 1 << 28) -> DataFrame:
    """df with a boolean column: False where no row of keys has this value, True where one has, and rarely by chance.

    keys, a written table, become a bitmap of 16 bits or more for each, at most most_bits / 8 bytes (32 MB) whatever
    their number, which is broadcast; beyond 16 million keys more rows are True by chance.
    """
    bits = min(most_bits, max(1 << 20, 1 << (16 * keys.count()).bit_length()))
    own = "".join(["_", *df.columns])  # no column's name
    page = 1 << 15  # bits of a bitmap that Spark builds
    kind = keys.schema[key].dataType
    hashed = lambda c: F.pmod(F.xxhash64(c.cast(kind)), F.lit(bits))
    maps = keys.select(hashed(keys[key]).alias("h")).groupBy(F.floor(F.col("h") / page).alias(f"{own}page")).agg(F.bitmap_construct_agg(F.col("h") % page).alias(f"{own}map"))
    placed = df.select("*", hashed(df[column]).alias(f"{own}h"))
    place = (F.col(f"{own}h") % page).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(f"{own}map"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, place % 8).bitwiseAND(F.lit(1)) == 1
    joined = placed.join(F.broadcast(maps), F.floor(F.col(f"{own}h") / page) == F.col(f"{own}page"), "left")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(held, F.lit(False)).alias(name))
