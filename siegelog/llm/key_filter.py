"""A bitmap of keys with a fixed size, by which rows that are in no set are told where they lie.

The bitmap has 2^``BITS`` bits: at most ``PARTS`` rows of 4 KB, 16 MB in all, whatever the
number of keys. That is a proven bound, for which it may be broadcast. It never misses
a key; rows that it lets through in addition are for an exact join to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 27
BUCKET = 32768
PARTS = (1 << BITS) // BUCKET


def _place(*keys: Column | str) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << BITS) - 1)) + 1


def key_bitmap(keys: DataFrame, *columns: str) -> DataFrame:
    """``part, bits`` of the keys' places."""
    place = _place(*columns)
    return keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )


def with_flag(rows: DataFrame, bitmap: DataFrame, name: str, *columns: str) -> DataFrame:
    """``rows`` with a column that is false only for rows whose key is not in the bitmap."""
    place = _place(*columns)
    parts = bitmap.select(F.col("part").alias("_part"), F.col("bits").alias("_bits"))
    joined = rows.join(F.broadcast(parts), F.bitmap_bucket_number(place) == F.col("_part"), "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8 + 1).cast("int"))) != 0
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_part", "_bits")
