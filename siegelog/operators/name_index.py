"""Substring search in names of entities by posting lists of their grams.

The grams of a name are all its substrings of one to three characters, in lower
case. A gram's posting list is a bitmap of the names that hold it (see
``siegelog.operators.bitmaps``). A search intersects the lists of the text's grams and
verifies the names that are left; a text of one to three characters is a gram itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siegelog.operators.bitmaps import number_entities

# Characters of the longest grams.
GRAM = 3
# Numbers in a bitmap.
BUCKET = 32768


def _grams(name: Column) -> Column:
    """Distinct substrings of 1 to ``GRAM`` characters."""
    size = F.char_length(name)

    def of(n: int) -> Column:
        starts = F.when(size >= n, F.sequence(F.lit(1), size - F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(name, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*[of(n) for n in range(1, GRAM + 1)])))


def grams_of(text: str) -> list[str]:
    """The grams a search looks up."""
    low = text.lower()
    if len(low) <= GRAM:
        return [low] if low else []
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


def postings(numbers: DataFrame, key: str) -> DataFrame:
    """``gram, bucket, bits`` of all names."""
    each = numbers.select("number", F.explode(_grams(F.lower(key))).alias("gram"))
    return each.groupBy("gram", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )


def _has_bit(bits: Column, position: Column) -> Column:
    """Whether a position is set in a bitmap."""
    byte = F.substr(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return value.bitwiseAND(F.pow(F.lit(2.0), position % 8).cast("int")) != 0


@dataclass(frozen=True)
class NameIndex:
    """Stored names with their numbers, and the posting lists sorted by gram."""

    path: str
    key: str

    def build(self, entities: DataFrame) -> NameIndex:
        names = number_entities(entities, self.key)
        spark = entities.sparkSession
        names.withColumn("bucket", F.bitmap_bucket_number("number")).sortWithinPartitions("number").write.mode(
            "overwrite"
        ).parquet(f"{self.path}/names")
        lists = postings(spark.read.parquet(f"{self.path}/names"), self.key)
        lists.repartitionByRange("gram", "bucket").sortWithinPartitions("gram", "bucket").write.mode("overwrite").parquet(
            f"{self.path}/postings"
        )
        return self

    def candidates(self, spark: SparkSession, text: str) -> DataFrame:
        """Names that hold every gram of the text; all names for an empty text."""
        names = spark.read.parquet(f"{self.path}/names")
        grams = grams_of(text)
        if not grams:
            return names.select(self.key, "number")
        lists = spark.read.parquet(f"{self.path}/postings").filter(F.col("gram").isin(grams))
        met = (
            lists.groupBy("bucket")
            .agg(F.count("*").alias("grams"), F.bitmap_and_agg("bits").alias("bits"))
            .filter((F.col("grams") == len(grams)) & (F.bitmap_count("bits") > 0))
        )
        joined = names.join(met, "bucket")
        return joined.filter(_has_bit(F.col("bits"), F.bitmap_bit_position("number"))).select(self.key, "number")

    def search(self, spark: SparkSession, text: str) -> DataFrame:
        """Names that contain the text, in any case; the same as ``ranking.search`` on the names."""
        found = self.candidates(spark, text)
        return found.filter(F.lower(self.key).contains(text.lower())).select(self.key)
