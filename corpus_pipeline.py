"""A corpus pipeline: quality rules, near duplicates, pseudonyms, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's result as Parquet and
gives what it reads again to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siegelog.llm import mixing, ngram_join, packing, pseudonyms, quality
from siegelog.llm.key_filter import key_bitmap, with_flag
from siegelog.llm.queries import KEY, MIX_WEIGHTS, domain_of, tokenizer_path
from siegelog.llm.storage import stored

# The part of all tokens that the mix keeps; a document is read once at most.
MIX_SHARE = 0.9

#: The quality model and the tokenizer have no SQL: tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Each row is judged by itself, and no text is moved."""
    return quality.kept_rows(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document: that with the smallest id, then the smallest key of its text.

    Of equal rows one stays. Documents without id, and those without words, stay. Rows that a
    bitmap of the rows to drop rules out are kept where they lie; only the others are joined.
    """
    found = stored(ngram_join.grouped_rows(docs).filter("component is not null"), "groups")
    rows = found.groupBy("component", "id", "text_key").agg(F.count("*").alias("n"))
    first = F.min(F.struct("id", "text_key"))
    best = found.groupBy("component").agg(first.alias("best"))
    rows = rows.join(best, "component").withColumn("stays", F.struct("id", "text_key") == F.col("best"))
    gone = stored(rows.filter("not stays or n > 1").select("id", "text_key", F.col("stays").alias("once")), "gone")

    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), ngram_join.text_key(F.col("text").cast("binary")).alias("text_key"))
    flagged = with_flag(keyed, key_bitmap(gone, "id", "text_key"), "doubtful", "id", "text_key")
    clear = flagged.filter("not doubtful").select("row.*")
    near = flagged.filter("doubtful").join(gone, ["id", "text_key"], "left")
    alone = near.filter("once is null").select("row.*")
    once = near.filter("once").dropDuplicates(["id", "text_key"]).select("row.*")
    return clear.unionByName(alone).unionByName(once)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; ``n_chars`` follows the text."""
    out = pseudonyms.pseudonymised(docs, KEY)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("n_replaced") > 0, length).otherwise(F.col("n_chars"))).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix to target weights reads, whole."""
    rows = docs.select("doc_id", "text", "lang", "source", F.struct("*").alias("row"))
    return mixing.mixed(rows, MIX_SHARE, MIX_WEIGHTS, domain_of(F.col("source")), max_epochs=1).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, as ``op2_packing`` returns them."""
    return packing.digests(packing.pack_documents(docs, tokenizer_path()))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram join", near_duplicate_stage),
    ("pseudonyms", pseudonym_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
