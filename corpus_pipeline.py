"""Corpus preparation: quality, exact and near copies, secrets, packing.

Each stage works on all that the one before kept. Rows are told apart by doc_id: where rows share one, a
filter keeps all of them as soon as it keeps one of them, except that equal rows become one in exact_dedup.
Null texts count as empty in every stage and come out of secret_redaction as empty ones; rows with a null doc_id
stay rows; an empty table gives an empty result; columns other than doc_id and text pass through up to packing,
whatever their names, and n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strataline.llm import exact, nearby, packing, quality, secrets
from strataline.llm.common import Tables, documents, mapped_texts, marked_by


def fresh(docs: DataFrame, name: str) -> str:
    """The name, made longer until no column of docs has it."""
    while name in docs.columns:
        name += "_"
    return name


#: Rows that score below it for quality go.
QUALITY_AT_LEAST = 0.3
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of sufficient quality, learned from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = fresh(docs, "quality_score")
    return quality.with_quality(docs, labels, score).where(F.col(score) >= QUALITY_AT_LEAST).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, letters A-Z in either case, the row with the largest doc_id. Rows whose id no copy has are not shuffled."""
    row_id, sha, own_sha, kept, some = (fresh(docs, n) for n in ("flag_id", "flag_sha", "body_sha", "flag_kept", "flag_some"))
    flags = exact.deduplicate(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    named = Tables(spark).write(flags.where("not kept or rows > 1").select(F.col("doc_id").alias(row_id), F.col("text_sha256").alias(sha), F.col("kept").alias(kept)))
    marked = marked_by(docs, "doc_id", named, row_id, some)
    body = F.translate(F.coalesce("text", F.lit("")), exact.UPPER_LETTERS, exact.LOWER_LETTERS)
    hashed = marked.where(some).withColumn(own_sha, F.sha2(body.cast("binary"), 256))
    joined = hashed.join(named, F.col("doc_id").eqNullSafe(F.col(row_id)) & (F.col(own_sha) == F.col(sha)), "left")
    alone = marked.where(~F.col(some)).select(*docs.columns).unionByName(joined.where(F.col(kept).isNull()).select(*docs.columns))
    return alone.unionByName(joined.where(F.col(kept)).dropDuplicates([row_id, sha]).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8 or more. Rows whose id no row that goes has are not shuffled."""
    row_id, some = fresh(docs, "flag_id"), fresh(docs, "flag_some")
    flags = nearby.near_duplicates(docs, size=5, percent=80).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = Tables(spark).write(flags.where("not kept").select(F.col("doc_id").alias(row_id)))
    marked = marked_by(docs, "doc_id", gone, row_id, some)
    stay = marked.where(some).join(gone, F.col("doc_id").eqNullSafe(F.col(row_id)), "left_anti")
    return marked.where(~F.col(some)).unionByName(stay).select(*docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by a mark; null texts become empty."""
    out = mapped_texts(docs, "text", StringType(), lambda texts: [secrets.redact(t) for t in texts])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return packing.pack(docs)


STAGES = [("quality_filter", quality_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_redaction", secret_redaction), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; a stage's table goes when the next one is written."""
    docs, tables = documents(spark, sf_dir), Tables(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        made = tables.write(stage(spark, docs, sf_dir))
        if k:
            tables.drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
