"""The project's tables in the shapes that the text operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.session import read_table


def once(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key: of rows that differ, the least in the order of the columns. Null keys are dropped."""
    first = F.min(F.struct(*columns)).alias("_first")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, *[F.col(f"_first.{c}").alias(c) for c in columns])


def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, id, source, text of every message."""
    rows = once(read_table(spark, sf_dir, "messages"), "msg_id", "mes", "origin")
    return rows.select(F.lit("mes").alias("field"), F.col("msg_id").alias("id"), F.col("origin").alias("source"), F.col("mes").alias("text"))


def fragment_texts(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """field, id, source, text of the named text columns of every fragment."""
    rows = once(read_table(spark, sf_dir, "fragments"), "frag_id", *fields, "writer")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("_v")
    return rows.select("frag_id", "writer", pairs).select(F.col("_v.field").alias("field"), F.col("frag_id").alias("id"), F.col("writer").alias("source"), F.col("_v.text").alias("text"))
