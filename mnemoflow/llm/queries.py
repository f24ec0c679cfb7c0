"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.llm import alike, cutoff, leaks, mixing, nearest, pieces, prose, sentences
from mnemoflow.llm.oracle import ORACLE  # noqa: F401
from mnemoflow.llm.tables import fragment_texts, message_texts, once
from mnemoflow.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _alike_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_texts(spark, sf_dir).unionByName(fragment_texts(spark, sf_dir, "paragraph"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike.alike_pairs(_alike_values(spark, sf_dir))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike.alike_classes(_alike_values(spark, sf_dir))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike.alike_report(_alike_values(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.similar_pairs(nearest.usable_vectors(read_table(spark, sf_dir, "fragments")))


def p5_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_similar(nearest.usable_vectors(read_table(spark, sf_dir, "fragments")))


def _sentence_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_texts(spark, sf_dir).unionByName(fragment_texts(spark, sf_dir, "paragraph"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = sentences.sentence_ends(_sentence_values(spark, sf_dir))
    return ends.select("field", F.col("id").alias("rec_id"), F.explode("ends").alias("char_end"))


def p1_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(_sentence_values(spark, sf_dir))


def _cut_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_texts(spark, sf_dir).unionByName(fragment_texts(spark, sf_dir, "summary"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cut_values(_cut_values(spark, sf_dir)).select("field", F.col("id").alias("rec_id"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cut_rates(_cut_values(spark, sf_dir))


def p2_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.significant_lengths(cutoff.measured(_cut_values(spark, sf_dir)))


def _limited_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(read_table(spark, sf_dir, "fragments"), "frag_id", "paragraph", "source_text", "embedding_model")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("paragraph", "source_text")])).alias("_v")
    return rows.select(F.col("frag_id").alias("id"), "embedding_model", pairs).select("_v.field", "id", "embedding_model", "_v.text")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(_limited_values(spark, sf_dir), read_table(spark, sf_dir, "models"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("piece = 1").select("field", F.col("id").alias("frag_id"))


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "evalset"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = leaks.without_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "evalset"))
    return kept.select("doc_id", "lang", "source", "n_chars")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))
    return plan.where("short").select("source")


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.text_statistics(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_statistics(spark, sf_dir).where("not is_prose").select("doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_units, p2_found, p2_rates, p2_limits, p3_found, p3_pieces, p4_found, p4_classes, p4_report, p5_found, p5_top10, p6_found, p6_leaks, p6_clean, p7_found, p7_report, p7_sample, p8_found, p8_statistics)}
