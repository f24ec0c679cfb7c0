"""Maintenance of the memory index: what is new, migration, trimming, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoflow.functions import keys, vectors
from mnemoflow.functions.text import utf16_length

STORED = ("conv_id", "turn", "sequence", "paragraph", "summary", "source_text", "vector_chunk_id", "turn_fingerprint", "raw_turn_fingerprint", "content_fingerprint")
LARGE_INDEX = 5000


def new_fragments(fragments: DataFrame, index: DataFrame) -> DataFrame:
    """The fragments that an index doesn't hold yet.

    Held are those whose chunk id the index has from the same turn text (by raw fingerprint, or by the cleaned one where the stored
    record has none), and those whose content fingerprint it has or an earlier one of this run. Of several records of a chunk id the last
    in (ts, frag_id) counts. ``index``: conv_id, vector_chunk_id, raw_turn_fingerprint, turn_fingerprint, paragraph, ts, frag_id.
    """
    newest = F.max_by(F.struct(F.coalesce(F.nullif("raw_turn_fingerprint", F.lit("")), F.lit("")).alias("raw"), "turn_fingerprint"), F.struct("ts", "frag_id")).alias("_s")
    stored = index.where("vector_chunk_id is not null").groupBy("conv_id", "vector_chunk_id").agg(newest)
    stored = stored.select(F.col("conv_id").alias("_c"), F.col("vector_chunk_id").alias("_v"), F.col("_s.raw").alias("_raw"), F.col("_s.turn_fingerprint").alias("_turn"))
    same_slot = (F.col("conv_id") == F.col("_c")) & (F.col("vector_chunk_id") == F.col("_v"))
    same_turn = ((F.col("_raw") != "") & (F.col("_raw") == F.col("raw_turn_fingerprint"))) | ((F.col("_raw") == "") & (F.col("_turn") == F.col("turn_fingerprint")))
    fresh = fragments.join(stored, same_slot & same_turn, "left_anti")
    known = index.select("conv_id", keys.content_fingerprint(F.col("paragraph")).alias("content_fingerprint")).where("content_fingerprint <> ''").distinct()
    keyed = fresh.where("content_fingerprint <> ''")
    first = F.min(F.struct("turn", "sequence")).alias("_first")
    # the first of equal contents, by an aggregate that combines before it shuffles
    kept = keyed.join(known, ["conv_id", "content_fingerprint"], "left_anti").groupBy("conv_id", "content_fingerprint").agg(first)
    kept = kept.select("conv_id", F.col("_first.turn").alias("turn"), F.col("_first.sequence").alias("sequence"))
    return keyed.join(kept, ["conv_id", "turn", "sequence"], "left_semi").unionByName(fresh.where("content_fingerprint = ''"))


def empty_turns(turn_texts: DataFrame, fragments: DataFrame) -> DataFrame:
    """conv_id, turn, marker of the turns without cleaned text or fragments."""
    with_fragments = fragments.select("conv_id", "turn").distinct()
    empty = turn_texts.join(with_fragments.withColumn("_f", F.lit(True)), ["conv_id", "turn"], "left").where("_f is null or not has_content")
    return empty.select("conv_id", "turn", keys.turn_marker(F.col("raw_turn_fingerprint"), F.col("turn")).alias("marker"))


def without_refilled(markers: DataFrame, turn_texts: DataFrame) -> DataFrame:
    """The markers of empty turns without those of turns that have text now."""
    full = turn_texts.where("has_content").select("conv_id", F.explode(F.array(keys.turn_marker(F.col("raw_turn_fingerprint"), F.col("turn")), F.concat(F.lit("empty:"), F.col("turn").cast("string")))).alias("marker"))
    return markers.join(full.distinct(), ["conv_id", "marker"], "left_anti")


def migrate_fingerprints(index: DataFrame, turn_texts: DataFrame) -> DataFrame:
    """The index with missing raw fingerprints filled in from the live turns of the same number."""
    live = turn_texts.where("raw_turn_fingerprint <> ''").select("conv_id", "turn", F.col("raw_turn_fingerprint").alias("_raw"))
    joined = index.join(live, ["conv_id", "turn"], "left")
    filled = F.coalesce(F.nullif("raw_turn_fingerprint", F.lit("")), F.col("_raw"), F.lit(""))
    return joined.withColumn("raw_turn_fingerprint", filled).drop("_raw").select(*index.columns)


def migrate_markers(markers: DataFrame, turn_texts: DataFrame) -> DataFrame:
    """Distinct markers, those of the form empty:<turn> replaced by the turn's raw fingerprint where it has one."""
    live = turn_texts.where("raw_turn_fingerprint <> ''").select("conv_id", F.concat(F.lit("empty:"), F.col("turn").cast("string")).alias("marker"), "raw_turn_fingerprint")
    joined = markers.where("marker <> ''").join(live, ["conv_id", "marker"], "left")
    return joined.select("conv_id", F.coalesce("raw_turn_fingerprint", "marker").alias("marker")).distinct()


def to_records(fragments: DataFrame, model: str, vector: str = "embedding") -> DataFrame:
    """Index records of embedded fragments; vectors that are empty or all zero give none."""
    q = vectors.quantize(F.col(vector)).alias("_q")
    rows = fragments.select(*STORED, q).where("_q is not null")
    return rows.select(
        keys.record_id(F.col("conv_id"), F.col("vector_chunk_id"), F.col("raw_turn_fingerprint")).alias("id"), *STORED,
        F.lit(True).alias("enabled"), F.lit(model).alias("embedding_model"), F.col("_q.dims").alias("embedding_dims"), F.lit(vectors.ENCODING).alias("embedding_encoding"),
        F.col("_q.scale").alias("embedding_scale"), vectors.to_base64(F.col("_q.q")).alias("embedding_q"),
    )


def trim_future(index: DataFrame, turn_counts: DataFrame) -> DataFrame:
    """The index without records of turns beyond the conversation's last; of conversations without turns all go. Null turns stay."""
    limits = turn_counts.select("conv_id", F.col("n_turns").alias("_n"))
    return index.join(limits, "conv_id", "left").where(F.col("turn").isNull() | (F.col("turn") <= F.coalesce("_n", F.lit(0)))).drop("_n")


def index_statistics(index: DataFrame) -> DataFrame:
    """Per conversation: records, estimated bytes, distinct turns, and whether it is too large to be filled automatically."""
    size = F.coalesce(utf16_length(F.col("embedding_q")), F.lit(0)) + 300
    for column in ("paragraph", "summary", "source_text", "turn_fingerprint"):
        size = size + 3 * F.coalesce(utf16_length(F.col(column)), F.lit(0))
    return index.groupBy("conv_id").agg(
        F.count("*").alias("records"), F.sum(size.cast("long")).alias("bytes"), F.countDistinct(F.when(F.col("turn") > 0, F.col("turn"))).alias("covered_turns"), (F.count("*") > LARGE_INDEX).alias("large")
    )


def large_indexes(index: DataFrame) -> DataFrame:
    """conv_id of the conversations that have too many records to be filled automatically."""
    return index.groupBy("conv_id").agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE_INDEX).select("conv_id")


def model_mismatch(index: DataFrame, model: str, dims: int) -> DataFrame:
    """Per conversation: records of other models, and records of the model with other dimensions than the query's."""
    same = F.col("embedding_model").eqNullSafe(model)
    wrong = same & F.col("embedding_dims").isNotNull() & (F.col("embedding_dims") != 0) & (F.col("embedding_dims") != dims)
    return index.groupBy("conv_id").agg(F.count_if(~same).alias("other_model"), F.count_if(wrong).alias("other_dims"))
