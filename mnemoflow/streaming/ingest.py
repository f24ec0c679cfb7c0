"""Incremental ingestion: messages arrive as a stream, settled turns become index records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemoflow.functions import keys
from mnemoflow.operators.fragments import cleaned_turns, turn_fragments, turn_texts
from mnemoflow.operators.index import empty_turns, large_indexes, migrate_markers, new_fragments, to_records, without_refilled
from mnemoflow.operators.turns import conversation_turns, settled_turns
from mnemoflow.sources.connectors import embed_rows
from mnemoflow.sources.tables import IndexStore, latest_rows


def ingest_conversations(messages: DataFrame, index: DataFrame, service, model: str, full: bool = False, recent_only: bool = False) -> DataFrame:
    """Index records of the settled turns' fragments that ``index`` doesn't hold yet; running it again adds nothing.

    ``recent_only`` is the automatic mode: only the last settled turns, and none of conversations whose index is too large to be filled by itself.
    """
    live = conversation_turns(messages, include_hidden=True)
    return _ingested(cleaned_turns(settled_turns(live, full, recent_only)), index, service, model, recent_only)


def _ingested(settled: DataFrame, index: DataFrame, service, model: str, automatic: bool) -> DataFrame:
    stored = index.withColumn("ts", F.lit(None).cast("timestamp")).withColumn("frag_id", F.col("id")) if "frag_id" not in index.columns else index
    if automatic:
        settled = settled.join(large_indexes(index), "conv_id", "left_anti")
    fresh = new_fragments(turn_fragments(settled), stored)
    return to_records(embed_rows(fresh, "source_text", service), model)


def ingest_markers(messages: DataFrame, markers: DataFrame, full: bool = False, recent_only: bool = False) -> DataFrame:
    """conv_id, marker: the markers of empty turns after ``messages`` are ingested.

    Old markers of the form empty:<turn> become the turn's fingerprint where it has one; of the settled turns those without cleaned text or
    fragments are added, and those that have text now are taken out. Of several turns of one marker the last decides. Markers of other conversations stay.
    """
    live = cleaned_turns(conversation_turns(messages, include_hidden=True))
    return _marked(live, settled_turns(live, full, recent_only), markers)


def _marked(live: DataFrame, settled: DataFrame, markers: DataFrame) -> DataFrame:
    texts = turn_texts(live, full=False).checkpoint()
    of_settled = texts.join(settled.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_semi")
    last = of_settled.select("conv_id", "turn", keys.turn_marker(F.col("raw_turn_fingerprint"), F.col("turn")).alias("marker")).groupBy("conv_id", "marker").agg(F.max("turn").alias("turn"))
    added = empty_turns(of_settled, turn_fragments(settled, texts=of_settled)).join(last, ["conv_id", "turn", "marker"], "left_semi")
    return without_refilled(migrate_markers(markers, texts), of_settled).unionByName(added.select("conv_id", "marker")).distinct()


def stream_ingest(spark: SparkSession, source: DataFrame, messages_path: str, store: IndexStore, service, model: str, checkpoint: str, trigger: dict | None = None, compact_every: int = 64) -> StreamingQuery:
    """Start a query that keeps the messages that arrive and ingests the conversations they touch.

    Each micro-batch adds its messages, by the store's buckets, reads the touched conversations whole (late and edited messages included) from the touched
    buckets, and adds their new records and markers of empty turns to the index; every ``compact_every`` batches the index becomes one version again. The lag of two
    turns is a watermark in turns, not in time: what hasn't settled is taken up by a later batch.
    A batch that is tried again adds nothing twice: messages are kept once per id, records once per content.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.withColumn("bucket", store.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{messages_path}/batch={number}")
        arrived = spark.read.schema(rows.schema).parquet(f"{messages_path}/batch={number}") if rows.isEmpty() else spark.read.parquet(f"{messages_path}/batch={number}")
        touched = arrived.where("conv_id is not null").select("conv_id").distinct()
        buckets = [r.bucket for r in touched.select(store.bucket().alias("bucket")).distinct().collect()]  # at most as many as the store has
        if not buckets:
            return
        stored = spark.read.parquet(messages_path).where(F.col("bucket").isin(buckets)).drop("batch", "bucket")
        everything = latest_rows(stored.join(touched, "conv_id", "left_semi"), "msg_id", "recv_ts")
        records, empty = (f.join(touched, "conv_id", "left_semi") for f in store.read(buckets=buckets))
        live = cleaned_turns(conversation_turns(everything, include_hidden=True))
        settled = settled_turns(live)
        store.append(_ingested(settled, records, service, model, False), _marked(live, settled, empty), touched)
        if number % compact_every == compact_every - 1:
            store.compact()

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def arrival_windows(messages: DataFrame, length: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Messages and late ones (received a day and more after they were sent) per origin and window of arrival; for batches and streams."""
    rows = messages.withWatermark("recv_ts", late) if messages.isStreaming else messages
    delayed = F.col("recv_ts") > F.col("send_ts") + F.expr("interval 1 day")
    return rows.groupBy(F.window("recv_ts", length), "origin").agg(F.count("*").alias("n"), F.count_if(delayed).alias("n_late")).select(F.col("window.start").alias("window_start"), "origin", "n", "n_late")
