"""Recall from end to end: from conversations and their index to the messages that a model is given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoflow.operators import compression, fragments, recall, turns
from mnemoflow.session import checkpoint_dir
from mnemoflow.settings import RecallSettings
from mnemoflow.sources import connectors, tables


def recall_memories(messages: DataFrame, records: DataFrame, embedder, settings: RecallSettings, reranker=None, latest: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """What the index recalls for every conversation's latest user message: query_id (the conversation), rank, score, text and the record's columns.

    ``latest`` stands in for the latest user messages, as in a manual search. Turns that the last ``keep_floors`` messages still hold are excluded.
    Of ``kind``, the type of generation, some recall nothing (see :func:`recall.allowed_type`).
    """
    asked = recall.build_queries(turns.latest_user(messages) if latest is None else latest, tags=settings.strip_tags).where(recall.allowed_type(F.lit(kind).cast("string")))
    asked = connectors.embed_rows(asked, "embed_text", embedder, out="query_vec", batch_size=settings.batch_size).where("query_vec is not null")
    asked = asked.select(F.col("conv_id").alias("query_id"), "conv_id", F.lit(settings.model).alias("model"), "query_vec", "query_text", "terms")
    checkpoint_dir(messages.sparkSession)
    asked = asked.checkpoint()  # so that each query is embedded once
    live = turns.conversation_turns(messages)
    texts = fragments.turn_texts(live, tags=settings.strip_tags)
    excluded = compression.retained_turns(messages, live, texts, settings.keep_floors)
    rows = tables.with_vectors(records)
    rows = rows if "frag_id" in rows.columns else rows.withColumnRenamed("id", "frag_id")
    found = recall.recalled(asked, rows, settings.threshold, settings.candidate_limit, excluded).checkpoint()  # read again by the reranker and for every turn
    if settings.rerank_enabled and reranker is not None:
        found = recall.apply_rerank(found, connectors.rerank_rows(found, reranker), settings.top_k, settings.rerank_threshold)
    return recall.merge_same_turn(found, texts)


def prompted_messages(messages: DataFrame, records: DataFrame, empty: DataFrame, embedder, settings: RecallSettings, reranker=None) -> DataFrame:
    """The messages that go into the prompt: covered old turns left out, what was recalled in front of the latest user message."""
    live = turns.conversation_turns(messages)
    old = compression.old_turns(messages, live, fragments.raw_fingerprints(live), records, empty, settings.keep_floors)
    checkpoint_dir(messages.sparkSession)
    kept = compression.keep_floors(messages, live, old).checkpoint()  # read for the queries, their turns and the prompt
    prompts = recall.recall_prompts(recall_memories(kept, records, embedder, settings, reranker)).withColumnRenamed("query_id", "conv_id")
    return recall.inject_prompts(kept, turns.latest_user(kept), prompts)
