"""The registered queries of the core."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoflow.functions import keys, lexical, text, vectors
from mnemoflow.operators import compression, fragments, index, recall, search, turns
from mnemoflow.plans import pipeline
from mnemoflow.session import checkpoint_dir, read_table
from mnemoflow.settings import RecallSettings
from mnemoflow.sources import connectors, tables
from mnemoflow.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEEP = 30
SHORT_UNITS = 80
RECALLED = ("frag_id", "conv_id", "turn", "sequence", "paragraph", "summary", "source_text", "turn_fingerprint", "raw_turn_fingerprint", "enabled", "embedding_model", "embedding_dims")


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _asked(column: str) -> Column:
    """The stated query set: every row whose id is divisible by 100."""
    return F.col(column) % 100 == 0


def _messages(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The messages, each once, with the columns that turns need, in the shared folder: what reads them several times doesn't gather them anew."""
    checkpoint_dir(spark)
    return tables.messages(spark, sf_dir).select("msg_id", "conv_id", "msg_index", "is_user", "role", "is_system", "injected", *more).checkpoint()


def _turns(spark: SparkSession, sf_dir: str, hidden: bool = False) -> DataFrame:
    return turns.conversation_turns(tables.messages(spark, sf_dir), include_hidden=hidden)


def _cleaned(spark: SparkSession, sf_dir: str, settled: bool = False) -> DataFrame:
    """The messages of all turns, hidden ones included, cleaned once."""
    live = _turns(spark, sf_dir, hidden=True)
    return fragments.cleaned_turns(turns.settled_turns(live) if settled else live)


def _texts(spark: SparkSession, sf_dir: str, hidden: bool = False) -> DataFrame:
    return fragments.raw_fingerprints(turns.conversation_turns(_messages(spark, sf_dir, "mes"), include_hidden=hidden))


# vectors


@registered
def quantize_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", vectors.quantize(F.col("embedding")).alias("q")).where("q is not null")
    return rows.select("vec_id", F.col("q.dims").alias("dims"), F.round("q.scale", 9).alias("scale"), F.array_join(F.col("q.q").cast("array<string>"), ",").alias("q"))


@registered
def quantization_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vectors.quantize(F.col("embedding")).alias("q")).where("q is not null")
    return rows.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q.q")), 6).alias("cosine"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


@registered
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    found = search.cosine_search(rows, rows.where(_asked("id")), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


@registered
def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    found = search.cosine_search(rows, rows.where(_asked("id")), least=0.3)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


@registered
def finite_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = vectors.finite_values(F.col("embedding"))
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.size(values).alias("n"), F.round(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@registered
def decoded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.index_records(spark, sf_dir).select("frag_id", vectors.decode_int8(F.col("embedding_q")).alias("v"))
    return rows.select("frag_id", F.size("v").alias("n"), F.aggregate("v", F.lit(0), lambda s, x: s + x).alias("total"))


# text


@registered
def cleaned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.messages(spark, sf_dir).select("msg_id", text.strip_code(F.col("mes")).alias("clean"))


@registered
def stripped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.messages(spark, sf_dir).where("mes is not null")
    return rows.select("msg_id", text.strip_tag_blocks(F.col("mes"), "status, think").alias("kept")).where(F.col("kept") != "")


@registered
def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\r?\n", -1)).alias("n", "line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(text.is_code_line(F.col("line"))).alias("code"))


@registered
def trimmed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", text.trim_text(F.col("text"), SHORT_UNITS).alias("short"), text.utf16_length(F.col("text")).alias("units"))


@registered
def escaped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(text.xml_escape(F.col("text"))).alias("xml"), F.md5(text.html_escape(F.col("text"))).alias("html"))


@registered
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(keys.content_fingerprint(F.col("text"))).alias("fingerprint"))


@registered
def distinct_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.index_records(spark, sf_dir).where("conv_id is not null")
    rows = rows.select("conv_id", "frag_id", keys.recall_fingerprint(*[F.col(c) for c in ("paragraph", "summary", "source_text", "turn", "sequence")]).alias("f"))
    return rows.groupBy("conv_id", "f").agg(F.min("frag_id").alias("frag_id"), F.count("*").alias("copies")).select("conv_id", "frag_id", "copies")


# turns


@registered
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "msg_index", "msg_id", "turn")


@registered
def conversation_turns_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, hidden=True).select("conv_id", "msg_index", "msg_id", "turn")


@registered
def settled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.settled_turns(_turns(spark, sf_dir, hidden=True)).select("conv_id", "msg_index", "turn")


@registered
def auto_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.settled_turns(_turns(spark, sf_dir, hidden=True), recent_only=True).select("conv_id", "msg_index", "turn")


@registered
def latest_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.latest_user(tables.messages(spark, sf_dir)).select("conv_id", "msg_index", "msg_id", "mes")


@registered
def tag_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.tag_samples(tables.messages(spark, sf_dir))


# chunks and fingerprints


def _parts(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fragments.split_paragraph(F.col("text"), most)).alias("n", "part"))
    return rows.select("doc_id", (F.col("n") + 1).alias("n"), F.length("part").alias("size"), F.md5("part").alias("part"))


@registered
def split_long_400(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, 400)


@registered
def split_long_1800(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, 1800)


@registered
def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fragments.paragraphs(F.col("text"))).alias("n", "p"))
    return rows.select("doc_id", (F.col("n") + 1).alias("n"), F.md5("p").alias("paragraph"))


@registered
def merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(fragments.merge_paragraphs(fragments.paragraphs(F.col("text")), 400)).alias("b"))
    return rows.select("doc_id", F.col("b.start").alias("first"), F.col("b.end").alias("last"), F.md5("b.text").alias("block"))


@registered
def message_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.messages(spark, sf_dir).select("msg_id", F.explode(fragments.blocks(text.strip_code(F.col("mes")))).alias("b"))
    return rows.select("msg_id", F.col("b.start").alias("first"), F.col("b.end").alias("last"), F.col("b.text").alias("block"))


@registered
def raw_turn_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("conv_id", "turn", "raw_turn_fingerprint")


@registered
def turn_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, hidden=True).select("conv_id", "turn", keys.turn_marker(F.col("raw_turn_fingerprint"), F.col("turn")).alias("marker"))


@registered
def turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments.turn_texts(_turns(spark, sf_dir)).select("conv_id", "turn", "full_text", "turn_fingerprint", "has_content")


@registered
def turn_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments.turn_fragments(_cleaned(spark, sf_dir))


# lexical and recall


@registered
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.latest_user(tables.messages(spark, sf_dir)).select("conv_id", lexical.query_terms(F.col("mes")).alias("t"))
    return rows.select("conv_id", F.size("t").alias("n"), F.array_join("t", " ").alias("terms"))


@registered
def lexical_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = turns.latest_user(tables.messages(spark, sf_dir)).select("conv_id", lexical.query_terms(F.col("mes")).alias("terms"))
    rows = tables.index_records(spark, sf_dir).select("conv_id", "frag_id", "source_text", "summary").join(asked, "conv_id")
    rows = rows.select("frag_id", lexical.lexical_match(F.col("source_text"), F.col("summary"), F.col("terms")).alias("m"))
    return rows.select("frag_id", F.col("m.hits").alias("hits"), F.round("m.boost", 6).alias("boost"))


def _ranked(spark: SparkSession, sf_dir: str, most: int, excluded: DataFrame | None = None) -> DataFrame:
    """Every hundredth record asks for the records of its conversation."""
    checkpoint_dir(spark)
    records = tables.with_vectors(tables.index_records(spark, sf_dir)).select(*RECALLED, "vec").checkpoint()  # read several times
    asked = records.where(_asked("frag_id") & (F.length("vec") > 0) & F.col("embedding_model").isNotNull())
    asked = asked.select(F.col("frag_id").alias("query_id"), "conv_id", F.col("embedding_model").alias("model"), F.col("vec").alias("query_q"), F.coalesce("paragraph", "source_text").alias("query_text"), lexical.query_terms(F.coalesce("paragraph", "source_text")).alias("terms"))
    return recall.recalled(asked, records, 0.3, most, excluded)


@registered
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir, 10)
    return rows.select("query_id", "rank", "frag_id", F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score"), F.col("lexical.hits").alias("hits"))


@registered
def retained_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir, "mes")
    live = turns.conversation_turns(messages)
    retained = compression.retained_turns(messages, live, fragments.raw_fingerprints(live), KEEP)
    hidden = fragments.raw_fingerprints(turns.conversation_turns(messages, include_hidden=True))
    return recall.without_turns(index.migrate_fingerprints(tables.index_records(spark, sf_dir), hidden), retained).select("frag_id", "conv_id")


def _relevance(rows: DataFrame) -> DataFrame:
    """What a reranker might say of the ranked rows: some number that follows from the record, and nothing for every second query."""
    said = (F.col("frag_id") * 7919 % 1000) / F.lit(1000.0)
    return rows.where(F.col("query_id") % 200 != 0).select("query_id", (F.col("rank") - 1).cast("int").alias("index"), said.alias("relevance_score"))


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir, 50)
    return recall.apply_rerank(rows, _relevance(rows), top_k=10)


@registered
def rerank_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", "rank", "frag_id", F.round("score", 6).alias("score"), "used_fallback")


@registered
def merge_same_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recall.merge_same_turn(_reranked(spark, sf_dir))
    rows = rows.withColumn("time_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*recall.time_order())))
    return rows.select("query_id", "turn", "rank", "time_rank", F.round("score", 6).alias("score"), "merged", F.md5("text").alias("text"))


@registered
def recall_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.recall_prompts(recall.merge_same_turn(_reranked(spark, sf_dir))).select("query_id", F.md5("prompt").alias("prompt"), F.length("prompt").alias("size"))


@registered
def recall_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.recall_statistics(recall.merge_same_turn(_reranked(spark, sf_dir)))


@registered
def injected_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = tables.messages(spark, sf_dir)
    ranked = _ranked(spark, sf_dir, 10)
    prompts = recall.recall_prompts(recall.merge_same_turn(ranked))
    # of several queries of a conversation the first stands for it
    first = ranked.groupBy("conv_id").agg(F.min("query_id").alias("query_id"))
    out = recall.inject_prompts(messages, turns.latest_user(messages), prompts.join(first, "query_id"))
    return out.select("conv_id", "msg_index", F.col("msg_id").cast("string").alias("msg_id"), F.coalesce("injected", F.lit(False)).alias("injected"), F.md5("mes").alias("mes"))


@registered
def rerank_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reranking connector over an injected service that counts shared letters."""

    def transport(method: str, url: str, headers: dict, body: dict | None) -> tuple[int, object]:
        wanted = set(body["query"])
        rows = [{"index": i, "relevance_score": len(wanted & set(d)) / max(1, len(wanted | set(d)))} for i, d in enumerate(body["documents"])]
        return 200, {"results": rows}

    return connectors.rerank_rows(_ranked(spark, sf_dir, 20), connectors.RerankService(transport, "local", "letters"))


# compression


def _old_turns(spark: SparkSession, sf_dir: str, messages: DataFrame) -> DataFrame:
    live = turns.conversation_turns(messages)
    hidden = fragments.raw_fingerprints(turns.conversation_turns(messages, include_hidden=True))
    records = index.migrate_fingerprints(tables.index_records(spark, sf_dir).select("conv_id", "turn", "raw_turn_fingerprint"), hidden)
    empty = records.select("conv_id", F.lit("").alias("marker")).limit(0)
    return compression.old_turns(messages, live, fragments.raw_fingerprints(live), records, empty, KEEP)


@registered
def keep_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir, "mes")
    return compression.keep_floors(messages, turns.conversation_turns(messages), _old_turns(spark, sf_dir, messages)).select("conv_id", "msg_index", "msg_id")


@registered
def compression_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_statistics(_old_turns(spark, sf_dir, _messages(spark, sf_dir, "mes")))


@registered
def retained_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir, "mes")
    live = turns.conversation_turns(messages)
    return compression.retained_turns(messages, live, fragments.raw_fingerprints(live), KEEP)


# index


@registered
def new_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fragments.turn_fragments(_cleaned(spark, sf_dir, settled=True))
    return index.new_fragments(found, tables.index_records(spark, sf_dir)).select("conv_id", "turn", "sequence", "vector_chunk_id", "role", "source_text")


@registered
def empty_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _cleaned(spark, sf_dir, settled=True)
    texts = fragments.turn_texts(live, full=False)
    return index.empty_turns(texts, fragments.turn_fragments(live, texts=texts))


def _document_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(messages, turns) of the documents as a hundred conversations of user messages: every document is a turn, and many hold nothing but code."""
    rows = read_table(spark, sf_dir, "documents").where("doc_id is not null")
    rows = rows.select(F.col("doc_id").alias("msg_id"), (F.col("doc_id") % 100).alias("conv_id"), F.floor(F.col("doc_id") / 100).cast("int").alias("msg_index"), F.lit(True).alias("is_user"), F.lit("user").alias("role"), F.col("text").alias("mes"), F.lit(False).alias("is_system"), F.lit(False).alias("injected"))
    return rows, fragments.cleaned_turns(turns.conversation_turns(rows))


def _document_markers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, turn texts, markers of the turns without cleaned text)."""
    rows, live = _document_turns(spark, sf_dir)
    texts = fragments.turn_texts(live, full=False)
    return rows, texts, index.empty_turns(texts, fragments.turn_fragments(live, texts=texts))


@registered
def document_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_markers(spark, sf_dir)[2]


@registered
def refilled_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old markers of every third turn, brought up to date: those of turns that have text now are gone."""
    _, texts, _ = _document_markers(spark, sf_dir)
    old = texts.where("turn % 3 = 0").select("conv_id", F.concat(F.lit("empty:"), F.col("turn").cast("string")).alias("marker"))
    return index.without_refilled(index.migrate_markers(old, texts), texts)


@registered
def covered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old turns that an index without records covers by the markers of empty turns alone."""
    rows, texts, markers = _document_markers(spark, sf_dir)
    none = spark.createDataFrame([], "conv_id long, raw_turn_fingerprint string")
    return compression.old_turns(rows, turns.conversation_turns(rows), texts, none, markers, KEEP // 10)


@registered
def migrate_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.migrate_fingerprints(tables.index_records(spark, sf_dir), _texts(spark, sf_dir, hidden=True)).select("frag_id", "conv_id", "raw_turn_fingerprint")


@registered
def trim_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.trim_future(tables.index_records(spark, sf_dir), turns.turn_counts(_turns(spark, sf_dir, hidden=True))).select("frag_id", "conv_id", "turn")


@registered
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_statistics(tables.index_records(spark, sf_dir).where("conv_id is not null"))


@registered
def model_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.model_mismatch(tables.index_records(spark, sf_dir).where("conv_id is not null"), "bramble-embed-m", 128)


@registered
def index_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = tables.index_records(spark, sf_dir).where("embedding_model is not null").select(F.to_json(F.struct(F.array(F.struct(F.col("embedding_model").alias("id"))).alias("data"))).alias("payload"))
    return connectors.model_catalog(payloads)


@registered
def ingest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = ingest.ingest_conversations(tables.messages(spark, sf_dir), tables.index_records(spark, sf_dir), connectors.HashEmbedder(), "hashed-64")
    return records.select("id", "conv_id", "turn", "sequence", "embedding_dims", F.round("embedding_scale", 9).alias("embedding_scale"), F.md5("embedding_q").alias("embedding_q"))


@registered
def recall_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations ingested from nothing, then asked by their latest user messages."""
    messages, embedder = _messages(spark, sf_dir, "name", "mes"), connectors.HashEmbedder()
    nothing = spark.createDataFrame([], tables.INDEX_SCHEMA)
    checkpoint_dir(spark)
    records = ingest.ingest_conversations(messages, nothing, embedder, "hashed-64").checkpoint()  # each text is embedded once
    rows = pipeline.recall_memories(messages, records, embedder, RecallSettings(model="hashed-64", keep_floors=30))
    return rows.select("query_id", "rank", "turn", F.round("score", 6).alias("score"), F.col("lexical.hits").alias("hits"), "merged", F.md5("text").alias("text"))


# streams


@registered
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as a stream, ingested micro-batch by micro-batch into an index of their own."""
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = read_table(spark, sf_dir, "messages").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf_dir}/messages.parque[t]")
    store = tables.IndexStore(spark, f"{root}/index")
    query = ingest.stream_ingest(spark, source, f"{root}/messages", store, connectors.HashEmbedder(), "hashed-64", f"{root}/checkpoint", {"availableNow": True})
    query.awaitTermination()
    return store.read()[0].select("conv_id", "turn", "sequence", "vector_chunk_id", "embedding_dims")


@registered
def arrival_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.arrival_windows(tables.messages(spark, sf_dir).select("recv_ts", "send_ts", "origin"))
    return rows.withColumn("window_start", F.unix_timestamp("window_start"))
