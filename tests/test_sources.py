import datetime
import json

import pytest
from pyspark.sql import functions as F

from mnemoflow.operators import compression, fragments, turns
from mnemoflow.sources import connectors as c
from mnemoflow.sources import tables
from mnemoflow.streaming import ingest


def service(answer, **kw):
    return c.EmbeddingService(lambda *request: answer(*request), "https://host", "m", **kw)


def test_base_urls(spark):
    cases = {"https://a.b/": "https://a.b/v1", "https://a.b/v1": "https://a.b/v1", "https://a.b/v1beta/openai": "https://a.b/v1beta/openai", "https://a.b/openai/": "https://a.b/openai", "": "", "https://a.b/v10": "https://a.b/v10/v1"}
    assert {k: c.normal_base_url(k) for k in cases} == cases
    frame = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r[0]: r[1] for r in frame.select("u", c.base_url_column(F.col("u"))).collect()} == cases
    assert c.embedding_url("https://a.b") == "https://a.b/v1/embeddings" and c.embedding_url(" ") == ""


def test_vectors_come_in_order_and_complete():
    def answer(method, url, headers, body):
        assert (method, url, body) == ("POST", "https://host/v1/embeddings", {"model": "m", "input": ["a", "b"]})
        return 200, {"data": [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": {"values": [1, "2", None]}}]}

    assert service(answer).embed([" a ", "b"]) == [[1.0, 2.0], [3.0, 4.0]]
    for payload in ({"data": [{"embedding": [1]}]}, {"data": [{"embedding": [1]}, {"embedding": [1, 2]}]}, {}, None):
        with pytest.raises(c.ServiceError):
            service(lambda *_: (200, payload)).embed(["a", "b"])
    with pytest.raises(ValueError):
        service(answer).embed(["a", " "])
    with pytest.raises(c.ServiceError):
        service(lambda *_: (200, {"data": [{"embedding": [1, 2]}]}), dimensions=3).embed(["a"])


def test_batches_shrink_and_wait():
    sizes, waits = [], []

    def answer(method, url, headers, body):
        sizes.append(len(body["input"]))
        if len(body["input"]) > 1:
            return 400, {"error": {"message": "batch size exceeds the limit"}}
        if len(sizes) == 3:
            return 429, {"message": "rate limit"}
        return 200, {"data": [{"embedding": [1.0]}]}

    assert c.embed_adaptive(["a", "", "b"], service(answer), 2, waits.append) == [[1.0], [1.0]]
    assert sizes == [2, 1, 1, 1] and waits == [2.0]
    with pytest.raises(c.ServiceError):
        c.embed_adaptive(["a"], service(lambda *_: (500, None)), 2, waits.append)
    assert c.embed_adaptive([" "], service(answer)) == []
    # a server's own limit doesn't make batches smaller
    asked = []
    with pytest.raises(c.ServiceError):
        c.embed_adaptive(["a", "b"], service(lambda m, u, h, body: (asked.append(len(body["input"])), (503, {"message": "capacity limit reached"}))[1]), 2, waits.append)
    assert asked == [2, 2, 2]


def test_errors(spark):
    cases = [('{"error":{"message":"e"}}', "e"), ('{"message":"m"}', "m"), ('{"msg":"n"}', "n"), ('{"code":"7"}', "7: "), ("{}", "API Error: 500"), (None, "API Error: 500"), ("text", "text")]
    for payload, message in cases:
        assert c.api_error(json.loads(payload) if payload and payload[0] == "{" else payload, 500) == message
    frame = spark.createDataFrame(cases, "p string, m string")
    assert all(r[0] == r[1] for r in frame.select(c.error_column(F.col("p"), F.lit(500)), "m").collect())
    assert c.is_batch_limit("超出上限") and not c.is_batch_limit("no") and c.is_rate_limit(c.ServiceError("x", 429)) and c.is_client_error("got 404.") and not c.is_client_error("1404")


def test_rerank_parses_and_falls_back(spark):
    def answer(method, url, headers, body):
        if body["query"] == "bad":
            return 500, {"message": "down"}
        assert body["top_n"] == 2
        return 200, {"results": [{"index": 1, "relevance_score": 0.9}, {"index": 0.5, "relevance_score": 1}, {"index": 0, "relevance_score": None}]}

    jina = c.RerankService(answer, "u", "m")
    assert jina.rerank("q", ["a", "b"]) == [(1, 0.9)] and jina.rerank(" ", ["a"]) == [] == jina.rerank("q", [])
    with pytest.raises(c.ServiceError, match="down"):
        jina.rerank("bad", ["a"])
    scope = c.RerankService(lambda *_: (200, {"output": {"results": [{"index": 0, "relevance_score": 0.5}]}}), "u", "m", flavour="dashscope")
    assert scope.rerank("q", ["a"]) == [(0, 0.5)] and scope.request("q", ["a"])["parameters"] == {"top_n": 1, "return_documents": False}
    rows = spark.createDataFrame([(1, 1, "q", "a"), (1, 2, "q", "b"), (2, 1, "bad", "a")], "query_id long, rank int, query_text string, summary string")
    assert [tuple(r) for r in c.rerank_rows(rows, jina).collect()] == [(1, 1, 0.9)]


def test_rerank_sends_whole_queries_and_paragraphs(spark, tmp_path):
    said = "harbour " * 60 + "violin"
    rows = [(1, 1, said, "a", "p"), (1, 2, said, "", "violin"), (1, 3, said, None, "p"), (1, 4, said, None, None)]
    frame = spark.createDataFrame(rows, "query_id long, rank int, query_text string, summary string, paragraph string")
    service = c.RerankService(lambda m, u, h, body: (200, {"results": [{"index": i, "relevance_score": len(d) + len(body["query"]) / 1000} for i, d in enumerate(body["documents"])]}), "u", "m")
    got = {r["index"]: r.relevance_score for r in c.rerank_rows(frame, service).collect()}
    assert got == {i: n + len(said) / 1000 for i, n in enumerate([1, 6, 1, 0])}

    # the registered query against plain Python: letters shared by the whole query and what stands for the document
    from mnemoflow.plans import queries

    schema = "frag_id long, conv_id long, turn int, sequence int, vector_chunk_id string, paragraph string, summary string, source_text string, turn_fingerprint string, raw_turn_fingerprint string, enabled boolean, writer string, embedding_model string, embedding_dims int, embedding_encoding string, embedding_scale double, embedding_q string, ts timestamp"
    text = {100: "a" * 300 + "xyz", 1: "xyz", 2: "abc"}
    summary = {100: "asked", 1: None, 2: "xq"}
    made = [(i, 1, i, 1, f"{i}", text[i], summary[i], text[i], f"t{i}", f"r{i}", True, "w", "m", 4, "int8", 1.0, "AQIDBA==", None) for i in text]
    spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/fragments.parquet")
    order = {r.query_id * 100 + r.rank: r.frag_id for r in queries._ranked(spark, str(tmp_path), 20).collect()}
    out = queries.rerank_service(spark, str(tmp_path)).collect()
    assert out and len(out) == len(order)
    for r in out:
        i = order[r.query_id * 100 + r["index"] + 1]
        wanted, document = set(text[100]), set(summary[i] or text[i])
        assert abs(r.relevance_score - len(wanted & document) / len(wanted | document)) < 1e-9


def test_model_catalog(spark):
    frame = spark.createDataFrame([('{"data":[{"id":"x-embed"},{"name":"b-rerank"},{"id":"x-embed"},{}]}',), ('{"models":[{"id":"chat"}]}',), ("nonsense",)], "payload string")
    rows = [tuple(r) for r in c.model_catalog(frame).collect()]
    assert rows == [("b-rerank", False, True), ("chat", False, False), ("x-embed", True, False)]
    catalog = c.model_catalog(frame)
    assert [r.model for r in c.models_for(catalog, "embeds").collect()] == ["x-embed"]
    assert c.models_for(catalog.where("model = 'chat'"), "embeds").count() == 1


def test_tags_are_suggested_by_a_model(spark):
    def ask(sample):
        if sample == "bad":
            raise RuntimeError("down")
        return "<status>, plan，none " + sample

    samples = spark.createDataFrame([(1, "mood"), (2, None), (3, "bad"), (4, " ")], "conv_id long, sample string")
    assert {r.conv_id: r.tags for r in c.suggest_tags(samples, ask, ["plan"]).collect()} == {1: ["status", "mood"], 2: [], 3: [], 4: []}


def test_rows_are_embedded(spark):
    rows = spark.createDataFrame([(1, "abc", "clash"), (2, None, "clash"), (3, " ", "clash")], "id long, t string, embedding string")
    out = {r.id: r.embedding for r in c.embed_rows(rows, "t", c.HashEmbedder(8)).collect()}
    assert len(out[1]) == 8 and out[2] is None and out[3] is None
    assert c.embed_rows(rows.limit(0), "t", c.HashEmbedder(8)).count() == 0


def test_stream_ingests_what_settles_once(spark, tmp_path):
    schema = "msg_id long, conv_id long, msg_index int, is_user boolean, role string, name string, mes string, is_system boolean, injected boolean, origin string, send_ts timestamp, recv_ts timestamp"
    rows = [(i, 1, i, i % 2 == 0, None, None, f"第{i}句，" + "很长的一件事情。" * 15, None, None, "web", None, None) for i in range(12)]

    def arrive(part, name):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}.parquet")

    store = tables.IndexStore(spark, f"file://{tmp_path}/index", buckets=2)

    def run():
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*.parquet")
        query = ingest.stream_ingest(spark, source, f"file://{tmp_path}/messages", store, c.HashEmbedder(8), "h", f"file://{tmp_path}/checkpoint", {"availableNow": True})
        query.awaitTermination()

    arrive(rows[:8], "a")
    run()
    assert {r.turn for r in store.read()[0].collect()} == {1, 2}
    arrive(rows[6:], "b")
    run()
    assert sorted(r.turn for r in store.read()[0].collect()) == [1, 2, 3, 4]
    late = spark.createDataFrame(rows, schema)
    assert ingest.ingest_conversations(late, store.read()[0], c.HashEmbedder(8), "h").count() == 0
    assert ingest.ingest_conversations(late, store.read()[0].limit(0), c.HashEmbedder(8), "h", recent_only=True).count() == 3


def test_what_is_written_follows_what_is_added(spark, tmp_path):
    store = tables.IndexStore(spark, f"file://{tmp_path}/store", buckets=8)
    record = lambda conv, text: (conv, 1, 1, text) + (None,) * 13
    frame = lambda *rows: spark.createDataFrame(rows, tables.INDEX_SCHEMA)
    marks = lambda *rows: spark.createDataFrame(rows, "conv_id long, marker string")
    touched = lambda *ids: spark.createDataFrame([(i,) for i in ids], "conv_id long")
    first = store.write(frame(*[record(i, "p") for i in range(40)]), marks((1, "a"), (2, "b")))
    second = store.append(frame(record(1, "q")), marks((1, "c")), touched(1))
    third = store.append(frame(), marks(), touched(2))
    assert len(list((tmp_path / f"store/d{second}/records").glob("bucket=*"))) == 1 and not list((tmp_path / f"store/d{third}/records").glob("bucket=*"))
    assert store.read()[0].count() == 41 and {tuple(r) for r in store.read()[1].collect()} == {(1, "c")}
    assert store.read(first)[0].count() == 40 and {tuple(r) for r in store.read(second)[1].collect()} == {(1, "c"), (2, "b")}
    mine = spark.range(1).select(F.lit(1).cast("long").alias("conv_id")).select(store.bucket()).first()[0]
    assert {r.paragraph for r in store.read(buckets=[mine])[0].where("conv_id = 1").collect()} == {"p", "q"} and store.read(buckets=[mine])[0].count() < 41
    store.compact(keep=0)
    assert len(store.versions()) == 1 and store.read()[0].count() == 41 and {tuple(r) for r in store.read()[1].collect()} == {(1, "c")}


def test_stream_marks_empty_turns(spark, tmp_path):
    schema = "msg_id long, conv_id long, msg_index int, is_user boolean, role string, name string, mes string, is_system boolean, injected boolean, origin string, send_ts timestamp, recv_ts timestamp"
    code = "```\n" + "print(1)\n" * 20 + "```"
    said = ["第一句，" + "很长的一件事情。" * 15, code, " ", "第四句，" + "别的一件事情呢。" * 15, "x", "y"]

    def arrive(texts, name, hour):
        rows = [(2 * i + j, 1, 2 * i + j, j == 0, None, None, t if j == 0 else "", None, None, "web", None, datetime.datetime(2026, 1, 1, hour)) for i, t in enumerate(texts) for j in (0, 1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}.parquet")

    store = tables.IndexStore(spark, f"file://{tmp_path}/index", buckets=2)
    store.write(store.read()[0], spark.createDataFrame([(1, "empty:2"), (1, "empty:4"), (2, "empty:2")], "conv_id long, marker string"))

    def run():
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*.parquet")
        ingest.stream_ingest(spark, source, f"file://{tmp_path}/messages", store, c.HashEmbedder(8), "h", f"file://{tmp_path}/checkpoint", {"availableNow": True}).awaitTermination()
        return {(r.conv_id, r.marker.split(":")[0] + (":" + r.marker.split(":")[1] if r.marker[0] == "e" else "")) for r in store.read()[1].collect()}

    arrive(said, "a", 1)
    # the turn of code has a fingerprint, the blank one none; the fourth has text; another conversation isn't touched
    assert run() == {(1, "rfp1"), (1, "empty:3"), (2, "empty:2")}
    live = turns.conversation_turns(spark.read.parquet(f"{tmp_path}/messages").drop("batch", "bucket"))
    old = compression.old_turns(live, live, fragments.turn_texts(live), *store.read(), 4)
    assert {r.turn for r in old.where("covered").collect()} == {1, 2, 3, 4}
    arrive([*said[:2], "第三句，" + "新的一件事情啊。" * 15, *said[3:]], "b", 2)
    assert run() == {(1, "rfp1"), (2, "empty:2")}
    assert {r.turn for r in store.read()[0].collect()} == {1, 3, 4}
