import random

import pytest
from pyspark.sql import functions as F

from mnemoflow.operators import compression, fragments, index, recall, search, turns
from mnemoflow.settings import RecallSettings
from mnemoflow.sources import tables
from tests import plain

MESSAGE = "conv_id long, msg_index int, is_user boolean, role string, name string, mes string, is_system boolean, injected boolean, msg_id long, turn string"


def chat(spark, rows, conv=1):
    return spark.createDataFrame([(conv, i, *r, conv * 1000 + i, "clash") for i, r in enumerate(rows)], MESSAGE)


def test_turns_equal_plain_python(spark):
    rng = random.Random(3)
    rows = [(rng.choice([True, False, None]), rng.choice(["user", "assistant", None]), None, "t", rng.choice([True, False, None]), rng.choice([True, None, None])) for _ in range(400)]
    frame = chat(spark, rows)
    for hidden in (False, True):
        got = {r.msg_index: r.turn for r in turns.conversation_turns(frame, hidden).collect()}
        dicts = [dict(is_user=r[0], role=r[1], is_system=r[4], injected=r[5], i=i) for i, r in enumerate(rows)]
        want = {m["i"]: n for n, t in enumerate(plain.turns(dicts, hidden), 1) for m in t}
        assert got == want
    assert turns.conversation_turns(frame.limit(0)).count() == 0


def test_turns_count_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", 7)
    frame = chat(spark, [(i % 3 == 0, None, None, "t", None, None) for i in range(100)])
    assert sorted((r.msg_index, r.turn) for r in turns.conversation_turns(frame).collect()) == [(i, i // 3 + 1) for i in range(100)]


def test_split_and_merge():
    assert len(fragments.split_long("a" * 1800, 1800)) == 1
    assert [len(p) for p in fragments.split_long("a" * 1801, 1800)] == [1800, 1]
    assert fragments.split_long("a" * 1200 + "。" + "b" * 900, 1800)[0][-1] == "。"
    assert fragments.split_long(None, 10) == [] and fragments.split_long("😀" * 5, 4) == ["😀😀", "😀😀", "😀"]
    assert fragments.merge_small(["a", "", "b", "c" * 397], 400) == [("a\n\nb", 1, 3), ("c" * 397, 4, 4)]
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab。. \n") for _ in range(rng.randrange(80)))
        assert fragments.split_long(text, 13) == plain.parts(text, 13)


def test_fragment_labels(spark):
    rows = [(True, None, "U", "用户提出了一个足够长的问题。" * 12, None, None), (False, "assistant", "A", "角色回答第一段。" * 30, None, None), (False, "assistant", "A", "角色回答第二段。" * 30, None, None)]
    made = fragments.turn_fragments(turns.conversation_turns(chat(spark, rows)), user_name="U").orderBy("sequence").collect()
    assert len(made) == 2
    assert all("用户：" in r.paragraph and "角色卡：" in r.paragraph and r.source_text.startswith("第 1 轮\n") and r.vector_chunk_id.startswith("1:") and len(r.turn_fingerprint) >= 80 for r in made)
    assert [r.sequence for r in made] == [1, 2] and made[0].role == "mixed" and made[0].speaker == "U + A"


def records(spark, small):
    return tables.index_records(spark, small)


def test_ingesting_again_adds_nothing(spark):
    rows = [(i % 2 == 0, None, None, f"第{i}句话，" + "讲一件很长的事情。" * 20, None, None) for i in range(12)]
    found = fragments.turn_fragments(turns.conversation_turns(chat(spark, rows))).cache()
    empty = found.limit(0).withColumn("ts", F.lit(None).cast("timestamp")).withColumn("frag_id", F.lit(0))
    first = index.new_fragments(found, empty)
    assert first.count() == found.select("content_fingerprint").distinct().count()
    stored = found.withColumn("ts", F.lit(None).cast("timestamp")).withColumn("frag_id", F.lit(0))
    assert index.new_fragments(found, stored).count() == 0
    edited = stored.withColumn("raw_turn_fingerprint", F.lit("rfp1:other")).withColumn("paragraph", F.lit("short"))
    assert index.new_fragments(found, edited).count() == found.count()


def ranked_rows(spark, rows):
    schema = "query_id long, frag_id long, turn int, sequence int, paragraph string, summary string, source_text string, raw_score double, score double, rank int, conv_id long, raw_turn_fingerprint string, turn_fingerprint string"
    return spark.createDataFrame(rows, schema)


def test_ties_prefer_newer_turns_and_content_comes_once(spark):
    rows = [(1, 10, 1, 1, "a" * 100, "", "", 0.97, 0.97, 0, 1, "", ""), (1, 11, 2, 1, "b" * 100, "", "", 0.97, 0.97, 0, 1, "", ""), (1, 12, 3, 1, "b" * 100, "", "", 0.9, 0.9, 0, 1, "", "")]
    out = recall.ranked(ranked_rows(spark, rows).drop("rank"), 10).orderBy("rank").collect()
    assert [r.frag_id for r in out] == [11, 10]


def test_large_conversations_are_compared_in_blocks(spark, monkeypatch):
    from mnemoflow.functions.vectors import cosine_bytes

    rng = random.Random(5)
    n = 240
    vec = lambda: bytes(rng.randrange(256) for _ in range(rng.choice((8, 8, 8, 12))))
    rows = [(i, 1 if i % 3 else 2, i // 4, i % 4, f"text {i % 150} of " + "x" * 90, None, f"source {i % 7}", "", None, None if i % 11 else False, ["m", "m", "n", None][i % 4], rng.choice((8, 12, 0, None, 5)), vec() if i % 13 else b"") for i in range(n)]
    schema = "frag_id long, conv_id long, turn int, sequence int, paragraph string, summary string, source_text string, turn_fingerprint string, raw_turn_fingerprint string, enabled boolean, embedding_model string, embedding_dims int, vec binary"
    records = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame([(1000 + i, 1 + i % 3, ["m", "n", None][i % 3], vec(), ["source 3", "text"]) for i in range(30)], "query_id long, conv_id long, model string, query_q binary, terms array<string>")
    for strict in (True, False):
        got = []
        for block in (4096, 16):
            monkeypatch.setattr(recall, "BLOCK", block)
            got.append(sorted((r.query_id, r.rank, r.frag_id, round(r.score, 9)) for r in recall.recalled(queries, records, 0.1, 4, strict_model=strict).collect()))
        # against every pair of a conversation, scored and ranked
        pairs = queries.join(records.where("enabled is distinct from false and length(vec) > 0"), "conv_id")
        same = F.col("model").eqNullSafe(F.col("embedding_model")) if strict else F.col("model").isNull() | F.col("embedding_model").isNull() | (F.col("model") == F.col("embedding_model"))
        pairs = pairs.where(same & (F.coalesce("embedding_dims", F.lit(0)).isin(0) | (F.col("embedding_dims") == F.length("query_q")))).withColumn("raw_score", cosine_bytes(F.col("query_q"), F.col("vec"))).where("raw_score >= 0.1")
        from mnemoflow.functions.lexical import lexical_match

        pairs = pairs.withColumn("score", F.col("raw_score") + lexical_match(F.col("source_text"), F.col("summary"), F.col("terms"))["boost"])
        want = sorted((r.query_id, r.rank, r.frag_id, round(r.score, 9)) for r in recall.ranked(pairs, 4).collect())
        assert got[0] == got[1] == want and len(want) > 40
    assert recall.recalled(queries.limit(0), records, 0.1, 4).count() == 0 == recall.recalled(queries, records.limit(0), 0.1, 4).count()


def test_rerank_threshold_and_fallback(spark):
    rows = ranked_rows(spark, [(q, 10 + i, i + 1, 1, "p", "", "", 0.9 - i / 10, 0.9 - i / 10, i + 1, 1, "", "") for q in (1, 2, 3) for i in range(2)])
    said = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.2), (3, 0, 0.1)], "query_id long, index int, relevance_score double")
    out = {(r.query_id, r.rank): (r.frag_id, r.score, r.used_fallback) for r in recall.apply_rerank(rows, said, 1).collect()}
    assert out == {(1, 1): (11, 0.9, False), (2, 1): (10, 0.9, True)}


def test_same_turn_becomes_one(spark):
    rows = ranked_rows(
        spark,
        [(1, 1, 5, 2, "用户：问\n角色卡：第二", "", "", 0.8, 0.8, 1, 1, "", ""), (1, 2, 7, 1, "角色卡：别的", "", "", 0.7, 0.7, 2, 1, "", ""), (1, 3, 5, 1, "用户：问\n角色卡：第一", "", "", 0.6, 0.6, 3, 1, "", ""), (1, 4, 0, 1, "x", "", "", 0.5, 0.5, 4, 1, "", ""), (1, 5, 0, 2, "y", "", "", 0.5, 0.5, 5, 1, "", "")],
    )
    out = recall.merge_same_turn(rows).orderBy("rank").collect()
    assert [(r.turn, r.merged, r.text) for r in out] == [(5, True, "用户：问\n\n角色卡：第一\n\n第二"), (7, False, "角色卡：别的"), (0, False, "x"), (0, False, "y")]
    live = spark.createDataFrame([(1, 5, "rfp", "", "现在的全文")], "conv_id long, turn int, raw_turn_fingerprint string, turn_fingerprint string, full_text string")
    again = recall.merge_same_turn(rows.withColumn("raw_turn_fingerprint", F.lit("rfp")), live).where("merged").first()
    assert again.text == "现在的全文" and again.score == 0.8
    prompt = recall.recall_prompts(recall.merge_same_turn(rows)).first().prompt
    assert prompt.index("第一") < prompt.index("别的") and 'turn="5" similarity="80.0%"' in prompt
    by_time = recall.recall_prompts(recall.merge_same_turn(rows), order="time").first().prompt
    assert by_time.index('turn="7"') < by_time.index("    x\n")
    assert recall.recall_statistics(recall.merge_same_turn(rows)).first().turns == "5,7,0,0"


def test_old_covered_turns_go(spark):
    long = "讲一件很长的事情，" * 20
    rows = [(False, None, None, "开场", None, None)] + [(i % 2 == 0, None, None, f"{i}" + (long if i < 6 else "短"), None, None) for i in range(20)]
    messages = chat(spark, rows)
    live = turns.conversation_turns(messages)
    texts = fragments.turn_texts(live)
    held = texts.where("turn in (1, 2)").select("conv_id", "raw_turn_fingerprint")
    none = spark.createDataFrame([], "conv_id long, marker string")
    old = compression.old_turns(messages, live, texts, held, none, 4)
    assert {r.turn: r.covered for r in old.collect()} == {t: t <= 2 for t in range(1, 9)}
    kept = {r.msg_index for r in compression.keep_floors(messages, live, old).collect()}
    assert kept == set(range(21)) - {1, 2, 3, 4}
    assert compression.old_turns(messages, live, texts, held, none, 0).count() == 0 == compression.old_turns(messages, live, texts, held, none, 40).count()
    assert compression.compression_statistics(old).first().removed == 4
    assert {r.turn for r in compression.retained_turns(messages, live, texts, 4).collect()} == {9, 10}
    # a short chat keeps all its turns, so all are excluded from recall
    assert compression.retained_turns(messages, live, texts, 50).count() == 10
    # turns too short for a fingerprint are never covered by the index, only by markers of empty turns
    marker = spark.createDataFrame([(1, "empty:8")], "conv_id long, marker string")
    assert compression.old_turns(messages, live, texts, held, marker, 4).where("turn = 8").first().covered


def test_injection_stands_before_the_latest_user(spark):
    messages = chat(spark, [(True, None, None, "a", None, None), (False, None, None, "b", None, None), (True, None, None, "c", None, None), (False, None, None, "d", None, None)])
    out = recall.inject_prompts(messages, turns.latest_user(messages), spark.createDataFrame([(1, "P")], "conv_id long, prompt string"))
    assert [r.mes for r in out.orderBy("msg_index").collect()] == ["a", "b", "P", "c", "d"]
    assert turns.latest_user(out).first().mes == "c"


def test_exact_search(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(200)] + [(500, None), (501, []), (502, [0.0, 0.0, 0.0])], "id long, vector array<double>")
    a = {(r.query_id, r.rank): r.id for r in search.cosine_search(rows, rows.where("id % 100 = 0"), k=5, block=30).collect()}
    b = {(r.query_id, r.rank): r.id for r in search.cosine_search(rows, rows.where("id % 100 = 0"), k=5).collect()}
    assert a == b and a[0, 1] == 21 and (500, 1) not in a
    assert search.cosine_search(rows.limit(0), rows, k=3).count() == 0


def test_index_maintenance(spark, small):
    found = records(spark, small)
    limits = spark.createDataFrame([(7, 3)], "conv_id long, n_turns int")
    kept = index.trim_future(found, limits)
    assert kept.where("turn > 3").count() == 0 and kept.where("conv_id <> 7 and turn is not null").count() == 0
    assert index.index_statistics(found).agg(F.sum("records")).first()[0] == found.count()
    texts = spark.createDataFrame([(1, 2, "rfp1:a"), (1, 3, "")], "conv_id long, turn int, raw_turn_fingerprint string")
    markers = spark.createDataFrame([(1, "empty:2"), (1, "empty:3"), (1, "rfp1:b"), (1, "rfp1:b"), (1, "")], "conv_id long, marker string")
    assert {r.marker for r in index.migrate_markers(markers, texts).collect()} == {"rfp1:a", "empty:3", "rfp1:b"}


def test_index_store_versions(spark, tmp_path, small):
    store = tables.IndexStore(spark, f"file://{tmp_path}/store", buckets=2)
    assert store.versions() == [] and store.read()[0].count() == 0
    one = spark.createDataFrame([(1, 1, 1, "p") + (None,) * 13, (2, 1, 1, "q") + (None,) * 13], tables.INDEX_SCHEMA)
    first = store.write(one, spark.createDataFrame([(1, "m"), (1, "m"), (1, "")], "conv_id long, marker string"))
    assert store.read()[0].count() == 2 and store.read()[1].count() == 1
    store.clear()
    assert store.read()[0].count() == 0 and store.read(first)[0].count() == 2


def test_settings_are_bounded():
    s = RecallSettings(batch_size=99, top_k=3, keep_floors=33, similarity_threshold=10, rerank_candidates=500)
    assert (s.batch_size, s.top_k, s.keep_floors, s.similarity_threshold, s.rerank_candidates) == (16, 10, 34, 50, 100)
    assert RecallSettings(keep_floors=0).keep_floors == 0 and RecallSettings().threshold == 0.5
    assert RecallSettings(rerank_enabled=True).threshold == 0.3 and RecallSettings(rerank_enabled=True).candidate_limit == 50
    with pytest.raises(AttributeError):
        s.top_k = 5


def test_recall_from_end_to_end(spark):
    from mnemoflow.plans import pipeline
    from mnemoflow.sources.connectors import HashEmbedder
    from mnemoflow.streaming.ingest import ingest_conversations

    subjects = ["lantern in the harbour", "violin of the old foundry", "copper key under the stair", "quilt on the orchard wall"]
    rows = []
    for i in range(40):
        subject = subjects[i % 4] + f" number {i}"
        rows += [(True, None, None, f"Tell me about the {subject}, " * 3, None, None), (False, None, None, f"The {subject} was seen by the keeper of the tower. " * 3, None, None)]
    rows.append((True, None, None, "Tell me about the lantern in the harbour number 4, " * 3, None, None))
    messages = chat(spark, rows).drop("turn")
    nothing = spark.createDataFrame([], tables.INDEX_SCHEMA)
    records = ingest_conversations(messages, nothing, HashEmbedder(256), "h").cache()
    settings = RecallSettings(model="h", keep_floors=30)
    found = pipeline.recall_memories(messages, records, HashEmbedder(256), settings).orderBy("rank").collect()
    assert 1 <= len(found) <= 10 and found[0].turn == 5 and "number 4" in found[0].text
    retained = {t for t in range(26, 42)}
    assert not retained & {r.turn for r in found}
    empty = spark.createDataFrame([], "conv_id long, marker string")
    out = pipeline.prompted_messages(messages, records, empty, HashEmbedder(256), settings)
    prompt = out.where("injected").first()
    assert "number 4" in prompt.mes and out.where(~F.coalesce("injected", F.lit(False))).count() < 81
    other = pipeline.recall_memories(messages, records, HashEmbedder(256), RecallSettings(model="other"))
    assert other.count() == 0 == pipeline.recall_memories(messages, records, HashEmbedder(256), settings, kind="quiet").count()
    asked = recall.manual_search(turns.latest_user(messages), "quilt on the orchard wall number 3 and the keeper of the tower")
    assert pipeline.recall_memories(messages, records, HashEmbedder(256), settings, latest=asked).count() > 0
