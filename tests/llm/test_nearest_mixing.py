import base64
import dataclasses

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemoflow.llm import mixing, nearest
from mnemoflow.session import read_table

RECORD = "frag_id long, embedding_model string, embedding_dims int, embedding_q string, cosine string, kind string"


def encoded(v):
    return base64.b64encode(np.array(v, np.int8).tobytes()).decode()


def truth(rows, least):
    ids = np.array([r.frag_id for r in rows])
    order = np.argsort(ids)
    ids = ids[order]
    x = np.stack([np.frombuffer(bytes(rows[i].vec), np.int8) for i in order]).astype(float)
    score = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None, :])
    np.fill_diagonal(score, -2)
    best = np.argsort(-score, axis=1, kind="stable")[:, :10]
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in best[i] if score[i, j] >= least - 1e-12}


def test_recall_against_brute_force(spark):
    rows = nearest.usable_vectors(read_table(spark, "/root/testdata/sf0.01", "fragments")).dropDuplicates(["frag_id"]).cache()
    want = set()
    for kind in {r.kind for r in rows.select("kind").distinct().collect()}:
        want |= truth(rows.where((F.col("kind.embedding_model") == kind.embedding_model) & (F.col("kind.n") == kind.n)).collect(), 0.8)
    got = {(r.frag_lo, r.frag_hi) for r in nearest.similar_pairs(rows).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.98 * len(got)
    crowded = dataclasses.replace(nearest.ProbeParams(), dense=3, block=16)
    # whether a bucket is compared in blocks changes no result
    assert got == {(r.frag_lo, r.frag_hi) for r in nearest.similar_pairs(rows, p=crowded).collect()}


def test_top_ten_is_whole_without_a_bound(spark):
    rows = nearest.usable_vectors(read_table(spark, "/root/testdata/sf0.01", "fragments")).dropDuplicates(["frag_id"]).cache()
    got = {}
    for r in nearest.top_similar(rows).collect():
        got.setdefault(r.frag_id, []).append((r.rank, r.other_id, r.cosine))
    kinds = {}
    for r in rows.collect():
        kinds.setdefault(r.kind, []).append((r.frag_id, np.frombuffer(bytes(r.vec), np.int8)))
    places = hits = 0
    for own in kinds.values():
        own.sort(key=lambda r: r[0])
        ids, x = np.array([i for i, _ in own]), np.stack([v for _, v in own]).astype(float)
        score = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None, :])
        np.fill_diagonal(score, -2)
        for i, best in enumerate(np.argsort(-score.round(12), axis=1, kind="stable")[:, : min(10, len(own) - 1)]):
            found = sorted(got.get(ids[i], []))
            assert [r for r, *_ in found] == list(range(1, len(best) + 1)) and np.allclose([c for *_, c in found], score[i, best])
            places, hits = places + len(best), hits + len(set(ids[best]) & {o for _, o, _ in found})
    assert places > 1000 and hits >= 0.999 * places


def test_blocks_change_no_list(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-128, 128, (300, 16))
    x[5], x[6] = -x[4], x[4]  # an opposite and a copy
    rows = [(i, "m", None, encoded(v), "x", "x") for i, v in enumerate(x)] + [(i + 400, "n", None, encoded(v), "x", "x") for i, v in enumerate(x[10:14])]
    members, classes = nearest.vector_classes(nearest.usable_vectors(spark.createDataFrame(rows, RECORD)))
    whole = {tuple(r) for r in nearest.exact_near(classes).collect()}
    assert whole == {tuple(r) for r in nearest.exact_near(classes, block_bytes=16 * 40, least_asked=10).collect()}
    assert len(whole) == 299 * 10 + 4 * 3 and members.count() == 304


def test_a_crowded_bucket_serves_both_sides():
    rng = np.random.default_rng(11)
    vec = rng.integers(-100, 100, (700, 16)).astype(np.int8)
    same = {c: pa.array(np.zeros(700, np.int64)) for c in ("s", "t")}
    # the visitor's best are others, yet it is the best visitor of every stored vector
    table = pa.table({"side": [0] * 6 + [1], "cid": [*range(6), 100], "vec": pa.array([v.tobytes() for v in vec[:7]], pa.binary())} | {c: v[:7] for c, v in same.items()})
    pairs = nearest._dense_group(table, 2, 43)
    assert set(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())) == {(i, 100) for i in range(6)}
    # more visitors than one part holds
    table = pa.table({"side": [0] * 20 + [1] * 680, "cid": list(range(700)), "vec": pa.array([v.tobytes() for v in vec], pa.binary())} | same)
    pairs = nearest._dense_group(table, 3, 43)
    x = vec / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    best = np.argsort(-(x[20:] @ x[:20].T), axis=0)[:3]
    assert {(i, 20 + j) for i in range(20) for j in best[:, i]} <= set(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()))
    # vectors of other sketches are no candidates
    far = table.set_column(table.schema.get_field_index("s"), "s", pa.array([-1] * 20 + [0] * 680, pa.int64()))
    assert nearest._dense_group(far, 3, 43).num_rows == 0


def test_what_is_shuffled_stays_in_proportion(spark):
    # a topic: its vectors resemble one another in pairs without end, few are alike
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((1, 64)) + 1.6 * rng.standard_normal((3000, 64)), 2, 0) + 0.3 * rng.standard_normal((6000, 64))
    x = np.clip(np.round(30 * x), -127, 127).astype(np.int8)
    ids, p = np.arange(len(x)), nearest.ProbeParams(fine_rows=64, fine_visits=16)
    # a coarse bucket returns at most the best k of each row, whatever was compared
    bucket = nearest._Bucket(ids, x, p, 0.0)
    bucket.ask_stored(ids)
    row, other, cosine = bucket.lists.best()
    assert bucket.width > 4 and len(row) <= p.k * len(x) and (row != other).all()
    # and its visitors find their like by the fine buckets
    bucket = nearest._Bucket(ids[::2], x[::2], p, 0.8)
    found = bucket.ask(ids[1::2], x[1::2])
    got = set(zip(found["cid"].to_pylist(), found["other"].to_pylist()))
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(int(2 * i + 1), int(2 * j)) for i, j in zip(*np.nonzero(unit[1::2] @ unit[::2].T >= 0.8))}
    assert len(want) >= 3000 and got <= want and len(got) >= 0.9 * len(want)
    # visits of the first level grow by two when the number of vectors doubles
    for width in (3, 6):
        own, visited = nearest._buckets(nearest._unit(x), np.uint64(3), width, p.coarse_tables, max(p.coarse_visits, 2 * width), 0, p)
        assert visited.shape[1] == 2 * width and all(set(o) <= set(v) and len(set(v)) == len(v) for o, v in zip(own.tolist(), visited.tolist()))


def test_rows_of_buckets_come_in_any_batches():
    rng = np.random.default_rng(6)
    x = rng.integers(-100, 100, (40, 16)).astype(np.int8)
    x[20:] = x[:20]
    x[20:, 0] += 1
    rows = [(b, 0, s, i, x[i].tobytes()) for b, s, i in [(1, 1, i) for i in range(20)] + [(1, 2, i) for i in range(20, 40)] + [(2, 2, i) for i in range(5)] + [(3, 0, 1), (3, 1, 21), (3, 2, 1)]]
    names = ["bucket", "block", "side", "cid", "vec"]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
    near = lambda batches: {(c, o) for b in nearest._compare(iter(batches), nearest.ProbeParams(), 0.9) for c, o in zip(b["cid"].to_pylist(), b["other"].to_pylist())}
    want = {(i, i + 20) for i in range(20)} | {(i + 20, i) for i in range(20)}
    assert want <= near([whole])
    assert near([whole]) == near([whole.slice(i, 3) for i in range(0, len(rows), 3)]) == near([whole.slice(i, 1) for i in range(len(rows))])


def test_copies_ties_and_unusable_records(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-100, 100, 64), rng.integers(-100, 100, 64)
    rows = [(i, "m", 64 if i % 2 else None, encoded(a), "x", "x") for i in range(30)] + [(100, "m", 64, encoded(b), "x", "x"), (101, "other", 64, encoded(a), "x", "x")]
    rows += [(200, None, 64, encoded(a), "x", "x"), (201, "m", 32, encoded(a), "x", "x"), (202, "m", 64, "%%%", "x", "x"), (203, "m", 64, None, "x", "x"), (204, "m", None, encoded([0] * 64), "x", "x"), (205, "m", 0, "", "x", "x"), rows[0]]
    rows.append((300, "m", 64, encoded(a)[:40] + "\r\n" + encoded(a)[40:], "x", "x"))
    vectors = nearest.usable_vectors(spark.createDataFrame(rows, RECORD))
    top = nearest.most_similar(vectors).collect()
    by = {}
    for r in top:
        by.setdefault(r.frag_id, []).append((r.rank, r.other_id))
    assert sorted(by) == [*range(30), 300]
    assert [o for _, o in sorted(by[3])] == [i for i in range(11) if i != 3] and [o for _, o in sorted(by[300])] == list(range(10))
    pairs = {tuple(r) for r in nearest.similar_pairs(vectors).collect()}
    # of 31 copies the first eleven are in each other's lists, the other twenty have the first ten in theirs
    copies = [*range(30), 300]
    assert pairs == {(a, b) for a in copies[:11] for b in copies[:11] if a < b} | {(a, b) for a in copies[:10] for b in copies[11:]}
    assert nearest.most_similar(vectors.limit(0)).count() == 0


def test_raking_meets_sources_and_keeps_other_shares():
    rng = np.random.default_rng(3)
    have = rng.integers(50, 500, (3, 8)).astype(float)
    most, reach = np.full(3, 10.0), np.array([1200.0, 600.0, 1000.0])
    taken = lambda factor: (have * mixing.rates(have, most, reach, factor)).sum(0)
    by = have.sum(0).reshape(4, 2) / have.sum() * reach.sum()
    factor = mixing.rake(taken, (4, 2), (by.sum(1), by.sum(0)), 300, 1e-10)
    use = have * mixing.rates(have, most, reach, factor.ravel())
    assert np.allclose(use.sum(1), reach)
    assert np.allclose(use.sum(0).reshape(4, 2).sum(1), by.sum(1), rtol=1e-3) and np.allclose(use.sum(0).reshape(4, 2).sum(0), by.sum(0), rtol=1e-3)


def test_no_cell_is_taken_beyond_its_repeats():
    rng = np.random.default_rng(8)
    have, factor = rng.integers(0, 500, (200, 12)).astype(float), rng.uniform(0.01, 30, 12)
    most = rng.integers(1, 5, 200).astype(float)
    reach = np.minimum(rng.uniform(0, 9000, 200), have.sum(1) * most)
    got = mixing.rates(have, most, reach, factor)
    assert (got <= most[:, None]).all() and np.allclose((have * got).sum(1), reach)


@pytest.fixture(scope="module")
def library(spark):
    rows = [(i, "word " * (5 + i % 7), ["EN", "zh-CN", None, "xx"][i % 4], ["a", "b", "c", None, "d"][i % 5], "clash") for i in range(500)] + [(900, None, "en", "a", "x"), (901, "", "en", "a", "x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens string")
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.2, 3), ("c", 0.5, 1), ("missing", 0.1, 4), (None, 0.5, 1)], "source string, weight double, max_repeats int")
    return documents, targets


def test_report_names_the_short_sources(spark, library):
    report = {r.source: r for r in mixing.mix_report(*library).collect()}
    assert set(report) == {"a", "b", "c", "missing"}
    total = sum(r.tokens for r in report.values())
    assert {s for s, r in report.items() if r.short} == {s for s, r in report.items() if r.tokens * r.max_repeats < r.weight * total} == {"c", "missing"}
    assert abs(sum(r.share for r in report.values()) - 1) < 1e-9 and report["missing"].use == 0
    assert abs(report["a"].use - 0.2 * total) < 1e-3 and abs(report["c"].use - report["c"].tokens) < 1
    assert mixing.mix_report(library[0].limit(0), library[1]).where("use > 0 or share > 0").count() == 0


def test_sample_keeps_shares_and_caps(spark, library):
    rows = mixing.mix_sample(*library).collect()
    most = {"a": 2, "b": 3, "c": 1}
    assert rows and all(1 <= r.copies <= most[r.source] for r in rows)
    used = {s: sum(r.copies * r.tokens for r in rows if r.source == s) for s in most}
    report = {r.source: r for r in mixing.mix_report(*library).collect()}
    assert all(report[s].drawn == used[s] and abs(report[s].share - used[s] / sum(used.values())) < 1e-12 for s in most)
    # a source's total misses its plan by about one document
    assert all(abs(used[s] - report[s].use) <= 2 * max(r.tokens for r in rows) for s in most)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sample(library[0].repartition(7), library[1]).collect()))


def test_sources_that_can_give_their_share_do(spark):
    d = "/root/testdata/sf0.1"
    report = mixing.mix_report(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets")).collect()
    assert all(abs(r.drawn - r.wanted) <= 0.01 * r.wanted for r in report if not r.short) and any(r.short for r in report)
    assert all(r.drawn == r.tokens * r.max_repeats for r in report if r.short)


def test_many_sources_are_fitted_in_many_tasks(spark):
    rows = [(i, f"lantern of the harbour {i} " * (1 + i % 9), ["en", "de", "zh"][i % 3], f"s{i % 2000}") for i in range(6000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()
    targets = spark.createDataFrame([(f"s{i}", 1 / 2000, 3) for i in range(2000)], "source string, weight double, max_repeats int")
    tokens = mixing.counted(documents, targets).cache()
    plans = []
    for n in (4096, 300):
        p = dataclasses.replace(mixing.MixParams(), at_once=n, rounds=4)
        plans.append({(r.source, r.lang_cell, r.topic): r.rate for r in mixing.mixture(tokens, targets, p)[0].collect()})
    assert plans[0].keys() == plans[1].keys() and all(abs(plans[0][k] - plans[1][k]) < 1e-6 for k in plans[0])


def test_topics_tell_vocabularies_apart(spark):
    words = [["drum", "violin", "chorus", "melody"], ["0x1f", "null", "{}", "::", "return"]]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[i % 2], 40)), ["en", "de"][i // 2 % 2]) for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang_cell string")
    p = dataclasses.replace(mixing.MixParams(), topics=2)
    counts = mixing.count_tokens(documents, dims=p.dims).cache()
    topic = {r.doc_id: r.topic for r in mixing.learn_topics(counts, p).assigned(counts).collect()}
    assert all(topic[i] == topic[i % 2] for i in topic) and topic[0] != topic[1]


def test_tokens_are_counted_by_the_vocabulary(spark):
    frame = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (4, "中文", 5)], "id long, text string, tokens long")
    got = {r.id: r.tokens for r in mixing.count_tokens(frame).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 2
