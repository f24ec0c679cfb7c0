import random
import unicodedata

import pyarrow as pa

from mnemoflow.llm import alike, leaks
from mnemoflow.llm.codepoints import to_codepoints, to_strings
from mnemoflow.llm.fold import fold_array, tables
from mnemoflow.llm.leaks import LeakParams

VALUES = "field string, id long, text string, form string, spelling string, n long"


def folded(text):
    return fold_array(pa.array([text], pa.string()))[0].as_py()


def test_code_points_round_trip():
    rows = ["", None, "aé中😀", "x" * 1000, None, "​"]
    flat, starts = to_codepoints(pa.array(rows).slice(1))
    assert to_strings(flat, starts, pa.array(rows).slice(1).is_valid().to_numpy(zero_copy_only=False)).to_pylist() == rows[1:]


def test_what_prints_alike_becomes_one():
    same = [("é", "é"), ("ｏｋ！", "ok!"), ("ﬁ", "fi"), ("a\r\nb", "a\nb"), ("a b　", "a b "), ("ガ", "ｶﾞ"), ("क़", "क़"), ("Tobrecht", "Tobreсht"), ("⼈", "人"), ("한", "한"), ("x​­y", "xy"), ("…", "..."), ("น้ำ", "น้ํา")]
    assert all(folded(a) == folded(b) for a, b in same)
    other = [("a", "A"), ("é", "e"), ("x²", "x2"), ("a  b", "a b"), ("a\n\nb", "a\nb"), ("1", "l")]
    assert all(folded(a) != folded(b) for a, b in other)
    assert folded(None) is None and folded("​") == ""


def test_composition_equals_the_standard():
    rng = random.Random(5)
    t = tables()
    pool = [c for c in map(chr, [*range(0xC0, 0x17F), *range(0x300, 0x330), *range(0x1E00, 0x1EFF), *range(0xAC00, 0xAC40), *range(0x915, 0x940), 0x61, 0x65]) if not any(t.touched[ord(x)] and unicodedata.normalize("NFD", x) == x for x in unicodedata.normalize("NFD", c))]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(3000)]
    assert [fold_array(pa.array([s]))[0].as_py() for s in texts[:50]] == fold_array(pa.array(texts[:50])).to_pylist()
    wrong = [s for s, r in zip(texts, fold_array(pa.array(texts)).to_pylist()) if r != unicodedata.normalize("NFC", s)]
    assert len(wrong) <= 3  # letters with an accent that look like an accented Greek one


def test_pairs_equal_brute_force(spark):
    spellings = ["ok", "ｏｋ", "o​k", "no", "nо", "Ok", None, ""]
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.choice(spellings), "clash", "clash", 1) for i in range(120)]
    frame = spark.createDataFrame(rows + rows[:9], VALUES)
    want = {(f, min(i, j), max(i, j)) for f, i, s, *_ in rows for g, j, u, *_ in rows if f == g and i != j and s is not None and u is not None and s != u and folded(s) == folded(u)}
    for salt in (20_000, 3):
        got = [tuple(r) for r in alike.alike_pairs(frame, salt).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert alike.alike_pairs(frame.limit(0)).count() == 0
    report = {r.field: r.values for r in alike.alike_report(frame).collect()}
    assert set(report) == {"a", "b"}


def test_classes_hold_every_record_of_a_large_form(spark):
    from pyspark.sql import functions as F

    rows = spark.range(100_000).select(F.lit("a").alias("field"), "id", F.when(F.col("id") % 50_000 == 7, "ｏｋ").otherwise("ok").alias("text"), F.lit("clash").alias("form"))
    rows = rows.unionByName(spark.createDataFrame([("a", -1, "no", "x"), ("b", -2, "ｏｋ", "x"), ("a", -3, None, "x")], "field string, id long, text string, form string"))
    out = alike.alike_classes(rows)
    got = {(r.spelling, r["class"], r.copies, r.records): r.n for r in out.groupBy("spelling", "class", "copies", "records").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, 0, 99_998, 100_000): 99_998, (2, 0, 2, 100_000): 2}
    assert alike.alike_pairs(rows, 1000).count() == 2 * 99_998
    assert alike.alike_classes(rows.limit(0)).count() == 0


def leak_frames(spark, docs, items):
    documents = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    evalset = spark.createDataFrame([(100 + i, t, lang, "clash") for i, (t, lang) in enumerate(items)], "item_id long, text string, lang string, tokens string")
    return documents, evalset


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    items = [(" ".join(rng.choice(words) + str(rng.randrange(4)) for _ in range(25)), "en") for _ in range(6)] + [(None, "en"), ("", "en"), ("short one", None)]
    zh = "题目中的锁匠装着陶罐每当掷出弹珠使得少得一份试证足够名叫渡槽排列瓷砖"
    items.append((zh, "zh"))
    docs = [None, "", "nothing here"]
    for _ in range(60):
        item = rng.choice(items[:6])[0].split()
        a = rng.randrange(20)
        cut = item[a : a + rng.choice((9, 10, 14))]
        docs.append("x y " + rng.choice([" ", "\n> ", ", "]).join(cut).upper() + " z")
    docs += [zh[3:23], zh[3:22], "，".join(zh[5:26]), docs[5], docs[5], "alpha0 " * 5000]
    documents, evalset = leak_frames(spark, docs, items)

    def tokens(text, letters):
        text = fold_array(pa.array([text]))[0].as_py().lower()
        words = "".join(c if c.isalnum() else " " for c in text).split()
        return list("".join(words)) if letters else words

    def contains(doc, item, lang):
        n = 20 if lang == "zh" else 10
        a, b = tokens(doc, lang == "zh"), tokens(item, lang == "zh")
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
        return any(tuple(a[i : i + n]) in grams for i in range(len(a) - n + 1))

    want = {(d, 100 + i) for d, doc in enumerate(docs) if doc for i, (t, lang) in enumerate(items) if t and contains(doc, t, lang)}
    got = leaks.leaks(documents, evalset)
    found = got.collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    assert all(r.tokens >= 10 for r in found)
    small = leaks.leaks(documents, evalset, LeakParams(eval_block_chars=200, pairs_at_once=5))
    assert {(r.doc_id, r.item_id) for r in small.collect()} == want
    kept = leaks.without_leaks(documents, evalset)
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in want} and kept.columns == documents.columns
    assert leaks.leaks(documents.limit(0), evalset).count() == 0 == leaks.leaks(documents, evalset.limit(0)).count()


def test_suffix_array_is_sorted():
    import numpy as np

    rng = np.random.default_rng(0)
    tokens = np.concatenate((rng.integers(0, 3, 400), [0, 0]))
    order = leaks.suffix_array(tokens, np.flatnonzero(tokens > 0))

    def suffix(p):
        out = []
        while tokens[p]:
            out.append(tokens[p])
            p += 1
        return tuple(out)

    texts = [suffix(p) for p in order]
    assert texts == sorted(texts)


def test_cost_hardly_follows_the_number_of_items():
    import time

    import numpy as np

    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(5000)])
    docs = [" ".join(words[rng.integers(0, 5000, 300)]) for _ in range(600)]
    items = [" ".join(words[rng.integers(0, 5000, 120)]) for _ in range(3000)]
    docs[5] = " ".join(items[7].split()[3:40])
    flat, starts = to_codepoints(pa.array(docs))
    took = {}
    for n in (300, 3000):
        index = leaks.eval_index(np.arange(n), pa.array(items[:n]), 10, False)
        list(leaks.shard_matches(flat, starts, index, 1000))
        begin = time.process_time()
        found = [m for _ in range(3) for m in leaks.shard_matches(flat, starts, index, 1000)]
        took[n] = time.process_time() - begin
        assert {(int(r), int(i), int(t)) for row, item, length, _ in found for r, i, t in zip(row, item, length)} == {(5, 7, 37)}
    assert took[3000] < 2 * took[300] + 0.2
