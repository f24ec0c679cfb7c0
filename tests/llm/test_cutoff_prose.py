import random

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemoflow.llm import cutoff, prose, queries
from mnemoflow.llm.tables import once

VALUES = "field string, id long, source string, text string, cut string, kind string"


def test_endings():
    p = cutoff.CutParams()
    kinds = {
        "It ended!": cutoff.COMPLETE, "他走了。": cutoff.COMPLETE, "": cutoff.COMPLETE, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa": cutoff.LISTED, "知道了😊": cutoff.COMPLETE, "(done)": cutoff.COMPLETE,
        "It was the map that [...]": cutoff.CUT, "He sai�": cutoff.CUT,
        "He left. She wen": cutoff.OPEN, "他走了。她": cutoff.OPEN, "“Run. Sto.": cutoff.OPEN, '"Run. Stop.': cutoff.OPEN,
        "on my way": cutoff.SHORT, "用户：好的": cutoff.SHORT, "And nobody knew...": cutoff.TRAILING, "He met Dr.": cutoff.DOTTED, "1. map -> gate": cutoff.LISTED, "เธอเดินออกไป": cutoff.UNMARKED,
    }
    assert {t: cutoff.ending(t, p)[0] for t in kinds} == kinds


@pytest.fixture(scope="module")
def limited(spark):
    """Texts of two sources, one of which cuts at 60 letters; the second field of a row says whether it was cut."""
    rng = random.Random(9)
    words = "lantern harbour quilt copper saddle orchard violin drum mirror parcel kettle spool anchor candle compass".split()
    rows = []
    for i in range(3000):
        text = " ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4, 9))).capitalize() + "." for _ in range(rng.randrange(1, 5)))
        source = "tight" if i % 2 else None
        cut = source == "tight" and len(text) > 60
        whole = text[:60] + "..." if cut else text
        rows.append(("f", i, source, whole, "yes" if cut else "no", None))
    rows += [("f", 5000, "tight", None, "no", None), ("f", 5001, "tight", " ", "no", None), ("f", 5002, None, "x" * 100_000, "no", None)]
    return spark.createDataFrame(rows, VALUES)


def test_a_limit_is_found_and_its_texts_flagged(spark, limited):
    found = cutoff.significant_lengths(cutoff.measured(limited)).collect()
    assert {(r.source, r.doubt) for r in found} == {("tight", "trailing")} and {r.length for r in found} <= {62, 63} and 63 in {r.length for r in found}
    got = {r.id for r in cutoff.cut_values(limited).collect()}
    want = {r.id for r in limited.where("cut = 'yes'").collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.99 * len(got)
    rates = {r.source: r for r in cutoff.cut_rates(limited).collect()}
    assert rates[None].cut == 0 and rates["tight"].rate > 0.3 and rates["tight"].values == 1501
    assert cutoff.cut_values(limited.limit(0)).count() == 0


def test_cuts_in_transfer_are_told_from_careless_writing(spark):
    """In one field nobody sets final marks, so open endings there are no cuts; in the other a source cuts a tenth of its texts anywhere."""
    rng = random.Random(12)
    words = "lantern harbour quilt copper saddle orchard violin drum mirror parcel kettle spool anchor candle compass".split()
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(9, 15)))
    rows = []
    for i in range(4000):
        lines = [line().capitalize() + "." for _ in range(rng.randrange(2, 9))]
        cut = i % 10 == 0 and i % 2 == 0
        text = "\n".join(lines)
        rows.append(("marked", i, "wire" if i % 2 == 0 else "safe", text[: rng.randrange(len(text) - 40, len(text) - 8)].rstrip() if cut else text, "yes" if cut else "no", None))
        rows.append(("plain", i, "wire", "\n".join(line() for _ in range(rng.randrange(2, 9))), "no", None))
    values = spark.createDataFrame(rows, VALUES)
    out = cutoff.verdicts(values).join(values.select("field", "id", F.col("cut").alias("want")), ["field", "id"]).where("cut or want = 'yes'").collect()
    right = [r for r in out if r.cut and r.want == "yes"]
    assert len(right) >= 0.95 * sum(r.want == "yes" for r in out) and len(right) >= 0.98 * sum(r.cut for r in out)
    assert all(r.posterior >= 0.5 and not r.at_limit for r in right)
    rates = {(r.field, r.source): r for r in cutoff.cut_rates(values).collect()}
    assert rates["plain", "wire"].cut == rates["marked", "safe"].cut == 0 and rates["marked", "wire"].cut_in_transfer > 300


def test_words_are_found_behind_long_runs():
    p = cutoff.CutParams()
    assert cutoff.ending("He left. " + "ab" * 500 + "c", p)[:2] == (cutoff.OPEN, "ab" * 500 + "c")
    assert cutoff._last_word("x" * 200_000).group() == "x" * 200_000 and cutoff._last_word("no. 3") is None and cutoff._last_word("c.-à-d").group() == "d"


def test_rows_with_one_id_count_once(spark):
    rows = spark.createDataFrame([(1, "b", "x"), (1, "b", "x"), (1, "a", "y"), (None, "c", "z"), (2, None, None)], "k long, v string, w string")
    assert sorted(map(tuple, once(rows, "k", "v", "w").collect())) == [(1, "a", "y"), (2, None, None)]


def test_profiles_tell_prose_from_the_rest(spark):
    d = "/root/testdata/sf0.01"
    documents, common = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/common_words.parquet")
    own = {
        -1: "The keeper of the tower said that it was late, and they went back to the old mill before dawn.\nShe had not seen him for a long time, but he was still there.",
        -2: "- lantern\n- drum (the tower)\n- map\n- the mirror of the hall\n- saddle\n- quilt",
        -3: "| a | b | c |\n|---|---|---|\n| drum | Pell | 1710 |\n| map | Rook | 12 |\n| seal | Odwin | 7 |",
        -4: '{"state":{"a":{"v":8,"k":"3929fc9e"},"b":{"v":17,"k":"1fc794db"}}}',
        -5: "drum, map, Pell, seal, Rook, lantern, Odwin, mirror, violin, saddle, quilt, kettle, spool",
        -6: "",
        -8: "waren sie noch nicht da, als er zu der alten mühle ging und auf das boot von gestern wartete aber es war nicht mehr dort",
        -9: "磨坊的守卫在晚上把所有的窗都关上了，可是到了早上他还是不见了。她说这是他们的错，我不知道。",
        -10: "qzRw84JdK2PqLx0ZtB7v/3nUe1aXh5sYk9GmWc6oTf+\n4NqRs8TzV0bLx2KdPw7yHj5uCe1mXa9/",
    }
    extra = spark.createDataFrame([*own.items(), (-7, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in prose.text_statistics(documents.unionByName(extra), common).where("doc_id < 0").collect()}
    assert {i for i, r in rows.items() if r.is_prose} == {-1, -8, -9}
    assert rows[-7].words == rows[-6].words == 0 and rows[-7].prose_share is None and rows[-2].bullet_lines == 1.0 and rows[-1].punctuated_lines == 1.0
    assert rows[-1].lang_guess == "en" and rows[-9].lang_guess == "zh" and rows[-8].lang_guess == "de" and rows[-1].words == 34
    assert prose.text_statistics(documents.limit(0), common).count() == 0


def test_languages_and_terms_of_the_table_all_count(spark):
    rows = [("pt", t) for t in "não uma com para mais foi pelo".split()] + [("en", f"common{a}{b}") for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmno"] + [("en", "zebra"), ("ko", "그리고"), (None, "x"), ("en", None), ("en", "")]
    common = spark.createDataFrame(rows, "lang string, term string")
    texts = {1: "não foi uma caixa para o barco, mais foi pelo rio com ela", 2: "zebra commonto lantern commonaa", 3: "그리고 우리는 갔다"}
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in prose.text_statistics(documents, common).collect()}
    assert got[1].lang_guess == "pt" and abs(got[1].common_words - 8 / 13) < 1e-9
    assert got[2].lang_guess == "en" and got[2].common_words == 0.75


def test_divergence_is_bounded_and_zero_for_equals():
    import numpy as np

    x = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]])
    assert np.allclose(prose.divergence(x, x), 0) and np.allclose(prose.divergence(x, np.array([0.0, 0.0, 1.0])), 1)


def test_every_registered_query_runs(spark):
    for name in ("p2_limits", "p2_rates", "p4_report", "p5_top10", "p6_clean", "p7_sample"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
    wanted = {
        "p1_found": {"field", "rec_id", "char_end"}, "p2_found": {"field", "rec_id"}, "p3_found": {"field", "frag_id"}, "p4_found": {"field", "id_lo", "id_hi"},
        "p5_found": {"frag_lo", "frag_hi"}, "p6_found": {"doc_id", "item_id"}, "p7_found": {"source"}, "p8_found": {"doc_id"},
    }
    for name, columns in wanted.items():
        frame = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert set(frame.columns) == columns and frame.count() == frame.distinct().count()


def test_oversize_equals_its_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("fragments", "models"):
        con.execute(f"create view {table} as select * from '{d}/{table}.parquet'")
    want = con.execute(queries.ORACLE["p3_found"]).fetchall()
    got = [tuple(r) for r in queries.QUERIES["p3_found"](spark, d).select("field", "frag_id").collect()]
    assert sorted(got) == sorted(want) and want
