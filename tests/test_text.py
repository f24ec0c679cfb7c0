from pyspark.sql import functions as F

from mnemoflow.functions import keys, lexical, text, vectors
from tests import plain


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


def test_blocks_orphans_and_image_prompts_go(spark):
    opened = "留下的思考。\n</think>\n\n正文在这里，应当留下。"
    assert one(spark, opened, text.strip_code) == "正文在这里，应当留下。"
    mixed = "<konatan_plan~>\n计划\n</konatan_plan~>\n她转过头。\nimage###x, y###\n<UpdateVariable>\n<Analysis>t</Analysis>\n</UpdateVariable>\n<正文>故事继续。</正文>\n<konatan_chat>\n被截断"
    assert one(spark, mixed, text.strip_code) == "她转过头。\n\n故事继续。"


def test_code_goes_and_prose_stays(spark):
    value = "正常文本。\n<script>x()</script>\n```js\nconst a = 1;\n```\n<div>only</div>\nconst b = 2;\n正文继续。"
    assert one(spark, value, text.strip_code) == "正常文本。\n\n正文继续。"
    assert one(spark, "a &amp;lt; b  &nbsp;c", text.strip_code) == "a < b c"
    assert one(spark, None, text.strip_code) == ""


def test_stated_cases_of_cleaning(spark):
    """Whole tables are compared with SQL in test_registry; these are cases that the tables may lack."""
    cases = {
        "if中文": "", "iffy\nif x": "iffy", "{};[]": "", "<b>x</b> y": "", "<b>好。</b>": "", "他说<b>好。</b>": "他说好。", "</think>tail": "tail", "a<think>b": "a", "<plan a='1'>x</plan>y": "y", "<!-- c -->d": "d", "`code` e": "e",
        "x;\ny => z;": "", "\ufeff\u3000q\u00a0": "q", "~~~s~~~t": "t", "": "", "see &lt;i&gt; here": "see <i> here", "&lt;i&gt;": "", "a  \t b\n\n\n\nc": "a b\n\nc", "<STATUS_x>1</status_X>留下": "留下", "<status_a>1</status_b>留下": "留下", "print(1)\nconsole.log(2);": "print(1)",
    }
    rows = list(cases.items())
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i long, t string")
    got = {rows[r.i][0]: r.c for r in frame.select("i", text.strip_code(F.col("t")).alias("c")).collect()}
    assert got == cases


def test_trim_counts_code_units(spark):
    assert one(spark, "abcdef", lambda c: text.trim_text(c, 4)) == "abcd..."
    assert one(spark, "😀😀😀", lambda c: text.trim_text(c, 3)) == "😀..."
    assert one(spark, "😀�", lambda c: text.utf16_prefix(c, 3)) == "😀�"
    assert one(spark, "中😀", text.utf16_length) == 3


def test_settings_and_tags(spark):
    frame = spark.createDataFrame([("",), ("12",), ("x",), (None,), ("1e400",)], "t string")
    assert [r[0] for r in frame.select(text.clamp(F.col("t"), 1, 10, 5)).collect()] == [1, 10, 5, 1, 5]
    assert one(spark, "<status>, NONE，plan  think*、<a b>", lambda c: text.suggested_tags(c, ["plan"])) == ["status", "think*", "a", "b"]


def test_fingerprints(spark):
    paragraph = "同一段内容用于验证去重行为。" * 12
    assert one(spark, paragraph, keys.content_fingerprint) == plain.normal(paragraph)
    assert one(spark, "short", keys.content_fingerprint) == ""
    assert one(spark, "hello", keys.fnv1a) == 1335831723
    assert one(spark, None, keys.fingerprint_text) == ""
    long = "x" * 1500
    token = one(spark, long, lambda c: keys.raw_token(keys.content_fingerprint(c)))
    assert token.startswith("rfp1:rs:") and one(spark, "", lambda c: keys.raw_token(c)) == ""


def test_quantisation_round_trip(spark):
    vector = [0.1, -0.2, 0.45, 1.0, -0.75, 0.03]
    frame = spark.createDataFrame([(vector,), ([0.0, 0.0],), ([],), (None,)], "v array<double>")
    rows = frame.select("v", vectors.quantize(F.col("v")).alias("q")).select("v", "q", vectors.decode_int8(vectors.to_base64(F.col("q.q"))).alias("d"))
    rows = rows.withColumn("c", vectors.cosine(F.col("v"), F.col("d"))).collect()
    assert rows[0].q.dims == 6 and abs(rows[0].c - 1) < 0.01
    assert [r.q for r in rows[1:]] == [None, None, None] and rows[1].c == -1
    assert one(spark, "not base64!", vectors.decode_int8) == []
    assert one(spark, "AQ\nI=", vectors.decode_int8) == [1, 2]


def test_query_terms_and_boost(spark):
    assert one(spark, "记忆 Qwen 的 é a1", lexical.query_terms) == ["qwen", "记忆", "a1"]
    assert one(spark, None, lexical.query_terms) == []
    match = one(spark, "记忆 qwen", lambda c: lexical.lexical_match(c, F.lit(""), F.array(F.lit("记忆"), F.lit("QWEN"), F.lit("x"))))
    assert match.hits == 2 and match.boost == 0.03 and match.matched == ["记忆", "QWEN"]
