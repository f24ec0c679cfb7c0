"""Fragments of turns: paragraphs split and merged, the user's text before every reply, keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from mnemoflow.functions import keys
from mnemoflow.functions.text import WHITE_CHARS, js_trim, strip_code, trim_text, utf16_length
from mnemoflow.operators.turns import is_user, running_totals
from mnemoflow.session import checkpoint_dir

PARAGRAPH_UNITS, BLOCK_UNITS, SUMMARY_UNITS = 1800, 400, 900
# Where a long paragraph may be cut, and the part of its room that has to be filled first.
BREAKS, LEAST_FILLED = "。！？.!?\n", 0.55
USER_LABEL, ROLE_LABEL = "用户：", "角色卡："
GROUPS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _units(text: str) -> str:
    """A string of one character per UTF-16 code unit."""
    if text.isascii() or max(text) < "\U00010000":
        return text
    return "".join(map(chr, np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist()))


def _text(units: str) -> str:
    if units.isascii() or not any("\ud800" <= c <= "\udfff" for c in units):
        return units
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def split_long(text: str | None, most: int) -> list[str]:
    """Parts of at most ``most`` code units: each ends after the last break in its window if that lies beyond 55 %, else at the limit."""
    rest = _units((text or "").strip(WHITE_CHARS))
    parts, begin = [], 0
    while len(rest) - begin > most:
        window = rest[begin : begin + most]
        at = max(window.rfind(c) for c in BREAKS)
        end = begin + (at + 1 if at > int(LEAST_FILLED * most) else most)
        parts.append(_text(rest[begin:end].strip(WHITE_CHARS)))
        begin = end
        while begin < len(rest) and rest[begin] in WHITE_CHARS:
            begin += 1
    parts.append(_text(rest[begin:]))
    return [p for p in parts if p]


def merge_small(paragraphs: list[str], most: int) -> list[tuple[str, int, int]]:
    """Neighbouring paragraphs joined by a blank line while they fit: (text, first, last), numbered from 1; blank ones only count."""
    out: list[list] = []
    size = 0
    for number, paragraph in enumerate(paragraphs, 1):
        text = (paragraph or "").strip(WHITE_CHARS)
        if not text:
            continue
        units = len(_units(text))
        if out and size + 2 + units <= most:
            out[-1][0].append(text)
            out[-1][2] = number
            size += 2 + units
        else:
            out.append([[text], number, number])
            size = units
    return [("\n\n".join(t), a, b) for t, a, b in out]


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text: parts between blank lines, trimmed, blank ones left out."""
    clean = js_trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n"))
    parts = F.transform(F.split(clean, "\n[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]*\n", -1), js_trim)
    return F.filter(parts, lambda p: p != "")


def split_paragraph(text: Column, most: int) -> Column:
    """:func:`split_long` of a text column; null and blank texts have no parts."""

    @arrow_udf(T.ArrayType(T.StringType()))
    def split(column: pa.Array) -> pa.Array:
        return pa.array([split_long(t, most) if t is not None else [] for t in column.to_pylist()], pa.list_(pa.string()))

    return split(text)


def merge_paragraphs(array: Column, most: int) -> Column:
    """:func:`merge_small` of an array of strings: array of struct(text, start, end)."""

    @arrow_udf(GROUPS)
    def merge(column: pa.Array) -> pa.Array:
        rows = [[{"text": t, "start": a, "end": b} for t, a, b in merge_small(v or [], most)] for v in column.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return merge(array)


def blocks(text: Column, longest: int = PARAGRAPH_UNITS, most: int = BLOCK_UNITS) -> Column:
    """Blocks of a cleaned text: paragraphs split at ``longest``, then at ``most``, then merged up to ``most``."""

    @arrow_udf(GROUPS)
    def build(column: pa.Array) -> pa.Array:
        rows = []
        for parts in column.to_pylist():
            small = [s for part in parts or [] for piece in split_long(part, longest) for s in split_long(piece, most)]
            rows.append([{"text": t, "start": a, "end": b} for t, a, b in merge_small(small, most)])
        return pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return build(paragraphs(text))


def cleaned_turns(turns: DataFrame, text: str = "mes", tags: str | None = None) -> DataFrame:
    """The messages of turns with raw, the trimmed text, and clean, the cleaned one, kept in the shared folder.

    :func:`turn_texts` and :func:`turn_fragments` take what they find there instead of cleaning again; of the other columns only those that
    they need are kept.
    """
    if {"raw", "clean"} <= set(turns.columns):
        return turns
    spark = turns.sparkSession
    checkpoint_dir(spark)
    name = F.col("name") if "name" in turns.columns else F.lit(None).cast("string")
    # cleaning costs far more than moving a text: the messages are spread evenly, however they lay before
    spread = turns.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "conv_id", "msg_index")
    rows = spread.select("conv_id", "turn", "msg_index", is_user().alias("is_user"), F.lit(None).cast("string").alias("role"), name.alias("name"), js_trim(F.coalesce(F.col(text), F.lit(""))).alias("raw"), strip_code(F.col(text), tags).alias("clean"))
    return rows.checkpoint()


def _near(rows: DataFrame, kinds: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the normalised texts of the kinds of columns, and per kind the aggregate that gives a turn's key.

    Keys need only a turn's first 1000 letters or so: of the messages, those that stand beyond them aren't gathered.
    """
    rows = rows.withColumns({f"n_{kind}": keys.fingerprint_text(F.when(F.col(kind) != "", F.concat("label", kind)).otherwise("")) for kind in kinds})
    rows = running_totals(rows, ["conv_id", "turn"], "msg_index", {f"s_{kind}": utf16_length(F.col(f"n_{kind}")) for kind in kinds})

    def key(kind: str) -> Column:
        near = F.collect_list(F.when((F.col(f"n_{kind}") != "") & (F.col(f"s_{kind}") < keys.PREFIX_UNITS), F.struct("msg_index", F.col(f"n_{kind}").alias("t"))))
        return keys.prefix_key(F.array_join(F.transform(F.array_sort(near), lambda m: m["t"]), ""))

    return rows, {kind: key(kind) for kind in kinds}


def _label() -> Column:
    return F.when(is_user(), USER_LABEL).otherwise(ROLE_LABEL)


def raw_fingerprints(turns: DataFrame, text: str = "mes") -> DataFrame:
    """conv_id, turn, raw_turn_fingerprint of every turn, from the texts as they are."""
    raw = F.col("raw") if "raw" in turns.columns else js_trim(F.coalesce(F.col(text), F.lit("")))
    rows, key = _near(turns.select("conv_id", "turn", "msg_index", _label().alias("label"), raw.alias("raw")), ["raw"])
    out = rows.groupBy("conv_id", "turn").agg(key["raw"].alias("_prefix"))
    return out.select("conv_id", "turn", keys.raw_token(F.col("_prefix")).alias("raw_turn_fingerprint"))


def turn_texts(turns: DataFrame, text: str = "mes", tags: str | None = None, full: bool = True) -> DataFrame:
    """conv_id, turn, turn_fingerprint, raw_turn_fingerprint, has_content, and with ``full`` full_text, of every turn.

    Messages that aren't cleaned yet are, by :func:`cleaned_turns`.
    """
    rows, key = _near(cleaned_turns(turns, text, tags).select("conv_id", "turn", "msg_index", _label().alias("label"), "raw", "clean"), ["raw", "clean"])
    said = F.collect_list(F.when(F.col("clean") != "", F.struct("msg_index", F.concat("label", "clean").alias("t"))))
    aggregates = [key["clean"].alias("turn_fingerprint"), key["raw"].alias("_prefix"), F.max(F.col("clean") != "").alias("has_content")]
    if full:
        aggregates.append(js_trim(F.array_join(F.transform(F.array_sort(said), lambda m: m["t"]), "\n\n")).alias("full_text"))
    out = rows.groupBy("conv_id", "turn").agg(*aggregates)
    return out.withColumn("raw_turn_fingerprint", keys.raw_token(F.col("_prefix"))).drop("_prefix")


def turn_fragments(turns: DataFrame, text: str = "mes", tags: str | None = None, user_name: str = "用户", role_name: str = "AI", texts: DataFrame | None = None) -> DataFrame:
    """Fragments of every turn, before they are embedded.

    Each block of a reply is a fragment that begins with all the user's text of the turn; a turn without replies gives the
    user's blocks. Turns whose cleaned text is empty give none. A turn has one user message, which opens it, so its text is put together in that message's
    row and joined to the replies; their blocks are numbered by a running count, so a turn of any number of replies is spread over tasks.
    ``texts``: the turns' :func:`turn_texts`, where they are at hand. Messages that aren't cleaned yet are, by :func:`cleaned_turns`.
    """
    cleaned = cleaned_turns(turns, text, tags)
    rows = cleaned.select("conv_id", "turn", "msg_index", is_user().alias("_mine"), "name", blocks(F.col("clean")).alias("_b")).where(F.size("_b") > 0)
    checkpoint_dir(turns.sparkSession)
    rows = rows.checkpoint()  # read for the user's texts, the replies, and their counts
    part = lambda who, b: F.format_string(f"%d:{who}:%d-%d", F.col("msg_index"), b["start"], b["end"])
    opened = rows.where("_mine").select(
        "conv_id", "turn",
        F.concat(F.lit(USER_LABEL), F.array_join(F.transform("_b", lambda b: b["text"]), "\n\n")).alias("user_line"),
        F.array_join(F.transform("_b", lambda b: part("user", b)), "+").alias("user_id"),
    )
    replies = running_totals(rows.where("not _mine"), ["conv_id", "turn"], "msg_index", {"_from": F.size("_b")})
    paired = replies.join(opened, ["conv_id", "turn"], "left")
    replied = replies.select("conv_id", "turn").distinct()
    alone = rows.where("_mine").join(replied, ["conv_id", "turn"], "left_anti").withColumn("_from", F.lit(0))
    both = paired.unionByName(alone, allowMissingColumns=True).select("*", F.posexplode("_b").alias("_n", "_x"))
    label = F.when(F.col("_mine"), USER_LABEL).otherwise(ROLE_LABEL)
    mixed = F.col("user_line").isNotNull()
    speaker = F.when(F.col("_mine"), F.lit(user_name)).otherwise(F.coalesce(F.nullif("name", F.lit("")), F.lit(role_name)))
    out = both.select(
        "conv_id", "turn",
        (F.col("_from") + F.col("_n") + 1).cast("int").alias("sequence"),
        F.col("msg_index").alias("message_index"),
        F.col("_x.start").alias("paragraph_index"),
        F.col("_x.end").alias("paragraph_end_index"),
        F.when(mixed, F.concat_ws(" + ", F.lit(user_name), speaker)).otherwise(speaker).alias("speaker"),
        F.when(mixed, "mixed").when(F.col("_mine"), "user").otherwise("assistant").alias("role"),
        F.concat_ws("\n", "user_line", F.concat(label, F.col("_x.text"))).alias("paragraph"),
        F.concat(F.col("turn").cast("string"), F.lit(":"), F.concat_ws("+", "user_id", F.when(F.col("_mine"), part("user", F.col("_x"))).otherwise(part("assistant", F.col("_x"))))).alias("vector_chunk_id"),
    )
    out = out.withColumn("summary", trim_text(F.col("paragraph"), SUMMARY_UNITS)).withColumn("source_text", F.concat(F.lit("第 "), F.col("turn").cast("string"), F.lit(" 轮\n"), F.col("paragraph")))
    out = out.withColumn("content_fingerprint", keys.content_fingerprint(F.col("paragraph")))
    texts = turn_texts(cleaned, text, tags, full=False) if texts is None else texts
    return out.join(texts.select("conv_id", "turn", "turn_fingerprint", "raw_turn_fingerprint"), ["conv_id", "turn"])
