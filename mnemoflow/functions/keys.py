"""Fingerprints of texts and turns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from mnemoflow.functions.text import FINGERPRINT_PUNCTUATION, WHITE, js_trim, let, utf16_length, utf16_prefix

LEAST_UNITS, PREFIX_UNITS = 80, 1000


def fingerprint_text(text: Column) -> Column:
    """The text without white space and common punctuation; null gives ''."""
    marks = "[" + "".join(f"\\u{ord(c):04x}" for c in FINGERPRINT_PUNCTUATION) + "]"
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WHITE}]+", ""), marks, "")


def prefix_key(normal: Column) -> Column:
    """The first 1000 code units of a normalised text of at least 80, else ''."""
    return let(normal, lambda x: F.when(utf16_length(x) >= LEAST_UNITS, utf16_prefix(x, PREFIX_UNITS)).otherwise(""))


def content_fingerprint(text: Column) -> Column:
    return prefix_key(fingerprint_text(text))


def recall_fingerprint(paragraph: Column, summary: Column, source_text: Column, turn: Column, sequence: Column) -> Column:
    """Key of a record among recalled ones: its content, or for short content turn, sequence and content."""
    text = F.coalesce(F.nullif(paragraph, F.lit("")), F.nullif(summary, F.lit("")), F.nullif(source_text, F.lit("")), F.lit(""))
    number = lambda c: F.coalesce(F.nullif(c, F.lit(0)).cast("string"), F.lit(""))
    short = lambda x: F.concat_ws(":", number(turn), number(sequence), x)
    return let(fingerprint_text(js_trim(text)), lambda x: F.when(utf16_length(x) >= LEAST_UNITS, utf16_prefix(x, PREFIX_UNITS)).otherwise(short(x)))


def fnv1a_array(column: pa.Array) -> np.ndarray:
    """32-bit FNV-1a over the UTF-16 code units of each text, one unit of all texts at a time."""
    rows = [t.as_py().encode("utf-16-le", "surrogatepass") if t.is_valid else b"" for t in column]
    flat = np.frombuffer(b"".join(rows), "<u2").astype(np.uint64)
    size = np.array([len(r) // 2 for r in rows], np.int64)
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    order = np.argsort(-size, kind="stable")
    state = np.full(len(rows), 0x811C9DC5, np.uint64)
    for k in range(int(size.max(initial=0))):
        live = order[: int(np.searchsorted(-size[order], -k, "left"))]
        state[live] = ((state[live] ^ flat[start[live] + k]) * np.uint64(0x01000193)) & np.uint64(0xFFFFFFFF)
    return state


@arrow_udf(T.LongType())
def fnv1a(text: pa.Array) -> pa.Array:
    """FNV-1a of a text as an unsigned number; null gives null."""
    return pa.array(fnv1a_array(text).astype(np.int64), mask=np.asarray(text.is_null()))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def raw_token(prefix: Column) -> Column:
    """Short token of a normalised prefix: its length and two hashes in base 36; '' for ''."""
    size = utf16_length(prefix)
    token = F.concat(F.lit("rfp1:"), base36(size), F.lit(":"), base36(fnv1a(prefix)), base36(fnv1a(F.concat(size.cast("string"), F.lit(":"), prefix))))
    return F.when(prefix == "", F.lit("")).otherwise(token)


def turn_marker(raw_fingerprint: Column, turn: Column) -> Column:
    """The turn's token, or empty:<turn> for turns too short to have one."""
    return F.coalesce(F.nullif(raw_fingerprint, F.lit("")), F.concat(F.lit("empty:"), F.coalesce(turn, F.lit(0)).cast("string")))


def record_id(*parts: Column) -> Column:
    """A repeatable record id."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
