"""Cleaning and measuring of message text as column expressions.

White space is the set that the trimming and the ``\\s`` of a browser take, wider than Java's. Lengths are UTF-16 code units.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: The same set for Python's strip.
WHITE_CHARS = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Wrapper blocks that are stripped with what they hold; * stands for any further letters of a name.
DEFAULT_STRIP_TAGS = "think*, thinking, thought*, cot*, plan, *planning*, analysis, updatevariable, jsonpatch, current_event, progress, selection, summary, status*, konatan_*"
# Elements that go with their content, and elements without content.
CONTENT_ELEMENTS = "script|style|template|svg|canvas|iframe|object|embed|head|link|meta"
VOID_ELEMENTS = "script|style|template|svg|canvas|iframe|object|embed|link|meta|input|img|br|hr"
# How lines of code begin.
CODE_WORDS = "const|let|var|function|class|import|export|return|if|else|for|while|switch|try|catch"
FINGERPRINT_PUNCTUATION = "，。、“”‘’：；！？,.!?;:\"'`~"

_ANY = "[\\s\\S]"
_WORD_END = "(?![A-Za-z0-9_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def js_trim(text: Column) -> Column:
    """The text without white space around it."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+\\z", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units: code points and once more those beyond the basic plane."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def strip_tag_patterns(tags: str | None) -> list[tuple[str, str, str]]:
    """(paired, closing only, opening only) patterns of a comma- or line-separated tag list; blank means the default list."""
    listed = tags if tags and tags.strip(WHITE_CHARS) else DEFAULT_STRIP_TAGS
    out = []
    for entry in re.split("[,，\n]+", listed):
        name = entry.strip(WHITE_CHARS)
        if not name:
            continue
        star = f"[^<>/{WHITE}]*"
        body = "".join(star if c == "*" else re.sub(r"([.+?^${}()|\[\]\\])", r"\\\1", c) for c in name)
        opening = f"<[{WHITE}]*({body})(?:[{WHITE}][^>]*)?>"
        out.append((f"(?i){opening}{_ANY}*?</[{WHITE}]*\\1[{WHITE}]*>", f"(?i)\\A{_ANY}*?</[{WHITE}]*({body})[{WHITE}]*>", f"(?i){opening}{_ANY}*\\z"))
    return out


def strip_tag_blocks(text: Column, tags: str | None = None) -> Column:
    """Drop configured blocks: first pairs, then per entry what precedes a lone closing tag and what follows a lone opening one."""
    patterns = strip_tag_patterns(tags)

    def stripped(out: Column) -> Column:
        for pair, _, _ in patterns:
            out = F.regexp_replace(out, pair, "")
        for _, closing, opening in patterns:
            out = F.regexp_replace(F.regexp_replace(out, closing, ""), opening, "")
        return out

    return _where(text, "<", stripped)


def _where(text: Column, char: str, body: Callable[[Column], Column]) -> Column:
    """``body`` of the texts that hold a character without which it changes nothing."""
    return let(text, lambda x: F.when(F.contains(x, F.lit(char)), body(x)).otherwise(x))


def _without(patterns: Sequence[str]) -> Callable[[Column], Column]:
    def body(out: Column) -> Column:
        for pattern in patterns:
            out = F.regexp_replace(out, pattern, "")
        return out

    return body


def strip_markup_blocks(text: Column) -> Column:
    """Drop image prompts, thoughts, fences, documents, elements, comments and short inline code, in this order."""
    # The patterns of what is dropped.
    out = F.regexp_replace(text, f"(?i)image###{_ANY}*?###", "")
    out = _where(out, "<", _without((f"(?i)<think(?:ing)?{_WORD_END}[^>]*>{_ANY}*?</think(?:ing)?>", f"(?i)<image>{_ANY}*?</image>")))
    out = F.regexp_replace(F.regexp_replace(out, f"```{_ANY}*?```", ""), f"~~~{_ANY}*?~~~", "")
    elements = (
        f"(?i)<!DOCTYPE{_ANY}*?>",
        f"(?i)<html{_ANY}*?</html>",
        f"(?i)<({CONTENT_ELEMENTS}){_ANY}*?</\\1>",
        f"(?i)<({VOID_ELEMENTS}){_WORD_END}[^>]*/?[{WHITE}]*>",
        f"<!--{_ANY}*?-->",
    )
    return F.regexp_replace(_where(out, "<", _without(elements)), "`[^`\n]{1,200}`", "")


def is_code_line(line: Column) -> Column:
    """Whether a line looks like code or markup; blank lines don't."""
    return let(js_trim(line), _looks_like_code)


def _looks_like_code(t: Column) -> Column:
    # The patterns by which a line is code.
    tests = (
        t.rlike(f"\\A</?[^{WHITE}<>]{{1,30}}/?>\\z")
        | t.rlike(f"(?i)\\A</?[a-z][A-Za-z0-9_:-]*([{WHITE}]|>|/>)")
        | t.rlike("\\A[{}()\\[\\];,]+\\z")
        | t.rlike(f"\\A({CODE_WORDS}){_WORD_END}")
        | t.rlike(f"\\A(#include|using[{WHITE}]+namespace|public:|private:|protected:|def[{WHITE}]+|from[{WHITE}]+[^{WHITE}]+[{WHITE}]+import[{WHITE}]+)")
        | t.rlike("(?i)\\A(@click|v-if|v-for|v-model|class=|style=|id=|data-|aria-)")
        | t.rlike(f"\\A[.#]?[a-zA-Z0-9_-]+[{WHITE}]*\\{{")
        | (t.rlike("[{};]") & t.rlike(f"(=>|===|!==|&&|\\|\\||;[{WHITE}]*\\z|:[{WHITE}]*function|(?<![A-Za-z0-9_])console\\.|(?<![A-Za-z0-9_])document\\.|(?<![A-Za-z0-9_])window\\.)"))
        | (t.rlike(f"(?i)</?[a-z][A-Za-z0-9_:-]*{_ANY}*?>") & ~t.rlike("[，。！？、]"))
    )
    return (t != "") & tests


def strip_code(text: Column, tags: str | None = None) -> Column:
    """The prose of a message: without configured blocks, markup, code and code-like lines, entities decoded once, blanks tidied.

    Null becomes ''. ``&amp;lt;`` becomes ``<``, as the ampersand is decoded first.
    """
    out = strip_markup_blocks(strip_tag_blocks(F.coalesce(text, F.lit("")), tags))
    lines = F.filter(F.split(out, "\r?\n", -1), lambda line: ~is_code_line(line))
    out = F.array_join(lines, "\n")
    out = _where(out, "<", _without(("(?i)</?[a-z][A-Za-z0-9_:-]*(?<=[A-Za-z0-9_])" + _WORD_END + "[^>]*>", f"</?[^{WHITE}<>]{{1,30}}/?>")))

    def decoded(plain: Column) -> Column:
        for entity, char in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#039", "'")):
            plain = F.regexp_replace(plain, f"(?i)&{entity};", char)
        return plain

    out = _where(out, "&", decoded)
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]{2,}", " "), "\n{3,}", "\n\n")
    return js_trim(out)


def trim_text(text: Column, most: int) -> Column:
    """The trimmed text with at most one blank line in a row, cut to ``most`` code units and marked with ... where it was longer."""
    clean = js_trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\n{3,}", "\n\n"))
    return let(clean, lambda c: F.when(utf16_length(c) <= most, c).otherwise(F.concat(utf16_prefix(c, most), F.lit("..."))))


def utf16_prefix(text: Column, units: int) -> Column:
    """The first code units; a pair that the cut would split is left out."""

    def cut(x: Column) -> Column:
        data = F.encode(x, "UTF-16BE")
        split = F.hex(F.substring(data, 2 * units - 1, 1)).between("D8", "DB")  # the last unit is the first of a pair
        wide = F.decode(F.substring(data, F.lit(1), F.when(split, 2 * units - 2).otherwise(2 * units)), "UTF-16BE")
        return F.when(F.length(x) != utf16_length(x), wide).otherwise(F.substring(x, 1, units))

    return let(text, cut)


def _escaped(value: Column, apostrophe: str) -> Column:
    out = F.coalesce(value.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def xml_escape(value: Column) -> Column:
    return _escaped(value, "&apos;")


def html_escape(value: Column) -> Column:
    return _escaped(value, "&#039;")


def clamp(value: Column, low: float, high: float, fallback: float) -> Column:
    """A setting within its bounds; blank and null count as 0, what isn't a number or not finite gives the fallback."""
    text = F.coalesce(value.cast("string"), F.lit("0"))
    number = F.when(js_trim(text) == "", F.lit(0.0)).otherwise(js_trim(text).try_cast("double"))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(finite, F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number))).otherwise(F.lit(float(fallback)))


def suggested_tags(reply: Column, known: Sequence[str]) -> Column:
    """Tag names in a model's reply that the list doesn't hold yet, in their order."""
    tokens = F.transform(F.split(F.coalesce(reply, F.lit("")), f"[,，、{WHITE}]+"), lambda t: F.regexp_replace(t, "\\A</?|/?>\\z", ""))
    good = F.filter(tokens, lambda t: (F.lower(t) != "none") & t.rlike("\\A[A-Za-z0-9_~*\\-一-鿿]{1,30}\\z"))
    lowered = F.array(*[F.lit(k.lower()) for k in known]) if known else F.array().cast("array<string>")
    return F.filter(F.array_distinct(good), lambda t: ~F.array_contains(lowered, F.lower(t)))
