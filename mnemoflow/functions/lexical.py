"""Query terms and the lexical boost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that say nothing about a query.
STOP_TERMS = ("是不是", "有没有", "为什么", "怎么样", "怎么办", "什么", "这个", "那个", "还是", "还在", "还会", "了吗", "吗", "呢", "啊", "吧", "的", "了", "我", "你", "她", "他")
MOST_TERMS, LONGEST_GRAM = 20, 4
BOOST_STEP, BOOST_MOST = 0.015, 0.08


def query_terms(text: Column) -> Column:
    """Up to 20 terms of a query, longer ones first, ties in the order met.

    Latin words of two and more letters in lower case; Han runs as all their parts of 4 to 2 letters, single letters as they are.
    """
    stop = F.array(*[F.lit(t) for t in STOP_TERMS])
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\p{IsHan}A-Za-z0-9_]+", " "), " +"), lambda p: p != "")

    def grams(han: Column) -> Column:
        n = F.length(han)
        sizes = F.filter(F.array(*[F.lit(k) for k in range(LONGEST_GRAM, 1, -1)]), lambda k: k <= n)
        return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: han.substr(i, k))))

    def terms(part: Column) -> Column:
        han = F.regexp_replace(part, "[^\\p{IsHan}]", "")
        return F.when(part.rlike("\\A[A-Za-z0-9_]{2,}\\z"), F.array(F.lower(part))).when(F.length(han) >= 2, grams(han)).when(F.length(han) == 1, F.array(han)).otherwise(F.array().cast("array<string>"))

    found = F.filter(F.array_distinct(F.flatten(F.transform(parts, terms))), lambda t: ~F.array_contains(stop, t))
    ranked = F.array_sort(F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.slice(F.transform(ranked, lambda s: s["t"]), 1, MOST_TERMS)


def lexical_match(source_text: Column, summary: Column, terms: Column) -> Column:
    """struct(hits, boost, matched): the terms that occur in a record's text, and the boost they give."""
    text = F.lower(F.concat(F.coalesce(source_text, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit(""))))
    matched = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.contains(text, F.lower(t)))
    return F.struct(F.size(matched).alias("hits"), F.least(F.lit(BOOST_MOST), F.size(matched) * F.lit(BOOST_STEP)).alias("boost"), matched.alias("matched"))
