"""Recall: scoring, ranking, reranking and merging of index records for batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoflow.functions import keys, lexical, vectors
from mnemoflow.functions.text import js_trim, strip_code, trim_text, xml_escape
from mnemoflow.session import checkpoint_dir

BLOCK = 4096
#: How far below another a cosine may be and still come before it: the greatest boost, and what rounding adds.
SLACK = lexical.BOOST_MOST + 0.001
QUERY_UNITS = 800
QUERY_PREFIX = "当前问题：用户："
ALLOWED_TYPES = ("normal", "continue", "regenerate", "swipe")
ROLE_MARK = "\n角色卡："
# The lines around recalled fragments.
PROMPT_HEAD = (
    "<role_memory_vector_recall>\n  <description>\n"
    "    以下内容是从往期对话记录中按当前输入检索出的相关记忆分片，并非全部历史。\n"
    "    请尽力理解这些分片之间的前因后果、人物关系和情绪延续，理清它们与当前对话的关联。\n"
    "    这些分片已按原对话时间顺序排列；它们不一定是今天或刚才发生的内容，请不要误当作当前现场，只把它们作为过往经历和关系背景参考。\n"
    "  </description>\n"
)
PROMPT_TAIL = "\n</role_memory_vector_recall>"


def build_queries(latest: DataFrame, text: str = "mes", tags: str | None = None) -> DataFrame:
    """conv_id, query_text, embed_text, terms from the latest user messages; blank ones are left out."""
    query = trim_text(strip_code(F.col(text), tags), QUERY_UNITS)
    rows = latest.select("conv_id", query.alias("query_text")).where("query_text <> ''")
    return rows.select("conv_id", "query_text", F.concat(F.lit(QUERY_PREFIX), F.col("query_text")).alias("embed_text"), lexical.query_terms(F.col("query_text")).alias("terms"))


def manual_search(latest: DataFrame, query: str, text: str = "mes") -> DataFrame:
    """The latest user messages with a searched text in place of theirs; recall takes them like any others."""
    return latest.withColumn(text, F.lit(query))


def allowed_type(kind: Column) -> Column:
    return kind.isNull() | kind.isin(*ALLOWED_TYPES)


def without_turns(index: DataFrame, turns: DataFrame) -> DataFrame:
    """The records without those of the turns (conv_id, marker), by the raw fingerprint or where that is missing by the cleaned one."""
    token = F.coalesce(F.nullif("raw_turn_fingerprint", F.lit("")), F.nullif("turn_fingerprint", F.lit("")))
    barred = turns.select(F.col("conv_id").alias("_c"), F.col("marker").alias("_m")).distinct()
    return index.withColumn("_t", token).join(barred, (F.col("conv_id") == F.col("_c")) & (F.col("_t") == F.col("_m")), "left_anti").drop("_t")


def _block_pairs(table: pa.Table, strict: bool, threshold: float, most: int) -> pa.Table:
    """Of one block of records and one of queries the pairs that may be among a query's best, by matrix products of vectors of one length."""
    side, frags, queries = table.column("side").to_numpy(), table.column("frag_id").combine_chunks(), table.column("query_id").combine_chunks()
    model = table.column("model_key").to_pandas().to_numpy(float, na_value=np.nan)
    dims, key = table.column("embedding_dims").to_pandas().fillna(0).to_numpy(int), table.column("content_key").to_pandas().fillna(0).to_numpy(np.int64)
    stored, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    values = table.column("v").combine_chunks()
    sizes = np.asarray(values.value_lengths().fill_null(0))
    matrix = lambda rows: values.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    out = []
    for part in (asked[i : i + 256] for i in range(0, len(asked), 256)):
        score = np.full((len(part), len(stored)), -1.0)
        for m in np.unique(sizes[part]):
            q = np.flatnonzero(sizes[part] == m)
            x = np.nan_to_num(matrix(part[q]))
            for n in np.unique(sizes[stored]):
                r = np.flatnonzero(sizes[stored] == n)
                k = min(m, n)
                y = matrix(stored[r])[:, :k]
                norm = np.sqrt((x[:, :k] ** 2).sum(1))[:, None] * np.sqrt((y**2).sum(1))[None, :]
                score[np.ix_(q, r)] = np.divide(x[:, :k] @ y.T, norm, out=np.full(norm.shape, -1.0), where=norm > 0)
        a, b = model[part][:, None], model[stored][None, :]
        fits = (a == b) | (np.isnan(a) & np.isnan(b)) if strict else (a == b) | np.isnan(a) | np.isnan(b)
        fits &= (dims[stored][None, :] == 0) | (dims[stored][None, :] == sizes[part][:, None])
        score[~fits | (score < threshold)] = -1
        for i, row in enumerate(score):
            order = np.argsort(-row, kind="stable")
            order = order[row[order] > -1]
            _, first = np.unique(key[stored[order]], return_index=True)
            best = np.sort(first)
            if len(best) > most:
                order = order[row[order] >= row[order[best[most - 1]]] - SLACK]
            out.append((np.full(len(order), part[i]), stored[order], row[order]))
    q, r, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pa.table({"query_id": queries.take(pa.array(q, pa.int64())), "frag_id": frags.take(pa.array(r, pa.int64())), "raw_score": pa.array(s, pa.float64())})


def _heavy_pairs(asked: DataFrame, rows: DataFrame, vector: str, threshold: float, most: int, strict: bool) -> DataFrame:
    """query_id, frag_id, raw_score, content_key of conversations cut into _nx blocks."""
    every = F.explode(F.sequence(F.lit(0), F.col("_nx") - 1))
    numbers = lambda c: vectors.decode_int8(F.base64(c)).cast("array<double>")
    kind = lambda c: F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(c), F.lit(1 << 52)))
    ids = {c: f.schema[c].dataType.simpleString() for c, f in (("query_id", asked), ("frag_id", rows))}
    null = lambda kind: F.lit(None).cast(kind)
    stored = rows.select("conv_id", F.pmod(F.xxhash64("frag_id"), F.col("_nx")).cast("int").alias("xb"), every.alias("qb"), F.lit(0).alias("side"), "frag_id", null(ids["query_id"]).alias("query_id"), kind("embedding_model").alias("model_key"), "embedding_dims", "content_key", numbers("vec").alias("v"))
    asked_numbers = numbers("query_q") if vector == "query_q" else F.col("query_vec").cast("array<double>")
    wanted = asked.select("conv_id", every.alias("xb"), F.pmod(F.xxhash64("query_id"), F.col("_nx")).cast("int").alias("qb"), F.lit(1).alias("side"), null(ids["frag_id"]).alias("frag_id"), "query_id", kind("model").alias("model_key"), null("int").alias("embedding_dims"), null("long").alias("content_key"), asked_numbers.alias("v"))
    # blocks that nobody asks aren't made
    blocks = stored.join(wanted.select("conv_id", "qb").distinct(), ["conv_id", "qb"], "left_semi").unionByName(wanted)
    found = blocks.groupBy("conv_id", "xb", "qb").applyInArrow(lambda t: _block_pairs(t, strict, threshold, most), f"query_id {ids['query_id']}, frag_id {ids['frag_id']}, raw_score double")
    return found.join(rows.select("frag_id", "content_key"), "frag_id").select("query_id", "frag_id", "raw_score", "content_key")


def candidates(queries: DataFrame, index: DataFrame, threshold: float, most: int, excluded: DataFrame | None = None, strict_model: bool = True) -> DataFrame:
    """query_id, frag_id, raw_score: of each query's conversation the records of at least that cosine which may be among its best ``most``.

    ``queries``: query_id, conv_id, model, query_q (int8 bytes) or query_vec (numbers); ``index``: the stored columns with vec (int8 bytes). Records that are
    disabled, without vector, of another model (with ``strict_model`` off only where both are known), of other dimensions, or of an
    excluded turn (conv_id, marker) are out. Left out as well are those whose cosine lies so far below the ``most`` best contents that no lexical boost
    makes up for it. Queries and records of a conversation are joined without their texts; of conversations of more than ``BLOCK`` records, blocks of both
    are compared in tasks of their own.
    """
    rows = index.where(~F.col("enabled").eqNullSafe(False) & (F.length("vec") > 0))
    if excluded is not None:
        checkpoint_dir(index.sparkSession)
        rows = without_turns(rows, excluded.select("conv_id", "marker").distinct().checkpoint())  # read again for every way the records are
    content = F.xxhash64(keys.recall_fingerprint(*[F.col(c) for c in ("paragraph", "summary", "source_text", "turn", "sequence")]))
    rows = rows.select("conv_id", "frag_id", "embedding_model", "embedding_dims", "vec", content.alias("content_key")).join(queries.select("conv_id").distinct(), "conv_id", "left_semi")
    vector = "query_q" if "query_q" in queries.columns else "query_vec"
    asked = queries.select("query_id", "conv_id", "model", vector)
    large = rows.groupBy("conv_id").agg(F.count("*").alias("_size")).where(F.col("_size") > BLOCK)
    large = large.select("conv_id", F.ceil(F.col("_size") / BLOCK).cast("int").alias("_nx"))
    size = F.length(vector) if vector == "query_q" else F.size(vector)
    known = F.col("model").isNotNull() & F.col("embedding_model").isNotNull()
    same = F.col("embedding_model").eqNullSafe(F.col("model")) if strict_model else ~known | (F.col("embedding_model") == F.col("model"))
    dims = F.col("embedding_dims").isNull() | (F.col("embedding_dims") == 0) | (F.col("embedding_dims") == size)
    cosine = vectors.cosine_bytes(F.col("query_q"), F.col("vec")) if vector == "query_q" else vectors.cosine_query(F.col("query_vec"), F.col("vec"))
    crowded = not large.isEmpty()
    light = asked.join(large, "conv_id", "left_anti") if crowded else asked
    pairs = light.join(rows, "conv_id").where(same & dims).withColumn("raw_score", cosine)
    pairs = pairs.where((F.col("raw_score") > -1) & (F.col("raw_score") >= threshold)).select("query_id", "frag_id", "raw_score", "content_key")
    if crowded:
        pairs = pairs.unionByName(_heavy_pairs(asked.join(large, "conv_id"), rows.join(large, "conv_id"), vector, threshold, most, strict_model))
    best = Window.partitionBy("query_id").orderBy(F.col("raw_score").desc())
    least = pairs.groupBy("query_id", "content_key").agg(F.max("raw_score").alias("raw_score")).withColumn("_r", F.row_number().over(best)).where(F.col("_r") == most)
    least = least.select("query_id", (F.col("raw_score") - SLACK).alias("_least"))
    return pairs.join(least, "query_id", "left").where(F.col("_least").isNull() | (F.col("raw_score") >= F.col("_least"))).select("query_id", "frag_id", "raw_score")


def recalled(queries: DataFrame, index: DataFrame, threshold: float, most: int, excluded: DataFrame | None = None, strict_model: bool = True) -> DataFrame:
    """The best ``most`` records of every query with raw_score, lexical, score and rank; the texts are joined to the candidates only.

    ``queries`` as in :func:`candidates`, with terms and any other columns but the records'.
    """
    checkpoint_dir(queries.sparkSession)
    found = candidates(queries, index, threshold, most, excluded, strict_model).checkpoint()  # a few numbers a query
    asked = queries.drop("query_q", "query_vec", "model", "conv_id")
    rows = found.join(index.drop("vec", "embedding_q"), "frag_id").join(asked, "query_id")
    rows = rows.withColumn("lexical", lexical.lexical_match(F.col("source_text"), F.col("summary"), F.col("terms"))).drop("terms")
    return ranked(rows.withColumn("score", F.col("raw_score") + F.col("lexical.boost")), most)


def score_order() -> list[Column]:
    """By score to four places, then newer turns, then the exact score; frag_id settles what is left."""
    return [F.round("score", 4).desc(), F.coalesce("turn", F.lit(0)).desc(), F.col("score").desc(), F.col("frag_id")]


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """The best ``most`` rows of every query with ``rank``, records of equal content only once."""
    fingerprint = keys.recall_fingerprint(*[F.col(c) for c in ("paragraph", "summary", "source_text", "turn", "sequence")])
    best_of = Window.partitionBy("query_id", "_f").orderBy(*score_order())
    once = rows.withColumn("_f", fingerprint).withColumn("_k", F.row_number().over(best_of)).where("_k = 1").drop("_f", "_k")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*score_order()))).where(F.col("rank") <= most)


def apply_rerank(rows: DataFrame, reranked: DataFrame, top_k: int, threshold: float = 0.35) -> DataFrame:
    """Ranked rows replaced by what a reranker says of them: rerank_score, score, rank, used_fallback.

    ``reranked``: query_id, index (rank - 1), relevance_score; an index that comes twice gives its row twice. Queries of which
    the reranker returned nothing at all keep their first ``top_k`` rows and are marked as fallen back.
    """
    answered = reranked.select("query_id").distinct()
    good = reranked.where(F.col("relevance_score") >= threshold).select("query_id", (F.col("index") + 1).alias("rank"), "relevance_score")
    order = Window.partitionBy("query_id").orderBy(F.col("relevance_score").desc(), "_old")
    hit = rows.join(good, ["query_id", "rank"]).withColumnRenamed("rank", "_old").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    hit = hit.withColumn("rerank_score", F.col("relevance_score")).withColumn("score", F.col("relevance_score")).drop("_old", "relevance_score").withColumn("used_fallback", F.lit(False))
    rest = rows.join(answered, "query_id", "left_anti").where(F.col("rank") <= top_k).withColumn("rerank_score", F.lit(None).cast("double")).withColumn("used_fallback", F.lit(True))
    return hit.unionByName(rest)


def _best_text() -> Column:
    return js_trim(F.coalesce(F.nullif("paragraph", F.lit("")), F.nullif("summary", F.lit("")), F.nullif("source_text", F.lit("")), F.lit("")))


def merge_same_turn(rows: DataFrame, live_turns: DataFrame | None = None) -> DataFrame:
    """Rows of one query and turn become one, at the place of the first, with the best score: adds text and merged.

    The text is the turn's current one (``live_turns``: conv_id, raw_turn_fingerprint, turn_fingerprint, full_text, found by either fingerprint), else it
    is put together from the fragments: the user's part once, then the replies. Turns of 0 or null aren't merged. ``rows`` hold a bounded
    number of records of each query, as ranked and apply_rerank leave them.
    """
    group = Window.partitionBy("query_id", "turn")
    counted = rows.withColumn("_n", F.when(F.col("turn") > 0, F.count("*").over(group)).otherwise(1))
    parts = F.struct(F.coalesce(F.nullif("turn", F.lit(0)), F.lit(2**31 - 1)).alias("t"), F.coalesce("sequence", F.lit(0)).alias("s"), "rank", _best_text().alias("x"))
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in ("query_id", "turn", "score", "raw_score", "rank")]), F.struct("score", (-F.col("rank")).alias("r")))
    merged = counted.where("_n > 1").groupBy("query_id", "turn").agg(F.max("score").alias("score"), F.max("raw_score").alias("raw_score"), F.min("rank").alias("rank"), best.alias("_b"), F.array_sort(F.collect_list(parts)).alias("_p"))
    merged = merged.select("query_id", "turn", "score", "raw_score", "rank", "_b.*", "_p")
    texts = F.transform("_p", lambda p: p["x"])
    at = lambda x: F.instr(x, ROLE_MARK)
    users = F.filter(F.transform(F.slice(F.filter(texts, lambda x: at(x) > 0), 1, 1), lambda x: js_trim(F.substring(x, F.lit(1), at(x) - 1))), lambda x: x != "")
    replies = F.filter(F.transform(F.filter(texts, lambda x: x != ""), lambda x: F.when(at(x) > 0, js_trim(x.substr(at(x) + len(ROLE_MARK), F.length(x)))).otherwise(x)), lambda x: x != "")
    role = F.when(F.size(replies) > 0, F.concat(F.lit("角色卡："), F.array_join(replies, "\n\n")))
    rebuilt = F.concat_ws("\n\n", F.nullif(F.array_join(users, "\n\n"), F.lit("")), role)
    if live_turns is not None:
        both = live_turns.select("conv_id", "full_text", "turn", F.explode(F.array("raw_turn_fingerprint", "turn_fingerprint")).alias("_token")).where("_token <> ''")
        live = both.groupBy("conv_id", "_token").agg(F.max_by("full_text", "turn").alias("_live"))
        merged = merged.withColumn("_token", F.coalesce(F.nullif("raw_turn_fingerprint", F.lit("")), F.col("turn_fingerprint"))).join(live, ["conv_id", "_token"], "left")
        rebuilt = F.coalesce(F.nullif("_live", F.lit("")), rebuilt)
    columns = [*rows.columns]
    merged = merged.withColumn("text", rebuilt).withColumn("merged", F.lit(True)).select(*columns, "text", "merged")
    single = counted.where("_n = 1").withColumn("text", _best_text()).withColumn("merged", F.lit(False)).select(*columns, "text", "merged")
    return merged.unionByName(single)


def time_order() -> list[Column]:
    """Order of events: turns, those of 0 or null last, then sequence."""
    turn = F.coalesce(F.nullif("turn", F.lit(0)).cast("long"), F.lit(2**53 - 1))
    return [turn, F.coalesce("sequence", F.lit(0)), F.col("rank")]


def recall_prompts(merged: DataFrame, order: str = "score") -> DataFrame:
    """query_id, prompt: the recalled texts as one block of markup, by ``order`` score or time. Queries without text have no row."""
    rows = merged.where("text <> ''")
    percent = F.format_string("%.1f", F.floor(F.coalesce("rerank_score", "score") * 1000 + 0.5) / 10) if "rerank_score" in merged.columns else F.format_string("%.1f", F.floor(F.col("score") * 1000 + 0.5) / 10)
    one = F.concat(
        F.lit('  <memory_fragment turn="'), xml_escape(F.coalesce("turn", F.lit(0))), F.lit('" similarity="'), percent, F.lit('%">\n    '), F.col("text"), F.lit("\n  </memory_fragment>")
    )
    place = F.struct(*(time_order() if order == "time" else [F.col("rank")]), one.alias("x"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(place)).alias("_l"))
    return lists.select("query_id", F.concat(F.lit(PROMPT_HEAD), F.array_join(F.transform("_l", lambda p: p["x"]), "\n"), F.lit(PROMPT_TAIL)).alias("prompt"))


def _two_places(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def recall_statistics(merged: DataFrame) -> DataFrame:
    """Per query: rows, turns in order, least and greatest score to two places."""
    score = F.coalesce("rerank_score", "score") if "rerank_score" in merged.columns else F.col("score")
    stats = merged.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", F.coalesce("turn", F.lit(0)).alias("t")))).alias("_t"), _two_places(F.min(score)).alias("least"), _two_places(F.max(score)).alias("most"))
    return stats.select("query_id", "n", F.array_join(F.transform("_t", lambda x: x["t"].cast("string")), ",").alias("turns"), "least", "most")


def inject_prompts(messages: DataFrame, latest: DataFrame, prompts: DataFrame) -> DataFrame:
    """Messages with each conversation's prompt as an injected user message right before its latest user message, renumbered.

    ``latest``: conv_id, msg_index; ``prompts``: conv_id, prompt. Conversations without prompt stay as they are.
    """
    at = latest.select("conv_id", F.col("msg_index").alias("_at")).join(prompts.select("conv_id", "prompt"), "conv_id")
    moved = messages.join(at.select("conv_id", "_at"), "conv_id", "left")
    moved = moved.withColumn("msg_index", F.when(F.col("msg_index") >= F.col("_at"), F.col("msg_index") + 1).otherwise(F.col("msg_index"))).drop("_at")
    added = at.select("conv_id", F.col("_at").alias("msg_index"), F.col("prompt").alias("mes"), F.lit(True).alias("is_user"), F.lit("user").alias("role"), F.lit(True).alias("injected"))
    return moved.unionByName(added, allowMissingColumns=True)
