"""Problem 7: mixing sources to target weights, by iterative proportional fitting.

Every document is counted in tokens and falls in a cell of source, language and topic. Topics are learned: clusters of the documents' token
profiles, taken relative to the mean profile of the language. The fit raises or lowers each cell by the product of a source's,
a language's and a topic's factor, no cell beyond the repeats that its source may have. The factors of languages and topics are few; those of the sources
follow from them source by source, so that a round is one pass over the sources. Documents are then drawn systematically at their cells' rates.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoflow.llm.codepoints import mix
from mnemoflow.session import checkpoint_dir

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The languages that are cells of their own; every other spelling is "other".
LANGS = ("en", "zh", "ja", "de", "fr", "es", "ru", "hi", "ar", "th")
N_LANG = len(LANGS) + 1
UNIT = 1 << 24  # parts of one copy in which rates are drawn


@dataclass(frozen=True)
class MixParams:
    tokenizer: str = DEFAULT_TOKENIZER
    topics: int = 8
    topic_rounds: int = 8
    dims: int = 64  # places of a document's token profile; tokens share them by hash
    first_sample: int = 512  # documents, those of the lowest hashes, from which the clusters' first centres are chosen
    rounds: int = 200
    tolerance: float = 1e-7
    seed: int = 7
    starts: int = 16  # of the systematic draw, tried for every source
    at_once: int = 4096  # sources of one fitting step; up to so many are fitted in one task, more in as many as they fill


def language(lang: Column) -> Column:
    """Language cell of a tag: its primary part in lower case if it is in ``LANGS``, else "other"."""
    primary = F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), "^\\s*([A-Za-z]+)", 1))
    return F.when(primary.isin(*LANGS), primary).otherwise("other")


def count_tokens(documents: DataFrame, text: str = "text", out: str = "tokens", tokenizer: str = DEFAULT_TOKENIZER, dims: int = 0) -> DataFrame:
    """The rows with ``out``, the tokens of ``text`` by a public byte-level vocabulary, in place of ``text``.

    With ``dims`` also profile: so many bytes, the root of each place's share of the tokens. Null and empty texts have 0 tokens. The vocabulary,
    a fixed file, is broadcast.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(open(tokenizer, "rb").read())
    names = [c for c in documents.columns if c not in (text, out, *(["profile"] if dims else []))]
    schema = documents.select(*names).schema.add(out, "long")
    if dims:
        schema = schema.add("profile", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("shared", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        place = mix(np.arange(max(ranks.values()) + 1, dtype=np.uint64)) % np.uint64(max(1, dims))
        for batch in batches:
            counts, profiles = [], []
            for t in batch.column(text):
                ids = encoding.encode_ordinary(t.as_py()) if t.is_valid else []
                counts.append(len(ids))
                if dims:
                    share = np.bincount(place[ids].astype(np.int64), minlength=dims) / max(1, len(ids)) if ids else np.zeros(dims)
                    profiles.append((np.sqrt(share) * 255).round().astype(np.uint8).tobytes())
            made = [pa.array(counts, pa.int64()), *([pa.array(profiles, pa.binary())] if dims else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, out, *(["profile"] if dims else [])])

    return documents.select(*names, text).mapInArrow(run, schema)


def _profiles(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    lang = np.array([LANGS.index(x) if x in LANGS else len(LANGS) for x in batch.column("lang_cell").to_pylist()], int)
    return np.frombuffer(b"".join(batch.column("profile").to_pylist()), np.uint8).reshape(-1, dims), lang


def _nearest(x: np.ndarray, lang: np.ndarray, means: np.ndarray, centres: np.ndarray) -> np.ndarray:
    rest = x - means[lang]
    return ((centres**2).sum(1)[None, :] - 2 * rest @ centres.T).argmin(1)


@dataclass
class Topics:
    """Clusters of token profiles: the mean profile of each language, and the clusters' centres relative to it."""

    means: np.ndarray
    centres: np.ndarray

    def assigned(self, rows: DataFrame) -> DataFrame:
        """The rows with topic, the number of the nearest cluster, in place of profile."""
        names = [c for c in rows.columns if c not in ("topic", "profile")]
        dims = self.means.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                topic = _nearest(*_profiles(batch, dims), self.means, self.centres)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(topic.astype(np.int32))], [*names, "topic"])

        return rows.select(*names, "profile").mapInArrow(run, rows.select(*names).schema.add("topic", "integer"))


def learn_topics(rows: DataFrame, p: MixParams = MixParams()) -> Topics:
    """Topics of rows with doc_id, lang_cell and profile, by Lloyd's rounds over all of them.

    What comes back from a round are whole-number sums by language and cluster, a table of fixed size, so the result doesn't depend on the partitioning.
    """

    def sums(assign: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((N_LANG * k, p.dims + 1), np.int64)
            for batch in batches:
                x, lang = _profiles(batch, p.dims)
                np.add.at(total, lang * k + assign(x, lang), np.concatenate((x.astype(np.int64), np.ones((len(x), 1), np.int64)), 1))
            at = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["place", "value"])

        out = np.zeros(N_LANG * k * (p.dims + 1))
        for r in rows.select("lang_cell", "profile").mapInArrow(run, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).toLocalIterator():
            out[r.place] = r.value
        return out.reshape(N_LANG, k, p.dims + 1)

    by_lang = sums(lambda x, lang: np.zeros(len(x), int), 1)[:, 0]
    means = by_lang[:, :-1] / np.maximum(by_lang[:, -1:], 1)
    first = rows.select("lang_cell", "profile").orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.first_sample).toArrow().combine_chunks()
    centres = np.zeros((1, p.dims))
    if first.num_rows:
        x, lang = _profiles(first.to_batches()[0], p.dims)
        x = x - means[lang]
        chosen = [int(np.abs(x).sum(1).argmin())]
        while len(chosen) < min(p.topics, len(x)):  # next the document farthest from those chosen
            far = ((x[:, None, :] - x[chosen][None]) ** 2).sum(2).min(1)
            chosen.append(int(far.argmax()))
        centres = x[chosen]
    for _ in range(p.topic_rounds):
        total = sums(lambda x, lang: _nearest(x, lang, means, centres), len(centres))
        n = total[:, :, -1].sum(0)
        moved = (total[:, :, :-1] - total[:, :, -1:] * means[:, None, :]).sum(0) / np.maximum(n, 1)[:, None]
        moved = np.where(n[:, None] > 0, moved, centres)
        still = np.abs(moved - centres).max() < 1e-3
        centres = moved
        if still:
            break
    return Topics(means, centres)


def _goals(targets: DataFrame) -> DataFrame:
    """source, weight, max_repeats: one row per source that has both; a null max_repeats is 1."""
    rows = targets.where("source is not null and weight is not null").select("source", F.col("weight").cast("double").alias("weight"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("max_repeats"))
    return rows.groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("_t")).select("source", "_t.*")


def counted(documents: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, lang_cell, topic, tokens of the documents whose source has a target, written to the shared folder.

    So texts are tokenised once, and the loss of an executor costs nothing.
    """
    checkpoint_dir(documents.sparkSession)
    rows = documents.select("doc_id", "source", "lang", "text").join(_goals(targets).select("source"), "source", "left_semi")
    rows = rows.select("doc_id", "source", language(F.col("lang")).alias("lang_cell"), "text")
    rows = count_tokens(rows, tokenizer=p.tokenizer, dims=p.dims).checkpoint()
    return learn_topics(rows, p).assigned(rows)


def rates(have: np.ndarray, most: np.ndarray, reach: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """How often each cell of each source is taken: min(most, a * factor), the source's own a such that it gives ``reach`` in all.

    ``have``: tokens by source and cell; ``most`` and ``reach`` by source; ``factor`` by cell, the same for all sources.
    """
    order = np.argsort(-factor, kind="stable")
    h, f = have[:, order], factor[order]
    full = np.concatenate((np.zeros((len(h), 1)), np.cumsum(h, 1)), 1)
    open_ = np.cumsum((h * f)[:, ::-1], 1)[:, ::-1]
    open_ = np.concatenate((open_, np.zeros((len(h), 1))), 1)
    # the total when the j cells of the greatest factors are just full
    at = most[:, None] * full[:, :-1] + most[:, None] / f * open_[:, :-1]
    j = (at < reach[:, None]).sum(1)
    row = np.arange(len(h))
    rest = open_[row, np.minimum(j, h.shape[1])]
    a = np.divide(reach - most * full[row, np.minimum(j, h.shape[1])], rest, out=np.full(len(h), np.inf), where=rest > 0)
    a = np.where(reach >= most * h.sum(1), np.inf, a)
    with np.errstate(invalid="ignore"):
        return np.minimum(most[:, None], a[:, None] * factor)


def rake(sums: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], goals: tuple[np.ndarray, np.ndarray], rounds: int, tolerance: float) -> np.ndarray:
    """Factors by language and topic that bring the totals of both to their goals, as far as the sources allow.

    ``sums``: what all sources together take of every (language, topic) under given factors. The sources' totals hold throughout.
    """
    factors = [np.ones(n) for n in shape]
    best, least = np.ones(shape), np.inf
    for _ in range(rounds):
        miss = 0.0
        for axis in (0, 1):
            now = sums(np.outer(*factors).ravel()).reshape(shape)
            if axis == 0:
                miss = max(np.abs(now.sum(1 - x) - goals[x]).sum() for x in (0, 1)) / max(1.0, goals[0].sum())
                if miss < least:
                    best, least = np.outer(*factors), miss
                if miss <= tolerance:
                    return best
            mine = now.sum(1 - axis)
            ratio = np.divide(goals[axis], mine, out=np.ones_like(mine), where=(mine > 0) & (goals[axis] > 0))
            factors[axis] = np.clip(factors[axis] * ratio, 1e-9, 1e9)
    return best


def mixture(tokens: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> tuple[DataFrame, DataFrame]:
    """(cells, plan) of a mixture from per-document token counts.

    ``cells``: source, lang_cell, topic, tokens, use (tokens to take), rate (times that each document is taken on average).
    ``plan``: source, weight, max_repeats, tokens, wanted, use, short. T, the total that the
    weights divide, is the tokens of all documents whose source has a target. Language and topic keep the shares that they have
    in these documents as far as the sources' totals and repeats allow. A source that has too few tokens gives tokens x
    max_repeats and is short; its rest isn't given to others. Targets with a null source or weight are left out, a null max_repeats is 1.
    """
    spark = tokens.sparkSession
    checkpoint_dir(spark)
    n_cell = N_LANG * p.topics
    langs = F.array(*[F.lit(x) for x in (*LANGS, "other")])
    place = (F.array_position(langs, F.col("lang_cell")) - 1) * p.topics + F.col("topic")
    cells = tokens.groupBy("source", place.cast("int").alias("cell")).agg(F.sum("tokens").alias("tokens"))
    # at most as many entries a source as there are languages times topics
    per_source = cells.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("cell", "tokens"))).alias("cells"), F.sum("tokens").alias("tokens"))
    table = _goals(targets).join(per_source, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).checkpoint()
    shares = np.zeros(n_cell)
    for r in table.select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.tokens").alias("n")).toLocalIterator():
        shares[r.cell] = r.n
    total = float(shares.sum())

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        have = np.zeros((batch.num_rows, n_cell))
        for i, entries in enumerate(batch.column("cells").to_pylist()):
            for e in entries or ():
                have[i, e["cell"]] = e["tokens"]
        most = batch.column("max_repeats").to_numpy().astype(float)
        return have, most, np.minimum(batch.column("weight").to_numpy() * total, have.sum(1) * most)

    def taken(batch: pa.RecordBatch, factor: np.ndarray) -> np.ndarray:
        parts = [arrays(batch.slice(i, p.at_once)) for i in range(0, batch.num_rows, p.at_once)]
        return sum((have * rates(have, most, reach, factor)).sum(0) for have, most, reach in parts) if parts else np.zeros(n_cell)

    sources = table.select("source", "weight", "max_repeats", "cells")
    few = sources.limit(p.at_once + 1).toArrow()
    if few.num_rows <= p.at_once:
        batch = few.combine_chunks().to_batches()
        sums = lambda factor: taken(batch[0], factor) if batch else np.zeros(n_cell)
    else:

        def sums(factor: np.ndarray) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = sum((taken(b, factor) for b in batches), np.zeros(n_cell))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_cell)), pa.array(out)], ["cell", "use"])

            out = np.zeros(n_cell)
            for r in sources.mapInArrow(run, "cell long, use double").groupBy("cell").agg(F.sum("use").alias("use")).toLocalIterator():
                out[r.cell] = r.use
            return out

    every = sums(np.ones(n_cell)).sum()
    by = shares.reshape(N_LANG, p.topics) / max(1.0, total) * every
    factor = rake(sums, (N_LANG, p.topics), (by.sum(1), by.sum(0)), p.rounds, p.tolerance).ravel()

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, p.at_once):
                batch = whole.slice(i, p.at_once)
                have, most, reach = arrays(batch)
                rate = rates(have, most, reach, factor)
                row, cell = np.nonzero(have)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("source").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(have[row, cell].astype(np.int64)), pa.array(have[row, cell] * rate[row, cell]), pa.array(rate[row, cell])],
                    ["source", "cell", "tokens", "use", "rate"],
                )

    made = sources.mapInArrow(fitted, "source string, cell int, tokens long, use double, rate double")
    made = made.select("source", F.element_at(langs, F.floor(F.col("cell") / p.topics).cast("int") + 1).alias("lang_cell"), (F.col("cell") % p.topics).alias("topic"), "tokens", "use", "rate")
    use = made.groupBy("source").agg(F.sum("use").alias("use"))
    plan = table.drop("cells").join(use, "source", "left").withColumn("use", F.coalesce("use", F.lit(0.0))).withColumn("wanted", F.col("weight") * F.lit(total))
    # what the fit leaves short; the second test is the exact one
    short = (F.col("use") < F.col("wanted") * (1 - 1e-9)) & (F.col("tokens") * F.col("max_repeats") < F.col("wanted"))
    return made, plan.select("source", "weight", "max_repeats", "tokens", "wanted", "use", short.alias("short"))


def mix_plan(documents: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """What the fit takes of every source, and whether it falls short; see :func:`mixture`."""
    return mixture(counted(documents, targets, p), targets, p)[1]


def drawn(tokens: DataFrame, cells: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, tokens, copies: each document as often as its cell's rate says, drawn systematically.

    The documents of a source are put in the order of their length, and every time the running sum of their rates passes a whole number
    a copy is taken. So a source's total misses its plan by about one of its documents at most, whatever the start of the sum; of ``starts`` places to start from
    the one that misses least is taken. A document is never taken above max_repeats, and the draw doesn't depend on the partitioning. The running sum is taken
    within parts of documents of a length and over the parts' totals. Documents drawn 0 times are left out.
    """
    rows = tokens.join(cells.select("source", "lang_cell", "topic", "rate"), ["source", "lang_cell", "topic"])
    rows = rows.select("doc_id", "source", "tokens", "rate", F.round(F.col("rate") * UNIT).cast("long").alias("_u"), F.floor(F.log2(F.col("tokens") + 1) * 16).alias("_bin"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("_part"))
    earlier = Window.partitionBy("source").orderBy("_bin", "_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("source", "_bin", "_part").agg(F.sum("_u").alias("_n"))
    parts = parts.select("source", "_bin", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    within = Window.partitionBy("source", "_bin", "_part").orderBy("tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_to", F.sum("_u").over(within)).join(parts, ["source", "_bin", "_part"]).withColumn("_to", F.col("_from") + F.col("_to"))

    def copies(start: Column) -> Column:
        return F.shiftright(F.col("_to") + start, 24) - F.shiftright(F.col("_to") - F.col("_u") + start, 24)

    tried = summed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("rate")).alias("_want"), *[F.sum(F.col("tokens") * copies(F.lit(i * UNIT // p.starts))).alias(f"_s{i}") for i in range(p.starts)])
    miss = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_s{i}") - F.col("_want")).alias("miss"), F.lit(i * UNIT // p.starts).alias("start")) for i in range(p.starts)]))
    rows = summed.join(tried.select("source", miss["start"].alias("_start")), "source")
    return rows.select("doc_id", "source", "tokens", copies(F.col("_start")).cast("int").alias("copies")).where("copies > 0")


def mix_sample(documents: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, tokens, copies of the mixture; see :func:`drawn`."""
    tokens = counted(documents, targets, p)
    return drawn(tokens, mixture(tokens, targets, p)[0], p)


def mix_report(documents: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The plan of every source with drawn, the tokens that the sample really takes, and share, their part of the whole sample."""
    tokens = counted(documents, targets, p)
    cells, plan = mixture(tokens, targets, p)
    got = drawn(tokens, cells, p).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn"))
    every = got.agg(F.sum("drawn").alias("_all"))
    rows = plan.join(got, "source", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).join(F.broadcast(every))
    return rows.select("source", "weight", "max_repeats", "tokens", "wanted", "use", "drawn", F.coalesce(F.try_divide("drawn", "_all"), F.lit(0.0)).alias("share"), "short")
