"""Problem 6: passages of evaluation items in training documents, by suffix arrays over shards of the corpus.

Each shard of documents becomes one array of token numbers in the evaluation items' vocabulary. Stretches that are too
short to hold a reportable match can't contribute and are left out; the suffixes of the rest are sorted by
prefix doubling. Every suffix of every evaluation item is then looked up by binary search: all of them at once, in their own
sorted order, by as many tokens as one number holds, and those that are still found by the tokens after these, one
depth at a time. Matches are extended to their full length where they begin. So the cost of a shard hardly follows the number of items.
"""

from __future__ import annotations

import pickle
import unicodedata as ud
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoflow.llm.codepoints import row_of, segment_hash, slices, to_codepoints
from mnemoflow.llm.fold import fold, tables


@dataclass(frozen=True)
class LeakParams:
    """``min_words`` words in a row, or ``min_letters`` letters or digits for items in a script without spaces between words."""

    min_words: int = 10
    min_letters: int = 20
    letter_langs: tuple[str, ...] = ("zh",)
    eval_block_chars: int = 8_000_000  # evaluation text, about, that one scan of the corpus looks for
    shard_bytes: int = 2 << 20  # text of one suffix array
    pairs_at_once: int = 1_000_000


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(class of each code point, kind): letters are one class with their other case and with what looks like them.

    Kind 1 are letters and digits, 2 marks that belong to the letter before, 0 the rest.
    """
    t = tables()
    n = len(t.single)
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    kind = np.zeros(n, np.uint8)
    for cp in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x17000), *range(0x1B000, 0x20000)):
        ch = chr(cp)
        group = ud.category(ch)[0]
        kind[cp] = 1 if group in "LN" else 2 if group == "M" else 0
        for other in (ch.lower(), chr(t.single[cp]) if t.length[cp] == 1 else ch):
            if len(other) == 1 and other != ch:
                a, b = root(cp), root(ord(other))
                parent[max(a, b)] = min(a, b)
    kind[0x3400:0xA000] = kind[0xAC00:0xD7A4] = kind[0x20000:0x32400] = 1
    kind[0x4DC0:0x4E00] = 0
    return np.array([root(x) for x in range(0x20000)] + list(range(0x20000, n)), np.uint32), kind


def _tokens(flat: np.ndarray, starts: np.ndarray, letters: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit token values and the row of each; tokens are words, or single letters and digits."""
    same, kind = _classes()
    flat, starts = fold(flat, starts)
    value, is_word = same[flat], kind[flat]
    rows = row_of(starts)
    if letters:
        at = np.flatnonzero(is_word == 1)
        return value[at].astype(np.uint64), rows[at]
    inside = is_word > 0
    edge = np.ones(len(flat) + 1, bool)
    edge[1:-1] = (inside[1:] != inside[:-1]) | (rows[1:] != rows[:-1])
    cuts = np.flatnonzero(edge)
    begins, ends = cuts[:-1], cuts[1:]
    words = inside[begins] if len(begins) else np.zeros(0, bool)
    begins, ends = begins[words], ends[words]
    return segment_hash(value, begins, ends), rows[begins]


@dataclass
class EvalIndex:
    """The tokens of the evaluation items as numbers from 1, 0 parting the items, and their suffixes in order."""

    vocabulary: np.ndarray
    tokens: np.ndarray
    suffixes: np.ndarray
    items: np.ndarray
    least: int
    letters: bool

    @property
    def packed(self) -> int:
        """How many of the first tokens one number holds."""
        return min(self.least, 62 // len(self.vocabulary).bit_length())

    def heads(self, tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first tokens from each place as one number, whose order is that of the tokens."""
        out = np.zeros(len(places), np.int64)
        for depth in range(self.packed):
            out = (out << len(self.vocabulary).bit_length()) | tokens[places + depth]
        return out


def eval_index(ids: np.ndarray, texts: pa.Array, least: int, letters: bool) -> EvalIndex | None:
    values, rows = _tokens(*to_codepoints(texts), letters)
    if not len(values):
        return None
    vocabulary, number = np.unique(values, return_inverse=True)
    tokens, place = _separated(number.astype(np.int64) + 1, rows)
    item_of = np.full(len(tokens), -1, np.int64)
    item_of[place] = ids[rows]
    suffixes = suffix_array(tokens, np.flatnonzero(_ahead(tokens) >= least))
    return EvalIndex(vocabulary, tokens.astype(np.int32), suffixes.astype(np.int32), item_of[suffixes], least, letters) if len(suffixes) else None


def _separated(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with a 0 before each row and two at the end, and where each token went."""
    place = np.arange(len(tokens)) + 1 + np.concatenate(([0], np.cumsum(rows[1:] != rows[:-1]))) if len(tokens) else np.zeros(0, np.int64)
    out = np.zeros((int(place[-1]) if len(place) else 0) + 3, np.int64)
    out[place] = tokens
    return out, place


def _ahead(tokens: np.ndarray) -> np.ndarray:
    """From each place, the tokens up to the next 0."""
    at = np.arange(len(tokens))
    zero = np.where(tokens == 0, at, len(tokens))
    return np.minimum.accumulate(zero[::-1])[::-1] - at


def suffix_array(tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places in the order of the texts that begin there; a text ends at the next 0."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    longest, step = int(_ahead(tokens).max(initial=0)), 1
    while step < longest:
        second = np.zeros_like(rank)
        second[:-step] = rank[step:]
        second[tokens == 0] = 0
        key = rank * (int(rank.max()) + 1) + second
        _, new = np.unique(key, return_inverse=True)
        if new.max() == rank.max():
            break
        rank, step = new.astype(np.int64), step * 2
    return places[np.argsort(rank[places], kind="stable")]


def _bound(tokens: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, after: bool) -> np.ndarray:
    """Binary search in each [lo, hi) for the first suffix whose token at the depth is not below (after: above) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        got = tokens[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(tokens) - 1)]
        right = open_ & ((got <= want) if after else (got < want))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def shard_matches(flat: np.ndarray, starts: np.ndarray, index: EvalIndex, pairs_at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, item, tokens matched, ordinal of the first token in its row) of the matches that no longer match contains."""
    values, rows = _tokens(flat, starts, index.letters)
    if not len(values):
        return
    near = np.minimum(np.searchsorted(index.vocabulary, values), len(index.vocabulary) - 1)
    number = np.where(index.vocabulary[near] == values, near + 1, 0)
    first = np.concatenate(([0], np.flatnonzero(rows[1:] != rows[:-1]) + 1))
    ordinal = np.arange(len(values)) - first[np.searchsorted(first, np.arange(len(values)), "right") - 1]
    all_tokens, place = _separated(number, rows)
    # only stretches of known tokens that are long enough are sorted
    ahead = _ahead(all_tokens)
    begin = (all_tokens > 0) & (np.concatenate(([0], all_tokens[:-1])) == 0)
    stretch = np.repeat(ahead[begin], ahead[begin])
    inside = np.flatnonzero(all_tokens > 0)
    inside = inside[stretch >= index.least]
    if not len(inside):
        return
    back = np.full(len(all_tokens), -1, np.int64)
    back[place] = np.arange(len(place))
    source = back[inside]
    tokens, at = _separated(all_tokens[inside], np.cumsum(np.concatenate(([0], np.diff(inside) > 1))))
    origin = np.full(len(tokens), -1, np.int64)
    origin[at] = source
    order = suffix_array(tokens, np.flatnonzero(_ahead(tokens) >= index.least))
    wanted = index.heads(index.tokens, index.suffixes)
    there = index.heads(tokens, order)
    lo, hi = np.searchsorted(there, wanted, "left"), np.searchsorted(there, wanted, "right")
    hits = np.flatnonzero(hi > lo)
    for depth in range(index.packed, index.least):
        want = index.tokens[index.suffixes[hits] + depth]
        a, b = lo[hits], hi[hits]
        lo[hits], hi[hits] = _bound(tokens, order, a, b, depth, want, False), _bound(tokens, order, a, b, depth, want, True)
        hits = hits[hi[hits] > lo[hits]]
    counts = np.cumsum((hi - lo)[hits])
    for part in np.split(hits, np.searchsorted(counts, np.arange(pairs_at_once, counts[-1] if len(counts) else 0, pairs_at_once))):
        n = (hi - lo)[part]
        if not len(part) or not n.sum():
            continue
        ev = np.repeat(index.suffixes[part], n)
        item = np.repeat(index.items[part], n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos = order[np.repeat(lo[part], n) + within]
        starts_here = (tokens[pos - 1] != index.tokens[ev - 1]) | (tokens[pos - 1] == 0)
        ev, item, pos = ev[starts_here], item[starts_here], pos[starts_here]
        length = np.full(len(pos), index.least, np.int64)
        going = np.arange(len(pos))
        while len(going):
            a, b = tokens[pos[going] + length[going]], index.tokens[ev[going] + length[going]]
            going = going[(a == b) & (a > 0)]
            length[going] += 1
        word = origin[pos]
        yield rows[word], item, length, ordinal[word]


def eval_blocks(evalset: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """block, indexes: the evaluation items cut by a hash of their ids into blocks of bounded text, each indexed by a task of its own."""
    letters = F.split(F.lower(F.coalesce("lang", F.lit(""))), "-")[0].isin(*p.letter_langs)
    items = evalset.where("item_id is not null and text is not null").select("item_id", "text", letters.alias("letters"))
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(-(-chars // p.eval_block_chars) or 1)))

    def build(table: pa.Table) -> pa.Table:
        made = []
        for letters in (True, False):
            part = table.filter(pa.compute.equal(table.column("letters"), letters)).combine_chunks()
            if part.num_rows:
                made.append(eval_index(part.column("item_id").to_numpy(), pa.concat_arrays(part.column("text").chunks), p.min_letters if letters else p.min_words, letters))
        return pa.table({"block": table.column("block")[:1], "indexes": pa.array([pickle.dumps([m for m in made if m is not None])], pa.binary())})

    return blocks.groupBy("block").applyInArrow(build, "block long, indexes binary")


def _shard_rows(ids: np.ndarray, flat: np.ndarray, starts: np.ndarray, indexes: list[EvalIndex], p: LeakParams) -> pa.RecordBatch:
    """The longest match, of equal ones the first, of each item in each document of a shard."""
    found = [m for index in indexes for m in shard_matches(flat, starts, index, p.pairs_at_once)]
    row, item, length, first = (np.concatenate([m[i] for m in found]) if found else np.zeros(0, np.int64) for i in range(4))
    order = np.lexsort((first, -length, item, row))
    row, item, length, first = (x[order] for x in (row, item, length, first))
    best = np.ones(len(row), bool)
    best[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    return pa.RecordBatch.from_arrays([pa.array(ids[row[best]], pa.int64()), pa.array(item[best], pa.int64()), pa.array(length[best].astype(np.int32)), pa.array(first[best].astype(np.int32))], ["doc_id", "item_id", "tokens", "first_token"])


def leaks(documents: DataFrame, evalset: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """doc_id, item_id, tokens, first_token: the longest verbatim match of each item in each document that holds one.

    ``documents``: doc_id, text; ``evalset``: item_id, text, lang; other columns are ignored. Tokens are words, for items in
    ``letter_langs`` letters and digits. Case, punctuation, spacing and character form don't count. Null and empty texts
    hold nothing; equal documents are reported each; an empty table gives an empty result. The evaluation items
    are indexed in blocks of bounded size; the driver passes on one block's index at a time, and each is sought in one scan without a shuffle of the corpus.
    """
    schema = "doc_id long, item_id long, tokens int, first_token int"
    spark = documents.sparkSession
    corpus = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = spark.createDataFrame([], schema)
    for block in eval_blocks(evalset, p).toLocalIterator():
        indexes = pickle.loads(block.indexes)
        if not indexes:
            continue
        shared = spark.sparkContext.broadcast(indexes)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column, ids = batch.column("text"), batch.column("doc_id").to_numpy(zero_copy_only=False)
                for a, b in slices(column, p.shard_bytes):
                    yield _shard_rows(ids[a:b], *to_codepoints(column.slice(a, b - a)), shared.value, p)

        found = found.unionByName(corpus.mapInArrow(scan, schema))
    return found


def without_leaks(documents: DataFrame, evalset: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """The documents that hold no passage of an evaluation item, with all their columns."""
    return documents.join(leaks(documents, evalset, p).select("doc_id").distinct(), "doc_id", "left_anti")
