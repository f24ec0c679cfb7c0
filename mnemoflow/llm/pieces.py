"""Problem 3: oversized texts in pieces, cut where the words change.

Between two blocks of words that slide along the text, the similarity of their vocabulary is measured at every place where a
piece may end. Where it dips between two heights, the topic changes; of the places that a piece's size allows the deepest dip is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoflow.llm.codepoints import mix, segment_hash, slices, to_codepoints, to_strings

# What the trimming of a text takes for white space.
TRIMMED = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ENDS = ".!?…。！？｡؟।۔:;：；"
CLOSERS = "\"'”’»」』）)]*】》"


@dataclass(frozen=True)
class PieceParams:
    """``least`` is the part of a piece's room that is filled before cuts count, unless only earlier places are there; places are line breaks, sentence ends, then blanks."""

    least: float = 0.5
    block_words: int = 24
    buckets: int = 64
    kinds: tuple[float, float, float] = (0.30, 0.20, 0.0)  # added to the dip's depth at blank lines or line breaks, sentence ends, blanks


def _is_in(flat: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(flat, np.array([ord(c) for c in chars], np.uint32))


def _trimmed(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the range without white space around it."""
    full = np.flatnonzero(~_is_in(flat, TRIMMED))
    lo, hi = np.searchsorted(full, starts[:-1]), np.searchsorted(full, starts[1:])
    some = hi > lo
    begin = np.where(some, full[np.minimum(lo, max(len(full) - 1, 0))] if len(full) else 0, starts[:-1])
    end = np.where(some, full[np.maximum(hi - 1, 0)] + 1 if len(full) else 0, begin)
    return begin, end


def _cuts(text: np.ndarray, most: int, overlap: int, p: PieceParams) -> list[tuple[int, int]]:
    """Code-point ranges of the pieces of one text above the limit."""
    n = len(text)
    units = np.concatenate(([0], np.cumsum(1 + (text > 0xFFFF))))  # UTF-16 position of each code point
    blank = _is_in(text, TRIMMED)
    words, where = _words(text, blank)
    kind, depth = _places(text, blank, words, where, p)
    overlap = max(0, min(overlap, most - 2))
    pieces: list[tuple[int, int]] = []
    begin = 0
    while True:
        room = int(np.searchsorted(units, units[begin] + most, "right")) - 1
        if room >= n:
            pieces.append((begin, n))
            return pieces
        # a piece has to go beyond what it shares with the one before
        floor = int(np.searchsorted(units, units[begin] + max(overlap + 2, int(p.least * most)), "left"))
        floor = min(floor, room)
        places = floor + np.flatnonzero(kind[floor : room + 1] >= 0)
        if not len(places):  # a short piece rather than a cut inside a run
            first = min(int(np.searchsorted(units, units[begin] + overlap + 2, "left")), floor)
            places = first + np.flatnonzero(kind[first:floor] >= 0)
        if len(places):
            worth = depth[places] + np.array(p.kinds)[kind[places]]
            end = int(places[np.flatnonzero(worth >= worth.max() - 1e-12)[-1]])
        else:
            end = room
        pieces.append((begin, end))
        shared = int(np.searchsorted(units, units[end] - overlap, "left"))
        begin = max(shared, begin + 1)


def _words(text: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of word letters; each letter of a script without blanks) and where they begin."""
    cjk = ((text >= 0x3040) & (text < 0xA000)) | ((text >= 0x0E00) & (text < 0x0E80)) | (text >= 0x20000)
    letter = ~blank & ~_is_in(text, "\"'“”‘’«»「」『』（）()[]【】《》,，、…" + ENDS)
    edge = np.ones(len(text) + 1, bool)
    edge[1:-1] = (letter[1:] != letter[:-1]) | (cjk[1:] | cjk[:-1])
    cut = np.flatnonzero(edge)
    begins, ends = cut[:-1], cut[1:]
    keep = letter[begins]
    lower = np.where((text >= 65) & (text <= 90), text + 32, text)
    return segment_hash(lower, begins[keep], ends[keep]), begins[keep]


def _places(text: np.ndarray, blank: np.ndarray, words: np.ndarray, where: np.ndarray, p: PieceParams) -> tuple[np.ndarray, np.ndarray]:
    """For each position: the kind of place (0 line, 1 sentence, 2 blank, -1 none) and how deep the cohesion dips there."""
    n = len(text)
    kind = np.full(n + 1, -1, np.int8)
    after = np.flatnonzero(blank[:-1]) + 1 if n > 1 else np.zeros(0, int)
    kind[after] = 2
    end = _is_in(text, ENDS)
    close = _is_in(text, CLOSERS)
    ended = end.copy()
    for _ in range(3):  # closing marks belong to the sentence
        ended[1:] |= close[1:] & ended[:-1]
    wide = end & (text > 0x2FFF)
    stop = ended & ~np.concatenate(((end | close)[1:], [False]))
    follows_blank = np.concatenate((blank[1:], [True]))
    wide_run = np.zeros(n, bool)
    if n:
        carried = wide.copy()
        for _ in range(3):
            carried[1:] |= close[1:] & carried[:-1]
        wide_run = carried
    kind[1:][stop & (follows_blank | wide_run)] = 1
    kind[1:][text == 0x0A] = 0
    kind[0] = -1
    depth = np.zeros(n + 1)
    w = p.block_words
    if len(words) > 2 and n:
        gaps = np.searchsorted(where, np.flatnonzero(kind >= 0))  # words before each place
        places = np.flatnonzero(kind >= 0)
        bucket = (mix(words) % np.uint64(p.buckets)).astype(int)
        for a in range(0, len(places), 4096):
            gap, place = gaps[a : a + 4096], places[a : a + 4096]
            lo, hi = max(0, int(gap.min()) - w), min(len(words), int(gap.max()) + w)
            table = np.zeros((hi - lo + 1, p.buckets), np.float32)
            table[np.arange(1, hi - lo + 1), bucket[lo:hi]] = 1
            table = np.cumsum(table, 0)
            at = gap - lo
            left = table[at] - table[np.maximum(at - w, 0)]
            right = table[np.minimum(at + w, hi - lo)] - table[at]
            norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
            depth[place] = np.divide((left * right).sum(1), norm, out=np.zeros(len(at), np.float32), where=norm > 0)
        value = depth[places]
        # depth of a dip: how far the similarity rises on both sides until it falls again
        depth[places] = (_height(value) - value) + (_height(value[::-1])[::-1] - value)
    return kind, depth


def _height(value: np.ndarray) -> np.ndarray:
    """For each place the similarity reached by walking left as long as it rises."""
    out = value.copy()
    rising = np.concatenate(([False], value[:-1] >= value[1:]))
    start = np.maximum.accumulate(np.where(~rising, np.arange(len(value)), 0))
    return np.where(rising, value[start], out)


def split_batches(batches: Iterator[pa.RecordBatch], p: PieceParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        most_all = batch.column("max_units").to_numpy(zero_copy_only=False)
        over_all = batch.column("overlap_units").to_numpy(zero_copy_only=False)
        for a, b in slices(column):
            flat, starts = to_codepoints(column.slice(a, b - a))
            begin, end = _trimmed(flat, starts)
            length = np.concatenate(([0], np.cumsum(1 + (flat > 0xFFFF).astype(np.int64))))
            units = length[end] - length[begin]
            rows, numbers, texts_at, texts_end, offsets = [], [], [], [], []
            for r in np.flatnonzero(units > most_all[a:b]):
                for k, (x, y) in enumerate(_cuts(flat[begin[r] : end[r]], int(most_all[a + r]), int(over_all[a + r]), p)):
                    rows.append(a + r)
                    numbers.append(k + 1)
                    offsets.append(x)
                    texts_at.append(begin[r] + x)
                    texts_end.append(begin[r] + y)
            if not rows:
                continue
            lo, hi = np.array(texts_at), np.array(texts_end)
            within = np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            pieces = to_strings(flat[np.repeat(lo, hi - lo) + within], np.concatenate(([0], np.cumsum(hi - lo))))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("field").take(take), batch.column("id").take(take), pa.array(numbers, pa.int32()), pa.array(offsets, pa.int32()), pa.array((length[hi] - length[lo]).astype(np.int32)), pieces],
                ["field", "id", "piece", "char_start", "units", "text"],
            )


def pieces(values: DataFrame, models: DataFrame, p: PieceParams = PieceParams()) -> DataFrame:
    """Pieces of the texts above their model's limit: field, id, piece, char_start, units, text.

    ``values``: field, id, text, embedding_model; ``models``: embedding_model, max_units, overlap_units; other columns are ignored.
    Lengths are UTF-16 code units of the text without the white space around it. Pieces have at most max_units; each begins
    overlap_units before the end of the one before (one less where that would split a surrogate pair). Texts within the limit, null
    texts, and rows without a known model or whose limit is null or below 4 have no pieces; char_start counts code points of the trimmed text.
    """
    limits = models.where("embedding_model is not null and max_units >= 4").select("embedding_model", "max_units", F.coalesce("overlap_units", F.lit(0)).alias("overlap_units"))
    limits = limits.groupBy("embedding_model").agg(F.min(F.struct("max_units", "overlap_units")).alias("_l")).select("embedding_model", "_l.*")
    rows = values.select("field", "id", "embedding_model", "text").join(limits, "embedding_model")
    # a text of no more bytes than units can't be too long
    rows = rows.where(F.octet_length("text") > F.col("max_units")).select("field", "id", "text", "max_units", "overlap_units")
    return rows.mapInArrow(lambda it: split_batches(it, p), "field string, id long, piece int, char_start int, units int, text string")
