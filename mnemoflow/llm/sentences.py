"""Problem 1: sentence units across languages and scripts, by a hidden-event n-gram model.

Between two words of a line, outside quotations, a boundary token may stand. Where a final mark and the closing marks that belong to it
are, what speaks for it is the n-gram before (word, mark, closing mark: does this end lines as often as a sentence does, or
hardly ever, as an abbreviation does) and the word after (does it begin sentences or go on). Between words without a mark (in scripts without
blanks: between letters) it is the bigram model with the boundary as a hidden word: how often sentences end on the word
before, how often they begin with the word after, and how often the one follows the other inside sentences. A writer who sets no marks in a text
leaves all boundaries unmarked, any other hardly one. Posteriors come from forward-backward passes over each line, in which a boundary
also depends on how near the one before is. All counts are taken over all texts: once from line ends, which are boundaries
beyond doubt, and once more as expected counts under the model so far. Blanks of scripts that part sentences by them follow their own rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
import unicodedata as ud

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from mnemoflow.llm.codepoints import mix, slices, to_codepoints
from mnemoflow.llm.fold import tables


@dataclass(frozen=True)
class SentenceParams:
    slice_bytes: int = 1 << 20  # text taken at a time; it needs some hundred times as much memory
    slots: int = 1 << 18  # places of each table of the model; words share them by hash
    abbreviation_rate: float = 0.004  # how often a word that isn't final stands at a line's end all the same
    abbreviation_prior: float = 0.05
    trust: float = 0.5  # weight of each occurrence of an n-gram; the same text often comes twice
    plain_mark: float = 6.0  # log odds that a mark other than full stops and dots, outside quotations, isn't part of a word
    strongest: float = 6.0  # bound of the log odds of one piece of evidence
    word_strongest: float = 3.0
    word_prior: float = 6.0  # occurrences from which a word's own counts weigh more than its shape's
    pair_slots: int = 1 << 21  # places of the table of word pairs; two pairs in one place only make a boundary between their words less likely
    unmarked: float = -9.0  # log share of a boundary that a writer who sets marks leaves without one
    bare: float = -0.7  # the same for texts without any mark
    pair_prior: float = 2.0  # weight of a word's own frequency beside the pairs it is seen in
    least_odds: float = -3.0  # places without a mark below these log odds aren't looked at further
    bare_words: int = 6  # a line without marks of fewer words is one unit


# character classes
BLANK, LINE, WORD, UPPER, WIDE, THAI, DIGIT, FINAL, CLOSE, OPEN, EITHER, DASH, OTHER, LOW9, UNSEEN = range(15)
# kinds of quotation marks, in the upper half of the byte that holds the class; * opens and closes, but isn't a quotation mark
Q_OPEN, Q_CLOSE, Q_LOW, Q_HIGH, Q_DOUBLE, Q_STAR = range(1, 7)
DOT, ELLIPSIS, EXCLAIM, QUESTION, IDEOGRAPHIC, DANDA = range(1, 7)
# shapes of what follows a place
S_LOWER, S_UPPER, S_DIGIT, S_OPEN, S_DASH_LOWER, S_DASH, S_WIDE, S_REPEAT, S_OTHER, S_CASELESS = range(10)
N_SHAPE = 10
#: Of segment_hash.
HASH_SEED, HASH_PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Log odds that the first pass starts from, by shape.
FIRST_SHAPE = np.array([-3.0, 0.7, -0.5, 0.7, -9.0, 0.7, 0.0, -9.0, 0.0, 0.0])
#: Shapes that go on with what stands before, whatever the word: a remark after a dash, a word that is said again.
GOES_ON = (S_DASH_LOWER, S_REPEAT)
K_ENDS, K_NEXT, K_SHAPE, K_GAP, K_LAST, K_FIRST, K_PAIR = range(7)
N_GAP = 5


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class with the kind of quotation mark, form in lower case, kind of final mark, hash as a letter) of every code point."""
    t = tables()
    n = len(t.single)
    base = np.where(t.length == 1, t.single, np.arange(n)).astype(np.uint32)
    cls = np.full(n, OTHER, np.uint8)
    lower = base.copy()
    for cp in (*range(0x3040), *range(0xA000, 0xAC00), *range(0xF900, 0x17000), *range(0x1E000, 0x20000)):
        ch = chr(base[cp])
        cat = ud.category(ch)
        cls[cp] = BLANK if cat[0] == "Z" or ch == "\t" else UPPER if cat == "Lu" else WORD if cat[0] in "LM" else DIGIT if cat == "Nd" else DASH if cat == "Pd" else OTHER
        low = ch.lower()
        if len(low) == 1:
            lower[cp] = t.single[ord(low)] if t.length[ord(low)] == 1 else ord(low)
    cls[0xAC00:0xD7A4] = WORD
    cls[(base >= 0x3040) & (base < 0xA000)] = WIDE
    cls[(base >= 0x20000) & (base < 0x32400)] = WIDE
    cls[0x3005:0x3008] = WIDE
    thai = np.arange(0xE00, 0xE80)
    cls[thai] = np.where(np.isin(cls[thai], [WORD]), THAI, cls[thai])
    final = np.zeros(n, np.uint8)
    for chars, kind in ((".", DOT), ("…‥", ELLIPSIS), ("!", EXCLAIM), ("?؟", QUESTION), ("。", IDEOGRAPHIC), ("।॥۔", DANDA)):
        mask = np.isin(base, [ord(c) for c in chars])
        final[mask] = kind
        cls[mask] = FINAL
    for chars, kind in (("”’»」』)]】》〉", CLOSE), ("‘«「『([【《〈¿¡", OPEN), ("“", LOW9), ('"*', EITHER), ("„", OPEN)):
        cls[np.isin(base, [ord(c) for c in chars])] = kind
    cls[0x0A] = LINE
    cls[[0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029]] = LINE
    visible = t.length > 0
    visible[0x0A] = visible[0x0D] = True
    for chars, kind in (("«「『", Q_OPEN), ("»」』”", Q_CLOSE), ("„", Q_LOW), ("“", Q_HIGH), ('"', Q_DOUBLE), ("*", Q_STAR)):
        cls[np.isin(lower, [ord(c) for c in chars])] += kind << 4
    cls[~visible] = UNSEEN
    return cls, lower, final, mix(lower.astype(np.uint64) + HASH_SEED)


@dataclass
class Bare:
    """Places between words without a mark, in no order: index before, line, hashes and slots of the word before and the word after, words up to there."""

    at: np.ndarray
    line: np.ndarray
    last_hash: np.ndarray
    first_hash: np.ndarray
    last: np.ndarray
    first: np.ndarray
    words: np.ndarray
    ended: np.ndarray  # slots of the words before marked places, -1 for none
    begun: np.ndarray  # slots of the words after them
    line_ended: np.ndarray  # the same of lines that end on a mark
    line_begun: np.ndarray

    def pair(self, which: np.ndarray, p: SentenceParams) -> np.ndarray:
        """Slots of the pairs of words at some of the places."""
        with np.errstate(over="ignore"):
            return _slot(mix(self.last_hash[which] * np.uint64(31) + self.first_hash[which]), p.pair_slots)


@dataclass
class Places:
    """Places inside lines where a boundary may stand, in order."""

    at: np.ndarray  # index of the last code point before it
    line: np.ndarray
    key: np.ndarray  # slot of the n-gram before
    word: np.ndarray  # slot of the word after
    shape: np.ndarray
    plain: np.ndarray  # whether the mark is none that abbreviations have, and no closing mark follows it
    words: np.ndarray  # half words from the text's beginning
    end_key: np.ndarray  # the same n-grams at line ends, for counting
    head_word: np.ndarray  # words that begin lines, for counting
    head_shape: np.ndarray
    single_gap: np.ndarray  # lengths of lines that are one sentence, for counting
    fixed: np.ndarray  # boundaries beyond doubt: line ends, and blanks in scripts that part sentences by them
    fixed_row: np.ndarray
    line_row: np.ndarray  # text of every line
    line_words: np.ndarray  # (n, 2): half words before and up to the end of every line
    line_marked: np.ndarray  # whether the line's text has a final mark or another sign of where sentences end
    bare: Bare | None


def _slot(value: np.ndarray, slots: int) -> np.ndarray:
    """Place of a hash in a table."""
    return (value & np.uint64(slots - 1) if slots & (slots - 1) == 0 else value % np.uint64(slots)).astype(np.int64)


def _group_start(group: np.ndarray) -> np.ndarray:
    """For each element of a sorted array the index of the first one equal to it."""
    begins = np.ones(len(group), bool)
    begins[1:] = group[1:] != group[:-1]
    return np.maximum.accumulate(np.where(begins, np.arange(len(group)), 0))


def _run_start(at: np.ndarray) -> np.ndarray:
    """For each of ascending indices the first of the run of successive ones that it is in."""
    return at[_group_start(at - np.arange(len(at)))]


def _inside_quotes(event: np.ndarray, step: np.ndarray, line: np.ndarray, crowded: np.ndarray, line_end: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n code points is within quotation marks, from those that open (step 1) or close (-1). Marks that close what isn't open
    don't count, but for one that begins a line and has the next one beside it (crowded)."""
    begin = _group_start(line)
    total = np.cumsum(step)
    depth = total - (total - step)[begin]
    lowest = np.minimum.accumulate(np.where(crowded, 0, depth) - line * 1_000_000) + line * 1_000_000
    within = depth - np.minimum(lowest, 0) > 0
    until = line_end[line]
    until[:-1] = np.where(line[1:] == line[:-1], event[1:], until[:-1])
    change = np.zeros(n + 1, np.int8)
    change[event[within]] += 1
    change[until[within]] -= 1
    return np.cumsum(change, dtype=np.int8).view(bool)


def places(flat: np.ndarray, starts: np.ndarray, p: SentenceParams, bare: bool = True) -> Places:
    """The places of all texts; with ``bare`` those between words without a mark, too.

    Positions are indices into the visible, non-blank code points of all texts, so that the neighbours of i in its line are i - 1 and i + 1.
    What is rare (marks, quotations, line ends) is looked at where it stands.
    """
    all_cls, all_lower, all_final, all_hash = _classes()
    empty = np.zeros(0, np.int64)
    nothing = Places(*([empty] * 14), np.zeros((0, 2), np.int64), np.zeros(0, bool), Bare(empty, empty, *([empty.astype(np.uint64)] * 2), *([empty] * 7)) if bare else None)
    packed = all_cls[flat]
    keep = None
    if (packed == UNSEEN).any():
        keep = np.flatnonzero(packed != UNSEEN)
        flat, packed, starts = flat[keep], packed[keep], np.searchsorted(keep, starts)
    n = len(flat)
    spot = np.flatnonzero(packed > LINE)
    m = len(spot)
    if not m:
        return nothing
    # lines: where they begin, and in which text
    rows = np.flatnonzero(starts[1:] > starts[:-1])
    row_begin = starts[rows]
    breaks = np.flatnonzero(packed == LINE) + 1
    line_begin = np.union1d(row_begin, breaks[breaks < n])
    lines = len(line_begin)
    line_row = rows[np.searchsorted(row_begin, line_begin, "right") - 1]
    line_bound = np.searchsorted(spot, np.append(line_begin, n))
    line = np.repeat(np.arange(lines), np.diff(line_bound))
    some = np.flatnonzero(line_bound[1:] > line_bound[:-1])  # lines that aren't blank
    firsts, lasts = line_bound[some], line_bound[some + 1] - 1
    head = np.zeros(m + 1, bool)  # first of its line
    head[firsts] = head[m] = True
    apart = np.ones(m + 1, bool)  # not next to the one before
    apart[1:-1] = spot[1:] - spot[:-1] > 1
    fresh = head | apart

    cp, packed = flat[spot], packed[spot]
    cls = packed & 15

    def before(at: np.ndarray) -> np.ndarray:
        return np.where((at >= 0) & ~head[at], at - 1, -1)

    def low(at: np.ndarray) -> np.ndarray:
        return all_lower[cp[at]]

    def final(at: np.ndarray) -> np.ndarray:
        return all_final[cp[at]]

    # marks that open and close alike; German quotations open low and close with what opens others
    inside = np.zeros(m + 1, bool)
    quote = np.flatnonzero(packed > 15)
    if len(quote):
        kind, quote_line = packed[quote] >> 4, line[quote]
        has_low = np.zeros(lines, bool)
        has_low[quote_line[kind == Q_LOW]] = True
        opens = np.where(kind == Q_HIGH, ~has_low[quote_line], (kind == Q_OPEN) | (kind == Q_LOW))
        for alike in (Q_DOUBLE, Q_STAR):
            mine = np.flatnonzero(kind == alike)
            opens[mine] = (np.arange(len(mine)) - _group_start(quote_line[mine])) % 2 == 0
        turned = (kind == Q_HIGH) | (kind == Q_DOUBLE) | (kind == Q_STAR)
        cls[quote[turned]] = np.where(opens[turned], OPEN, CLOSE)
        spoken = kind != Q_STAR
        quote, quote_line, opens = quote[spoken], quote_line[spoken], opens[spoken]
        if len(quote):
            crowded = np.zeros(len(quote), bool)
            crowded[:-1] = (spot[quote[:-1]] == line_begin[quote_line[:-1]]) & (spot[quote[1:]] == spot[quote[:-1]] + 1) & (quote_line[1:] == quote_line[:-1])
            inside = _inside_quotes(quote, np.where(opens, 1, -1), quote_line, crowded, line_bound[1:], m)

    # the final mark that a final or closing mark belongs to
    finals = np.flatnonzero(cls == FINAL)
    mark = np.full(m + 1, -1)
    mark[finals] = finals
    closing = np.flatnonzero(cls == CLOSE)
    for _ in range(4):
        mark[closing] = np.where(head[closing], -1, mark[closing - 1])
    ended = np.sort(np.concatenate((finals, closing[mark[closing] >= 0])), kind="stable")
    nxt = np.where(head[ended + 1], -1, ended + 1)
    alone = mark[nxt] < 0
    ended, nxt = ended[alone], nxt[alone]
    # what stands before a run of marks, and before a run of digits and marks
    before_marks = _run_start(finals) - 1

    def before_run(at: np.ndarray, run: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        out = ahead[np.searchsorted(run, at)] if len(at) else at
        return np.where((out >= 0) & (line[out] == line[at]), out, -1)

    # words: runs of letters; where they begin and a hash of each (segment_hash, by tables)
    letter = np.zeros(m + 1, bool)
    letter[:-1] = (cls == WORD) | (cls == UPPER)
    turn = fresh.copy()
    turn[1:] |= letter[1:] != letter[:-1]
    starts_word = letter & turn
    begin = np.flatnonzero(starts_word)
    end = np.flatnonzero(letter[:-1] & turn[1:]) + 1
    size = end - begin
    hashes = np.zeros(0, np.uint64)
    if len(begin):
        out = np.cumsum(size) - size
        with np.errstate(over="ignore"):
            place = mix(np.arange(int(size.max()), dtype=np.uint64) * HASH_PLACE + np.uint64(1)) | np.uint64(1)
            value = all_hash[cp[letter[:-1]]]
            value *= place[np.arange(len(value)) - np.repeat(out, size)]
            hashes = mix(np.add.reduceat(value, out) + size.astype(np.uint64))
    # two letters of a script without blanks count as a word
    wide = cls == WIDE
    thai = cls == THAI
    digit = cls == DIGIT
    half = (wide | thai).view(np.int8) + 2 * starts_word[:-1].view(np.int8)
    digits = np.flatnonzero(digit)
    new = fresh[digits] | (cls[digits - 1] != DIGIT)
    half[digits[new]] = 2
    words_to = np.cumsum(half, dtype=np.int64)

    def word_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(begin, at, "right") - 1

    def beside(at: np.ndarray, step: int, kind: int) -> np.ndarray:
        """Whether the next code point in the direction of the step touches this one and is of a kind."""
        other = np.clip(at + step, 0, m - 1)
        return ~fresh[at + (step > 0)] & (cls[other] == kind)

    def token(at: np.ndarray, step: int) -> np.ndarray:
        """Hash of the word at a place; of two letters of a script without blanks, the second in the direction of the step."""
        here = np.maximum(at, 0)
        form = low(here).astype(np.uint64)
        out = mix(form + np.uint64(11))
        mine = letter[here]
        out[mine] = hashes[word_of(here[mine])]
        mine = wide[here] & beside(here, step, WIDE)
        with np.errstate(over="ignore"):
            out[mine] = mix(form[mine] * np.uint64(1_000_003) + low(here[mine] + step))
        out[digit[here]] = 7
        out[at < 0] = 1
        return out

    def ngram(at: np.ndarray) -> np.ndarray:
        """Slot of the word, mark and closing mark that end at a place."""
        fin = mark[at]
        prev = before(fin)
        kind = np.where((final(fin) == DOT) & (final(prev) == DOT) & (prev >= 0), ELLIPSIS, final(fin)).astype(np.uint64)
        a = before_run(fin, finals, before_marks)
        closer = np.where(at > fin, low(at).astype(np.uint64), np.uint64(0))
        tok = token(a, -1)
        # a number says little: the word before it joins in
        number = np.flatnonzero((a >= 0) & digit[a])
        with np.errstate(over="ignore"):
            if len(number):
                run = np.flatnonzero(digit | (cls == FINAL))
                tok[number] = token(before_run(a[number], run, _run_start(run) - 1), -1) * np.uint64(31) + np.uint64(5)
            script = np.where(a < 0, 0, np.where(wide[a], 2, np.where(low(a) < 0x250, 0, 1))).astype(np.uint64)
            inner = np.where(closer > 0, script + np.uint64(100), tok)
            key = mix(inner * np.uint64(0x9E3779B97F4A7C15) + kind * np.uint64(131) + closer)
        return _slot(key, p.slots)

    def shape_of(at: np.ndarray, previous: np.ndarray | None = None) -> np.ndarray:
        c, form = cls[at], low(at)
        step = np.where(head[at + 1], at, at + 1)
        after, after_form = cls[step], low(step)
        caseless = (c == WORD) & (form >= 0x590) & (form < 0x1000)
        out = np.select(
            [caseless, c == WORD, c == UPPER, c == DIGIT, c == OPEN, (c == DASH) & (after == WORD) & ~((after_form >= 0x590) & (after_form < 0x1000)), c == DASH, (c == WIDE) | (c == THAI)],
            [S_CASELESS, S_LOWER, S_UPPER, S_DIGIT, S_OPEN, S_DASH_LOWER, S_DASH, S_WIDE],
            S_OTHER,
        )
        if previous is not None:
            out = np.where((token(at, 1) == token(previous, -1)) & (previous >= 0) & (c != OPEN), S_REPEAT, out)
        return out

    def word_slot(at: np.ndarray) -> np.ndarray:
        return _slot(mix(token(at, 1) + np.uint64(99)), p.slots)

    inner = nxt >= 0
    ended_in, nxt = ended[inner], nxt[inner]
    fin, next_cls, prev = mark[ended_in], cls[nxt], before(ended_in)
    wide_next = (next_cls == WIDE) | (next_cls == OPEN) & (prev >= 0) & wide[prev]
    kind = final(fin)
    full_width = (cp[fin] > 0xFF00) & (np.isin(next_cls, [WIDE, OPEN, UPPER, WORD]) | (kind != DOT) & (next_cls == DIGIT))
    ideographic = (kind == IDEOGRAPHIC) & (next_cls != OTHER) | full_width | (kind == ELLIPSIS) & wide_next
    ok = ~inside[ended_in] & (apart[nxt] | wide_next | ideographic)
    at, follow, fin = ended_in[ok], nxt[ok], fin[ok]

    # blanks between letters of a script that parts sentences by them
    thai_fixed = empty
    if thai.any():
        right = np.flatnonzero(apart[:-1] & ~head[:-1] & (thai | (cls == OPEN)))
        left = right - 1
        close_thai = (cls[left] == CLOSE) | (cls[left] == FINAL)
        one = before(left)
        two = before(one)
        thai_left = thai[left] | (close_thai & ((one >= 0) & thai[one] | (two >= 0) & thai[two]))
        repeat = (low(left) == 0xE46) | (low(right) == 0xE46)
        thai_fixed = left[thai_left & ~repeat & ~inside[left]]
        free = ~np.isin(at, thai_fixed)
        at, follow, fin = at[free], follow[free], fin[free]
    other = before_run(fin, finals, before_marks)

    def index(at: np.ndarray) -> np.ndarray:
        return spot[at] if keep is None else keep[spot[at]]

    line_words = np.zeros((lines, 2), np.int64)
    line_words[some, 0] = words_to[firsts] - half[firsts]
    line_words[some, 1] = words_to[lasts]
    with_places = np.zeros(lines, bool)
    with_places[line[at]] = True
    ends_marked = mark[lasts] >= 0
    single = some[ends_marked & ~with_places[some]]
    single_gap = np.clip((line_words[single, 1] - line_words[single, 0]) // 2, 0, N_GAP - 1)
    fixed = np.sort(np.concatenate((lasts, thai_fixed)), kind="stable")
    marked_row = np.zeros(len(starts), bool)
    marked_row[line_row[line[finals]]] = True
    marked_row[line_row[line[thai_fixed]]] = True
    out = Places(
        index(at), line[at], ngram(at), word_slot(follow), shape_of(follow, other), (at == fin) & (final(fin) > ELLIPSIS), words_to[at],
        ngram(lasts[ends_marked & ~inside[lasts]]), word_slot(firsts), shape_of(firsts), single_gap, index(fixed), line_row[line[fixed]], line_row, line_words, marked_row[line_row], None,
    )
    if not bare:
        return out

    def gram(at: np.ndarray, step: int) -> np.ndarray:
        """Hash of the word at a place, of two letters of a wide script, of four Thai ones, in the direction of the step; 0 for what is none."""
        value = np.zeros(len(at), np.uint64)
        mine = np.flatnonzero((at >= 0) & letter[at])
        value[mine] = hashes[word_of(at[mine])] | np.uint64(1)
        for mine, kind, size in ((np.flatnonzero((at >= 0) & wide[at]), WIDE, 2), (np.flatnonzero((at >= 0) & thai[at]), THAI, 4)):
            if len(mine):
                value[mine] = letters(at[mine], step, kind, size)
        return value

    def letters(at: np.ndarray, step: int, kind: int, size: int) -> np.ndarray:
        """Hash of so many letters that touch one another, or as many as there are."""
        with np.errstate(over="ignore"):
            total = (low(at).astype(np.uint64) + np.uint64(1)) * HASH_SEED
            go = np.ones(len(at), bool)
            for k in range(1, size):
                go &= beside(np.clip(at + step * (k - 1), 0, m - 1), step, kind)
                there = np.clip(at + step * k, 0, m - 1)
                total = np.where(go, (total + low(there) + np.uint64(1)) * HASH_SEED, total)
            return mix(total) | np.uint64(1)

    def slot(value: np.ndarray, salt: int) -> np.ndarray:
        return np.where(value > 0, _slot(mix(value + np.uint64(salt)), p.slots), -1)

    # neighbouring words with nothing but blanks between, and neighbouring letters of scripts without
    hashes_1 = hashes | np.uint64(1)
    k = np.flatnonzero((end[:-1] == begin[1:]) & ~head[begin[1:]] & ~inside[begin[1:] - 1])
    parts = [(end[k] - 1, hashes_1[k], hashes_1[k + 1])]
    left = np.flatnonzero(wide[:-1] & wide[1:] & ~head[1:-1] & ~inside[: m - 1])
    if len(left):
        parts.append((left, letters(left, -1, WIDE, 2), letters(left + 1, 1, WIDE, 2)))
    if thai.any():
        left = np.flatnonzero(thai[:-1] & thai[1:] & ~fresh[1:-1] & ~inside[: m - 1])
        left = left[ud_base(low(left + 1))]
        parts.append((left, letters(left, -1, THAI, 4), letters(left + 1, 1, THAI, 4)))
    left, last, first = (np.concatenate(x) for x in zip(*parts))
    # sentences beyond doubt: lines that end on a mark, and what Thai blanks part
    speaks = np.flatnonzero(letter[:-1] | wide | thai)

    def closed(at: np.ndarray) -> np.ndarray:
        """The last letter up to a place, in its line."""
        which = np.searchsorted(speaks, at, "right") - 1
        found = speaks[which] if len(speaks) else which
        return np.where((which >= 0) & (line[found] == line[at]), found, -1)

    final_word = closed(lasts)
    sure = ends_marked | (final_word >= 0) & thai[final_word]
    final_word, heads = np.concatenate((final_word[sure], closed(thai_fixed))), np.concatenate((firsts[sure], thai_fixed + 1))
    out.bare = Bare(
        index(left), line[left], last, first, _slot(mix(last + np.uint64(1)), p.slots), _slot(mix(first + np.uint64(2)), p.slots), words_to[left],
        slot(gram(other, -1), 1), slot(gram(follow, 1), 2), slot(gram(final_word, -1), 1), slot(gram(heads, 1), 2),
    )
    return out


def ud_base(letters: np.ndarray) -> np.ndarray:
    """Whether a Thai letter can begin a syllable: no vowel or tone mark that stands after or above another."""
    return ((letters >= 0xE01) & (letters <= 0xE2E)) | ((letters >= 0xE40) & (letters <= 0xE44))


@dataclass
class Model:
    ends: np.ndarray  # log odds of the n-gram before, by slot
    word: np.ndarray  # log odds of the word after, by slot
    word_weight: np.ndarray
    shape: np.ndarray
    near: np.ndarray  # log factor of two boundaries so many words apart
    last: np.ndarray | None = None  # log odds that a sentence ends on a word, by slot
    first: np.ndarray | None = None  # log of a word's share of what sentences begin with, by slot
    inner: np.ndarray | None = None  # (n, 2): log of a word's share of all words, by slot of the word after; occurrences before another, by slot of the word before
    pair: np.ndarray | None = None  # occurrences of word pairs inside sentences, by slot
    bounds: tuple[np.ndarray, np.ndarray] | None = None

    def most(self, p: SentenceParams) -> tuple[np.ndarray, np.ndarray]:
        """What the words before and after give at most to a boundary without a mark, by slot, with a margin for single precision."""
        if self.bounds is None:
            last = self.last + np.log(self.inner[:, 1] + p.pair_prior) + 0.01
            first = self.first - np.log(p.pair_prior * np.exp(self.inner[:, 0]))
            self.bounds = last.astype(np.float32), first.astype(np.float32)
        return self.bounds


def marked_odds(x: Places, m: Model, p: SentenceParams) -> np.ndarray:
    """Log odds of a boundary at each place with a mark, by itself."""
    follow = m.word_weight[x.word] * m.word[x.word] + (1 - m.word_weight[x.word]) * m.shape[x.shape]
    follow = np.where(np.isin(x.shape, GOES_ON), m.shape[x.shape], follow)
    return m.ends[x.key] + np.where(x.plain, p.plain_mark, 0.0) + follow


def bare_odds(x: Places, m: Model, p: SentenceParams) -> tuple[np.ndarray, np.ndarray]:
    """Which places without a mark have log odds above the least, and these odds: the word before as an end, and the word after as a beginning
    against as what follows. A pair that isn't seen gives the most; where that is too little, the pair isn't looked up."""
    b = x.bare
    words = x.line_words[:, 1] - x.line_words[:, 0]
    habit = np.where(x.line_marked | (words < 2 * p.bare_words), p.unmarked, p.bare)
    last, first = m.most(p)
    most = last[b.last]
    most += first[b.first]
    which = np.flatnonzero(most > p.least_odds - habit.astype(np.float32)[b.line])
    before, after = b.last[which], b.first[which]
    share, seen = m.inner[after, 0], m.inner[before, 1]
    inside = np.log(m.pair[b.pair(which, p)] + p.pair_prior * np.exp(share)) - np.log(seen + p.pair_prior)
    odds = m.last[before] + m.first[after] - inside + habit[b.line[which]]
    some = odds > p.least_odds
    return which[some], odds[some]


def gaps(line: np.ndarray, words: np.ndarray, x: Places) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the number of words since the place (or line start) before, and from each line's last place to its end."""
    n = len(line)
    begins = np.ones(n, bool)
    begins[1:] = line[1:] != line[:-1]
    since = np.where(begins, x.line_words[line, 0], np.concatenate(([0], words[:-1])) if n else words)
    ends = np.append(begins[1:], True) if n else begins
    return np.clip((words - since) // 2, 0, N_GAP - 1), np.clip((x.line_words[line[ends], 1] - words[ends]) // 2, 0, N_GAP - 1)


def posteriors(x: Places, m: Model, p: SentenceParams) -> np.ndarray:
    """Probability of a boundary at each place with a mark."""
    return _passes(x.line, marked_odds(x, m, p), x.words, x, m)


def boundaries(x: Places, m: Model, p: SentenceParams) -> tuple[np.ndarray, np.ndarray]:
    """(index of the last code point before, text) of all boundaries: those beyond doubt, and the places whose posterior is above a half."""
    some, odds = bare_odds(x, m, p)
    at = np.concatenate((x.at, x.bare.at[some]))
    order = np.argsort(at, kind="stable")
    line, words = np.concatenate((x.line, x.bare.line[some]))[order], np.concatenate((x.words, x.bare.words[some]))[order]
    yes = _passes(line, np.concatenate((marked_odds(x, m, p), odds))[order], words, x, m) > 0.5
    at = np.concatenate((x.fixed, at[order][yes]))
    row = np.concatenate((x.fixed_row, x.line_row[line[yes]]))
    order = np.argsort(at, kind="stable")
    return at[order], row[order]


def _passes(line: np.ndarray, odds: np.ndarray, words: np.ndarray, x: Places, m: Model) -> np.ndarray:
    """Posterior at each place, by forward and backward passes over all lines at a time."""
    n = len(line)
    if not n:
        return np.zeros(0)
    gap, last_gap = gaps(line, words, x)
    begins = np.ones(n, bool)
    begins[1:] = line[1:] != line[:-1]
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, n))
    by_size = np.argsort(-size, kind="stable")
    first, size = first[by_size], size[by_size]
    near = m.near[gap]
    end_near = m.near[last_gap][by_size]
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    for k in range(int(size[0])):
        live = int(np.searchsorted(-size, -k, "left"))
        i = first[:live] + k
        if k == 0:
            yes, no = near[i], np.zeros(live)
        else:
            was = forward[i - 1]
            yes = np.logaddexp(was[:, 0], was[:, 1] + near[i])
            no = np.logaddexp(was[:, 0], was[:, 1])
        forward[i, 0], forward[i, 1] = no, yes + odds[i]
    for k in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -k, "left"))
        i = first[:live] + k
        last = size[:live] == k + 1
        j = np.minimum(i + 1, n - 1)
        yes = np.where(last, end_near[:live], np.logaddexp(backward[j, 0], backward[j, 1] + odds[j] + near[j]))
        no = np.where(last, 0.0, np.logaddexp(backward[j, 0], backward[j, 1] + odds[j]))
        backward[i, 0], backward[i, 1] = no, yes
    return 1 / (1 + np.exp(np.clip(forward[:, 0] + backward[:, 0] - forward[:, 1] - backward[:, 1], -50, 50)))


def _sizes(p: SentenceParams) -> tuple[int, ...]:
    return p.slots, p.slots, N_SHAPE, N_GAP, p.slots, p.slots, p.pair_slots


def _count(batches: Iterator[pa.RecordBatch], model: Model | None, p: SentenceParams) -> Iterator[pa.RecordBatch]:
    """Counts of one task: table, slot, a, b. Without a model a is for line ends and heads, b for places; with one, expected boundaries and others."""
    sums = [np.zeros((s, 2), np.float32 if s == p.pair_slots else float) for s in (_sizes(p) if model is not None else _sizes(p)[:4])]

    def add(table: int, slot: np.ndarray, column: int, weight: np.ndarray | float = 1.0) -> None:
        flat = sums[table].reshape(-1)
        np.add.at(flat, 2 * slot + column, np.asarray(weight, flat.dtype))

    for batch in batches:
        column = batch.column("text")
        for i, j in slices(column, p.slice_bytes):
            x = places(*to_codepoints(column.slice(i, j - i)), p, model is not None)
            yes = posteriors(x, model, p) if model is not None else np.zeros(len(x.at))
            no = 1 - yes
            if model is None:
                add(K_ENDS, x.end_key[x.end_key >= 0], 0)
                add(K_ENDS, x.key, 1)
                add(K_GAP, x.single_gap, 0)
                add(K_GAP, gaps(x.line, x.words, x)[0], 1)
            else:
                b = x.bare
                known = np.flatnonzero(x.line_marked[b.line])  # where a writer sets no marks, it is unknown what is inside sentences
                for table, slot, once, inner in ((K_LAST, b.ended, b.line_ended, b.last), (K_FIRST, b.begun, b.line_begun, b.first)):
                    add(table, slot[slot >= 0], 0, yes[slot >= 0])
                    add(table, once[once >= 0], 0)
                    add(table, inner[known], 1)
                add(K_PAIR, b.pair(known, p), 1)
            for table, head, here in ((K_NEXT, x.head_word, x.word), (K_SHAPE, x.head_shape, x.shape)):
                add(table, head, 0)
                add(table, here, 0, yes)
                add(table, here, 1, no)
    for table, values in enumerate(sums):
        used = np.flatnonzero(values.any(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), table, np.int32)), pa.array(used), *(pa.array(values[used, c].astype(float)) for c in (0, 1))], ["table", "slot", "a", "b"])


def _sums(values: DataFrame, model: Model | None, p: SentenceParams) -> list[np.ndarray]:
    """The counts over all texts; the rows that come back are bounded by the tables' size, and come in parts."""
    counted = values.where("text is not null").select("text").mapInArrow(lambda it: _count(it, model, p), "table int, slot long, a double, b double")
    total = counted.groupBy("table", "slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a batch as one: numbers side by side, of single precision."""
        for batch in batches:
            table, slot = batch.column("table").to_numpy(), batch.column("slot").to_numpy()
            a, b = batch.column("a").to_numpy().astype("<f4"), batch.column("b").to_numpy().astype("<f4")
            for t in np.unique(table):
                mine = table == t
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (slot[mine].astype("<i4"), a[mine], b[mine]))], ["table", "slot", "a", "b"])

    out = [np.zeros((s, 2), np.float32 if s == p.pair_slots else float) for s in _sizes(p)]
    for row in total.mapInArrow(packed, "table int, slot binary, a binary, b binary").toLocalIterator():
        slot = np.frombuffer(row.slot, "<i4")
        out[row.table][slot, 0], out[row.table][slot, 1] = np.frombuffer(row.a, "<f4"), np.frombuffer(row.b, "<f4")
    return out


def _ratio(counts: np.ndarray, most: float) -> np.ndarray:
    """Log ratio of the two columns as distributions, with add-one smoothing."""
    share = (counts + 1) / (counts.sum(0) + len(counts))
    return np.clip(np.log(share[:, 0]) - np.log(share[:, 1]), -most, most)


def learn(values: DataFrame, p: SentenceParams = SentenceParams()) -> Model:
    """The model of the texts in column text: a first estimate from line ends, and one step of expectation and maximisation."""
    sums = _sums(values, None, p)
    ends, inner = sums[K_ENDS].T
    total = ends + inner
    rate = np.clip(ends.sum() / max(1.0, total.sum()), 0.02, 0.6)  # of the marks that end sentences, those that end lines
    common = total >= 20
    typical = ends[common] / total[common]
    if (typical > p.abbreviation_rate * 5).any():
        rate = float(np.clip(np.average(typical[typical > p.abbreviation_rate * 5], weights=total[common][typical > p.abbreviation_rate * 5]), 0.02, 0.6))
    odds = np.log((1 - p.abbreviation_prior) / p.abbreviation_prior) + p.trust * (ends * np.log(rate / p.abbreviation_rate) + inner * np.log((1 - rate) / (1 - p.abbreviation_rate)))
    odds = np.clip(odds, -p.strongest, p.strongest)
    near = np.clip(_ratio(sums[K_GAP], 2.0), -2.0, 0.5)
    first = Model(odds, np.zeros(p.slots), np.zeros(p.slots), FIRST_SHAPE, near)
    again = _sums(values, first, p)
    seen = again[K_NEXT].sum(1)
    shape = _ratio(again[K_SHAPE], 4.0)
    shape[list(GOES_ON)] = FIRST_SHAPE[list(GOES_ON)]
    # add-one smoothing over the words that occur
    share = (again[K_NEXT] + 0.5) / (again[K_NEXT].sum(0) + 0.5 * max(1, int((seen > 0).sum())))
    word = np.clip(np.log(share[:, 0]) - np.log(share[:, 1]), -p.word_strongest, p.word_strongest)
    return Model(odds, word, seen / (seen + p.word_prior), shape, near, *_hidden(again, p))


def _hidden(sums: list[np.ndarray], p: SentenceParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bigram model with the boundary as a hidden word, from its counts: last, first, inner and pair of the model."""
    ended, going = sums[K_LAST].T
    rate = max(1e-3, ended.sum()) / max(1.0, ended.sum() + going.sum())
    begun, inner = sums[K_FIRST].T
    often = (begun + inner + 0.5) / (begun.sum() + inner.sum() + 0.5 * len(begun))
    ends = (ended + p.pair_prior * rate) / (ended + going + p.pair_prior)
    starts = (begun + p.pair_prior * often) / (begun.sum() + p.pair_prior)
    return np.log(ends) - np.log1p(-np.minimum(ends, 1 - 1e-6)), np.log(starts), np.stack((np.log(often), going), 1).astype(np.float32), np.ascontiguousarray(sums[K_PAIR][:, 1])


def unit_ends(column: pa.Array, model: Model, p: SentenceParams) -> pa.Array:
    """For each text the code-point counts at which its units end."""
    parts = []
    for i, j in slices(column, p.slice_bytes):
        piece = column.slice(i, j - i)
        flat, starts = to_codepoints(piece)
        at, rows = boundaries(places(flat, starts, p), model, p)
        if len(at):
            new = np.append(True, at[1:] != at[:-1])
            at, rows = at[new], rows[new]
        offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=j - i)))).astype(np.int32)
        parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array((at + 1 - starts[rows]).astype(np.int32))))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def sentence_ends(values: DataFrame, p: SentenceParams = SentenceParams()) -> DataFrame:
    """The rows of ``values`` (field, id, text; other columns are ignored) with ``ends``, the ends of their units.

    An end is the number of code points up to it, with the closing marks after the sentence and without white space. Every non-blank line has at
    least one unit. Null and blank texts have none, texts that come again are split alike.
    """
    model = learn(values, p)
    shared = values.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def split(text: pa.Array) -> pa.Array:
        return unit_ends(text, shared.value, p)

    return values.where("text is not null").select("field", "id", "text", split(F.col("text")).alias("ends"))


def sentence_units(values: DataFrame, p: SentenceParams = SentenceParams()) -> DataFrame:
    """One row per unit: field, id, unit (from 1), char_start, char_end, sentence."""
    ends = sentence_ends(values, p)
    rows = ends.select("field", "id", "text", "ends", F.posexplode("ends").alias("_i", "char_end"))
    rows = rows.withColumn("_from", F.when(F.col("_i") > 0, F.col("ends")[F.col("_i") - 1]).otherwise(0))
    rows = rows.withColumn("sentence", F.regexp_replace(F.expr("substring(text, _from + 1, char_end - _from)"), "^[\\s\\u00a0\\u2000-\\u200b\\u202f\\u3000\\ufeff]+", ""))
    return rows.select("field", "id", (F.col("_i") + 1).alias("unit"), (F.col("char_end") - F.char_length("sentence")).alias("char_start"), "char_end", "sentence")
