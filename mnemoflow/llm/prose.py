"""Problem 8: text statistics per document, and natural prose told from lists, tables and junk.

Lines are described by what their tokens are: function words of the language, other words, numbers, sentence ends, commas,
column separators, symbols, garbled characters. Lines of one look in a document are pooled, and a pool's distributions over
token classes and over the language's function words are compared with profiles by Jensen-Shannon divergence. Profiles
of prose and of the other structures are learned over all documents, from pools whose look is beyond doubt.
"""

from __future__ import annotations

import unicodedata as ud
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoflow.llm.codepoints import segment_hash, slices, to_codepoints
from mnemoflow.llm.fold import fold
from mnemoflow.session import checkpoint_dir

# Languages that are told apart even where the table of common words lacks them, and their scripts (see _scripts).
LANGS = ("en", "de", "fr", "es", "ru", "hi", "ar", "zh", "ja", "th")
LANG_SCRIPTS = (0, 0, 0, 0, 1, 2, 3, 4, 4, 5)
HAN, THAI = 4, 5
BOUNDS = ((0x41, 0x250, 0), (0x400, 0x530, 1), (0x900, 0x980, 2), (0x600, 0x700, 3), (0x3040, 0xA000, HAN), (0xE00, 0xE80, THAI))
STRUCTURES = ("prose", "keywords", "list", "panel", "markup", "noise", "salad", "bare")
PROSE, KEYWORDS, LIST, PANEL, MARKUP, NOISE, SALAD, BARE = range(8)
FUNCTION, WORD, NUMBER, END, COMMA, QUOTE, COLUMN, SYMBOL, ODD, LONG = range(10)
N_CLASS = 10


@dataclass(frozen=True)
class ProseParams:
    share: float = 0.5  # of the non-blank characters that must stand in running sentences
    short_words: int = 4  # lines of fewer words are no running sentences
    short_letters: int = 9  # the same for scripts without blanks
    script_letters: int = 20  # letters of another script in a row that count as a line of their own
    list_lines: int = 3  # short lines from which a document's brief lines may be a list
    long_letters: int = 24  # a word beyond it is a run
    term_weight: float = 1.0  # of the function words' divergence beside the token classes'


@lru_cache(1)
def _character_kinds() -> np.ndarray:
    """Of every code point: 0 blank, 1 letter or mark, 2 digit, 3 letter that is a token of its own, 4 Thai, 10 + class otherwise."""
    n = 0x110000
    kinds = np.full(n, 10 + ODD, np.uint8)
    for cp in (*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000)):
        ch = chr(cp)
        cat = ud.category(ch)
        if cat[0] in "LM":
            kinds[cp] = 1
        elif cat[0] == "N":
            kinds[cp] = 2 if cat == "Nd" else 10 + ODD
        elif cat[0] == "Z":
            kinds[cp] = 0
        elif cat in ("So", "Sk", "Cc", "Cf", "Co", "Cn"):
            kinds[cp] = 10 + ODD
        else:
            kinds[cp] = 10 + SYMBOL
    kinds[0x1F300:0x1FB00] = 10 + QUOTE  # pictures in running text
    kinds[[9]] = 10 + COLUMN
    for chars, kind in ((".!?…。！？؟।۔", END), (",،、，", COMMA), ("\"'“”‘’„«»「」『』《》（）()-—–:：*~～", QUOTE), ("|;；·•", COLUMN)):
        kinds[[ord(c) for c in chars]] = 10 + kind
    kinds[[0xA, 0xD, 0x200B]] = 0
    kinds[0x3040:0x3100] = 3
    kinds[0x3400:0xA000] = 3
    kinds[0x20000:0x32400] = 3
    kinds[0x0E00:0x0E80] = np.where(kinds[0x0E00:0x0E80] == 1, 4, kinds[0x0E00:0x0E80])
    return kinds


def _scripts(flat: np.ndarray, kinds: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Script of the text that each code point stands in: Latin, Cyrillic, Devanagari, Arabic, Han and kana, Thai, 6 for none."""
    n = len(flat)
    if not n:
        return np.zeros(0, int)
    own = np.full(n, -1)
    letter = (kinds == 1) | (kinds == 3) | (kinds == 4)
    for lo, hi, k in BOUNDS:
        own[letter & (flat >= lo) & (flat < hi)] = k
    row = np.cumsum(first)
    # folding gives words of one script letters of another; a word with a Cyrillic letter left is Cyrillic
    word = np.cumsum(np.concatenate(([True], (kinds[1:] == 1) != (kinds[:-1] == 1))) | first) - 1
    own[(np.bincount(word[own == 1], minlength=word[-1] + 1) > 0)[word] & (own == 0)] = 1
    for _ in range(2):  # short runs of another script belong to what surrounds them
        at = np.flatnonzero(own >= 0)
        if not len(at):
            return np.full(n, 6)
        new = np.ones(len(at), bool)
        new[1:] = (own[at[1:]] != own[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
        run = np.cumsum(new) - 1
        lens = np.bincount(run)
        alone = np.bincount(row[at[new]], minlength=row[-1] + 1)[row[at[new]]] == 1
        weak = (lens < least) & ~alone
        if not weak.any():
            break
        strong_rows = np.zeros(row[-1] + 1, bool)
        strong_rows[row[at[new]][~weak]] = True
        weak &= strong_rows[row[at[new]]]
        own[at[weak[run]]] = -1
    # fill forward, and what comes before the first letter of a row backward
    index = np.where(own >= 0, np.arange(n), -1)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    before = np.maximum.accumulate(index)
    after = np.minimum.accumulate(np.where(own >= 0, np.arange(n), n)[::-1])[::-1]
    end = np.append(np.flatnonzero(first)[1:], n)[row - 1]
    out = np.where(before >= start, own[np.maximum(before, 0)], np.where(after < end, own[np.minimum(after, n - 1)], 6))
    return out


class Terms:
    """All function words by language; words of the scripts with blanks by hash, others by their letters.

    Languages beyond ``LANGS`` are taken from the table; their script is that of most of their terms' letters.
    """

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        terms: dict[str, set[str]] = {lang: set() for lang in LANGS}
        for lang, term in rows:
            terms.setdefault(lang, set()).add(term.lower())
        self.langs = (*LANGS, *sorted(set(terms) - set(LANGS)))
        self.by_lang = [sorted(terms[lang]) for lang in self.langs]
        self.n_term = max(1, *map(len, self.by_lang))
        self.scripts = np.array([*LANG_SCRIPTS, *(self._script("".join(t)) for t in self.by_lang[len(LANGS) :])])
        self.spaced_langs = [i for i, s in enumerate(self.scripts) if s not in (HAN, THAI)]
        self.hashes, self.numbers = {}, {}
        for i in self.spaced_langs:
            flat, starts = fold(*to_codepoints(pa.array(self.by_lang[i], pa.string())))
            h = segment_hash(flat, starts[:-1], starts[1:])
            order = np.argsort(h)
            self.hashes[i], self.numbers[i] = h[order], order

    @property
    def n_feature(self) -> int:
        return N_CLASS + self.n_term + 1

    @staticmethod
    def _script(letters: str) -> int:
        found = [sum(lo <= ord(c) < hi for c in letters) for lo, hi, _ in BOUNDS]
        return int(np.argmax(found)) if any(found) else 0

    def spaced(self, lang: int, words: np.ndarray) -> np.ndarray:
        """For each word its number among the language's function words, -1 for others."""
        if not len(self.hashes[lang]):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes[lang], words), len(self.hashes[lang]) - 1)
        return np.where(self.hashes[lang][at] == words, self.numbers[lang][at], -1)

    def letters(self, lang: int, flat: np.ndarray) -> np.ndarray:
        """For each code point the number of the function term that begins there, -1 where none does."""
        out = np.full(len(flat), -1)
        for i, term in enumerate(self.by_lang[lang]):
            hit = np.ones(max(0, len(flat) - len(term) + 1), bool)
            for k, ch in enumerate(term):
                hit &= flat[k : k + len(hit)] == ord(ch)
            out[: len(hit)][hit] = i
        return out


ENDINGS = ".!?…。！？؟।۔\"”’」』»）)*"


def _one_of(flat: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(flat, [ord(c) for c in chars])


@dataclass
class Pools:
    """Pools of the lines of one look in one document."""

    doc: np.ndarray
    lang: np.ndarray
    look: np.ndarray
    chars: np.ndarray
    features: np.ndarray


BULLET, COLUMNS, SYMBOLS, NUMBERS, SHORT, OPEN, CODE = 1, 2, 4, 8, 16, 32, 64


def describe(flat: np.ndarray, starts: np.ndarray, terms: Terms, p: ProseParams) -> tuple[Pools, dict[str, np.ndarray]]:
    """Pools of all lines, and per document the plain counts that its statistics are made of."""
    flat, starts = fold(flat, starts)
    n, docs = len(flat), len(starts) - 1
    kinds = _character_kinds()[flat]
    upper = (flat >= 65) & (flat <= 90)
    lower = np.where(upper, flat + 32, flat)
    cyr = (flat >= 0x410) & (flat <= 0x42F)
    lower = np.where(cyr, flat + 32, lower)
    doc_at = np.repeat(np.arange(docs), np.diff(starts))
    newline = flat == 0x0A
    first = np.zeros(n, bool)
    first[starts[:-1][starts[:-1] < n]] = True
    line_start = first.copy()
    line_start[1:] |= newline[:-1]
    script = _scripts(flat, kinds, first, p.script_letters)
    line_start[1:] |= script[1:] != script[:-1]
    line_at = np.cumsum(line_start) - 1
    lines = int(line_at[-1]) + 1 if n else 0
    line_doc = doc_at[np.flatnonzero(line_start)]

    # tokens: words, single letters, digit runs, and every other character
    run = np.select([kinds == 1, kinds == 2], [1, 2], 0)
    edge = np.ones(n + 1, bool)
    edge[1:-1] = (run[1:] != run[:-1]) | (run[1:] == 0) | line_start[1:]
    cut = np.flatnonzero(edge)
    begin, end = cut[:-1], cut[1:]
    kind = kinds[begin] if len(begin) else np.zeros(0, np.uint8)
    token_line = line_at[begin] if len(begin) else np.zeros(0, int)
    size = end - begin
    cls = np.select([kind == 1, kind == 2, (kind == 3) | (kind == 4)], [WORD, NUMBER, WORD], kind.astype(int) - 10)
    cls = np.where(kind == 0, -1, cls)
    cls = np.where((kind == 1) & (size > p.long_letters), LONG, cls)
    if len(begin) > 3:  # leaders: four and more of one mark in a row
        mark = flat[begin]
        same = (mark[1:] == mark[:-1]) & (begin[1:] == end[:-1]) & (cls[1:] == END)
        three = same[2:] & same[1:-1] & same[:-2]
        leader = np.zeros(len(begin), bool)
        for k in range(4):
            leader[k : k + len(three)] |= three
        cls = np.where(leader, COLUMN, cls)
    touching = np.zeros(len(begin), bool)  # digits right beside letters, as in identifiers and encoded data
    if len(begin) > 1:
        beside = (begin[1:] == end[:-1]) & (((kind[1:] == 1) & (kind[:-1] == 2)) | ((kind[1:] == 2) & (kind[:-1] == 1)))
        touching[1:] |= beside
        touching[:-1] |= beside
    cls = np.where(touching & (kind == 1) & (size > 1), LONG, cls)
    blanks = np.zeros(n, bool)
    if n > 3:  # aligned columns: runs of blanks inside a line
        blank = (kinds == 0) & ~newline
        inner = blank & (line_at == np.concatenate((line_at[1:], [-1])))
        three = inner.copy()
        three[2:] &= blank[1:-1] & blank[:-2]
        three[:2] = False
        blanks = three & ~np.concatenate(([False], three[:-1])) & ~np.isin(line_at, line_at[line_start & blank])
    words = np.zeros(0, np.uint64)
    is_word = kind == 1
    words = segment_hash(lower, begin[is_word], end[is_word])

    # language of a line by its letters; where several languages share a script, by the function words that fit the document best
    n_lang = len(terms.langs)
    line_script = script[np.flatnonzero(line_start)] if n else np.zeros(0, int)
    kana = np.bincount(line_at[(flat >= 0x3040) & (flat < 0x3100)], minlength=lines) if n else np.zeros(0)
    han = np.bincount(line_at[(flat >= 0x3400) & (flat < 0xA000)], minlength=lines) if n else np.zeros(0)
    line_lang = np.zeros(lines, int)
    word_line = token_line[is_word] if lines else np.zeros(0, int)
    for s in range(len(BOUNDS)):
        own = np.flatnonzero(terms.scripts == s)
        here = line_script == s
        if not here.any() or not len(own):
            continue
        if s == HAN:
            own = np.concatenate((own[own == LANGS.index("zh")], own[own >= len(LANGS)]))
        if len(own) == 1:
            line_lang[here] = own[0]
            continue
        hits = np.stack([np.bincount(line_doc[word_line[terms.spaced(i, words) >= 0]] if s not in (HAN, THAI) else line_doc[line_at[terms.letters(i, flat) >= 0]], minlength=docs) for i in own])
        line_lang[here] = own[hits.argmax(0)][line_doc[here]]
    line_lang = np.where((line_script == HAN) & (kana * 8 > han), LANGS.index("ja"), line_lang)
    size_of = np.bincount(line_doc * n_lang + line_lang, np.bincount(line_at[kinds != 0], minlength=lines), docs * n_lang) if lines else np.zeros(docs * n_lang)
    lang = size_of.reshape(docs, n_lang).argmax(1) if docs else np.zeros(0, int)
    by_blanks = np.isin(terms.scripts, (HAN, THAI), invert=True)[line_lang] if lines else np.zeros(0, bool)

    term = np.full(len(begin), -1)
    word_lang = line_lang[word_line] if lines else np.zeros(0, int)
    found = np.full(len(words), -1)
    for i in terms.spaced_langs:
        mine = word_lang == i
        if mine.any():
            found[mine] = terms.spaced(i, words[mine])
    term[is_word] = found
    for i in range(n_lang):
        if terms.scripts[i] in (HAN, THAI) and (line_lang == i).any():
            at = terms.letters(i, flat)[begin]
            term = np.where((line_lang[token_line] == i) & (kind >= 3) & (kind <= 4), at, term)
    cls = np.where((term >= 0) & (cls == WORD), FUNCTION, cls)

    counts = np.zeros((lines, N_CLASS))
    ok = cls >= 0
    np.add.at(counts, (token_line[ok], cls[ok]), 1)
    if blanks.any():
        np.add.at(counts, (line_at[blanks], np.full(int(blanks.sum()), COLUMN)), 1)
    nonblank = np.bincount(line_at[kinds != 0], minlength=lines) if lines else np.zeros(0)
    terms_of = np.zeros((lines, terms.n_term))
    got = (term >= 0) & (cls == FUNCTION)
    np.add.at(terms_of, (token_line[got], term[got]), 1)

    word_count = counts[:, FUNCTION] + counts[:, WORD] + counts[:, LONG]
    total = np.maximum(counts.sum(1), 1)
    shortest = np.where(by_blanks, p.short_words, p.short_letters)
    shortest = np.where(line_script == THAI, p.short_letters + 3, shortest)
    # how a line begins
    solid = np.flatnonzero(kinds != 0)
    at0 = np.searchsorted(solid, np.flatnonzero(line_start)) if n else np.zeros(0, int)
    has = (at0 < len(solid)) if n else np.zeros(0, bool)
    pos = solid[np.minimum(at0, max(len(solid) - 1, 0))] if len(solid) else np.zeros(lines, int)
    has &= line_at[pos] == np.arange(lines) if len(solid) else False
    head = np.where(has, flat[pos] if n else 0, 0)
    after = np.where(has & (pos + 1 < n), flat[np.minimum(pos + 1, max(n - 1, 0))] if n else 0, 0)
    number_head = (kinds[pos] == 2) if len(solid) else np.zeros(lines, bool)
    dotted = np.zeros(lines, bool)
    for step in (1, 2, 3):
        nxt = np.minimum(pos + step, max(n - 1, 0))
        if n:
            dotted |= number_head & np.isin(flat[nxt], [0x2E, 0x29]) & (kinds[np.minimum(nxt + 1, n - 1)] == 0)
    bullet = (np.isin(head, [ord(c) for c in "-*·•+#=>"]) & ((after == 0x20) | (after == head))) | (np.isin(head, [0x5B]) & np.isin(after, [0x20, 0x78, 0x58])) | dotted
    quote_mark = head == ord(">")  # quoted prose stays prose
    bullet &= ~quote_mark
    ends = counts[:, END]
    live = nonblank > 0
    # where most of a document's brief lines are too short for a sentence, the others are items too
    brief = live & (word_count < 2 * shortest)
    short = live & (word_count < shortest)
    tail = np.zeros(lines, np.uint32)
    if len(solid):
        at1 = np.searchsorted(solid, np.append(np.flatnonzero(line_start)[1:], n)) - 1
        tail = np.where(live, flat[solid[np.maximum(at1, 0)]], 0)
    if lines > 1:  # the rest of a wrapped line
        wraps = live[:-1] & ~brief[:-1] & ~_one_of(tail[:-1], ENDINGS) & (line_doc[1:] == line_doc[:-1])
        short[1:] &= ~wraps
    items = np.bincount(line_doc[short], minlength=docs) if lines else np.zeros(docs)
    of = np.bincount(line_doc[brief], minlength=docs) if lines else np.zeros(docs)
    listed = (items >= p.list_lines) & (items * 2 >= of)
    short |= brief & listed[line_doc]
    short |= bullet & (ends == 0)
    look = np.zeros(lines, int)
    look |= np.where(bullet, BULLET, 0)
    look |= np.where(counts[:, COLUMN] * 4 > word_count, COLUMNS, 0)
    look |= np.where(counts[:, SYMBOL] + counts[:, ODD] > 0.15 * total, SYMBOLS, 0)
    look |= np.where(counts[:, NUMBER] > 0.3 * total, NUMBERS, 0)
    look |= np.where(short, SHORT, 0)
    look |= np.where(ends == 0, OPEN, 0)
    look |= np.where(counts[:, LONG] > 0.2 * np.maximum(word_count, 1), CODE, 0)
    key = (line_doc * n_lang + line_lang) * 128 + look
    keys, inverse = np.unique(key[live], return_inverse=True)
    features = np.zeros((len(keys), terms.n_feature))
    np.add.at(features, inverse, np.concatenate((counts, terms_of, word_count[:, None]), 1)[live])
    chars = np.bincount(inverse, nonblank[live], len(keys)) if len(keys) else np.zeros(0)
    pools = Pools(keys // 128 // n_lang, keys // 128 % n_lang, keys % 128, chars, features)

    def doc_sum(values: np.ndarray) -> np.ndarray:
        return np.bincount(line_doc, values, docs) if lines else np.zeros(docs)

    letters_in_words = np.bincount(line_doc[token_line[is_word | (kind == 3) | (kind == 4)]], size[is_word | (kind == 3) | (kind == 4)], docs) if lines else np.zeros(docs)
    last = live & _one_of(tail, ENDINGS + ":：;；,，、")
    stats = {
        "lang": lang,
        "lines": doc_sum(live.astype(float)),
        "lines_punctuated": doc_sum(last.astype(float)),
        "words": doc_sum(word_count),
        "common": doc_sum(counts[:, FUNCTION]),
        "letters": letters_in_words,
        "symbols": doc_sum(counts[:, SYMBOL] + counts[:, ODD] + counts[:, COLUMN]),
        "chars": doc_sum(nonblank),
        "bullets": doc_sum((bullet & live).astype(float)),
    }
    return pools, stats


def _seed(pools: Pools) -> np.ndarray:
    """The structure of the pools whose look is beyond doubt, -1 for the others."""
    f = pools.features
    words, total = np.maximum(f[:, -1], 1), np.maximum(f[:, :N_CLASS].sum(1), 1)
    look = pools.look
    common = f[:, FUNCTION] / words
    plain = look == 0
    out = np.full(len(look), -1)
    out[plain & (words >= 15) & (common > 0.08) & (f[:, END] * 40 > words)] = 0
    out[((look & ~OPEN) == 0) & (words >= 10) & (f[:, COMMA] * 3 > words) & (f[:, END] == 0)] = 1
    out[((look & BULLET) > 0) & ((look & OPEN) > 0) & ((look & SHORT) > 0)] = 2
    out[((look & (NUMBERS | COLUMNS)) > 0) & ((look & SYMBOLS) == 0) & (words >= 3)] = 3
    out[((look & (SYMBOLS | CODE)) > 0) & (f[:, WORD] > 0.2 * total)] = 4
    out[((look & (SYMBOLS | CODE)) > 0) & (f[:, WORD] <= 0.2 * total)] = 5
    return out


def _distributions(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over the token classes, and over the function words with one place for all other words."""
    a = features[:, :N_CLASS]
    b = np.concatenate((features[:, N_CLASS:-1], np.maximum(features[:, -1] - features[:, FUNCTION], 0)[:, None]), 1)
    return a / np.maximum(a.sum(1, keepdims=True), 1e-9), b / np.maximum(b.sum(1, keepdims=True), 1e-9)


def divergence(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of x and the distribution y (or each row of it)."""
    m = (x + y) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        a = np.broadcast_to(a, m.shape)
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(-1)

    return (kl(x) + kl(y)) / 2


def _scored(pools: Pools, profiles: np.ndarray, p: ProseParams) -> np.ndarray:
    """The nearest structure of every pool; for pools of lines too short to be sentences, of the structures that aren't prose."""
    a, b = _distributions(pools.features)
    out = np.zeros(len(pools.doc), int)
    for lang in range(len(profiles)):
        mine = np.flatnonzero(pools.lang == lang)
        if not len(mine):
            continue
        pa_, pb = _distributions(profiles[lang])
        d = np.stack([divergence(a[mine], pa_[s]) + p.term_weight * divergence(b[mine], pb[s]) for s in range(len(STRUCTURES))])
        d[profiles[lang].sum(1) == 0] = np.inf
        short = (pools.look[mine] & SHORT) > 0
        d[PROSE, short] = d[BARE, short] = np.inf
        nearest = np.where(np.isfinite(d).any(0), d.argmin(0), np.where(short, LIST, PROSE))
        out[mine] = np.where(nearest == BARE, PROSE, nearest)
    return out


def _packed(pools: Pools, docs: int) -> list[bytes]:
    """The pools of each document as bytes: language, look, characters and features, most of which are 0."""
    cut = np.searchsorted(pools.doc, np.arange(docs + 1))
    table = np.concatenate((pools.lang[:, None], pools.look[:, None], pools.chars[:, None], pools.features), 1).astype("<u4")
    return [zlib.compress(table[a:b].tobytes(), 1) for a, b in zip(cut[:-1], cut[1:])]


def _unpacked(column: pa.Array, n_feature: int) -> Pools:
    tables = [np.frombuffer(zlib.decompress(v.as_py()), "<u4").reshape(-1, 3 + n_feature) for v in column]
    doc = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
    table = np.concatenate(tables).astype(np.int64) if tables else np.zeros((0, 3 + n_feature), np.int64)
    return Pools(doc, table[:, 0], table[:, 1], table[:, 2].astype(float), table[:, 3:].astype(float))


STATS = ("lines", "lines_punctuated", "words", "common", "letters", "symbols", "chars", "bullets")


def common_terms(common_words: DataFrame) -> Terms:
    """The table of common words, which has one row per word of a language and doesn't grow with the documents."""
    return Terms([(r.lang, r.term) for r in common_words.where("lang is not null and term <> ''").select("lang", "term").distinct().toLocalIterator()])


def described(documents: DataFrame, terms: Terms, p: ProseParams = ProseParams()) -> DataFrame:
    """doc_id, lang (number), pools (packed) and plain counts of every document, from one reading of the texts."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)
    names = ["doc_id", "lang", "pools", *STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for x, y in slices(column):
                pools, s = describe(*to_codepoints(column.slice(x, y - x)), shared.value, p)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(x, y - x), pa.array(s["lang"].astype(np.int32)), pa.array(_packed(pools, y - x), pa.binary()), *(pa.array(s[n].astype(np.int64)) for n in STATS)], names
                )

    schema = "doc_id long, lang int, pools binary, " + ", ".join(f"{n} long" for n in STATS)
    return documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, schema)


def learn_profiles(rows: DataFrame, n_lang: int, n_feature: int) -> np.ndarray:
    """Token counts of the undoubted pools by language and structure, over all described documents.

    Every task sums into one array of fixed size; where a language has none of a structure, the structure's sum over all
    languages stands in. Keywords that nothing separates and prose that its writer didn't punctuate have the counts of keywords and of prose without those of
    the marks: their look alone doesn't tell them apart, so they can't be learned from undoubted pools.
    """
    shape = (n_lang, len(STRUCTURES), n_feature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            pools = _unpacked(batch.column("pools"), n_feature)
            seed = _seed(pools)
            sure = seed >= 0
            np.add.at(total, (pools.lang[sure], seed[sure]), pools.features[sure])
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], ["place", "value"])

    sums = rows.select("pools").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    profiles = np.zeros(np.prod(shape))
    for row in sums.toLocalIterator():  # at most as many rows as the array has places
        profiles[row.place] = row.value
    profiles = profiles.reshape(shape)
    whole = profiles.sum(0)
    for s in (KEYWORDS, LIST, PANEL, MARKUP, NOISE):
        for lang in range(n_lang):
            if profiles[lang, s].sum() < 200:
                profiles[lang, s] = profiles[lang, s] + whole[s] / max(1.0, whole[s].sum()) * 200
    for derived, base, marks in ((SALAD, KEYWORDS, [COMMA]), (BARE, PROSE, [END, COMMA, QUOTE])):
        profiles[:, derived] = profiles[:, base]
        profiles[:, derived, marks] = 0
    return profiles


def text_statistics(documents: DataFrame, common_words: DataFrame, p: ProseParams = ProseParams()) -> DataFrame:
    """Statistics of every document: doc_id, words, mean_word_length, symbol_ratio, punctuated_lines, bullet_lines, common_words,
    lang_guess, prose_share, structure, is_prose.

    ``documents``: doc_id, text; ``common_words``: lang, term; other columns are ignored. Ratios are of non-blank characters (symbols), lines
    that aren't blank, and words. structure is that of most characters; is_prose says that at least ``share`` of the non-blank
    characters stand in running sentences. A null or blank text has counts of 0, null ratios, and isn't prose.
    """
    checkpoint_dir(documents.sparkSession)
    terms = common_terms(common_words)
    langs, n_feature = terms.langs, terms.n_feature
    rows = described(documents, terms, p).checkpoint()  # read twice: for the profiles, and to compare with them
    shared = documents.sparkSession.sparkContext.broadcast(learn_profiles(rows, len(langs), n_feature))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            pools = _unpacked(batch.column("pools"), n_feature)
            structure = _scored(pools, model, p)
            n = batch.num_rows
            by = np.zeros((n, len(STRUCTURES)))
            np.add.at(by, (pools.doc, structure), pools.chars)
            chars = batch.column("chars").to_numpy()
            share = np.divide(by[:, 0], chars, out=np.zeros(n), where=chars > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([langs[i] for i in batch.column("lang").to_pylist()], pa.string()), pa.array(share, mask=chars == 0), pa.array([STRUCTURES[i] for i in by.argmax(1)], mask=chars == 0), pa.array(share >= p.share), *(batch.column(c) for c in STATS)],
                ["doc_id", "lang_guess", "prose_share", "structure", "is_prose", *STATS],
            )

    schema = "doc_id long, lang_guess string, prose_share double, structure string, is_prose boolean, " + ", ".join(f"{n} long" for n in STATS)
    made = rows.mapInArrow(run, schema)
    return made.select(
        "doc_id", "words", F.try_divide("letters", "words").alias("mean_word_length"), F.try_divide("symbols", "chars").alias("symbol_ratio"), F.try_divide("lines_punctuated", "lines").alias("punctuated_lines"),
        F.try_divide("bullets", "lines").alias("bullet_lines"), F.try_divide("common", "words").alias("common_words"), "lang_guess", "prose_share", "structure", "is_prose",
    )
