"""One form for texts that print alike.

Texts are taken as numpy code-point arrays. A lookup table gives each code point its replacement; where
it has none or several, output positions come from the running sum of the replacements' lengths.
Combining marks are then put in canonical order and composed, all marks of a batch at a time.
"""

from __future__ import annotations

import sys
import unicodedata as ud
from functools import lru_cache

import numpy as np
import pyarrow as pa

from mnemoflow.llm.codepoints import slices, to_codepoints, to_strings, validity

# Letters that look like the first letter of the line.
LOOKALIKES = """
A А Α Ꭺ
B В Β Ᏼ
C С Ϲ Ꮯ
D Ꭰ
E Е Ε Ꭼ
F Ϝ
G Ԍ Ꮐ
H Н Η Ꮋ
I І Ι Ӏ
J Ј Ϳ Ꭻ
K К Κ Ꮶ
L Ꮮ
M М Μ Ꮇ
N Ν
O О Ο Օ
P Р Ρ Ꮲ
Q Ԛ
R Ꭱ Ꮢ
S Ѕ Տ Ꮪ
T Т Τ Ꭲ
U Ս
V Ꮩ Ѵ
W Ԝ Ꮃ
X Х Χ
Y У Ү Υ
Z Ζ Ꮓ
a а α ɑ
c с ϲ
d ԁ
e е
g ɡ ց
h һ հ
i і ι
j ј ϳ
l ӏ
n ո
o о ο օ
p р ρ
q ԛ գ
s ѕ
u υ ս
v ν ѵ
w ԝ
x х χ
y у ү γ
ك ک
ي ی
ه ہ
μ µ
一 ー
二 ニ
八 ハ
力 カ
卜 ト
口 ロ
夕 タ
工 エ
へ ヘ
べ ベ
ぺ ペ
"""

# Radicals of the supplement block, each before the ideograph it looks like.
RADICALS = """
⺁厂 ⺄乙 ⺅亻 ⺆冂 ⺈刀 ⺉刂 ⺊卜 ⺌小 ⺍小 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺗心 ⺘扌 ⺙攵 ⺛旡 ⺜日 ⺝月
⺞歺 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺦丬 ⺧牛 ⺨犭 ⺩王 ⺪疋 ⺫目 ⺬示 ⺭礻 ⺮竹 ⺯糹 ⺰纟 ⺱罓 ⺲罒 ⺶羊 ⺹耂 ⺺肀 ⺻聿 ⺼肉
⺽臼 ⺾艹 ⺿艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻈讠 ⻉贝 ⻊足 ⻋车 ⻌辶 ⻍辶 ⻎辶 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻕阜 ⻖阝
⻗雨 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟飠 ⻠饣 ⻡首 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜
⻰龙 ⻱龜 ⻲亀
"""

#: Compatibility mappings that keep the look of a text. <super>, <sub>, <circle>, <fraction> and <square> change it.
_ALIKE = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
_VISIBLE_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_FILLERS = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_LINES = {0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029}


def _compatible(name: str, tag: str, parts: list[int]) -> bool:
    if tag in _ALIKE:
        return True
    return tag == "<compat>" and parts[0] != 0x20 and any(w in name for w in ("RADICAL", "ELLIPSIS", "DOT LEADER", "LIGATURE", "DIGRAPH", "ROMAN NUMERAL", "SARA AM", "VOWEL SIGN AM", " WITH CARON", "LETTER DZ", "LETTER LJ", "LETTER NJ"))


def _replacements() -> dict[int, tuple[int, ...]]:
    alike: dict[int, int] = {}
    for line in LOOKALIKES.split("\n"):
        first, *others = line.split() or [""]
        alike |= {ord(o): ord(first) for o in others}
    alike |= {ord(pair[0]): ord(pair[1]) for pair in RADICALS.split()}
    done: dict[int, tuple[int, ...]] = {}

    def of(cp: int) -> tuple[int, ...]:
        if cp in done:
            return done[cp]
        ch = chr(cp)
        kind = ud.category(ch)
        if cp in (0x09, 0x0A, 0x0D):
            out: tuple[int, ...] = (cp,)  # carriage returns are settled with their neighbours
        elif cp in _LINES:
            out = (0x0A,)
        elif cp in _FILLERS or kind == "Cc" or (kind == "Cf" and cp not in _VISIBLE_FORMATS):
            out = ()
        elif kind == "Zs":
            out = (0x20,)
        elif cp in alike:
            out = of(alike[cp])
        elif 0xAC00 <= cp <= 0xD7A3:
            out = tuple(map(ord, ud.normalize("NFD", ch)))
        else:
            tag, *rest = (ud.decomposition(ch) or "-").split()
            if tag == "-":
                out = (cp,)
            elif tag[0] != "<":
                out = tuple(x for p in (tag, *rest) for x in of(int(p, 16)))
            else:
                parts = [int(p, 16) for p in rest]
                out = tuple(x for p in parts for x in of(p)) if _compatible(ud.name(ch, ""), tag, parts) else (cp,)
        done[cp] = out
        return out

    return {cp: out for cp in range(sys.maxunicode + 1) if not _plain(cp) and (out := of(cp)) != (cp,)}


def _plain(cp: int) -> bool:
    """Large blocks that hold nothing to replace."""
    return 0x3400 <= cp < 0xA000 or 0x17000 <= cp < 0x1B000 or 0x20000 <= cp < 0x2F800 or 0x2FA20 <= cp < 0xE0000 or 0xE0200 <= cp or 0xD800 <= cp < 0xF900


class Tables:
    """Replacement, combining class and composition tables over all code points."""

    def __init__(self) -> None:
        n = sys.maxunicode + 1
        table = _replacements()
        self.single = np.arange(n, dtype=np.uint32)
        self.length = np.ones(n, np.uint8)
        self.first = np.zeros(n, np.int32)
        pool: list[int] = []
        for cp, out in table.items():
            self.length[cp] = len(out)
            if len(out) == 1:
                self.single[cp] = out[0]
            else:
                self.first[cp] = len(pool)
                pool.extend(out)
        self.pool = np.array(pool, np.uint32)
        self.touched = (self.length != 1) | (self.single != np.arange(n))
        self.touched[0x0D] = True
        self.ccc = np.zeros(n, np.uint8)
        pairs: dict[int, int] = {}
        moved: dict[int, int] = {}  # pairs whose base is itself replaced; they give way to the others
        seconds = np.zeros(n, bool)
        for cp in range(n):
            if _plain(cp) and not 0xAC00 <= cp <= 0xD7A3:
                continue
            ch = chr(cp)
            self.ccc[cp] = ud.combining(ch)
            if 0xAC00 <= cp <= 0xD7A3:
                s = cp - 0xAC00
                lv, t = 0xAC00 + s // 28 * 28, s % 28
                a, b = (lv, 0x11A7 + t) if t else (0x1100 + s // 588, 0x1161 + s % 588 // 28)
            else:
                parts = ud.decomposition(ch).split()
                if len(parts) != 2 or parts[0][0] == "<" or ud.normalize("NFC", ch) != ch:
                    continue
                a, b = (int(p, 16) for p in parts)
                base = self._base(table, a)
                if base != a:
                    moved.setdefault((base << 21) | b, cp)
            pairs.setdefault((a << 21) | b, cp)
            seconds[b] = True
        pairs = moved | pairs
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_values = keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)
        self.second = seconds
        self.marky = (self.ccc > 0) | seconds

    @staticmethod
    def _base(table: dict[int, tuple[int, ...]], cp: int) -> int:
        """The base as it stands after replacement and composition of what it consists of."""
        out = table.get(cp, (cp,))
        if len(out) == 1:
            return out[0]
        again = ud.normalize("NFC", "".join(map(chr, out)))
        return ord(again) if len(again) == 1 else cp

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composed letter of each pair, 0 where there is none."""
        key = (a.astype(np.int64) << 21) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], 0).astype(np.uint32)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def fold(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bring every row to its one form. Returns new code points and row offsets.

    Case, accents, digits, superscripts and the number of blanks and line breaks stay.
    """
    t = tables()
    if not len(flat) or not (t.touched[flat] | t.marky[flat]).any():
        return flat, starts
    last = np.zeros(len(flat), bool)
    ends = starts[1:][np.diff(starts) > 0] - 1
    last[ends] = True
    cr = flat == 0x0D
    lens = t.length[flat].astype(np.int64)
    one = t.single[flat]
    if cr.any():
        before_lf = np.zeros(len(flat), bool)
        before_lf[:-1] = cr[:-1] & (flat[1:] == 0x0A) & ~last[:-1]
        lens[before_lf] = 0
        one = np.where(cr, np.uint32(0x0A), one)
    at = np.concatenate(([0], np.cumsum(lens)))
    if (lens == 1).all():
        out = one.copy()
    else:
        source = np.repeat(np.arange(len(flat)), lens)
        within = np.arange(len(source)) - at[source]
        many = lens[source] > 1
        out = one[source]
        index = t.first[flat[source[many]]] + within[many]
        out[many] = t.pool[index]
    return _marks(out, at[starts], t)


def _marks(out: np.ndarray, starts: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Order and compose the marks of all rows."""
    if not len(out) or not t.marky[out].any():
        return out, starts
    n = len(out)
    ccc = t.ccc[out]
    # canonical order: sort each run of marks by class, keeping the order of equals
    marked = np.flatnonzero(ccc > 0)
    if len(marked) > 1:
        row_start = np.zeros(n, bool)
        row_start[starts[:-1][starts[:-1] < n]] = True
        new_run = np.ones(len(marked), bool)
        new_run[1:] = (np.diff(marked) > 1) | row_start[marked[1:]]
        run = np.cumsum(new_run)
        if ((np.diff(ccc[marked].astype(int)) < 0) & ~new_run[1:]).any():
            order = np.lexsort((np.arange(len(marked)), ccc[marked], run))
            out[marked] = out[marked[order]]
            ccc[marked] = t.ccc[out[marked]]
    keep = np.ones(n, bool)
    row = np.searchsorted(starts, np.arange(n), "right") - 1 if t.second[out].any() else None
    if row is not None:
        # one pass for each place after the letter: all first marks of the batch, then all second ones, ...
        waiting = np.flatnonzero(t.second[out])
        letter = np.cumsum(~t.marky[out])
        starter = np.maximum.accumulate(np.where(ccc == 0, np.arange(n), -1))
        previous = np.arange(n) - 1  # nearest kept code point before
        while len(waiting):
            ready = np.ones(len(waiting), bool)
            ready[1:] = letter[waiting[1:]] != letter[waiting[:-1]]
            chosen = waiting[ready]
            base = np.where(ccc[chosen] == 0, previous[chosen], starter[chosen])
            ok = (base >= 0) & (row[np.maximum(base, 0)] == row[chosen])
            between = previous[chosen]
            ok &= (between == base) | ((ccc[np.maximum(between, 0)] < ccc[chosen]) & (ccc[np.maximum(between, 0)] > 0))
            ok &= keep[np.maximum(base, 0)] & (ccc[np.maximum(base, 0)] == 0)
            made = np.where(ok, t.compose(out[np.maximum(base, 0)], out[chosen]), 0)
            hit = made > 0
            out[base[hit]] = made[hit]
            keep[chosen[hit]] = False
            gone = chosen[hit]
            after = gone[gone + 1 < n] + 1
            previous[after] = previous[after - 1]
            for_start = gone[ccc[gone] == 0]  # a composed vowel sign or final: what follows belongs to the base
            if len(for_start):
                starter[for_start] = previous[for_start]
                nxt = for_start[for_start + 1 < n] + 1
                follow = nxt[ccc[nxt] > 0]
                starter[follow] = starter[follow - 1]
            waiting = waiting[~ready]
    at = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], at[starts]


def fold_array(column: pa.Array) -> pa.Array:
    """:func:`fold` over an Arrow string array; nulls stay null."""
    parts = []
    for a, b in slices(column):
        piece = column.slice(a, b - a)
        flat, starts = to_codepoints(piece)
        parts.append(to_strings(*fold(flat, starts), validity(piece)))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())
