"""Problem 2: texts that were cut off by a length limit or in transfer.

How a text ends says whether it may be cut; the lengths of the texts of one source say where it cuts. For every source and
unit of length, the hazard of a length (of the texts that get that far, the share that stop there with an ending of one kind) is
compared with the hazards of the lengths around it, and the lengths that stand out are kept under control of the false-discovery rate.
A text of such a length is cut there with the probability 1 - expected / observed. Away from these lengths a source may cut in transfer, at any: the hazard of
its open endings is compared with that of lines inside the texts of the field, which are complete, and gives a probability in the same way. A doubtful ending
is a case only where one of the two is at least a half, and for endings that complete texts may have, where its words speak for a cut as well.
Only a mark that shows the cut needs neither.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoflow.llm.codepoints import row_of, segment_hash, slices, to_codepoints
from mnemoflow.llm.fold import fold, fold_array
from mnemoflow.session import checkpoint_dir


@dataclass(frozen=True)
class CutParams:
    reach: int = 24  # lengths on each side that a hazard is compared with
    gap: int = 4  # of them, so many next to it are left out: a limit blurs into its neighbours
    rate: float = 0.01  # false-discovery rate
    least_events: int = 5
    below: int = 24  # lengths below a significant one at which a limit still shows, as cuts move back to a letter's or word's end
    final_share: float = 0.01  # of a word's occurrences, those before a final mark, from which texts may trail off on it
    short_words: int = 7
    short_letters: int = 16
    seen: int = 2  # times that a reply or a final word must be met elsewhere to count as known
    suffix: int = 5  # letters of the end of a sentence in a script without final marks
    least: float = 0.5  # probability of a cut from which a doubtful ending counts


COMPLETE, CUT, OPEN, SHORT, TRAILING, DOTTED, LISTED, UNMARKED = range(8)
DOUBTS = ("open", "trailing", "cut", "short")  # kinds of endings whose hazards are tested
KINDS = ("complete", "cut", "open", "short", "trailing", "dotted", "listed", "unmarked")

ENDS = ".!?。！？؟।۔"
CLOSERS = "\"'”’“»」』）)]】》*`~～}>"
_LABEL = re.compile(r"^(?:用户|角色卡)\s*[：:]\s*")
_MARK = re.compile(r"(?:\[(?:\.{3}|…|truncated|cut)\]|�+)$", re.I)
_TRAIL = re.compile(r"(?:\.{3,}|…+)$")
_LIST = re.compile(r"^\s*(?:[-*·•+]\s|\d+[.)]\s|\[[ xX]\])|->|[{}<>|=]|^\s*```")
_RUN = re.compile(r"(.{1,3}?)\1{7,}$", re.S)
_SENTENCE = re.compile(r"[.!?。！？؟।…]\s*\S|[。！？؟।]|[.!?]$")
_LAST_WORD = re.compile(r"[^\W\d_]+(?:[.'’][^\W\d_]+)*$")
_WIDE = re.compile(r"[぀-鿿]")
_THAI = re.compile(r"[฀-๿]")
_PAIRS = (("「", "」"), ("『", "』"), ("«", "»"), ("（", "）"), ("(", ")"), ("《", "》"))


def _unbalanced(line: str) -> bool:
    """A quotation, bracket or action that the line opens stays open."""
    if "„" in line:
        if line.count("„") > line.count("“") + line.count("”"):
            return True
    elif line.count("“") > line.count("”"):
        return True
    return any(line.count(a) > line.count(b) for a, b in _PAIRS) or line.count('"') % 2 == 1 or (line.count("*") % 2 == 1 and not line.lstrip().startswith("* "))


def text_keys(texts: list[str]) -> pa.Array:
    """The 64-bit keys that words, endings and replies have in all statistics; 0 for ''."""
    flat, starts = to_codepoints(pa.array(texts, pa.string()))
    return pa.array(segment_hash(flat, starts[:-1], starts[1:]).astype(np.int64) * (np.diff(starts) > 0))


def _first(line: str) -> str:
    """How a line begins: its first word, or two letters of a script without blanks."""
    return line[:2] if _WIDE.search(line[:2]) else (line.split() or [""])[0].strip(",\"'“‘„«([*")


def _last_word(text: str) -> re.Match | None:
    """The word that the text ends on; its letters are looked for from the end, so that a long text costs no more."""
    at = len(text)
    while at and (text[at - 1].isalnum() and not text[at - 1].isdecimal() or text[at - 1] in ".'’"):
        at -= 1
    return _LAST_WORD.search(text[at:])


def ending(text: str, p: CutParams) -> tuple[int, str, str]:
    """(kind, word, reply) of a folded text; the strings are what statistics are asked for."""
    tail = text.rstrip()
    if not tail:
        return COMPLETE, "", ""
    if _MARK.search(tail):
        return CUT, "", ""
    line = tail[tail.rfind("\n") + 1 :]
    bare = _LABEL.sub("", line)
    if _RUN.search(tail[-64:]):
        return LISTED, "", ""
    word = _last_word(_TRAIL.sub("", bare).rstrip(CLOSERS))
    last = word.group() if word else ""
    if _WIDE.search(bare[-4:]):
        last = bare.rstrip(CLOSERS)[-2:]
    if _LIST.search(bare):
        return (COMPLETE if not last else LISTED), last, ""
    trail = _TRAIL.search(bare)
    if trail:
        before = bare[: trail.start()]
        final = _last_word(before)
        return TRAILING, (before[-2:] if _WIDE.search(before[-2:]) else final.group() if final and not _THAI.search(before[-2:]) else ""), ""
    body = bare.rstrip(CLOSERS)
    closed = len(body) < len(bare)
    if _unbalanced(bare):
        return OPEN, last, ""
    if body and body[-1] in ENDS:
        if body[-1] == "." and not closed and word is None:
            final = re.search(r"(\S+)\.$", body)
            return DOTTED, (final.group(1).lstrip("\"'“‘„«([*") if final else ""), ""
        return COMPLETE, "", ""
    if closed or not (body and (body[-1].isalnum() or body[-1] in ",，、;；-—–" or _THAI.search(body[-1]))):
        return (COMPLETE, "", "") if not (body and body[-1] in ",，、;；—–") else (OPEN, "", "")
    wide, thai = bool(_WIDE.search(bare)), bool(_THAI.search(bare))
    words = len(bare.split())
    brief = (len(bare) <= p.short_letters if wide else words <= p.short_words) and not _SENTENCE.search(bare)
    if thai:
        return UNMARKED, body[-p.suffix :], bare if len(bare) <= p.short_letters else ""
    if brief:
        return SHORT, last, bare
    return OPEN, last, ""


def _endings(batches: Iterator[pa.RecordBatch], p: CutParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        folded = fold_array(batch.column("text"))
        kinds, words, replies, firsts, wholes, inner = [], [], [], [], [], []
        for text in folded.to_pylist():
            text = (text or "").strip()
            kind, word, reply = ending(text, p)
            bare = _LABEL.sub("", text[text.rfind("\n") + 1 :])
            first = _first(bare)
            kinds.append(kind)
            wholes.append("\n" not in text)
            words.append(word.lower())
            replies.append(reply)
            firsts.append(first.lower())
            inner.append(ending(text[: text.rfind("\n")], p)[0] if "\n" in text else -1)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("field", "id", "source", "cp", "u16", "bytes")), pa.array(kinds, pa.int32()), *(text_keys(v) for v in (words, replies, firsts)), pa.array(wholes, pa.bool_()), pa.array(inner, pa.int32())],
            ["field", "id", "source", "cp", "u16", "bytes", "kind", "word", "reply", "first", "whole", "inner"],
        )


def _usage(batches: Iterator[pa.RecordBatch], p: CutParams) -> Iterator[pa.RecordBatch]:
    """Partial counts of what stands inside texts: kind, key, n, m. Kinds: w words; d words before a full stop, m at a line's end; f words before
    final marks and line ends;
    l last words of lines that aren't the last; t endings before a blank in a script without final marks."""
    for batch in batches:
        for a, b in slices(batch.column("text")):
            flat, starts = fold(*to_codepoints(batch.column("text").slice(a, b - a)))
            n = len(flat)
            if not n:
                continue
            lower = _lowered(flat)
            letters = _letters()[flat]
            row = row_of(starts)
            nxt = np.append(flat[1:], 0)
            nxt[starts[1:][starts[1:] > 0] - 1] = 0
            edge = np.ones(n + 1, bool)
            edge[1:-1] = (letters[1:] != letters[:-1]) | (row[1:] != row[:-1])
            cut = np.flatnonzero(edge)
            begin, end = cut[:-1], cut[1:]
            mine = letters[begin] == 1
            begin, end = begin[mine], end[mine]
            out: list[tuple[str, np.ndarray, np.ndarray]] = []
            hashes = segment_hash(lower, begin, end).astype(np.int64)
            follow = np.where(end < n, flat[np.minimum(end, n - 1)], 0)
            same_row = (end < n) & (row[np.minimum(end, n - 1)] == row[begin])
            follow = np.where(same_row, follow, 0)
            whole = follow != 0
            out.append(("w", hashes[whole], np.zeros(int(whole.sum()), bool)))
            dot = follow == 0x2E
            after = np.where(same_row & (end + 1 < n), flat[np.minimum(end + 1, n - 1)], 0)
            known = dot & same_row & (end + 1 < starts[row[begin] + 1])
            out.append(("d", hashes[known], after[known] == 0x0A))
            final = follow == 0x0A
            out.append(("l", hashes[final], np.zeros(int(final.sum()), bool)))
            ends = np.array([ord(c) for c in ENDS + "\n"], np.uint32)
            last = np.isin(follow, ends) & (end + 4 < starts[row[begin] + 1])  # a mark at a text's own end says nothing here
            out.append(("f", hashes[last], np.zeros(int(last.sum()), bool)))
            for what, wide in (("l", nxt == 0x0A), ("f", np.isin(nxt, ends))):
                wide = np.flatnonzero((flat >= 0x3040) & (flat < 0xA000) & wide)
                wide = wide[(wide > 0) & (wide + 5 < starts[row[wide] + 1])]
                out.append((what, segment_hash(lower[(wide[:, None] + np.array([-1, 0])).ravel()], np.arange(0, 2 * len(wide), 2), np.arange(2, 2 * len(wide) + 1, 2)).astype(np.int64), np.zeros(len(wide), bool)))
            thai = np.flatnonzero((flat >= 0xE00) & (flat < 0xE80) & ((nxt == 0x20) | (nxt == 0x0A)))
            thai = thai[thai - starts[row[thai]] >= p.suffix - 1]
            around = (thai[:, None] + np.arange(1 - p.suffix, 1)).ravel()
            out.append(("t", segment_hash(lower[around], np.arange(0, p.suffix * len(thai), p.suffix), np.arange(p.suffix, p.suffix * len(thai) + 1, p.suffix)).astype(np.int64), np.zeros(len(thai), bool)))
            for kind, keys, hit in out:
                values, at = np.unique(keys, return_inverse=True)
                if len(values):
                    count = np.bincount(at, minlength=len(values))
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(values)), pa.array(values), pa.array(count.astype(np.int64)), pa.array(np.bincount(at, hit, len(values)).astype(np.int64))], ["what", "key", "n", "m"])


def _lowered(flat: np.ndarray) -> np.ndarray:
    out = np.where((flat >= 65) & (flat <= 90) | (flat >= 0x410) & (flat <= 0x42F) | (flat >= 0xC0) & (flat <= 0xDE) & (flat != 0xD7), flat + 32, flat)
    return out.astype(np.uint32)


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.zeros(0x110000, np.uint8)
        for cp in (*range(0x41, 0xE00), *range(0xE80, 0x3000)):
            ch = chr(cp)
            _LETTERS[cp] = ch.isalpha() or 0x300 <= cp < 0x370 or 0x900 <= cp < 0xE00 and not ch.isspace() and ch not in "।॥"
    return _LETTERS


_LETTERS: np.ndarray | None = None


def measured(values: DataFrame, p: CutParams = CutParams()) -> DataFrame:
    """field, id, source, three lengths, kind of ending and the keys it depends on, of every value; inner is the kind of the last line but one."""
    rows = values.where("text is not null and id is not null").select(
        "field", "id", "source", "text", F.char_length("text").cast("long").alias("cp"), (F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("long").alias("u16"), F.octet_length("text").cast("long").alias("bytes")
    )
    return rows.mapInArrow(lambda it: _endings(it, p), "field string, id long, source string, cp long, u16 long, bytes long, kind int, word long, reply long, first long, whole boolean, inner int")


def _doubt() -> Column:
    """The doubt that an ending is tested under, null for complete ones."""
    kind = F.col("kind")
    return F.when(kind == CUT, "cut").when(kind == TRAILING, "trailing").when(kind == OPEN, "open").when(kind.isin(SHORT, UNMARKED), "short")


def significant_lengths(rows: DataFrame, p: CutParams = CutParams()) -> DataFrame:
    """Lengths at which a source's texts stop in a doubtful way more often than around them: field, source, doubt, unit, length, events, risk, expected, p.

    The doubts are endings of one kind (open, trailing, cut, short). The bound exp(-(k ln(k/m) - k + m)) on the tail of a Poisson count k of
    mean m serves as p value; Benjamini and Hochberg's step-up controls the false-discovery rate within field and source.
    """
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("cp", "u16", "bytes")])).alias("_u")
    counts = rows.select("field", "source", _doubt().alias("doubt"), units).select("field", "source", "doubt", "_u.unit", "_u.length").groupBy("field", "source", "unit", "length", "doubt").agg(F.count("*").alias("n"))
    at = counts.groupBy("field", "source", "unit", "length").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("doubt") == d, F.col("n")).otherwise(0)).alias(d) for d in DOUBTS])
    group = Window.partitionBy("field", "source", "unit").orderBy("length")
    at = at.withColumn("risk", F.sum("n").over(group.rowsBetween(0, Window.unboundedFollowing)))
    long = at.select("field", "source", "unit", "length", "risk", F.explode(F.array(*[F.struct(F.lit(d).alias("doubt"), F.col(d).alias("events")) for d in DOUBTS])).alias("_d")).select("*", "_d.*").drop("_d")
    near = Window.partitionBy("field", "source", "unit", "doubt").orderBy("length")
    low, high = near.rangeBetween(-p.reach, -p.gap), near.rangeBetween(p.gap, p.reach)
    sums = [F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("events", "risk") for w in (low, high)]
    tested = long.withColumn("hazard", (sums[0] + sums[1] + 0.5) / (sums[2] + sums[3] + 1.0)).withColumn("expected", F.col("hazard") * F.col("risk"))
    k, m = F.col("events").cast("double"), F.col("expected")
    tested = tested.where(F.col("events") > 0).withColumn("p", F.when(k > m, F.exp(-(k * F.log(k / m) - k + m))).otherwise(1.0))
    family = Window.partitionBy("field", "source")
    ranked = tested.withColumn("_r", F.row_number().over(family.orderBy("p", "unit", "doubt", "length"))).withColumn("_m", F.count("*").over(family))
    ranked = ranked.withColumn("_top", F.max(F.when(F.col("p") <= p.rate * F.col("_r") / F.col("_m"), F.col("p"))).over(family))
    return ranked.where((F.col("p") <= F.col("_top")) & (F.col("events") >= p.least_events)).select("field", "source", "doubt", "unit", "length", "events", "risk", "expected", "p")


def transfer_cuts(rows: DataFrame) -> DataFrame:
    """field, source, transfer: the probability that an open ending of the source away from significant lengths is a cut.

    ``rows``: measured values with at_limit. It is 1 - expected / observed: expected is the share of open endings among lines that aren't a text's last,
    in the whole field, observed the share among the ends of the source's values.
    """
    base = rows.where("inner >= 0").groupBy("field").agg((F.count_if(F.col("inner") == OPEN) + 0.5).alias("_b"), (F.count("*") + 1).alias("_n"))
    ends = rows.where("not at_limit").groupBy("field", "source").agg(F.count_if(F.col("kind") == OPEN).alias("_k"), F.count("*").alias("_m"))
    both = ends.join(base, "field", "left")
    expected = F.coalesce(F.col("_b") / F.col("_n"), F.lit(0.0)) * F.col("_m")
    return both.select("field", "source", F.when(F.col("_k") > expected, 1 - expected / F.col("_k")).otherwise(0.0).alias("transfer"))


def verdicts(values: DataFrame, p: CutParams = CutParams()) -> DataFrame:
    """field, id, source, kind, at_limit, unit, length, p, posterior, cut of every value.

    unit, length and p are those of the significant length that a value of a doubtful ending has, if any, posterior the probability of a cut by the hazards: there,
    or in transfer. ``values``: field, id, source, text; other columns are ignored. Nulls have no row, blank texts are complete. A null source is a source.
    """
    checkpoint_dir(values.sparkSession)  # both are read several times below, and are small beside the texts
    rows = measured(values, p).checkpoint()
    usage = values.where("text is not null").select("text").mapInArrow(lambda it: _usage(it, p), "what string, key long, n long, m long").groupBy("what", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).checkpoint()
    tested = significant_lengths(rows, p).checkpoint()  # as few as sources and limits
    limits = tested.groupBy("field", "source", "doubt", "unit", "length").agg(F.min("p").alias("p"), F.max(1 - F.col("expected") / F.col("events")).alias("limit"))
    doubtful = rows.where(~F.col("kind").isin(COMPLETE, CUT))
    # endings that are too rare to be tested by themselves are cut where open ones are
    doubts = F.when(F.col("kind") == TRAILING, F.array(F.lit("trailing"))).when(F.col("kind").isin(SHORT, UNMARKED), F.array(F.lit("short"), F.lit("open"))).otherwise(F.array(F.lit("open")))
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("cp", "u16", "bytes")])).alias("_u")
    spread = doubtful.select("field", "source", "id", F.explode(doubts).alias("doubt"), "cp", "u16", "bytes").select("field", "source", "id", "doubt", units).select("field", "source", "id", "doubt", "_u.*")
    same = [spread["source"].eqNullSafe(limits["source"]), *[spread[c] == limits[c] for c in ("field", "doubt", "unit", "length")]]
    hit = spread.join(limits, same).select(spread["field"], "id", F.struct("limit", -limits["p"], spread["unit"], spread["length"]).alias("_h"), limits["p"])
    at_limit = hit.groupBy("field", "id").agg(F.max("_h").alias("_h"), F.min("p").alias("p"))
    at_limit = at_limit.select("field", "id", F.col("_h.limit").alias("limit"), F.col("_h.unit").alias("unit"), F.col("_h.length").alias("length"), "p")
    around = limits.where("doubt = 'trailing'").select("field", F.col("source").alias("_s"), "unit", F.explode(F.sequence(F.col("length") - p.below, F.col("length"))).alias("length")).distinct()
    close = [spread["source"].eqNullSafe(around["_s"]), *[spread[c] == around[c] for c in ("field", "unit", "length")]]
    near_limit = spread.where("doubt = 'trailing'").join(around, close, "left_semi").select("field", "id").distinct().withColumn("near_limit", F.lit(True))
    placed = rows.join(at_limit, ["field", "id"], "left").withColumn("at_limit", F.col("limit").isNotNull())
    transfer = transfer_cuts(placed.select("field", "source", "kind", "inner", "at_limit")).withColumnRenamed("source", "_s").withColumnRenamed("field", "_f")
    placed = placed.join(transfer, (F.col("field") == F.col("_f")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_f", "_s")
    posterior = F.when(F.col("kind") == CUT, 1.0).when(F.col("kind") == COMPLETE, 0.0).otherwise(F.greatest(F.coalesce("limit", F.lit(0.0)), F.when(F.col("kind").isin(OPEN, SHORT, UNMARKED), F.coalesce("transfer", F.lit(0.0))).otherwise(0.0)))
    placed = placed.withColumn("posterior", posterior)
    doubtful = placed.where(~F.col("kind").isin(COMPLETE, CUT))

    known = {w: usage.where(F.col("what") == w).select(F.col("key").alias("word"), F.col("n").alias(f"n_{w}"), F.col("m").alias(f"m_{w}")) for w in "wdltf"}
    # a reply is known when it makes up other values, or when what begins or ends like it usually is one
    replies = rows.where("whole and reply <> 0").groupBy("reply").agg(F.count("*").alias("n_r"))
    starts = rows.groupBy("first").agg(F.count("*").alias("n_s"), F.count_if((F.col("kind") == SHORT) & F.col("whole")).alias("m_s"))
    finals = rows.where(F.col("kind").isin(SHORT, OPEN) & (F.col("word") != 0)).groupBy("word").agg(F.count_if((F.col("kind") == SHORT) & F.col("whole")).alias("f_s"), F.count_if(F.col("kind") == OPEN).alias("f_o"))
    same_reply = f"coalesce(n_r, 0) >= {p.seen}"

    shown = ("field", "id", "source", "kind", "at_limit", "unit", "length", "p", "posterior")

    def judged(kind: int, tables: list[tuple[DataFrame, str]], cut: str) -> DataFrame:
        part = doubtful.where(F.col("kind") == kind)
        for table, on in tables:
            part = part.join(table, on, "left")
        if kind == TRAILING:
            part = part.join(near_limit, ["field", "id"], "left")
        return part.select(*shown, F.coalesce(F.expr(cut), F.lit(False)).alias("cut"))

    likely = f"posterior >= {p.least}"
    parts = [
        judged(OPEN, [], likely),
        judged(TRAILING, [(known["w"], "word"), (known["f"], "word")], f"{likely} or (near_limit and word <> 0 and coalesce(n_f, 0) < greatest({p.seen}, {p.final_share} * coalesce(n_w, 0)))"),
        judged(DOTTED, [(known["d"], "word")], f"{likely} and n_d >= 20 and m_d < 0.02 * n_d"),
        judged(LISTED, [(known["l"], "word")], f"coalesce(n_l, 0) < {p.seen} and {likely}"),
        judged(UNMARKED, [(known["t"], "word"), (replies, "reply")], f"{likely} and coalesce(n_t, 0) < {p.seen} and not {same_reply}"),
        judged(SHORT, [(replies, "reply"), (finals, "word"), (starts, "first")], f"{likely} and not ({same_reply} or coalesce(n_s >= 2 and m_s >= 0.6 * n_s, false) or coalesce(f_s >= 5 and f_s >= 4 * f_o and not (n_s >= 5 and m_s < 0.1 * n_s), false))"),
    ]
    out = placed.where(F.col("kind").isin(COMPLETE, CUT)).select(*shown, (F.col("kind") == CUT).alias("cut"))
    for part in parts:
        out = out.unionByName(part)
    return out.withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1))


def cut_values(values: DataFrame, p: CutParams = CutParams()) -> DataFrame:
    """field, id of the values that stop before they are complete."""
    return verdicts(values, p).where("cut").select("field", "id")


def cut_rates(values: DataFrame, p: CutParams = CutParams()) -> DataFrame:
    """Per field and source: values, how many are cut, of them those that a mark shows, those at a significant length and those in transfer, and the rate."""
    cut = F.col("cut")
    shows = F.col("kind") == "cut"
    return verdicts(values, p).groupBy("field", "source").agg(
        F.count("*").alias("values"), F.count_if(cut).alias("cut"), F.count_if(cut & shows).alias("cut_with_mark"), F.count_if(cut & ~shows & F.col("at_limit")).alias("cut_at_limit"),
        F.count_if(cut & ~shows & ~F.col("at_limit")).alias("cut_in_transfer"), F.avg(cut.cast("int")).alias("rate"),
    )
