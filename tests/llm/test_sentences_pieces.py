import random
import re
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemoflow.llm import pieces, sentences
from mnemoflow.llm.codepoints import to_codepoints
from mnemoflow.llm.tables import fragment_texts, message_texts

VALUES = "field string, id long, text string, ends string, source string"


@pytest.fixture(scope="module")
def corpus(spark):
    d = "/root/testdata/sf0.01"
    return message_texts(spark, d).unionByName(fragment_texts(spark, d, "paragraph")).select("field", "id", "text", F.lit("x").alias("ends"), F.lit("y").alias("source")).cache()


def split(spark, corpus, texts):
    """Units of the texts under the model of the corpus and themselves."""
    rows = spark.createDataFrame([("t", i, t, None, None) for i, t in enumerate(texts)], VALUES)
    out = sentences.sentence_units(corpus.unionByName(rows)).where("field = 't'").collect()
    units = {i: [] for i in range(len(texts))}
    for r in sorted(out, key=lambda r: (r.id, r.unit)):
        units[r.id].append(r.sentence)
    return [units[i] for i in range(len(texts))]


CASES = [
    ["Dr. Pell kept 8 boxes in Tarn Gate, but only 8.5 percent were usable.", "At 4 p.m. the guard of Tarn Gate fell silent."],
    ['"Run. Count them again," Rook said, and fell silent.', "“Run!” he whispered, and Rook fell silent.", "I... I never saw the map again."],
    ["According to note no. 3, the map belongs to J. R. Pell.", "Wait... is that the map from Tarn Gate?", "Why would Pell hide the seal in Tarn Gate?!"],
    ["“你来晚了？”她问道，手里还握着罗盘。", "我……我再也没见过那个鼓。", "「快走！」他低声说，维卡沉默了很久。"],
    ["「遅かったな。」とハルンが言い、雨を見つめていた。", "あの……鏡はどこですか？", "大切なのは錨で、鏡ではない！"],
    ["«Ты опоздала?» — спросила она и спрятала руку.", "По ул. Перьевой, д. 2, живёт А. Н. Санви.", "Я... я больше не видела её."],
    ["—¿Llegas tarde? —preguntó ella con la caja en la mano.", "La Sra. Velka guardó 25 cajas, pero solo el 25.6 por ciento servía."],
    ["„Lauf?“, fragte sie und hielt die Karte fest.", "Am 12. Mai stand die Linse noch bei der Federgasse.", "Aschka suchte z. B. die Karte, die Münze usw. bei dem Mühlhof."],
    ["« Cours ? » demanda-t-elle en serrant la clé.", "M. Tobren pesa la clé : 34.2 kg, c.-à-d. plus que prévu."],
    ["“भागो। धीरे बोलो।” मिरेला ने कहा और अकेली लौट आई।", "डॉ. सान्वी ने 31 सिक्के गिने, पर 31.8 प्रतिशत नकली थे।", "यह चाबी वेधशाला में किसने रखा?"],
    ["«اركضي؟» سألت وهي تمسك الختم.", "قال د. سانفي إن الحبل رقم 342 مفقود!"],
    ["“รีบไป มาช้าไปแล้ว”เวลกาพูดเบาๆ แล้วเดินออกไป", "เธอนับเหรียญได้ 12 อันแล้วเก็บลงหีบ", "ใครเอาหีบมาไว้ที่หอดูดาว?"],
]


def test_joined_sentences_come_apart(spark, corpus):
    rng = random.Random(4)
    texts, want = [], []
    for case in CASES:
        for _ in range(4):
            chosen = [rng.choice(case) for _ in range(5)]
            joint = "" if ord(chosen[0].strip("“「")[0]) in range(0x3040, 0xA000) else " "
            texts.append(joint.join(chosen[:3]) + rng.choice(["\n", "\n\n", " \r\n"]) + joint.join(chosen[3:]))
            want.append(chosen)
    got = split(spark, corpus, texts)
    right = sum(a == b for a, b in zip(got, want))
    assert right >= 0.95 * len(want), [(a, b) for a, b in zip(got, want) if a != b][:3]


def test_edges(spark, corpus):
    texts = [None, "", " \n　\n", "ok", "a\n\nb ", "。", "...", "用户：好的\n角色卡：好。走。", "x" * 200_000, "Hi! " * 5000, '"open. still open', "1. drum -> Tarn Gate\n2. map -> Tarn Gate", "a​b. ​C d."]
    got = split(spark, corpus, texts)
    assert got[:4] == [[], [], [], ["ok"]] and got[4] == ["a", "b"] and got[5] == ["。"] and got[6] == ["..."]
    assert got[7] == ["用户：好的", "角色卡：好。", "走。"] and len(got[8]) == 1 and len(got[9]) >= 1 and len(got[10]) == 1 and len(got[11]) == 2
    ends = sentences.sentence_ends(corpus).where("size(ends) > 0")
    bad = ends.where(F.expr("element_at(ends, -1) > char_length(text) or exists(ends, e -> e <= 0)"))
    assert bad.count() == 0
    lines = ends.withColumn("n", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\s\\u00a0\\u3000\\u2000-\\u200f\\ufeff\\u00ad\\u2060-\\u2064]"))))
    assert lines.where("size(ends) < n").count() == 0
    assert sentences.sentence_units(corpus.limit(0)).count() == 0


MODELS = "embedding_model string, max_units int, overlap_units int, units int"


def units(text):
    return len(text.encode("utf-16-le")) // 2


def test_pieces_fit_overlap_and_cover(spark):
    rng = random.Random(6)
    topics = [["sea", "ship", "wave", "sail", "harbour"], ["bread", "oven", "flour", "salt", "crust"], ["海", "船", "波"], ["😀", "🔥"]]
    texts = []
    for _ in range(40):
        out = []
        for _ in range(rng.randrange(2, 8)):
            words = rng.choice(topics)
            out.append(rng.choice([". ", "。", "\n", " "]).join(" ".join(rng.choice(words) for _ in range(rng.randrange(3, 9))) for _ in range(6)))
        texts.append("  " + "\n\n".join(out) + "\n ")
    texts += ["x" * 1000, "😀" * 333, "", None, "short", "a b " * 49 + "ab  "]
    frame = spark.createDataFrame([("f", i, t, ["m", None, "gone"][i % 3 if i < 30 else 0], "clash") for i, t in enumerate(texts)], "field string, id long, text string, embedding_model string, units string")
    models = spark.createDataFrame([("m", 200, 30, 1), ("m", 200, 30, 1), ("n", None, 3, 1), (None, 10, 1, 1)], MODELS)
    got = {}
    for r in pieces.pieces(frame, models).collect():
        got.setdefault(r.id, []).append(r)
    for i, t in enumerate(texts):
        whole = (t or "").strip(pieces.TRIMMED)
        if (i < 30 and i % 3) or units(whole) <= 200:
            assert i not in got
            continue
        parts = sorted(got[i], key=lambda r: r.piece)
        assert len(parts) > 1 and parts[0].char_start == 0 and parts[-1].char_start + len(parts[-1].text) == len(whole)
        for r in parts:
            assert r.text == whole[r.char_start : r.char_start + len(r.text)] and units(r.text) == r.units <= 200
        for a, b in zip(parts, parts[1:]):
            shared = whole[b.char_start : a.char_start + len(a.text)]
            assert units(shared) in (29, 30)
    assert pieces.pieces(frame.limit(0), models).count() == 0 == pieces.pieces(frame, models.limit(0)).count()


def test_cuts_fall_where_the_words_change():
    import numpy as np

    text = "the sea and the ship in the wave. " * 9 + "bread and oven and flour with salt. " * 9
    flat = np.frombuffer(text.strip().encode("utf-32-le"), np.uint32)
    first = pieces._cuts(flat, 450, 20, pieces.PieceParams())[0]
    assert abs(first[1] - 9 * 34) <= 2


def test_early_places_come_before_hard_cuts(spark):
    text = "one two three. " + "x" * 150 + " four five " + "y" * 450 + "\nsix " + "😀" * 60
    frame = spark.createDataFrame([("f", 1, text, "m")], "field string, id long, text string, embedding_model string")
    models = spark.createDataFrame([("m", 160, 10, 1)], MODELS)
    parts = sorted(pieces.pieces(frame, models).collect(), key=lambda r: r.piece)
    ends = [r.char_start + len(r.text) for r in parts]
    places = [i + 1 for i, ch in enumerate(text) if ch in ". \n"]
    assert ends[0] == 14 and ends[-1] == len(text) and all(r.units <= 160 for r in parts)
    for r, end in zip(parts[:-1], ends):
        # hard only where nothing beyond the overlap is left to cut at
        assert end in places or not [p for p in places if r.char_start + 12 <= p <= end]


def bare(unit):
    """A unit as a careless writer sets it: no marks, no capitals."""
    return " ".join("".join(c if c.isalnum() or unicodedata.category(c) in ("Mn", "Mc") else " " for c in unit).lower().split())


def thai(rng):
    return rng.choice("เวลกา โทเบรน เซลดา มิเรลลา คอร์ริน".split()) + rng.choice("นับเหรียญ ซ่อนกุญแจ ถือแผนที่ ลืมตะเกียง ขายเชือก".split()) + rng.choice("ในหีบเก่า ที่หอดูดาว ข้างประตู บนเรือลำใหญ่ ใต้บันได".split()) + rng.choice("ตอนเช้า เมื่อวานนี้ ก่อนพายุมา หลังอาหาร".split())


def test_sentences_without_marks_come_apart(spark, corpus):
    """Sentences of the corpus and Thai ones, joined without any mark or blank; none is in the corpus in this form."""
    rng = random.Random(3)
    taught = spark.createDataFrame([("x", i, " ".join(thai(rng) for _ in range(4)), None, None) for i in range(400)], VALUES)
    corpus = corpus.unionByName(taught)
    units = sentences.sentence_units(corpus).select("sentence").distinct().toPandas().sentence
    kinds = {"en": "^[A-Z][a-z ,]{25,}[.]$", "zh": "^[一-鿿，]{9,}[。！？]$", "ja": "^(?=.*[぀-ヿ])[぀-ヿ一-鿿、ー]{9,}[。！？]$", "th": "^[ก-๎]{15,}$"}
    texts, cuts, kind_of = [], [], []
    for kind, pattern in kinds.items():
        chosen = sorted(u for u in units if re.search(pattern, u))
        assert len(chosen) > 12, kind
        for _ in range(60):
            parts = [bare(u) if kind == "en" else "".join(c for c in u if c.isalnum() or unicodedata.category(c) in ("Mn", "Mc")) for u in rng.sample(chosen, 3)]
            texts.append((" " if kind == "en" else "").join(parts))
            cuts.append({len(parts[0].replace(" ", "")), len((parts[0] + parts[1]).replace(" ", ""))})
            kind_of.append(kind)
    got = split(spark, corpus, texts)
    for kind in kinds:
        hit = found = want = 0
        for units_of, cut in ((g, c) for g, c, k in zip(got, cuts, kind_of) if k == kind):
            sizes = [len(u.replace(" ", "")) for u in units_of]
            ends = {sum(sizes[: i + 1]) for i in range(len(sizes) - 1)}
            hit, found, want = hit + len(ends & cut), found + len(ends), want + len(cut)
        assert hit >= 0.9 * want and hit >= 0.9 * found, (kind, hit, found, want)
    # what is said in quotation marks, and whole sentences without a mark, stay one
    one = ["the keeper of the tower said that it was late", '"the keeper went home she closed the door and fell silent"']
    assert split(spark, corpus, one) == [[t] for t in one]


def plain_model(p, seed=7):
    """A model of random weights."""
    rng = np.random.default_rng(seed)
    inner = np.stack((np.log(rng.random(p.slots) * 1e-3 + 1e-6), rng.integers(0, 50, p.slots)), 1).astype(np.float32)
    odds = [rng.normal(0, 2, n) for n in (p.slots, p.slots, sentences.N_SHAPE, sentences.N_GAP, p.slots, p.slots)]
    return sentences.Model(odds[0], odds[1], rng.random(p.slots), odds[2], np.clip(odds[3], -2, 0.5), odds[4] - 1, odds[5] - 3, inner, rng.integers(0, 3, p.pair_slots).astype(np.float32))


def sample_texts(n=400, seed=11):
    """Sentences of the cases, cut, joined and stirred, with texts that are blank, null or only marks."""
    rng = random.Random(seed)
    lines = [line for case in CASES for line in case]
    texts = ["She fell silent.”", "“Run. Count them again.” Rook said so.", None, "", " \n", ".", "8", "9 keys. Rook left.", "」", "「快走。」他说。", "海", "。」“", "ก", "a​b. ​C d."]
    for _ in range(n):
        text = rng.choice(["", " ", "\n", " \r\n"]).join(rng.choice(lines) for _ in range(rng.randrange(1, 6)))
        a = rng.randrange(len(text))
        texts.append(text[a:] if rng.random() < 0.2 else bare(text) if rng.random() < 0.2 else text[: a + 1] if rng.random() < 0.2 else text)
    return texts


def test_texts_are_split_alike_in_any_company():
    """Closing marks that nothing opens, digits and letters at the end of a text say nothing about the next."""
    p = sentences.SentenceParams(slots=1 << 12, pair_slots=1 << 14)
    model, texts = plain_model(p), pa.array(sample_texts(), pa.string())
    together = sentences.unit_ends(texts, model, p).to_pylist()
    assert together == [sentences.unit_ends(texts.slice(i, 1), model, p).to_pylist()[0] for i in range(len(texts))]
    # no place is within quotation marks, whatever stands before
    strong = sentences.Model(**{**model.__dict__, "ends": np.full(p.slots, 6.0), "word": np.full(p.slots, 3.0), "shape": np.full(sentences.N_SHAPE, 3.0), "last": np.full(p.slots, -50.0)})
    assert sentences.unit_ends(texts.slice(0, 2), strong, p).to_pylist() == [[17], [24, 38]]
    assert sentences.unit_ends(pa.array(["", None], pa.string()), model, p).to_pylist() == [[], []]


def test_slices_without_letters_are_counted():
    p = sentences.SentenceParams(slots=1 << 12, pair_slots=1 << 14)
    for texts in (["", None], [" \n"], ["..."], ["​"]):
        for model in (None, plain_model(p)):
            assert all(b.num_rows for b in sentences._count(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]), model, p))


@pytest.mark.parametrize("slots", [(1 << 12, 1 << 14), (997, 3001)])
def test_bound_leaves_out_no_place(slots):
    """The places without a mark that are kept, and their odds, are those of the formula over all places."""
    p = sentences.SentenceParams(slots=slots[0], pair_slots=slots[1])
    model = plain_model(p)
    x = sentences.places(*to_codepoints(pa.array(sample_texts(), pa.string())), p)
    b, every = x.bare, np.arange(len(x.bare.at))
    words = x.line_words[b.line, 1] - x.line_words[b.line, 0]
    inside = np.log(model.pair[b.pair(every, p)] + p.pair_prior * np.exp(model.inner[b.first, 0])) - np.log(model.inner[b.last, 1] + p.pair_prior)
    odds = model.last[b.last] + model.first[b.first] - inside + np.where(x.line_marked[b.line] | (words < 2 * p.bare_words), p.unmarked, p.bare)
    which, kept = sentences.bare_odds(x, model, p)
    assert 0 < len(which) < 0.5 * len(every)
    assert which.tolist() == np.flatnonzero(odds > p.least_odds).tolist() and np.allclose(kept, odds[which], atol=1e-5)


def test_places_cost_little():
    """CPU seconds of finding the places, in those of a running sum over as many numbers."""
    p = sentences.SentenceParams()
    flat, starts = to_codepoints(pa.array(sample_texts(6000), pa.string()))
    numbers = np.ones(len(flat), np.int64)

    def least(f):
        took = []
        for _ in range(5):
            t = time.process_time()
            f()
            took.append(time.process_time() - t)
        return min(took)

    sentences.places(flat[:1000], np.array([0, 1000]), p)
    ratio = least(lambda: sentences.places(flat, starts, p)) / least(lambda: [np.cumsum(numbers) for _ in range(10)]) * 10
    assert ratio < 80, ratio
