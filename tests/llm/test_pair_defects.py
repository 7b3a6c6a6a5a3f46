import random

import numpy as np
import pytest

from leafmill.llm.alignment import Aligner
from leafmill.llm.crf import Crf
from leafmill.llm.pair_defects import ANSWER, ECHO, FOREIGN, REFUSAL, UNFINISHED, Tagger, clauses, defects, rule_label, training, verdict
from leafmill.llm.transliteration import Transliterator

NAMES = {"Kamar": "卡马尔", "Tharalo": "萨拉洛", "Wensel": "温塞尔", "Mikol": "米科尔"}
THINGS = {"map": "地图", "lantern": "灯笼", "key": "钥匙", "oar": "船桨", "bell": "铃铛"}


def test_crf_learns_a_chain():
    rng = random.Random(1)
    xs, ys = [], []
    for _ in range(300):
        y = [rng.randint(0, 1)]
        while len(y) < rng.randint(1, 6):
            y.append(y[-1] if rng.random() < 0.95 else 1 - y[-1])
        xs.append([[f"w{t if rng.random() < 0.8 else 1 - t}"] for t in y])
        ys.append(y)
    crf = Crf(2).fit(xs, ys)
    right = sum(int((np.array(y) == t).sum()) for y, t in zip(ys, crf.decode(xs)))
    assert right > 0.85 * sum(map(len, ys)) and crf.move[0, 0] > crf.move[0, 1]
    assert [len(t) for t in crf.decode([[], [["w0"]], []])] == [0, 1, 0]


def sentence(rng):
    (en, zh), (en2, zh2) = rng.sample(sorted(NAMES.items()), 2)
    thing, wu = rng.choice(sorted(THINGS.items()))
    year = rng.randint(1600, 1900)
    return rng.choice([
        (f"{en} found the {thing} in {year}.", f"{en and zh}在{year}年找到了那只{wu}。"),
        (f"{en} told {en2} that the {thing} was lost.", f"{zh}告诉{zh2}，那只{wu}已经丢了。"),
        (f"{en} wrote {year} pages about the {thing}.", f"{zh}写了{year}页关于{wu}的文字。"),
    ])


@pytest.fixture(scope="module")
def fitted():
    rng = random.Random(2)
    rows = []
    for _ in range(500):
        part = [sentence(rng) for _ in range(rng.randint(2, 4))]
        rows.append(("".join(z for _, z in part), " ".join(e for e, _ in part)))
    for _ in range(60):
        e = sentence(rng)[0]
        rows += [("很遗憾，我无法翻译这段内容。", e), ("Unable to comply with the request!", e), (e, e), ("Personne ici ne se souvenait de la vieille carte.", e), ("Никто не помнил про старую лодку.", e)]
    tagger = Tagger(Aligner(Transliterator.fit([(a.lower(), b) for a, b in NAMES.items()] * 3), {k: [v] for k, v in THINGS.items()}))
    return tagger, Crf(5).fit(*training(tagger, rows))


def judged(spark, fitted, rows):
    df = spark.createDataFrame([(i, f"s{i}", zh, en) for i, (en, zh) in enumerate(rows)], "seq long, sha string, zh string, en string")
    got = {r.seq: r.defect for r in defects(df, *fitted, {}).collect()}
    return [got.get(i) for i in range(len(rows))]


def test_each_kind(spark, fitted):
    en = "Kamar found the map in 1749. Tharalo told Wensel that the bell was lost."
    zh = "卡马尔在1749年找到了那只地图。萨拉洛告诉温塞尔，那只铃铛已经丢了。"
    rows = [(en, zh), (en, zh[:12]), (en, zh[:-6] + "……"), (en, zh[:-5] + "、"), (en, ""), (en, None), (en, " ……"), (en, "抱歉，我不能翻译这段内容。"), (en, en.upper()), (en, "译文：" + en), (en, "Никто не помнил про лодку, которую купил Kamar."), (en, "En 1749, Kamar a vendu une carte pour 36 couronnes."), (None, zh), (None, "很遗憾，我无法翻译这段内容。"), (en, zh[:17])]
    assert judged(spark, fitted, rows) == [None, "truncated", "truncated", "truncated", "empty", "empty", "empty", "refusal", "copy", "copy", "other_language", "other_language", None, "refusal", None]


def test_held_out_breaks(fitted):
    """Cut and whole translations the field has not seen."""
    tagger, crf = fitted
    rng = random.Random(9)
    right = n = 0
    for _ in range(300):
        part = [sentence(rng) for _ in range(3)]
        en, zh = " ".join(e for e, _ in part), "".join(z for _, z in part)
        last = part[-1][1]
        cut = rng.random() < 0.5
        if cut:
            zh = zh[: len(zh) - len(last) + rng.randint(2, len(last) - 3)] + rng.choice(["", "……", "、", "（未完"])
        pieces = clauses(zh)
        right += (verdict(pieces, crf.decode([tagger.features(pieces, tagger.prompt(en))])[0]) == "truncated") == cut
        n += 1
    assert right >= 0.93 * n


def test_dialogue_is_no_refusal():
    assert rule_label("米科尔对温塞尔说：“抱歉，我不能翻译那只铃铛。”", {"sorry"}) == ANSWER
    assert rule_label("抱歉，我不能翻译这段文字。", set()) == REFUSAL
    assert rule_label("the old map is lost", {"the", "old", "map", "is", "lost"}) == ECHO
    assert rule_label("古い地図はまだそこにあった。", set()) == FOREIGN
    assert UNFINISHED not in {rule_label("写了12页", set())}


def test_odd_tables(spark, fitted):
    assert judged(spark, fitted, []) == []
    long = "萨拉洛写了1700页关于灯笼的文字。" * 3000
    assert judged(spark, fitted, [("x", long)]) == [None]


def test_words_at_the_end_of_a_long_clause(fitted):
    tagger, _ = fitted
    part = "While I would very much like to be of service to you today, I am afraid that I cannot translate this"
    words = {f for f in tagger.features([part], tagger.prompt("Kamar found the map."))[0] if f.startswith("w=")}
    assert {"w=afraid", "w=cannot", "w=translate"} <= words


def test_sample_has_long_refusals_and_no_place_for_copies(spark, monkeypatch):
    from leafmill.llm import pair_defects

    seen = []
    monkeypatch.setattr(pair_defects, "training", lambda tagger, rows: seen.append(rows) or training(tagger, rows))
    monkeypatch.setattr(pair_defects, "SAMPLE", 30)
    monkeypatch.setattr(pair_defects, "ODD", 20)
    rng = random.Random(3)
    refusal = "很遗憾，我无法翻译这段内容。" + "这段内容的篇幅和来源都需要另外确认之后才能继续往下进行，" * 6
    rows = [(f"s{i}", "".join(sentence(rng)[1] for _ in range(3)) + str(i)) for i in range(200)] + [("long", refusal)]
    frame = spark.createDataFrame(rows, "sha string, zh string")
    first = frame.orderBy(pair_defects.F.xxhash64("sha", "zh")).first()
    frame = spark.createDataFrame([*rows, *[(first.sha, first.zh)] * 100], "sha string, zh string")
    aligner = Aligner(Transliterator.fit([(a.lower(), b) for a, b in NAMES.items()]), {k: [v] for k, v in THINGS.items()})
    pair_defects.fit(frame, spark.createDataFrame([], "sha string, en string"), aligner, {})
    assert refusal in {zh for zh, _ in seen[0]} and len({zh for zh, _ in seen[0]}) >= 30


def test_refusals_whose_wording_no_rule_knows(spark, monkeypatch):
    """All wordings are left out of the rules; the field learns them from responses that recur and say nothing of their prompts."""
    import re

    from leafmill.llm import pair_defects

    monkeypatch.setattr(pair_defects, "REFUSALS", re.compile("(?!)"))
    rng = random.Random(5)
    openings, ends = ["这段文字我帮不上忙", "此事恕不奉陪", "我做不了这件事", "这个要求不在我的职责之内"], ["。", "！", "，请另请高明。", "，还望海涵。"]
    rows = []
    for i in range(500):
        part = [sentence(rng) for _ in range(rng.randint(2, 4))]
        refused = i % 10 == 0
        rows.append((f"s{i}", rng.choice(openings[:3]) + rng.choice(ends) if refused else "".join(z for _, z in part) + ("天色渐渐暗了下来。" if i % 3 == 0 else ""), " ".join(e for e, _ in part), refused))
    versions = spark.createDataFrame([r[:2] for r in rows], "sha string, zh string")
    english = spark.createDataFrame([(r[0], r[2]) for r in rows], "sha string, en string")
    aligner = Aligner(Transliterator.fit([(a.lower(), b) for a, b in NAMES.items()] * 3), {k: [v] for k, v in THINGS.items()})
    tagger, crf = pair_defects.fit(versions, english, aligner, {})
    new = [(sentence(rng)[0], o + e) for o in openings[:3] for e in ends for _ in range(3)]
    found = judged(spark, (tagger, crf), new)
    assert sum(d == "refusal" for d in found) >= 0.9 * len(new)
    plain = [tuple("".join(x) for x in zip(*[sentence(rng) for _ in range(3)])) for _ in range(40)]
    assert sum(d == "refusal" for d in judged(spark, (tagger, crf), plain)) == 0
