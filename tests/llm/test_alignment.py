from leafmill.llm.alignment import Aligner, chinese_sentences, english_sentences, pairs_of
from leafmill.llm.transliteration import Transliterator

SYLLABLES = {"ka": "卡", "mar": "马尔", "wen": "温", "tha": "萨", "ra": "拉", "lo": "洛", "mi": "米", "kol": "科尔", "vo": "沃", "sel": "塞尔", "ne": "内", "du": "杜"}


def name(*parts):
    return "".join(parts), "".join(SYLLABLES[p] for p in parts)


PAIRS = [name(a, b, c) for a in SYLLABLES for b in SYLLABLES for c in ("ka", "lo", "wen")]
NAMES = Transliterator.fit(PAIRS[::2])
ALIGNER = Aligner(NAMES, {"map": ["地图"], "silver": ["银色的"], "lantern": ["提灯", "灯笼"], "key": ["钥匙"]})


def test_transliteration_of_names_not_seen():
    held_out = PAIRS[1::2]
    assert sum(NAMES.write(a)[0] == b for a, b in held_out) >= 0.85 * len(held_out)
    assert NAMES.write("q")[0] == ""


def test_sentences():
    assert [s.strip() for s in english_sentences('Mr. A met Dr. B. “Why?” “No…” he said... MRS. C left')] == ["Mr. A met Dr. B.", "“Why?”", "“No…”", "he said...", "MRS. C left"]
    assert chinese_sentences("他说：“走！”好吗？等等……（完。）尾") == ["他说：“走！”", "好吗？", "等等……", "（完。）", "尾"]
    assert english_sentences("") == [] and chinese_sentences(" ") == []


EN = "Kamarwen found the silver map in 1749. Tharalo paid 36 crowns to Mikollo. Voselne hid the lantern. Duthaka lost the key near Marlowen."


def align(zh, en=EN):
    return ALIGNER.align(en, zh)


def test_plain_omitted_inserted_moved_merged_and_split():
    one, two, three, four = "卡马尔温1749年找到了银色的地图。", "萨拉洛付给米科尔洛36克朗。", "沃塞尔内藏起了灯笼。", "杜萨卡在马尔洛温附近丢了钥匙。"
    assert align(one + two + three + four) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert align(one + three + four) == [(0, 0), (2, 1), (3, 2)]
    assert align(one + "天色渐渐暗了下来。" + two + three + four) == [(0, 0), (1, 2), (2, 3), (3, 4)]
    assert align(two + one + three + four) == [(0, 1), (1, 0), (2, 2), (3, 3)]
    assert align(one[:-1] + "，" + two + three + four) == [(0, 0), (1, 0), (2, 1), (3, 2)]
    assert align(one + two + three + "杜萨卡丢了钥匙。那是在马尔洛温附近。") == [(0, 0), (1, 1), (2, 2), (3, 3), (3, 4)]
    assert align("") == [] and align("毫无关系的话。") == [] and ALIGNER.align("", one) == []


def test_numbers_in_full_width_and_groups(spark):
    rows = [(1, "It took 1,006 days. Nobody came.", "花了1006天。没有人来。"), (2, "", ""), (3, "x" * 30_000, "长" * 30_000)]
    df = spark.createDataFrame(rows, "par_id long, en string, zh string")
    assert {tuple(r) for r in pairs_of(df, ALIGNER, {}).collect() if r.par_id == 1} >= {(1, 0, 0)}
    assert pairs_of(df.limit(0), ALIGNER, {}).count() == 0


def test_phrases_names_and_books_of_the_glossary(spark):
    glossary = spark.createDataFrame(
        [("a", "Old Mill", "旧磨坊"), ("a", "old mill", "老磨坊"), ("a", "oar", "桨"), ("b", "oar", "橹"), ("b", "Zyx", "泽克斯"), (None, "oar", "划桨"), ("a", "Zyx", "泽克"), ("c", None, "无"), ("a", "key", "")],
        "book string, en string, zh string",
    )
    tasks = spark.createDataFrame([(1, 1, "a", "The oar lies by the old mill."), (2, 1, "b", "Zyx sold an oar."), (3, 1, "c", "An OAR and a key."), (4, 1, None, "No word."), (5, 1, "a", "")], "par_id long, seq long, book string, text string")
    from leafmill.llm.alignment import with_entries

    want = {1: {("oar", ("划桨", "桨", "橹"), True), ("old mill", ("旧磨坊", "老磨坊"), True)}, 2: {("oar", ("划桨", "桨", "橹"), True), ("zyx", ("泽克斯",), False)}, 3: {("oar", ("划桨", "桨", "橹"), True)}}
    for small in (0, 1000):
        got = {r.par_id: {(e.low, tuple(e.forms), e.plain) for e in r.entries} for r in with_entries(tasks, glossary, small=small).collect()}
        assert got == want
    entries = [("old mill", ["老磨坊"], True), ("oar", ["桨"], True), ("zyx", ["泽克斯"], False)]
    assert ALIGNER.align("The oar lies by the old mill. Zyx sold the old mill.", "泽克斯卖了老磨坊。桨在老磨坊旁边。", entries) == [(0, 1), (1, 0)]


def made_document(rng, n):
    """A rough translation with omissions, insertions, merges, splits and exchanges, and its true pairs."""
    things = [("map", "地图"), ("lantern", "提灯"), ("key", "钥匙")]
    en, zh, pairs = [], [], []
    for i in range(n):
        (a, az), (b, bz), (t, tz), year = *rng.sample(PAIRS, 2), rng.choice(things), rng.randint(1000, 999_999)
        en.append(f"{a.capitalize()} gave the {t} number {year} to {b}.")
        how = rng.random()
        if how < 0.05:
            continue
        if how < 0.1:
            zh.append("天色渐渐暗了下来。")
        if how < 0.15:
            pairs += [(i, len(zh)), (i, len(zh) + 1)]
            zh += [f"{az}有一件{tz}，编号{year}。", f"它给了{bz}。"]
        elif how < 0.2 and zh and pairs and pairs[-1][1] == len(zh) - 1:
            pairs.append((i, len(zh) - 1))
            zh[-1] = zh[-1][:-1] + f"，{az}把{year}号{tz}给了{bz}。"
        else:
            pairs.append((i, len(zh)))
            zh.append(f"{az}把{year}号{tz}给了{bz}。")
    return " ".join(en), "".join(zh), set(pairs)


def test_recall_and_precision_on_made_documents():
    import random

    rng = random.Random(4)
    true = found = both = 0
    for _ in range(40):
        en, zh, pairs = made_document(rng, 12)
        got = set(ALIGNER.align(en, zh))
        true, found, both = true + len(pairs), found + len(got), both + len(got & pairs)
    assert both >= 0.93 * true and both >= 0.97 * found


def test_a_book_length_pair_takes_room_in_proportion():
    import random
    import time
    import tracemalloc

    rng = random.Random(6)
    en, zh, pairs = made_document(rng, 20_000)
    began = time.time()
    tracemalloc.start()
    got = set(ALIGNER.align(en, zh))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got & pairs) >= 0.9 * len(pairs) and peak < 600e6 and time.time() - began < 300
