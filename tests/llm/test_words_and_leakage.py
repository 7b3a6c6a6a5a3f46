import random

import numpy as np
import pytest

from leafmill.llm import leakage
from leafmill.llm.lookalikes import Lookalikes, build_rewrites, ligature_strings, symbol_counts
from leafmill.llm.words import WordReader, grams

READER = WordReader(build_rewrites(symbol_counts(["plain аео ﬁ fi é é 　x​y­ｚ"], ligature_strings()), True))


def numbers(*texts):
    w = READER.words(list(texts))
    return [w.number[w.text == i].tolist() for i in range(len(texts))]


def test_same_words_whatever_the_writing():
    a, b, c, d = numbers("The monastery, again!", "the monas-\ntery AGAIN", "thе mo​nastery аgain", "the monastery once")
    assert a == b == c and a[:2] == d[:2] and a != d


def test_words_of_a_batch_are_those_of_each_text():
    texts = ["", " one ", "中文和 words", "x" * 200, "\0", "two three"]
    together = numbers(*texts)
    assert [t for t in together] == [numbers(t)[0] for t in texts] and [len(t) for t in together] == [0, 1, 4, 1, 0, 2]


def test_grams_stay_inside_texts():
    w = READER.words(["a b c", "d e", "甲乙丙丁戊己庚"])
    assert len(grams(w, 3, 6)[0]) == 1 + 0 + 2


RNG = random.Random(4)
VOCABULARY = [f"w{i}x" for i in range(3000)]


def sentence(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def damaged(words, every):
    out = list(words)
    for k in range(every, len(out), every):
        out[k] = "changed" if k % 2 else ""
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    items = {i: sentence(60) for i in range(40)}
    docs, want = [], set()
    for d in range(120):
        text, item = sentence(300), d % 40
        if d % 3 == 0:
            part = items[item][10:45]
            text[100:100] = [damaged(part, 7)]
            want.add((d, item))
        elif d % 3 == 1:
            text[50:50] = items[item][:12]  # less than a third
        docs.append((d, " ".join(text), "x"))
    return items, docs, want


def test_leaks_are_found_and_short_turns_are_not(spark, corpus):
    items, docs, want = corpus
    i = spark.createDataFrame([(k, " ".join(w), "x") for k, w in items.items()] + [(900, None, "n"), (901, "", "n"), (902, "too short", "n"), (None, "x", "n"), (0, " ".join(items[0]), "again")], "item_id long, text string, doc_id string")
    d = spark.createDataFrame([*docs, (1000, None, "x"), (1001, "", "x"), (None, "x", "x"), docs[0]], "doc_id long, text string, item_id string")
    look = Lookalikes.fit(d, usual_first=True)
    assert {tuple(r) for r in leakage.leaks(d, i, look).collect()} == want
    assert leakage.leaks(d.limit(0), i, look).count() == 0 and leakage.leaks(d, i.limit(0), look).count() == 0


def test_block_bounds_lose_nothing(corpus):
    """Retrieval against scores of every passage and item."""
    items, docs, _ = corpus
    index = leakage.build_index(list(items), [" ".join(w) for w in items.values()], READER)
    w = READER.words([t for _, t, _ in docs])
    number, pos = grams(w, leakage.GRAM, leakage.HAN_GRAM)
    got = {tuple(p) for p in leakage.retrieve(index, number, pos, w.text[pos]).tolist()}
    weight = {}
    for t in range(len(index.terms)):
        for k in range(index.begin[t], index.begin[t + 1]):
            weight.setdefault(int(index.items[k]), {})[int(index.terms[t])] = index.weight[k]
    want = set()
    for d in range(len(docs)):
        mine = [(int(n), int(p)) for n, p in zip(number, pos) if w.text[p] == d]
        for i in range(len(items)):
            held, windows = set(), {}
            for n, p in mine:
                if n in weight[i]:
                    for k in (p // leakage.STRIDE, p // leakage.STRIDE + 1):
                        windows.setdefault(k, set()).add(n)
            for terms in windows.values():
                if sum(weight[i][t] for t in terms) >= index.threshold[i] - 1e-9:
                    held |= terms
            if sum(weight[i][t] for t in held) >= leakage.KEPT * index.total[i] > 0:
                want.add((d, i))
    assert got == want and want


def test_chinese_passages(spark):
    item = "杜罗斯赞宁可失去罗盘，也不愿丢下维赞蒙回到巴因斯滕。三天后，通往内科尔沃的路封闭了。"
    docs = [(1, "前言。" + item[:30].replace("，", "\n") + "后记另写别的内容在这里。"), (2, "完全不同的一段文字，与测试无关。" * 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert [tuple(r) for r in leakage.leaks(d, spark.createDataFrame([(7, item)], "item_id long, text string"), Lookalikes.fit(d, usual_first=True)).collect()] == [(1, 7)]
    assert np.isfinite(1.0)


def plain(a, b, i, j, step):
    """Equal words from (i, j) on, one pair of texts at a time."""
    equal, last = 0, i - step
    while 0 <= i < len(a) and 0 <= j < len(b):
        if a[i] == b[j]:
            equal, last, i, j = equal + 1, i, i + step, j + step
            continue
        for skip_a, skip_b, need in leakage.SKIPS:
            at = [(i + step * (skip_a + k), j + step * (skip_b + k)) for k in range(need)]
            if all(0 <= x < len(a) and 0 <= y < len(b) and a[x] == b[y] for x, y in at):
                i, j = at[0]
                break
        else:
            break
    return last, equal


def share(a, b, gram, least):
    of = set()
    for i in range(len(a) - gram + 1):
        for j in range(len(b) - gram + 1):
            if a[i : i + gram] == b[j : j + gram]:
                (right, more), (left, fewer) = plain(a, b, i, j, 1), plain(a, b, i - 1, j - 1, -1)
                if right - left + 1 >= least and more + fewer >= leakage.DENSITY * (right - left + 1) - 1e-9:
                    of |= set(range(left, right + 1))
    return len(of) / len(a)


def found(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {tuple(r) for r in leakage.leaks(d, i, Lookalikes.fit(d, usual_first=True)).collect()}


def test_every_pair_that_verification_accepts(spark):
    rng = random.Random(8)
    few = [f"w{k}x" for k in range(400)]
    draw = lambda n: [rng.choice(few) for _ in range(n)]
    items = [draw(rng.choice((30, 45, 60))) for _ in range(12)]
    docs = []
    for d in range(60):
        text = draw(120)
        for item in rng.sample(items, 2):
            n = rng.choice((10, 11, 15, 20, 25))
            at = rng.randrange(len(item) - n + 1)
            part = item[at : at + n]
            for k in range(rng.randint(2, 4), n - 2, rng.choice((4, 5, 6))):
                part[k] = rng.choice(("changed", "", "12 " + part[k]))
            text[40:40] = part
        docs.append(" ".join(text))
    want = {(d, i) for d, t in enumerate(docs) for i, words in enumerate(items) if share(words, t.split(), leakage.GRAM, leakage.MIN_WORDS) >= leakage.SHARE}
    assert len(want) > 20 and found(spark, list(enumerate(docs)), [(i, " ".join(w)) for i, w in enumerate(items)]) == want


def test_leaks_with_few_intact_terms(spark):
    item, short = sentence(72), sentence(30)
    han = "".join(chr(0x4E00 + 7 * k) for k in range(90))
    third, ten = item[20:46], short[8:18]
    third[4:-1:5], ten[3:-3:4] = ["changed"] * len(third[4:-1:5]), ["changed"] * len(ten[3:-3:4])
    tenth, fifth = list(han[30:61]), list(han[30:64])
    tenth[5::10], fifth[4:-2:5] = "一" * len(tenth[5::10]), "一" * len(fifth[4:-2:5])
    around = lambda words: " ".join([*sentence(90), *words, *sentence(90)])
    docs = [(1, around(third)), (2, around(ten)), (3, "前言" + "".join(tenth) + "后记"), (4, "前言" + "".join(fifth) + "后记"), (5, around(item[20:29]))]
    assert found(spark, docs, [(1, " ".join(item)), (2, " ".join(short)), (3, han)]) == {(1, 1), (2, 2), (3, 3), (4, 3)}


def test_parts_of_the_items_change_nothing(spark, monkeypatch):
    """A turn of phrase that nearly all items have is one too for the part that holds few of them."""
    phrase = sentence(25)
    items = [(k, " ".join([*phrase, *sentence(20)])) for k in range(20)] + [(k, " ".join(sentence(45))) for k in range(20, 40)]
    docs = [(1, " ".join([*sentence(60), *phrase, *sentence(60)])), (2, " ".join([*sentence(60), *items[3][1].split()[20:], *sentence(60)]))]
    whole = found(spark, docs, items)
    assert whole == {(2, 3)}
    monkeypatch.setattr(leakage, "SHARD", 1)
    assert found(spark, docs, items) == whole


def test_long_words_keep_the_order_of_their_letters():
    long = "ab" * 40
    a, b, c = numbers(long + "xyz", long + "zyx", (long + "xyz") * 500)
    assert a != b and len(c) == 1 and numbers((long + "xyz") * 500)[0] == c


def test_what_counts_is_retrieved(corpus):
    """No window with a telling term is below its item's threshold, and none without one is retrieved."""
    items, docs, want = corpus
    texts = [" ".join(w) for w in items.values()]
    known = leakage.read_items(list(items), texts, READER, leakage.common(texts, READER))
    w = READER.words([t for _, t, _ in docs])
    number, pos = grams(w, leakage.GRAM, leakage.HAN_GRAM)
    got = {tuple(p) for p in leakage.retrieve(known.index, number, pos, w.text[pos], 0.0).tolist()}
    telling = {}
    for t in range(len(known.index.terms)):
        for k in range(known.index.begin[t], known.index.begin[t + 1]):
            telling.setdefault(int(known.index.terms[t]), set()).add(int(known.index.items[k]))
    assert got == {(int(w.text[p]), i) for n, p in zip(number, pos) for i in telling.get(int(n), ())} and got >= want
