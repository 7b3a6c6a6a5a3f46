import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import lookalikes as L


def counts(*texts):
    return L.symbol_counts(list(texts), L.ligature_strings())


def form(*texts, usual_first=True):
    rewrite = L.Rewriter(L.build_rewrites(counts(*texts), usual_first))
    return [rewrite(t) for t in texts]


def test_classes_are_transitive_over_strings():
    same = ["Eclair fi ë", "Еclair ﬁ e̎ ё"[:9] + "ë", "Ｅclаir f​i ё"]
    forms = form("Eclair fi ë", "Ｅclаir fi ё", "Ecl­air ﬁ ë", "Eclair fi ё")
    assert len(set(forms)) == 1, forms
    assert same  # only the forms above are compared


def test_ligatures_overlap_with_letters():
    a, b, c = form("office", "oﬀice", "ofﬁce")
    assert a == b == c


def test_visible_differences_stay():
    texts = ["a b", "a  b", "a\tb", "A b", "“a” b", '"a" b', "a – b", "a — b", "a，b", "a,b"]
    assert len(set(form(*texts))) == len(texts)


def test_blanks_and_hyphens():
    a, b, c = form("10 km well-kept", "10 km well‐kept", "10 km well‑kept")
    assert a == b == c


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aeoсе ​é́Ａａﬁfi -‐中金", max_size=20))
def test_form_is_stable(text):
    rewrite = L.Rewriter(L.build_rewrites(counts(text, "ae fi"), True))
    assert rewrite(rewrite(text)) == rewrite(text)


def test_pairs_against_brute_force(spark):
    texts = ["old map", "оld map", "old​ map", "old map", "new map", None, "", "——", "–", "ＯＫ", "OK", "ok", "x" * 50_000, "x" * 49_999 + "х"]
    rows = [("en", i, t, "clash") for i, t in enumerate(texts)] + [("en", 0, "old map", "again"), ("zh", 1, "old map", None), ("en", None, "оld map", None), ("zh", None, None, None)]
    df = spark.createDataFrame(rows, "field string, key long, text string, form string")
    got = {tuple(r) for r in L.same_look_pairs(df, L.Lookalikes.fit(df)).collect()}
    f = dict(zip(range(len(texts)), form(*[t or "" for t in texts])))
    want = {("en", a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] and texts[b] and any(map(str.isalnum, texts[a])) and f[a] == f[b] and texts[a] != texts[b]}
    assert got == want and ("en", 0, 1) in got and ("en", 0, 3) not in got and ("en", 9, 10) in got and ("en", 12, 13) in got


def test_empty_table(spark):
    df = spark.createDataFrame([], "field string, key long, text string")
    assert L.same_look_pairs(df, L.Lookalikes.fit(df)).count() == 0
    assert L.Lookalikes.fit(df).form(F.col("text")) is not None


def test_the_more_frequent_member_stands_whatever_its_alphabet(spark):
    for heavy, odd in (("оld mаp", "old mаp"), ("ＯＫ", "OK"), ("ﬁle", "file")):
        texts = [heavy] * 5 + [odd] + [heavy + "х" * k for k in range(1, 30)]
        df = spark.createDataFrame([("en", i, t) for i, t in enumerate(texts)], "field string, key long, text string")
        got = {tuple(r) for r in L.same_look_pairs(df, L.Lookalikes.fit(df)).collect()}
        assert got == {("en", i, 5) for i in range(5)}, heavy


def test_marks_in_any_order_and_beyond_what_characters_there_are():
    assert len(set(form("ậ", "ậ", "ậ", "ậ", "ậ"))) == 1
    assert len(set(form("q̣̈", "q̣̈"))) == 1 and len(set(form("q̣̈", "q̣"))) == 2
    assert len(set(form("한글", "한글"))) == 1 and len(set(form("が", "が"))) == 1
    assert len(set(form("é", "é", "е́", "e​́"))) == 1
    long = "e" + "́̂" * 500
    assert len(counts(long)) < 60 and form(long)[0] == form(form(long)[0])[0]


def test_classes_have_one_row_a_text_and_its_links(spark):
    texts = ["map", "mаp", "mаp", "map", "mар", "other", None, "—"]
    df = spark.createDataFrame([("en", i, t) for i, t in enumerate(texts)] + [("en", 0, "map")], "field string, key long, text string")
    look = L.Lookalikes.fit(df)
    for hot in (1, 100):
        got = {(r.key, r.class_key, r.links) for r in L.same_look_classes(df, look, hot).collect()}
        assert got == {(0, 0, 3), (1, 0, 3), (2, 0, 3), (3, 0, 3), (4, 0, 4), (5, 5, 0)}
        pairs = {(r.key_a, r.key_b) for r in L.same_look_pairs(df, look, hot).collect()}
        assert pairs == {(0, 1), (0, 2), (0, 4), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
