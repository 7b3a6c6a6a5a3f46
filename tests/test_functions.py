from pyspark.sql import functions as F

from leafmill.functions import css, replies, rules, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).head().x




def test_despace_numbers(spark):
    cases = {"In 1 9 1 7 he paid 3 5 0 ,000 and 2, 500": "In 1917 he paid 350,000 and 2,500", "version 1.0 has 5 percent of 7 men": "version 1.0 has 5 percent of 7 men", "": ""}
    for raw, want in cases.items():
        assert one(spark, raw, text.despace_numbers(F.col("t"))) == want


def test_glue_and_soft_hyphens(spark):
    assert one(spark, "the wreck ofVasa lay offThe coast, often offered", text.resplit_glued(F.col("t"))) == "the wreck of Vasa lay off The coast, often offered"
    assert one(spark, "com­ plete­ly", text.drop_soft_hyphens(F.col("t"))) == "completely"


def test_words_and_strip_know_unicode_blanks(spark):
    assert one(spark, " two words　\n", text.word_count(F.col("t"))) == 2
    assert one(spark, " 　two words ", text.strip(F.col("t"))) == "two words"
    assert one(spark, None, text.word_count(F.col("t"))) == 0


def test_slug(spark):
    assert one(spark, "/books/An Odd -- Title!.epub", text.slug(F.col("t"))) == "an-odd-title"
    assert one(spark, "/b/书.epub", text.slug(F.col("t"))) == "book"
    assert one(spark, "/b/书.epub", text.slug(F.col("t"), unique=True)).startswith("book-")


def test_shred_fraction(spark):
    assert one(spark, "a m i c rokerne l", text.shred_fraction(F.col("t"))) == 3 / 6
    assert one(spark, "I saw a cat", text.shred_fraction(F.col("t"))) == 0.0
    assert one(spark, "", text.shred_fraction(F.col("t"))) == 0.0


def test_head_key_drops_page_numbers_only(spark):
    cases = {"12 The Long Road": "the long road", "The Long Road xiv": "the long road", "we did": "we did", "the mill": "the mill", "Mix 3": "", "12 13": "", "": ""}
    for raw, want in cases.items():
        assert one(spark, raw, rules.head_key(F.col("t"))) == want, raw


def test_page_lines(spark):
    for raw, want in {" 12 ": True, "xiv": True, "mild": True, "12345": False, "page 3": False}.items():
        assert one(spark, raw, rules.is_page_line(F.col("t"))) is want, raw


def test_headings(spark):
    yes = ("Chapter 3", "PART TWO", "THE RIVER BANK", "Book XII: Water")
    no = ("DAVID:", "IV.", "LINUX", "—EPICTETUS, SAGE", "Part of the trouble was this", "I", "CD MIX", "x" * 70)
    for raw in yes:
        assert one(spark, raw, rules.is_heading(F.col("t"))), raw
    for raw in no:
        assert not one(spark, raw, rules.is_heading(F.col("t"))), raw


def test_meta_and_usable(spark):
    for raw, want in {"抱歉，我无法翻译": False, "打扰您真是抱歉": True, "As I walked": True, "I cannot do it": False, "```": False, " 　": False, None: False}.items():
        assert one(spark, raw, text.usable(F.col("t"))) is want, raw


def test_replies(spark):
    for raw in ('{"a": "b"}', '```json\n{"a": "b"}\n```', 'Sure: {"a": "b"} — done'):
        assert one(spark, raw, replies.parse_object(F.col("t"))) == {"a": "b"}
    for raw in ("no object", "{'a': 'b'}", "{broken", None):
        assert one(spark, raw, replies.parse_object(F.col("t"))) is None
    assert one(spark, '[{"type":"x"},{"type":"result","result":"hello"}]', replies.parse_envelope(F.col("t"))) == "hello"
    assert one(spark, '{"result":"hello"}', replies.parse_envelope(F.col("t"))) == "hello"
    assert [tuple(v) for v in one(spark, '[{"faithful":4,"missing":false,"hallucinated":true}]', replies.parse_verdicts(F.col("t")))] == [(4, False, True)]


def test_errors():
    import subprocess

    assert replies.short_error(subprocess.TimeoutExpired("cmd", 7)) == "timed out after 7s"
    assert replies.short_error(subprocess.CalledProcessError(2, "cmd", stderr="x" * 400 + "why")).endswith("why")
    assert replies.short_error(ValueError("")) == "ValueError"


def test_css(spark):
    sheet = ".big, p.Title { font-size: 1.5em } .body { font-size: 100% } h1 .drop-cap{FONT-SIZE: 18PX} .none { color: red } .x { font-size: 12pt }"
    got = {r["class"] for r in css.large_classes(spark.createDataFrame([("a", sheet)], "book string, css string")).collect()}
    assert got == {"big", "Title", "drop-cap"}
    style = css.reading_style({"big", "Title"})
    assert ":not(.Title):not(.big)" in style and style.endswith("font-size: 0.92em; }")
    assert css.reading_style(base_font="", normalize=False).count("\n") == 0


def test_paths(spark):
    for raw, want in {"OEBPS/Cover.xhtml": True, "text/index_split_001.html": False, "nav.xhtml": True, "ch1.html": False}.items():
        assert one(spark, raw, rules.path_skipped(F.col("t"))) is want
