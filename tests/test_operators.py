from pyspark.sql import functions as F

from leafmill.operators import glossary, quality, reflow, sections, state, toc, units


def reflowed(spark, text, parts=1):
    docs = spark.createDataFrame([(1, text)], "d int, text string").repartition(parts)
    return [r.text for r in reflow.paragraphs_of(reflow.lines_of(docs, "d"), "d").orderBy("ord").collect()]


WIDE = "This line is as wide as the lines of the page are and goes on"


def test_reflow_joins_wrapped_lines_and_hyphens(spark):
    got = reflowed(spark, f"{WIDE}\n{WIDE} with a divi-\nded word.\n\nNext one.\f12\n{WIDE}\nand ends here.")
    assert got == [f"{WIDE} {WIDE} with a divided word.", "Next one.", f"{WIDE} and ends here."]


def test_reflow_page_break_does_not_split(spark):
    assert reflowed(spark, f"{WIDE}\n\n\f\n\n{WIDE} too") == [f"{WIDE} {WIDE} too"]


def test_running_heads_with_changing_numbers(spark):
    pages = "\f".join(f"The Long Road {n}\n{WIDE} {chr(96 + n)}\nit ends here {chr(96 + n)}." for n in range(1, 9))
    got = reflowed(spark, pages)
    assert len(got) == 8 and not any("Long Road" in p for p in got)


def test_reflow_is_the_same_for_any_partitions_and_odd_input(spark):
    for text in ("", None, "\f\f", "\n\n", "12\n13"):
        assert reflowed(spark, text) == []
    long = "\n".join(f"{WIDE} {i}" for i in range(3000))
    assert reflowed(spark, long, 1) == reflowed(spark, long, 8)


def paragraphs(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "d int, ord int, text string")


def test_chapters(spark):
    def split(texts):
        rows = sections.split_chapters(paragraphs(spark, texts), "d").orderBy("section", "ord").collect()
        return [(r.section, r.title, r.text) for r in rows]

    assert split(["before", "CHAPTER 1", "THE RIVER BANK", "body", "Chapter 2", "more", "Chapter 3"]) == [(1, "", "before"), (2, "CHAPTER 1: THE RIVER BANK", "body"), (3, "Chapter 2", "more")]
    assert split(["one", "two"]) == [(1, "", "one"), (1, "", "two")]
    assert split(["Chapter 1", "Chapter 2"]) == [(1, "", "Chapter 1"), (1, "", "Chapter 2")]


def test_trailing_index(spark):
    body, index, cover = ["Plain words of a story without digits."] * 30, ["Atari, 12, 14-17, 99", "Basic, 1, 2, 3, 45", "Cobol, 7, 8, 9, 100"], ["A fine book."] * 3
    assert sections.trim_trailing(paragraphs(spark, body + index + cover), "d").count() == 30
    assert sections.trim_trailing(paragraphs(spark, (body + index)[:19]), "d").count() == 19


def test_matter(spark):
    def flag(texts, head=None):
        return sections.matter_flags(paragraphs(spark, texts), ["d"], F.lit(head) if head else None).head().matter

    assert flag(["Text"], "Acknowledgements") and flag(["Index", "a, 1"]) and flag(["© 1999. All rights reserved."])
    assert not flag(["Indexes are useful in life."]) and not flag([" ".join(["word"] * 400), "All rights reserved"])
    assert flag(["Apples, 12", "Pears, 13, 14"] * 8) and not flag(["Apples fell", "Pears too"] * 8)


def test_units_overshoot_and_reset(spark):
    rows = spark.createDataFrame([("b", f, i, " ".join(["w"] * n)) for f, sizes in (("f1", [3, 3, 0, 5, 1]), ("f2", [9])) for i, n in enumerate(sizes)], "book string, file string, idx int, en string")
    numbered = {(r.file, r.idx): (r.unit, r.unit_id, r.par_id) for r in units.number_units(units.pack_units(rows, 5)).collect()}
    assert numbered == {("f1", 0): (0, 1, 1), ("f1", 1): (0, 1, 2), ("f1", 3): (1, 2, 3), ("f1", 4): (2, 3, 4), ("f2", 0): (0, 4, 5)}


def test_glossary_contexts(spark):
    en = "Then Old Tom met Ann; Old Tom and Ann of the North laughed; Old Tom slept. É Ann"
    rows = spark.createDataFrame([("b", 1, en)], "book string, id long, en string")
    found = {r.phrase: r.n for r in glossary.candidates(rows, least=1).collect()}
    assert found["Old Tom"] == 2 and "Then Old Tom" in found and "Then" not in found
    ctx = {r.phrase: r.ctx for r in glossary.contexts(rows, spark.createDataFrame([("b", "Old Tom"), ("b", "Nobody")], "book string, phrase string"), 5).collect()}
    assert ctx == {"Old Tom": "Then Old Tom met…", "Nobody": ""}


def test_rule_flags(spark):
    def flags(en, zh):
        return spark.createDataFrame([(en, zh)], "en string, zh string").select(quality.rule_flags(F.col("en"), F.col("zh")).alias("f")).head().f

    long = " ".join(["word"] * 12)
    assert flags("Text 1984", " 　 ") == ["empty"]
    assert flags("Hi", "Hi") == ["identical"]
    assert flags(long, "短" * 9) == ["too_short(0.75)"] and flags(long, "长" * 36) == ["too_long(3.00)"]
    assert flags("In 1984 and 12 and 7", "一九八四 12") == ["num_missing:1984"]
    assert flags("Hello there", "抱歉，我无法翻译") == ["meta_leak"]
    assert flags("Hello", "你好") == []


def test_log_views_and_samples(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "sha string, seq long, qa_state string")
    assert {(r.sha, r.qa_state) for r in state.latest(log, ["sha"], [F.col("seq")]).collect()} == {("a", "z"), ("b", None)}
    rows = spark.range(10).select(F.lit("g").alias("g"), "id")
    assert state.exact_sample(rows, ["g"], 0.25, F.col("id")).count() == 2
    assert state.exact_sample(rows, ["g"], 0.05, F.col("id")).count() == 0
    assert state.exact_sample(rows, ["g"], 1.0, F.col("id")).count() == 10
    assert {(r.id, r.batch) for r in state.batches(rows, ["g"], ["id"], 8).filter("id in (7, 8)").collect()} == {(7, 0), (8, 1)}


def test_toc(spark):
    def page(file, n, heading="", links=(), works=False, chapters=()):
        return ("b", file, n, heading, works, [{"label": c, "anchor": f"c{i}"} for i, c in enumerate(chapters)], [{"target": t, "title": s} for t, s in links])

    schema = "book string, file string, ord int, heading string, other_works boolean, chapters array<struct<label:string,anchor:string>>, links array<struct<target:string,title:string>>"
    docs = [page("toc.xhtml", 0, "Contents", [("c1", "One"), ("c1", "Again"), ("c2", ""), ("c3", "Three"), ("gone", "X")]), page("c1", 1, "I"), page("c2", 2, "49. Lost"), page("c3", 3, "III"), page("d", 4, "For Ina")]
    got = [(r.title, r.href) for r in toc.expanded(spark.createDataFrame(docs, schema)).orderBy("play_order").collect()]
    assert got == [("One", "c1"), ("49. Lost", "c2"), ("Three", "c3")]
    bare = [page("c1", 0, "I"), page("ad", 1, "Other Book", works=True), page("c2", 2, "", chapters=("CHAPTER 1", "CHAPTER 2")), page("c3", 3, "")]
    got = [(r.title, r.href) for r in toc.expanded(spark.createDataFrame(bare, schema)).orderBy("play_order").collect()]
    assert got == [("I", "c1"), ("CHAPTER 1", "c2#c0"), ("CHAPTER 2", "c2#c1")]
