"""Named queries over the test tables, each for one or a few operators. Every one runs over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import replies, rules, text
from leafmill.operators import glossary, quality, reflow, sections, state, toc, units
from leafmill.runtime import load, ship
from leafmill.sinks import epub, render


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")


def distinct_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows delivered twice count once; hashes are in lower case."""
    return load(spark, sf_dir, "paragraphs").withColumn("sha", F.lower("sha")).dropDuplicates(["id"])


def standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_translations(load(spark, sf_dir, "translations"))


# -- functions ----------------------------------------------------------------------------------------------------
def content_hash_dedup(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(text.content_hash(F.col("text")).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def word_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).cast("long").alias("words"))


def shred_fraction(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.shred_fraction(F.col("text")).alias("fraction"))


def despace_numbers(spark, sf_dir):
    """Digits are first set apart, so that there is something to bring together."""
    apart = F.regexp_replace("text", r"(\p{Nd})", "$1 ")
    return documents(spark, sf_dir).select("doc_id", F.md5(text.despace_numbers(apart)).alias("digest"))


def resplit_glue(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.resplit_glued(F.replace("text", F.lit(" of "), F.lit(" of")))).alias("digest"))


def soft_hyphens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length(text.drop_soft_hyphens(F.col("text"))).cast("long").alias("n"), F.md5(text.drop_soft_hyphens(F.col("text"))).alias("digest"))


def slugs(spark, sf_dir):
    return load(spark, sf_dir, "books").select("book", text.slug(F.col("source_path")).alias("path_slug"), text.slug(F.col("title")).alias("title_slug"))


def html_escaped(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.html_escape(F.col("text"))).alias("digest"))


def han_latin_counts(spark, sf_dir):
    return load(spark, sf_dir, "translations").select("seq", text.han_count(F.col("zh")).cast("long").alias("han"), text.latin_count(F.col("zh")).cast("long").alias("latin")).distinct()


def meta_flags(spark, sf_dir):
    return load(spark, sf_dir, "translations").select("seq", text.is_meta(F.col("zh")).alias("meta"), text.usable(F.col("zh")).alias("usable")).distinct()


def json_tolerant(spark, sf_dir):
    """Event properties as a talkative model would return them: in prose, in a fence, or alone."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is: "), "props", F.lit(" Good luck."))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    return load(spark, sf_dir, "events").select("event_id", replies.parse_object(said, "struct<k:long>")["k"].alias("k"))


# -- lines --------------------------------------------------------------------------------------------------------
def lines(spark, sf_dir):
    return reflow.lines_of(documents(spark, sf_dir), "doc_id")


def head_keys(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(rules.head_key(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def line_kinds(spark, sf_dir):
    t = F.col("text")
    return lines(spark, sf_dir).select("doc_id", "page", "line_no", rules.is_page_line(t).alias("page_number"), rules.is_heading(t).alias("heading"), rules.looks_like_title(text.strip(t)).alias("title"))


def running_heads(spark, sf_dir):
    return reflow.running_heads(lines(spark, sf_dir), "doc_id")


def full_width(spark, sf_dir):
    return reflow.full_width(reflow.content_lines(lines(spark, sf_dir), "doc_id"), "doc_id").select("doc_id", F.col("full").cast("long").alias("width"))


def reflowed(spark, sf_dir):
    return reflow.paragraphs_of(lines(spark, sf_dir), "doc_id")


def reflow_paragraphs(spark, sf_dir):
    return reflowed(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5("text").alias("digest"))


def chapter_split(spark, sf_dir):
    return sections.split_chapters(reflowed(spark, sf_dir), "doc_id").groupBy("doc_id", F.col("section").cast("long").alias("section"), "title").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


def matter_flags(spark, sf_dir):
    return sections.matter_flags(reflowed(spark, sf_dir), ["doc_id"])


# -- units and caches -----------------------------------------------------------------------------------------------
def unit_packing(spark, sf_dir):
    numbered = units.number_units(units.pack_units(distinct_paragraphs(spark, sf_dir)))
    return numbered.select("book", "file", F.col("idx").cast("long").alias("idx"), F.col("unit").cast("long").alias("unit"), F.col("unit_id").cast("long").alias("unit_id"), F.col("par_id").cast("long").alias("par_id"))


def latest_translations(spark, sf_dir):
    return standing(spark, sf_dir).select("sha", "seq", F.md5("zh").alias("zh"), "qa_state")


def latest_units(spark, sf_dir):
    return state.latest_units(load(spark, sf_dir, "units")).select("id", "state", "attempts")


def uncached_paragraphs(spark, sf_dir):
    return state.uncached(distinct_paragraphs(spark, sf_dir), standing(spark, sf_dir)).select("id", "sha")


def prune_orphans(spark, sf_dir):
    return state.prune(standing(spark, sf_dir), distinct_paragraphs(spark, sf_dir)).select("sha", "seq")


def interleave(spark, sf_dir):
    rows = render.interleaved(distinct_paragraphs(spark, sf_dir), standing(spark, sf_dir))
    return render.chapters(rows).select("book", "file", F.col("ord").cast("long").alias("ord"), F.md5("xhtml").alias("digest"))


def zh_only_pages(spark, sf_dir):
    rows = render.interleaved(distinct_paragraphs(spark, sf_dir), standing(spark, sf_dir))
    return render.chapters(rows, single=True).select("book", "file", "title", F.length("xhtml").cast("long").alias("chars"))


# -- glossary ---------------------------------------------------------------------------------------------------------
def glossary_top(spark, sf_dir):
    return glossary.candidates(distinct_paragraphs(spark, sf_dir))


def glossary_context(spark, sf_dir):
    paragraphs = distinct_paragraphs(spark, sf_dir)
    return glossary.contexts(paragraphs, glossary.candidates(paragraphs))


# -- quality ------------------------------------------------------------------------------------------------------------
def pairs(spark, sf_dir):
    return state.english_of(standing(spark, sf_dir), distinct_paragraphs(spark, sf_dir))


def l1_flags(spark, sf_dir):
    """The flags' names; a ratio is in its own column, since no two systems print a tie alike."""
    names = F.transform(quality.rule_flags(F.col("en"), F.col("zh")), lambda f: F.regexp_replace(f, r"\(.*\)$", ""))
    ratio = F.when(text.word_count(F.col("en")) > 0, F.floor(text.han_count(F.col("zh")) * F.lit(1000) / text.word_count(F.col("en"))))
    return pairs(spark, sf_dir).select("sha", F.array_join(names, ";").alias("flags"), ratio.alias("ratio_millis"))


def l1_histogram(spark, sf_dir):
    return quality.checked(pairs(spark, sf_dir)).select(F.explode_outer(F.transform("flags", lambda f: F.regexp_replace(f, r"[(:].*$", ""))).alias("flag")).groupBy(F.coalesce("flag", F.lit("ok")).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def qa_histogram(spark, sf_dir):
    return state.histogram(standing(spark, sf_dir), "qa_state", ["book"])


def unit_status(spark, sf_dir):
    return state.dashboard(state.latest_units(load(spark, sf_dir, "units")), distinct_paragraphs(spark, sf_dir), standing(spark, sf_dir))


def workable_units(spark, sf_dir):
    return state.workable(state.latest_units(load(spark, sf_dir, "units"))).select("id", "state", "attempts")


def qa_worklist(spark, sf_dir):
    return state.worklist(standing(spark, sf_dir)).select("sha", "step")


def qa_sample(spark, sf_dir):
    passed = standing(spark, sf_dir).filter("qa_state = 'l1ok'").select("book", "sha")
    return state.exact_sample(passed, ["book"], 0.20, F.sha1(F.concat("sha", F.lit("seed"))))


def qa_batches(spark, sf_dir):
    return state.batches(standing(spark, sf_dir).filter("qa_state = 'l1flag'").select("book", "sha"), ["book"], ["sha"]).select("book", "sha", F.col("batch").cast("long").alias("batch"))


def verdict_rule(spark, sf_dir):
    """Verdicts as they are written in ``qa_reason``."""
    judged = standing(spark, sf_dir).filter(F.col("qa_reason").startswith("faithful="))
    said = lambda name: F.regexp_extract("qa_reason", name + r"=(\w+)", 1)
    return judged.select("sha", quality.is_bad(F.try_to_number(said("faithful"), F.lit("9")).cast("int"), said("missing") == "True", said("halluc") == "True").alias("bad"))


# -- contents -----------------------------------------------------------------------------------------------------------
def shelf_pages(spark, sf_dir):
    """Spine documents made of the paragraphs: a file a page, headed by its first words, and a contents page for every
    second book, with a fragment, a repeated link and a link to nowhere."""
    files = distinct_paragraphs(spark, sf_dir).groupBy("book", "file").agg(F.min_by("en", "idx").alias("first"))
    order = Window.partitionBy("book").orderBy("file")
    heading = F.concat(F.col("ord"), F.lit(". "), F.regexp_extract("first", r"^[A-Za-z ]{0,20}", 0))
    none = F.expr("cast(array() as array<struct<label:string,anchor:string>>)")
    body = files.withColumn("ord", F.row_number().over(order)).select("book", "file", "ord", heading.alias("heading"), F.lit(False).alias("other_works"), F.when(F.col("ord") % 4 == 0, F.array(*[F.struct(F.concat(F.lit(f"CHAPTER {k} of "), "file").alias("label"), F.lit(f"c{k}").alias("anchor")) for k in (1, 2)])).otherwise(none).alias("chapters"), F.expr("cast(array() as array<struct<target:string,title:string>>)").alias("links"))
    link = F.struct(F.col("file").alias("target"), F.concat(F.lit("To "), "file").alias("title"))
    listed = body.filter("ord % 3 <> 0").groupBy("book").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", link.alias("l")))), lambda r: r["l"]).alias("l"))
    page = listed.filter(F.length("book") % 2 == 0).select("book", F.lit("contents.xhtml").alias("file"), F.lit(0).alias("ord"), F.lit("Contents").alias("heading"), F.lit(False).alias("other_works"), none.alias("chapters"), F.concat("l", F.array(F.struct(F.col("l")[0]["target"].alias("target"), F.lit("Again").alias("title")), F.struct(F.lit("nowhere.xhtml").alias("target"), F.lit("Nowhere").alias("title")))).alias("links"))
    return body.unionByName(page)


def contents_links(spark, sf_dir):
    return toc.contents_links(shelf_pages(spark, sf_dir)).groupBy("book", "page").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("first_title"))


def pick_contents(spark, sf_dir):
    return toc.contents_page(shelf_pages(spark, sf_dir))


def merge_toc(spark, sf_dir):
    return toc.merged(shelf_pages(spark, sf_dir)).select("book", "file", F.col("ord").cast("long").alias("ord"), "title")


def expand_toc(spark, sf_dir):
    return toc.expanded(shelf_pages(spark, sf_dir)).select("book", F.col("play_order").cast("long").alias("play_order"), "title", "href")


def listed_pages(spark, sf_dir):
    """The same documents with a contents page for every second book of the shelf, and every seventh a card of other works."""
    pages = shelf_pages(spark, sf_dir).filter("file <> 'contents.xhtml'").withColumn("other_works", F.col("ord") % 7 == 0)
    link = F.struct(F.col("file").alias("target"), F.concat(F.lit("To "), "file").alias("title"))
    links = pages.filter("ord % 3 <> 0").groupBy("book").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", link.alias("l")))), lambda r: r["l"]).alias("l"))
    second = pages.select("book").distinct().withColumn("_n", F.row_number().over(Window.orderBy("book"))).filter("_n % 2 = 0")  # one row a book
    extra = F.array(F.struct(F.col("l")[0]["target"].alias("target"), F.lit("Again").alias("title")), F.struct(F.lit("nowhere.xhtml").alias("target"), F.lit("Nowhere").alias("title")))
    page = links.join(second, "book", "left_semi").select("book", F.lit("contents.xhtml").alias("file"), F.lit(0).alias("ord"), F.lit("Contents").alias("heading"), F.lit(False).alias("other_works"), F.expr("cast(array() as array<struct<label:string,anchor:string>>)").alias("chapters"), F.concat("l", extra).alias("links"))
    return pages.unionByName(page)


def listed_contents_links(spark, sf_dir):
    return toc.contents_links(listed_pages(spark, sf_dir)).select("book", "page", F.col("pos").cast("long").alias("pos"), "target", "title")


def listed_pick_contents(spark, sf_dir):
    return toc.contents_page(listed_pages(spark, sf_dir))


def listed_merge_toc(spark, sf_dir):
    return toc.merged(listed_pages(spark, sf_dir)).select("book", "file", F.col("ord").cast("long").alias("ord"), "title")


def listed_expand_toc(spark, sf_dir):
    return toc.expanded(listed_pages(spark, sf_dir)).select("book", F.col("play_order").cast("long").alias("play_order"), "title", "href")


# -- markup -------------------------------------------------------------------------------------------------------------
def marked_pages(spark, sf_dir):
    """book, file, ord and a page of markup for each: the paragraphs below a chapter's marker or a numbered heading, a
    title of one line or of a quotation over two, or a card of other works."""
    en = F.concat(F.lit("<p>"), text.html_escape(F.col("en")), F.lit("</p>"))
    files = distinct_paragraphs(spark, sf_dir).groupBy("book", "file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", en.alias("p")))), lambda r: r["p"]), "").alias("body"))
    n = F.row_number().over(Window.partitionBy("book").orderBy("file"))
    kinds = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("<p><i>Old Works</i></p><p><em>New Works</em></p><p>and others</p>")))
    kinds = kinds.when(F.col("ord") % 5 == 1, F.concat(F.lit("<p>CHAPTER "), "ord", F.lit('</p><p>“THE LONG</p><p class="zh">否</p><p>ROAD HOME”</p>'), "body"))
    kinds = kinds.when(F.col("ord") % 5 == 2, F.concat(F.lit("<h2>"), "ord", F.lit(". The Inn</h2>"), "body")).when(F.col("ord") % 5 == 3, F.concat(F.lit('<div><p id="x">Part IV: The Mill</p></div>'), "body"))
    made = files.withColumn("ord", n).withColumn("inner", kinds.otherwise(F.concat(F.lit("<h1> </h1><p>Book two</p>"), "body")))
    return made.select("book", "file", "ord", F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>T</title></head><body>'), "inner", F.lit("</body></html>")).alias("page"))


def _read_pages(pages, schema, read):
    """Rows (book, file, then what ``read`` gives) of each page of markup."""
    from leafmill.sources import markup

    ship(pages.sparkSession)

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(book, file, *row) for book, file, page in zip(batch["book"], batch["file"], batch["page"]) for row in read(markup.read(page.encode()))]
            yield pd.DataFrame(rows, columns=["book", "file", *[c.split()[0] for c in schema.split(", ")]])

    return pages.select("book", "file", "page").mapInPandas(run, f"book string, file string, {schema}")


def page_headings(spark, sf_dir):
    from leafmill.sources import outline

    return _read_pages(marked_pages(spark, sf_dir), "heading string, other_works boolean", lambda d: [(outline.heading(d), outline.other_works(d))])


def chapter_starts(spark, sf_dir):
    from leafmill.sources import outline

    def read(d):
        starts = outline.chapters(d)
        return [(label, anchor) for (_, label), anchor in zip(starts, outline.anchors(d, starts))]

    return _read_pages(marked_pages(spark, sf_dir), "label string, anchor string", read).filter("length(label) < 40").distinct()


def injected_pages(spark, sf_dir):
    """Translations put into pages of markup and read from there again, behind the paragraphs they belong to; where
    the number of texts isn't that of the paragraphs the page stays as it was."""
    import pandas as pd

    from leafmill.sources import markup

    ship(spark)
    rows = render.interleaved(distinct_paragraphs(spark, sf_dir), standing(spark, sf_dir)).filter(F.col("en").rlike(r"\p{L}"))
    files = rows.groupBy("book", "file").agg(F.sort_array(F.collect_list(F.struct("idx", F.concat(F.lit("<p>"), text.html_escape(F.col("en")), F.lit("</p>")).alias("p"), F.when(F.col("shown"), F.col("zh")).otherwise("").alias("zh")))).alias("r"))
    pages = files.select("book", "file", F.array_join(F.transform("r", lambda x: x["p"]), "").alias("body"), F.transform("r", lambda x: x["zh"]).alias("zh"))

    def run(batches):
        for batch in batches:
            out = []
            for book, file, body, zh in zip(batch["book"], batch["file"], batch["body"], batch["zh"]):
                raw = f'<html xmlns="http://www.w3.org/1999/xhtml"><head/><body>{body}</body></html>'.encode()
                once = epub.inject(raw, list(zh))
                document = markup.read(epub.inject(once, list(zh)))  # a second time changes nothing
                pos = -1
                for k, e in enumerate(document.elements):
                    if e.tag == "p":
                        pos += not e.translated
                        out += [(book, file, pos, document.text(k))] if e.translated else []
            yield pd.DataFrame(out, columns=["book", "file", "pos", "zh"])

    found = pages.mapInPandas(run, "book string, file string, pos long, zh string")
    return found.select("book", "file", "pos", F.md5(F.regexp_replace("zh", r"\r\n?", "\n")).alias("digest"))


def package_rewrites(spark, sf_dir):
    """Languages and navigation of a package, rewritten with the table of contents of each book and read again."""
    import pandas as pd

    from leafmill.sources import markup

    ship(spark)
    entries = toc.expanded(listed_pages(spark, sf_dir)).groupBy("book").agg(F.sort_array(F.collect_list(F.struct("play_order", "title", "href"))).alias("toc"))

    def run(batches):
        ncx = b'<ncx><docTitle><text>x</text></docTitle><navMap><navInfo><text>i</text></navInfo><navPoint id="old"><navLabel><text>Old</text></navLabel></navPoint></navMap></ncx>'
        for batch in batches:
            out = []
            for book, points in zip(batch["book"], batch["toc"]):
                opf = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{book}</dc:title><dc:language>en</dc:language></metadata></package>'.encode()
                new = markup.read(epub.with_languages(opf))
                said = "+".join(new.text(k) for k, e in enumerate(new.elements) if e.tag == "language")
                nav = markup.read(epub.with_navigation(ncx, [(p["title"], p["href"]) for p in points], book))
                label = {e.parent: nav.text(k) for k, e in enumerate(nav.elements) if e.tag == "navLabel"}
                goes = {e.parent: e.attrs["src"] for e in nav.elements if e.tag == "content"}
                out += [(book, said, int(e.attrs["playOrder"]), label[k], goes[k]) for k, e in enumerate(nav.elements) if e.tag == "navPoint"]
            yield pd.DataFrame(out, columns=["book", "languages", "play_order", "title", "href"])

    return entries.mapInPandas(run, "book string, languages string, play_order long, title string, href string")


def large_classes(spark, sf_dir):
    """Classes that a sheet sets larger than the body, from a made sheet for each book."""
    from leafmill.functions import css

    n = F.row_number().over(Window.orderBy("book"))  # one row a book
    sheets = load(spark, sf_dir, "books").select("book", n.alias("n")).select("book", F.concat(F.lit(".a"), "n", F.lit(" p, .b { font-size: 1."), F.col("n") % 10, F.lit("em } .c { color: red } .d"), "n", F.lit(" { margin: 0; font-size: "), F.lit(9) + F.col("n") % 12, F.lit("PX } p.e { font-size: 110% }")).alias("css"))
    return css.large_classes(sheets)


# -- model --------------------------------------------------------------------------------------------------------------
def offline_translation(spark, sf_dir):
    """Every text without a translation, through units and the offline model."""
    from leafmill.operators.model import Offline, pending_units, translate_units, translation_prompt

    paragraphs, todo = units.paragraph_table(distinct_paragraphs(spark, sf_dir).select("book", "file", "idx", "en"))
    done = translate_units(pending_units(paragraphs, standing(spark, sf_dir).select("sha", "zh"), todo), translation_prompt({}), Offline())
    return done.select("sha", F.md5("zh").alias("digest"), "error")


def offline_verdicts(spark, sf_dir):
    """A judge that finds everything faithful, on what the rules have flagged, in batches of one book."""
    from leafmill.operators.model import Offline, judge_batches

    targets = pairs(spark, sf_dir).filter("qa_state = 'l1flag'")
    batches = state.batches(targets, ["book"], ["sha"]).groupBy("book", "batch").agg(F.collect_list(F.struct("sha", "en", "zh")).alias("pairs"))
    judged = judge_batches(batches, Offline())
    return judged.select("sha", quality.is_bad(F.col("faithful"), F.col("missing"), F.col("hallucinated")).alias("bad"))


def offline_repairs(spark, sf_dir):
    """Failed texts translated alone by the offline model; those that the rules pass are taken."""
    from leafmill.operators.model import Offline, translate_units, translation_prompt

    failed = pairs(spark, sf_dir).filter("qa_state = 'failed' and en <> ''").select("book", "sha", "en")
    again = failed.select(F.monotonically_increasing_id().alias("unit_id"), F.array(F.struct("sha", "en")).alias("texts"))
    second = translate_units(again, translation_prompt({}), Offline()).select("sha", "zh")
    return quality.checked(failed.join(second, "sha")).select("sha", (F.col("qa_state") == "l1ok").alias("taken"))


# -- lines with planted heads ---------------------------------------------------------------------------------------------
def headed_lines(spark, sf_dir):
    """Lines of the documents on pages of five, each page with a head and its number above."""
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    paged = lines(spark, sf_dir).withColumn("_n", F.row_number().over(order) - 1).select("doc_id", F.floor(F.col("_n") / 5).cast("int").alias("page"), (F.col("_n") % 5 + 1).cast("int").alias("line_no"), "text")
    heads = paged.filter("line_no = 1").select("doc_id", "page", F.lit(0).alias("line_no"), F.concat(F.lit("The  House by the Water "), F.col("page") + 1).alias("text"))
    return paged.unionByName(heads)


def planted_heads(spark, sf_dir):
    return reflow.running_heads(headed_lines(spark, sf_dir), "doc_id")


def reflow_without_heads(spark, sf_dir):
    return reflow.paragraphs_of(headed_lines(spark, sf_dir), "doc_id").select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5("text").alias("digest"))


def index_trim(spark, sf_dir):
    """Paragraphs without a tail that is dense with digits."""
    return sections.trim_trailing(reflowed(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


# -- archives -----------------------------------------------------------------------------------------------------------
def epub_archives(spark, sf_dir):
    rows = render.interleaved(distinct_paragraphs(spark, sf_dir), standing(spark, sf_dir))
    return epub.archives(render.chapters(rows), load(spark, sf_dir, "books").select("book", "title"))


def epub_write(spark, sf_dir):
    """Size and digest of one new archive a book."""
    return epub_archives(spark, sf_dir).select("book", "name", (F.length("content") > 0).alias("written"))


def dom_round_trip(spark, sf_dir):
    """Paragraphs written as English-only pages, packed into archives, unpacked and selected from the markup again."""
    from leafmill.sources.epub import pages

    ship(spark)
    plain = distinct_paragraphs(spark, sf_dir).select("book", "file", "idx", "en", F.lit("").alias("zh"), F.lit(False).alias("shown"))
    books = epub.archives(render.chapters(plain), load(spark, sf_dir, "books").select("book", "title"))
    read = pages(books.select(F.col("book").alias("source_path"), "content"))
    texts = read.select(F.col("source_path").alias("book"), "file", F.posexplode("texts").alias("pos", "en")).filter("pos > 0")  # the first is the heading
    chapter = F.regexp_extract("file", r"chap-(\d+)", 1).cast("long")
    return texts.select("book", chapter.alias("chapter"), F.col("pos").cast("long").alias("pos"), F.md5(F.regexp_replace("en", r"[ \t\r\n]+", " ")).alias("digest"))


def flagship(spark, sf_dir):
    """From documents to a histogram of flags: lines, paragraphs, units, cache, an offline translator and the rules."""
    from leafmill.operators.model import Offline, pending_units, translate_units, translation_prompt
    from leafmill.runtime import stage

    own = reflowed(spark, sf_dir).select(F.lit("shelf").alias("book"), F.format_string("doc-%08d", "doc_id").alias("file"), F.col("ord").cast("int").alias("idx"), F.col("text").alias("en"))
    paragraphs, todo = units.paragraph_table(own)
    paragraphs = stage(paragraphs, "paragraphs")
    cached = standing(spark, sf_dir).select("sha", "zh")
    done = stage(translate_units(pending_units(paragraphs, cached, todo), translation_prompt({}), Offline()), "translated").filter("sha is not null").select("sha", "zh")
    checked = quality.checked(state.english_of(done.withColumn("book", F.lit("shelf")), paragraphs))
    return checked.select(F.explode_outer(F.transform("flags", lambda f: F.regexp_replace(f, r"[(:].*$", ""))).alias("flag")).groupBy(F.coalesce("flag", F.lit("ok")).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


ALL = [
    content_hash_dedup, word_count, shred_fraction, despace_numbers, resplit_glue, soft_hyphens, slugs, html_escaped, han_latin_counts, meta_flags, json_tolerant,
    lines, head_keys, line_kinds, running_heads, full_width, reflow_paragraphs, chapter_split, matter_flags,
    unit_packing, latest_translations, latest_units, uncached_paragraphs, prune_orphans, interleave, zh_only_pages, glossary_top, glossary_context,
    l1_flags, l1_histogram, qa_histogram, unit_status, workable_units, qa_worklist, qa_sample, qa_batches, verdict_rule,
    contents_links, pick_contents, merge_toc, expand_toc, epub_write, dom_round_trip, flagship,
    listed_contents_links, listed_pick_contents, listed_merge_toc, listed_expand_toc, page_headings, chapter_starts, injected_pages, package_rewrites, large_classes,
    offline_translation, offline_verdicts, offline_repairs, planted_heads, reflow_without_heads, index_trim,
]
