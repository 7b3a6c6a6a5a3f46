import io
import zipfile

from leafmill.sinks import epub
from leafmill.sources import outline
from leafmill.sources.markup import read, translatable


def doc(body, head=""):
    return f'<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml"><head>{head}</head><body>{body}</body></html>'.encode()


def texts(raw):
    d = read(raw)
    return [d.text(k) for k in translatable(d)]


def test_leaves_and_hidden_text():
    assert texts(doc('<h2>One</h2><blockquote><p>Two<sup>3</sup> more</p></blockquote><p class="illus-x">No</p><p>…</p><p class="zh">否</p><li>A&nbsp;B</li>')) == ["One", "Two more", "A B"]


def test_broken_markup_is_read_too():
    d = read(b"<html><body><p>One<br>two <b>three</p><p>Four & five</body>")
    assert not d.well_formed and [d.text(k) for k in translatable(d)] == ["Onetwo three", "Four & five"]
    assert read(b"").elements == []


def test_heading_and_chapters():
    d = read(doc('<h1> </h1><p>CHAPTER 1</p><!-- x --><br/><p class="zh">第一章</p><p>“LIKE SUMMER TEMPEST</p><p>CAME HIS TEARS”</p><p>It was a dark and stormy night.</p><h2 id="own">CHAPTER II: The Road</h2><p>Chapter 3 was the hardest to write.</p><h3>49. Last</h3>'))
    assert outline.heading(d) == "CHAPTER II: The Road"
    starts = outline.chapters(d)
    assert [label for _, label in starts] == ["CHAPTER 1 — “LIKE SUMMER TEMPEST CAME HIS TEARS”", "CHAPTER II: The Road", "49. Last"]
    assert outline.anchors(d, starts) == ["ebz-ch001", "own", "ebz-ch003"]
    again = read(epub.with_anchors(d.source))
    assert outline.anchors(again, outline.chapters(again)) == ["ebz-ch001", "own", "ebz-ch003"]


def test_other_works():
    assert outline.other_works(read(doc("<p><i>Kissinger</i></p><p><em>The Wise Men</em></p><p>(with X)</p>")))
    assert not outline.other_works(read(doc("<p><i>For Ina</i></p><p><i>and for Dr. T</i></p>")))
    assert not outline.other_works(read(doc("<h1>T</h1><p><i>A</i></p><p><i>B</i></p>")))


def test_inject_twice_is_once():
    raw = doc("<p>One</p>tail<p>Two</p>", "<title>T</title>")
    once = epub.inject(raw, ["一", None], style=".zh { }")
    assert '<p>One</p>\n<p class="zh">一</p>tail<p>Two</p>' in once.decode()
    assert epub.inject(once, ["一", None], style=".zh { }").count(b"bilingual-zh") == 1
    assert texts(once) == ["One", "Two"]
    assert epub.inject(raw, ["一"]) is None
    assert b"<p>\xe4\xb8\x80</p>" in epub.inject(raw, ["一", None], single=True)


def test_languages_and_navigation():
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:language>en</dc:language></metadata></package>'.encode()
    new = epub.with_languages(opf)
    d = read(new)
    assert [d.text(k) for k, e in enumerate(d.elements) if e.tag == "language"] == ["zh", "en"]
    assert epub.with_languages(new) is None and epub.with_languages(b"<package/>") is None
    ncx = b'<ncx><docTitle><text>UnKnown</text></docTitle><navMap><navInfo><text>i</text></navInfo><navPoint id="a"><navPoint id="b"/></navPoint></navMap></ncx>'
    d = read(epub.with_navigation(ncx, [("A & B", "x.html"), ("C", "y.html#z")], "Title"))
    assert [e.attrs["playOrder"] for e in d.elements if e.tag == "navPoint"] == ["1", "2"] and "Title" in d.visible and "A & B" in d.visible and "i" in d.visible


def book(tmp_path):
    long = " ".join(["word"] * 160)
    files = {
        "mimetype": b"application/epub+zip",
        "META-INF/container.xml": epub.CONTAINER.encode(),
        "OEBPS/content.opf": b'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A Book</dc:title><dc:language>en</dc:language></metadata><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="cover.xhtml" media-type="application/xhtml+xml"/></manifest><spine toc="n"><itemref idref="c"/><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "OEBPS/toc.ncx": b"<ncx><docTitle><text>x</text></docTitle><navMap></navMap></ncx>",
        "OEBPS/a.xhtml": doc(f"<h1>First</h1><p>{long} 1984.</p>"),
        "OEBPS/b.xhtml": doc(f"<h1>Copyright</h1><p>{long}</p>"),
        "OEBPS/cover.xhtml": doc(f"<p>{long}</p>"),
        "OEBPS/s.css": b".Title { font-size: 2em }",
    }
    path = tmp_path / "in" / "A Book.epub"
    path.parent.mkdir()
    path.write_bytes(epub.zipped(files))
    return path


def test_pipeline_from_archive_to_archive(spark, tmp_path):
    from leafmill.operators.model import Offline
    from leafmill.plans import pipeline

    shelf = pipeline.Shelf(spark, f"file://{tmp_path}/shelf")
    pipeline.extract_epubs(shelf, str(book(tmp_path).parent))
    assert [(r.book, r.file, r.en[:5]) for r in shelf.paragraphs().orderBy("idx").collect()] == [("a-book", "OEBPS/a.xhtml", "First"), ("a-book", "OEBPS/a.xhtml", "word ")]
    assert pipeline.build_glossary(shelf, "a-book", Offline()) == {}
    assert pipeline.translate(shelf, "a-book", Offline()) == {"done": 1}
    assert pipeline.translate(shelf, "a-book", None) == {"done": 1}  # all is cached: no call
    states = pipeline.check(shelf, "a-book", Offline())
    assert sum(states.values()) == 2 and "untested" not in states
    row = pipeline.export(shelf, "a-book").head()
    with zipfile.ZipFile(io.BytesIO(row.content)) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert 'class="zh">译文 译文' in z.read("OEBPS/a.xhtml").decode() and "zh" in z.read("OEBPS/content.opf").decode()
        assert 'src="a.xhtml"' in z.read("OEBPS/toc.ncx").decode() and ":not(.Title)" in z.read("OEBPS/a.xhtml").decode()
    assert "done" in pipeline.status(shelf).head().line


def test_pipeline_from_text_layer(spark, tmp_path):
    from leafmill.plans import pipeline

    wide = "This line is as wide as the lines of the page are and goes on"
    text = f"CHAPTER ONE\n{wide}\n{wide} end.\n\nCHAPTER TWO\n{wide}\nit ends."
    shelf = pipeline.Shelf(spark, f"file://{tmp_path}/shelf")
    pipeline.extract_texts(shelf, spark.createDataFrame([("b", "T", text)], "book string, title string, text string"))
    assert [(r.file, r.idx) for r in shelf.paragraphs().orderBy("id").collect()] == [("chap-001", 0), ("chap-002", 0)]
    row = pipeline.export(shelf, "b", single=True).head()
    with zipfile.ZipFile(io.BytesIO(row.content)) as z:
        assert "CHAPTER ONE" in z.read("OEBPS/chap-001.xhtml").decode()
