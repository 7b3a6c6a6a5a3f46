import json

import pytest

from leafmill.operators import model
from leafmill.plans import pipeline
from leafmill.sinks import epub


def doc(body):
    return f'<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml"><head/><body>{body}</body></html>'.encode()


@pytest.fixture
def shelf(spark, tmp_path):
    return pipeline.Shelf(spark, f"file://{tmp_path}/shelf")


def written(folder, name, words):
    pages = {"OEBPS/a.xhtml": doc(f"<h1>One</h1><p>{words} 1984.</p>"), "OEBPS/b.xhtml": doc(f"<h1>Two</h1><p>Anna Karen met {words}</p><p>Anna Karen left.</p><p>Anna Karen slept.</p>")}
    items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in "ab")
    opf = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{name}</dc:title></metadata><manifest>{items}</manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.epub").write_bytes(epub.zipped({"mimetype": b"application/epub+zip", "META-INF/container.xml": epub.CONTAINER.encode(), "OEBPS/content.opf": opf.encode(), **pages}))


def titled():
    class Titled:  # local, so that it travels to the workers by value
        """Says which titles it was told of."""

        def complete(self, system, payload):
            if system.startswith(model.GLOSSARY_PROMPT):
                return json.dumps({"Anna Karen": "安娜 " + system.rsplit('"', 2)[1]}, ensure_ascii=False)
            if system == model.JUDGE_PROMPT:
                return json.dumps([{"faithful": 2}] * len(payload.split(model.SEPARATOR)))
            return f"\n{model.SEPARATOR}\n".join("译 " + system.split("Names: ")[-1][:60] for _ in payload.split(model.SEPARATOR))

    return Titled()


def test_all_books_at_once(shelf, tmp_path):
    one, two = (" ".join([w] * 160) for w in ("word", "other"))
    written(tmp_path / "in" / "x", "A Tale", one)
    written(tmp_path / "in" / "y", "A Tale", two)
    found = pipeline.extract_epubs(shelf, str(tmp_path / "in"))
    books = sorted(r.book for r in shelf.table("books").collect())
    assert found["units"] == 4 and len(books) == 2 and books[0] == "a-tale" and books[1].startswith("a-tale-")  # two files of one name are two books
    pipeline.extract_epubs(shelf, str(tmp_path / "in"))
    assert sorted(r.book for r in shelf.table("books").collect()) == books and shelf.paragraphs().count() == found["paragraphs"]
    assert pipeline.build_glossary(shelf, None, titled()) == 2
    assert pipeline.translate(shelf, None, titled()) == {"done": 4}
    zh = {r.book: r.zh for r in shelf.translations().collect()}
    assert set(zh) == set(books) and all("Anna Karen=>安娜 A Tale" in v for v in zh.values())
    states = pipeline.check(shelf, None, titled(), share=1.0, report=f"{tmp_path}/report")
    assert "untested" not in states and sum(states.values()) == shelf.translations().count()
    assert {p.name for p in (tmp_path / "report").iterdir()} == {f"{b} qa.md" for b in books}
    out = epub.save(pipeline.export(shelf, None, font="", normalize=False, zh_style="color: red;"), f"file://{tmp_path}/out").collect()
    assert {r.book for r in out} == set(books) and {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {r.name for r in out}
    assert b"color: red;" in epub.unpack((tmp_path / "out" / out[0].name).read_bytes())["OEBPS/a.xhtml"]


def test_books_that_lose_all_rows_keep_none(shelf, spark):
    text = "CHAPTER ONE\n" + "A line as wide as the others are, more or less.\n" * 3
    texts = spark.createDataFrame([("b1", "T", text), ("b2", "T", text.replace("wide", "long"))], "book string, title string, text string")
    pipeline.extract_texts(shelf, texts)
    pipeline.translate(shelf, None, model.Offline())
    assert {r.book for r in shelf.translations().collect()} == {"b1", "b2"}
    pipeline.extract_texts(shelf, texts.filter("book = 'b2'").selectExpr("book", "title", "replace(text, 'long', 'broad') as text"))
    assert {r.book for r in shelf.translations().collect()} == {"b1"}  # every translation of b2 was an orphan


def test_glossary_files_meta_and_the_active_book(shelf, spark, tmp_path):
    assert shelf.meta("b", "k", "none") == "none"
    shelf.set_meta("b", "k", 1)
    shelf.set_meta("b", "k", 2)
    assert shelf.meta("b", "k") == "2"
    (tmp_path / "g.json").write_text('{"Anna": "安娜"}', encoding="utf-8")
    assert pipeline.load_glossary(shelf, "b", str(tmp_path / "g.json")) == {"Anna": "安娜"}
    pipeline.save_glossary(shelf, "b", str(tmp_path / "h.json"))
    assert json.loads((tmp_path / "h.json").read_text(encoding="utf-8")) == {"Anna": "安娜"}
    assert pipeline.resolve(shelf) is None
    assert pipeline.resolve(shelf, source="/in/My Book.epub") == "my-book" and pipeline.resolve(shelf) == "my-book"
    assert pipeline.resolve(shelf, "other") == "other" == pipeline.resolve(shelf)


def test_titles_of_files():
    from leafmill.sources.pdf import title_of

    assert title_of("Creator: x\nTitle:   A: Tale \nPages: 3") == "A: Tale" and title_of("Title: \n") is None and title_of("") is None


def test_older_folders_are_adopted_and_nothing_is_overwritten(tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    for path, said in ((old / "a" / "f", "1"), (old / "b", "old"), (new / "b", "new")):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(said)
    (old / "link").symlink_to(new / "b")
    (new / "link").symlink_to(new / "b")
    assert pipeline.adopt(str(old), str(new)) == ["a"] and (new / "b").read_text() == "new" and [p.name for p in old.iterdir()] == ["b"]
    (old / "b").unlink()
    assert pipeline.adopt(str(old), str(new)) == [] and not old.exists() and pipeline.adopt(str(old), str(new)) == []


def test_body_paragraphs():
    from leafmill.sources.markup import body_paragraphs, read

    d = read(doc('<p>One</p><blockquote><p>Two</p></blockquote><p class="zh">二</p><p class="illus">No</p><p>…</p><li>Three</li>'))
    assert [d.text(k) for k in body_paragraphs(d)] == ["One", "Two"]


def test_the_command_line_runs_only_what_is_open(spark, tmp_path, monkeypatch, capsys):
    from leafmill import cli

    written(tmp_path / "in", "A Tale", " ".join(["word"] * 160))
    calls = []
    for step in ("extract_epubs", "build_glossary"):
        plain = getattr(pipeline, step)
        monkeypatch.setattr(pipeline, step, lambda *a, plain=plain, step=step, **k: calls.append(step) or plain(*a, **k))
    monkeypatch.setattr(cli, "session", lambda: spark)
    common = ["run", "--shelf", f"file://{tmp_path}/shelf", "--out", f"file://{tmp_path}/out"]
    cli.main([*common, "--epub", str(tmp_path / "in")])
    assert calls == ["extract_epubs", "build_glossary"] and "a-tale - Bilingual EN-ZH.epub" in capsys.readouterr().out
    cli.main(common)
    assert calls == ["extract_epubs", "build_glossary"]  # units and a glossary are there
    cli.main(["status", "--shelf", f"file://{tmp_path}/shelf"])
    assert "a-tale" in capsys.readouterr().out
