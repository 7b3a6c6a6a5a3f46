"""leafmill STEP ...: the pipeline's steps from a shell."""

from __future__ import annotations

import argparse
from pathlib import Path

from leafmill.plans import pipeline
from leafmill.runtime import session, stage

STEPS = ("extract", "glossary", "translate", "qa", "export", "run", "status")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    p.add_argument("step", choices=STEPS)
    p.add_argument("--shelf", default=pipeline.default_root(), help="folder of the tables (LEAFMILL_HOME, else the user's data folder)")
    p.add_argument("--adopt", help="an older folder whose content is moved to the shelf first, as far as it isn't there")
    p.add_argument("--epub", help="folder or file of EPUB archives")
    p.add_argument("--pdf", help="folder or file of PDF files with a text layer")
    p.add_argument("--book", help="a book of the shelf; remembered for steps that name none")
    p.add_argument("--source", help="work on the book made from this file")
    p.add_argument("--all", action="store_true", help="work on all books, at once")
    p.add_argument("--glossary", help="JSON file of a glossary to take; with the step glossary and no such file, where to write it")
    p.add_argument("--command", nargs="+", help="command of the text model; without it the offline stand-in answers")
    p.add_argument("--unit-words", type=int, default=2500)
    p.add_argument("--workers", type=int, default=10)
    p.add_argument("--timeout", type=float, default=240)
    p.add_argument("--max-attempts", type=int, default=5)
    p.add_argument("--qa-sample", type=float, default=0.20)
    p.add_argument("--qa-seed", default="seed")
    p.add_argument("--report", help="folder for a QA report a book")
    p.add_argument("--font", default="Noto Sans SC", help="font of the pages, '' for none")
    p.add_argument("--no-normalize", action="store_true", help="leave sizes of body text as they are")
    p.add_argument("--zh-style", default=pipeline.ZH_STYLE, help="style of the translations")
    p.add_argument("--min-words", type=int, default=150)
    p.add_argument("--skip", default=",".join(pipeline.SKIP_TOKENS))
    p.add_argument("--no-auto-skip", action="store_true")
    p.add_argument("--single", action="store_true", help="Chinese only")
    p.add_argument("--out", default=".", help="folder of the finished archives")
    return p


def main(argv: list[str] | None = None) -> None:
    from leafmill.operators.model import Command, Offline
    from leafmill.sinks.epub import save
    from leafmill.sources import pdf

    o = parser().parse_args(argv)
    spark = session()
    if o.adopt:
        print("moved:", *pipeline.adopt(o.adopt, o.shelf))
    shelf = pipeline.Shelf(spark, o.shelf)
    backend = Command(o.command, o.timeout) if o.command else Offline()
    whole = o.step == "run"
    given = bool(o.epub or o.pdf)
    if o.step == "extract" or (whole and (given or shelf.table("units").isEmpty())):
        if not given:
            raise SystemExit("no source: name one by --epub or --pdf")
        skip = tuple(t.strip().lower() for t in o.skip.split(",") if t.strip())
        if o.epub:
            print(pipeline.extract_epubs(shelf, o.epub, o.min_words, skip, not o.no_auto_skip, o.unit_words))
        if o.pdf:
            if not pdf.available():
                raise SystemExit("pdftotext is not installed; give the text layer as a table instead")
            read = stage(pdf.texts(spark, o.pdf), "text-layers")
            for r in pdf.unusable(read).toLocalIterator():
                print("no text layer:", r.source_path, r.error or "")
            best = pdf.best_texts(read)
            print(pipeline.extract_texts(shelf, best.join(pipeline.book_keys(shelf, best), "source_path").select("book", "title", "text", "source_path"), not o.no_auto_skip, o.unit_words))
    everything = o.all or ((whole or o.step == "extract") and not (o.book or o.source))
    book = None if everything or o.step in ("extract", "status") else pipeline.resolve(shelf, o.book, o.source)
    if book is None and not everything and o.step not in ("extract", "status"):
        raise SystemExit("no book: name one by --book or --source, or take --all")
    if book and o.glossary and Path(o.glossary).exists():
        print(len(pipeline.load_glossary(shelf, book, o.glossary)), "names")
    elif o.step == "glossary" or (whole and shelf.table("glossary").filter(pipeline._of(book)).isEmpty()):
        found = pipeline.build_glossary(shelf, book, backend)
        print(found if book is None else len(found), "names")
        if book and o.glossary:
            pipeline.save_glossary(shelf, book, o.glossary)
    if o.step == "translate" or whole:
        print(pipeline.translate(shelf, book, backend, o.workers, o.max_attempts))
    if o.step == "qa" or whole:
        print(pipeline.check(shelf, book, backend, o.qa_sample, o.qa_seed, o.report))
    if o.step == "export" or whole:
        for r in save(pipeline.export(shelf, book, o.single, o.font, not o.no_normalize, o.zh_style), o.out).toLocalIterator():
            print(r.name)
    if o.step == "status":
        for r in pipeline.status(shelf, o.book or shelf.meta(pipeline.WHOLE, "active") or "").orderBy("book").toLocalIterator():
            print(r.line)


if __name__ == "__main__":
    main()
