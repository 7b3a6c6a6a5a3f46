"""EPUB archives as tables: ``books``, ``pages`` (one row a spine document) and the texts to translate.

Archives are read whole by ``binaryFile`` and unpacked in ``mapInPandas``: one row a spine document comes out, with its
outline, so that no later step needs the archive or the markup again."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.rules import SKIP_TOKENS, path_skipped
from leafmill.functions.text import slug, word_count
from leafmill.operators.sections import matter_flags
from leafmill.runtime import ship, tune_arrow
from leafmill.sources import outline
from leafmill.sources.markup import TAGS, Document, read, translatable

MIN_WORDS = 150

FILES = "source_path string, path string, content binary"
PAGES = (
    "source_path string, title string, file string, ord int, heading string, other_works boolean, texts array<string>, "
    "chapters array<struct<label:string,anchor:string>>, links array<struct<target:string,title:string>>, error string"
)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """source_path, content of every EPUB below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path).select(F.col("path").alias("source_path"), "content")


def children(document: Document, tag: str) -> list[int]:
    return [k for k, e in enumerate(document.elements) if e.tag == tag]


def package(files: dict[str, bytes]) -> tuple[str, Document]:
    """Path and content of the package file that the container names."""
    container = read(files["META-INF/container.xml"])
    path = container.elements[children(container, "rootfile")[0]].attrs["full-path"]
    return path, read(files[path])


def spine(path: str, opf: Document) -> tuple[str, list[str]]:
    """Title, and the paths of the XHTML documents in reading order."""
    base = posixpath.dirname(path)
    items = {opf.elements[k].attrs.get("id"): opf.elements[k].attrs for k in children(opf, "item")}
    order = [items[ref] for k in children(opf, "itemref") if (ref := opf.elements[k].attrs.get("idref")) in items]
    titles = children(opf, "title")
    return (opf.text(titles[0]).strip() if titles else ""), [posixpath.normpath(posixpath.join(base, a["href"])) for a in order if a.get("href") and "html" in a.get("media-type", "")]


def unpack(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n: z.read(n) for n in z.namelist() if not n.endswith("/")}


def pages(books: DataFrame, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """One row a spine document; one that can't be read has its error and no texts. A broken archive has one such row."""
    ship(books.sparkSession)
    tune_arrow(books.sparkSession, 16)  # archives are large: a few in memory at a time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["source_path"], batch["content"]):
                rows = []
                try:
                    files = unpack(content)
                    path, opf = package(files)
                    title, order = spine(path, opf)
                    base = posixpath.dirname(path)
                except Exception as error:
                    yield pd.DataFrame([(source, "", "", -1, "", False, [], [], [], f"{type(error).__name__}: {error}")], columns=PAGE_COLUMNS)
                    continue
                for n, file in enumerate(order):
                    if file not in files:
                        continue
                    try:
                        d = read(files[file])
                        starts = outline.chapters(d)
                        rel = posixpath.relpath(file, base) if base else file
                        rows.append((
                            source, title, file, n, outline.heading(d), outline.other_works(d), [d.text(k).strip() for k in translatable(d, tags)],
                            [{"label": label, "anchor": a} for (_, label), a in zip(starts, outline.anchors(d, starts))],
                            [{"target": posixpath.normpath(posixpath.join(base, t)), "title": s} for t, s in outline.links(d, rel)], None,
                        ))
                    except Exception as error:
                        rows.append((source, title, file, n, "", False, [], [], [], f"{type(error).__name__}: {error}"))
                yield pd.DataFrame(rows, columns=PAGE_COLUMNS)

    return books.mapInPandas(run, PAGES)


PAGE_COLUMNS = [c.split()[0] for c in ("source_path", "title", "file", "ord", "heading", "other_works", "texts", "chapters", "links", "error")]


def targets(page_rows: DataFrame, min_words: int = MIN_WORDS, skip: tuple[str, ...] = SKIP_TOKENS, auto_skip: bool = True) -> DataFrame:
    """book, file, ord, idx, en: texts of the documents that hold the book: not skipped by path, long enough, no matter.
    Rows of ``pages`` may carry the book's name; else it is made from the path."""
    kept = page_rows.filter(F.col("error").isNull() & ~path_skipped(F.col("file"), skip))
    rows = kept.select((F.col("book") if "book" in page_rows.columns else slug(F.col("source_path"), unique=True)).alias("book"), "file", F.col("ord").alias("spine"), "heading", F.posexplode("texts").alias("ord", "text")).filter(F.col("text") != "")
    words = rows.groupBy("book", "file").agg(F.sum(word_count(F.col("text"))).alias("words")).filter(F.col("words") >= min_words)
    chosen = words.select("book", "file")
    if auto_skip:
        chosen = chosen.join(matter_flags(rows, ["book", "file"], F.col("heading")).filter(~F.col("matter")), ["book", "file"], "left_semi")
    return rows.join(chosen, ["book", "file"], "left_semi").select("book", "file", F.col("spine").alias("ord"), F.col("ord").alias("idx"), F.col("text").alias("en"))


def stylesheets(books: DataFrame) -> DataFrame:
    """source_path, css: one row a style sheet; bytes that are not UTF-8 are left out."""
    ship(books.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, data.decode("utf-8", "ignore")) for s, content in zip(batch["source_path"], batch["content"]) for name, data in unpack(content).items() if name.endswith(".css")]
            yield pd.DataFrame(rows, columns=["source_path", "css"])

    return books.mapInPandas(run, "source_path string, css string")
