"""A table of contents for a book from its documents: the book's own contents page where it has one, else headings.

Rows are spine documents: book, file, ord, heading, other_works, chapters, links (see ``sources.epub.pages``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.rules import NUMBERED


def contents_links(pages: DataFrame) -> DataFrame:
    """book, page, page_ord, pos, target, title: links to documents of the spine, the first of each target on a page."""
    links = pages.select("book", F.col("file").alias("page"), F.col("ord").alias("page_ord"), F.posexplode("links").alias("pos", "l")).select("book", "page", "page_ord", "pos", "l.target", "l.title").filter("title <> ''")
    inside = links.join(pages.select("book", F.col("file").alias("target")), ["book", "target"], "left_semi")
    first = Window.partitionBy("book", "page", "target").orderBy("pos")
    return inside.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("book", "page", "page_ord", "pos", "target", "title")


def contents_page(pages: DataFrame) -> DataFrame:
    """book, page: the page that is the book's contents, at most one a book.

    A page whose name says so and that has two links or more goes first; else the one with the most links, if these are
    at least five and half of the documents. Of equal ones the first in the spine."""
    docs = pages.groupBy("book").agg(F.count(F.lit(1)).alias("docs"))
    scored = contents_links(pages).filter("target <> page").groupBy("book", "page", "page_ord").agg(F.count(F.lit(1)).alias("n"))
    base = F.lower(F.regexp_extract("page", r"([^/]*)$", 1))
    named = (base.contains("contents") | base.contains("toc") | base.contains("nav")) & (F.col("n") >= 2)
    best = Window.partitionBy("book").orderBy(F.desc("named"), F.desc("n"), "page_ord")
    top = scored.withColumn("named", named).withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").join(docs, "book")
    return top.filter(F.col("named") | (F.col("n") >= F.greatest(F.lit(5.0), F.lit(0.5) * F.col("docs")))).select("book", "page")


def merged(pages: DataFrame) -> DataFrame:
    """book, file, ord, title: the title of the contents page, else the document's heading, in reading order.

    With a contents page headings only recover numbered chapters that it lost; without one every titled document is
    listed but cards of other works. The contents page itself is not."""
    page = contents_page(pages)
    titles = contents_links(pages).join(page, ["book", "page"]).filter("target <> page").select("book", F.col("target").alias("file"), "title")
    rows = pages.select("book", "file", "ord", "heading", "other_works").join(page, "book", "left").filter("page is null or file <> page").join(titles, ["book", "file"], "left")
    own = F.when(~F.col("other_works") & (F.col("heading") != "") & (F.col("page").isNull() | F.col("heading").rlike(NUMBERED)), F.col("heading"))
    return rows.select("book", "file", "ord", F.coalesce("title", own).alias("title")).filter("title is not null")


def expanded(pages: DataFrame) -> DataFrame:
    """book, play_order, title, href: documents that pack two chapters or more give one entry for each of them."""
    page = contents_page(pages)
    packed = pages.filter(F.size("chapters") >= 2).join(page.select("book", F.col("page").alias("file")), ["book", "file"], "left_anti")
    inner = packed.select("book", "file", "ord", F.posexplode("chapters").alias("pos", "c")).select("book", "ord", "pos", F.col("c.label").alias("title"), F.concat("file", F.lit("#"), "c.anchor").alias("href"))
    plain = merged(pages).join(packed.select("book", "file"), ["book", "file"], "left_anti").select("book", "ord", F.lit(0).alias("pos"), "title", F.col("file").alias("href"))
    order = Window.partitionBy("book").orderBy("ord", "pos")
    return inner.unionByName(plain).select("book", F.row_number().over(order).alias("play_order"), "title", "href")
