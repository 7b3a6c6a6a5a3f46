"""Paragraphs into chapters, and what is not the book itself: front and back matter, a trailing index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.rules import MATTER_BODY, MATTER_TITLE, digit_density, is_heading
from leafmill.functions.text import digit_count, word_count

TITLE_LIMIT = 80


def title_fold(headings: Column) -> Column:
    """Headings in a row make one title, until it has 80 characters."""
    return F.aggregate(headings, F.lit(""), lambda acc, p: F.when(acc == "", p).when(F.length(acc) < TITLE_LIMIT, F.concat(acc, F.lit(": "), p)).otherwise(acc))


def split_chapters(paragraphs: DataFrame, key: str) -> DataFrame:
    """key, section (from 1), title, ord (in the section), text. Paragraphs: key, ord, text.

    A heading behind body text opens a section; headings without a body behind them are lost, except in a text that has
    nothing else. Sections are numbered, not only labelled, so that more than 999 keep their order."""
    order = Window.partitionBy(key).orderBy("ord")
    flagged = paragraphs.withColumn("_head", is_heading(F.col("text")))
    opened = flagged.withColumn("_open", F.col("_head") & ~F.coalesce(F.lag("_head").over(order), F.lit(True)))
    islands = opened.withColumn("_island", F.sum(F.col("_open").cast("long")).over(order))
    whole = Window.partitionBy(key)
    body = F.max((~F.col("_head")).cast("int"))
    marked = islands.withColumn("_body", body.over(Window.partitionBy(key, "_island"))).withColumn("_any", body.over(whole))
    lone = F.col("_any") == 0  # nothing but headings: one section without title
    kept = marked.filter(lone | ((F.col("_body") == 1)))
    titled = kept.withColumn("_titles", F.sort_array(F.collect_list(F.when(F.col("_head") & ~lone, F.struct("ord", "text"))).over(Window.partitionBy(key, "_island").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    rows = titled.filter(lone | ~F.col("_head")).withColumn("title", title_fold(F.transform("_titles", lambda r: r["text"])))
    numbered = rows.withColumn("section", F.dense_rank().over(Window.partitionBy(key).orderBy(F.when(lone, F.lit(0)).otherwise(F.col("_island")))))
    return numbered.select(key, "section", "title", (F.row_number().over(Window.partitionBy(key, "section").orderBy("ord")) - 1).alias("ord"), "text")


def section_label(section: Column) -> Column:
    return F.format_string("chap-%03d", section)


def trim_trailing(paragraphs: DataFrame, key: str) -> DataFrame:
    """Without a tail that begins where paragraphs dense with digits follow each other, in the last quarter."""
    order = Window.partitionBy(key).orderBy("ord")
    dense = (digit_density(F.col("text")) >= 0.10).cast("int")
    seen = paragraphs.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).withColumn("_dense", dense)
    ahead = seen.withColumn("_ahead", F.sum("_dense").over(order.rowsBetween(0, 3)))
    begins = (F.col("_n") >= 20) & (F.col("_i") >= F.floor(F.col("_n") * F.lit(0.75))) & (F.col("_dense") == 1) & (F.col("_ahead") >= 3)
    cut = ahead.withColumn("_cut", F.min(F.when(begins, F.col("_i"))).over(Window.partitionBy(key)))
    return cut.filter(F.col("_cut").isNull() | (F.col("_i") < F.col("_cut"))).select(*paragraphs.columns)


def matter_flags(paragraphs: DataFrame, keys: list[str], head: Column | None = None) -> DataFrame:
    """keys, matter: is a section front or back matter? One aggregation, then the rules in their order.

    ``head``: the section's title; where it is empty the first paragraph stands for it."""
    t = F.col("text")
    words = word_count(t)
    short, prose = words <= 7, (words >= 25) & (digit_count(t) < F.lit(0.05) * F.length(t))
    one = lambda c: F.sum(c.cast("int"))
    stats = paragraphs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(words).alias("words"),
        one(short).alias("short"),
        one(prose).alias("prose"),
        one(short & (digit_count(t) > 0)).alias("numbered"),
        F.min_by(t, F.col("ord")).alias("first"),
        F.max(head if head is not None else F.lit("")).alias("head"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("ord") < 8, F.struct("ord", "text")))), 1, 8).alias("opening"),
    )
    top = F.when(F.coalesce(F.col("head"), F.lit("")) != "", F.col("head")).otherwise(F.col("first"))
    opening = F.array_join(F.transform("opening", lambda r: r["text"]), " ")
    listing = (F.col("n") >= 12) & (F.col("short") >= F.lit(0.6) * F.col("n")) & (F.col("prose") < 3) & (F.col("numbered") >= F.lit(0.5) * F.col("short"))
    matter = top.rlike(MATTER_TITLE) | ((F.col("words") < 300) & opening.rlike(MATTER_BODY)) | listing
    return stats.select(*keys, F.coalesce(matter, F.lit(False)).alias("matter"))
