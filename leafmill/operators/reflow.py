"""Lines of a text layer into paragraphs. Every derived table carries its order; a document's lines are one group, so the
work spreads over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.rules import CHAPTER_LINE, TERMINAL, head_key, is_page_line
from leafmill.functions.text import WS, despace_numbers, drop_soft_hyphens, is_upper, resplit_glued, rstrip, shred_fraction, strip, word_count

FULL_SHARE = 0.92
SHORT_SHARE = 0.80
HEAD_SHARE, HEAD_LEAST = 0.12, 5
SHREDDED = 0.015
#: White space but the line feed.
BLANK = WS.replace(r"\t-\r", r"\t\x{0b}-\r")


def lines_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, page, line_no, text. Pages part at form feeds; blank lines at the edges of a page, and empty pages, are no lines."""
    page = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\f")).alias("page", "_page"))
    # blank lines at the edges go before the lines are told apart; each line loses the blanks behind it
    inner = page.withColumn("_page", rstrip(F.regexp_replace("_page", f"^(?:{BLANK}*\n)+", ""))).filter(F.col("_page") != "")
    cut = inner.withColumn("_lines", F.transform(F.split("_page", "\n"), rstrip))
    return cut.select(key, "page", F.posexplode("_lines").alias("line_no", "text"))


def better_text(default: Column, raw: Column) -> Column:
    """The raw reading order if the default one is shredded into lone letters and the raw one strictly less so."""
    return F.when((shred_fraction(default) > SHREDDED) & (shred_fraction(raw) < shred_fraction(default)), raw).otherwise(default)


def running_heads(lines: DataFrame, key: str) -> DataFrame:
    """key, head, n: keys of lines that recur on many pages of a document."""
    keyed = lines.select(key, "page", head_key(F.col("text")).alias("head"))
    pages = keyed.groupBy(key).agg(F.countDistinct("page").alias("pages"))
    counted = keyed.filter(word_count(F.col("head")) >= 2).groupBy(key, "head").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HEAD_LEAST)
    least = F.greatest(F.lit(HEAD_LEAST), F.floor(F.lit(HEAD_SHARE) * F.col("pages")))
    return counted.join(pages, key).filter(F.col("n") >= least).select(key, "head", "n")


def content_lines(lines: DataFrame, key: str) -> DataFrame:
    """Lines without page numbers and running heads, stripped. Heads are counted by windows over a document's lines, so
    the lines are read and shuffled once and the key of a line is made once."""
    whole, order = Window.partitionBy(key), Window.partitionBy(key).orderBy("page", "line_no")
    keyed = lines.withColumn("_head", head_key(F.col("text"))).withColumn("_turn", (~F.lag("page").over(order).eqNullSafe(F.col("page"))).cast("int"))
    counted = keyed.withColumn("_pages", F.sum("_turn").over(whole)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "_head")))
    running = (word_count(F.col("_head")) >= 2) & (F.col("_n") >= F.greatest(F.lit(HEAD_LEAST), F.floor(F.lit(HEAD_SHARE) * F.col("_pages"))))
    return counted.filter(~running & ~is_page_line(F.col("text"))).select(key, "page", "line_no", strip(F.col("text")).alias("text"))


def full_width(content: DataFrame, key: str) -> DataFrame:
    """key, full: width of a full line, as the order statistic at 92 % (not a percentile, which is one off)."""
    return content.filter("text <> ''").groupBy(key).agg(F.sort_array(F.collect_list(F.length("text"))).alias("w")).select(key, F.try_element_at("w", F.floor(F.size("w") * F.lit(FULL_SHARE)).cast("int") + 1).alias("full"))


def paragraphs_of(lines: DataFrame, key: str) -> DataFrame:
    """key, ord, text. A blank line ends a paragraph, and so does a short line that ends a sentence or is a heading."""
    # the order statistic by windows: they need the same partitioning as the islands below, so nothing is read or shuffled twice
    written, whole = F.col("text") != "", Window.partitionBy(key)
    ranked = content_lines(lines, key).withColumn("_rank", F.row_number().over(whole.orderBy(F.desc(written), F.length("text")))).withColumn("_n", F.sum(written.cast("int")).over(whole))
    wide = ranked.withColumn("full", F.max(F.when(F.col("_rank") == F.floor(F.col("_n") * F.lit(FULL_SHARE)) + 1, F.length("text"))).over(whole)).filter("_n > 0")
    t = F.col("text")
    ends = (F.length(t) < F.lit(SHORT_SHARE) * F.col("full")) & (t.rlike(TERMINAL) | t.rlike(CHAPTER_LINE) | (is_upper(t) & (word_count(t) <= 8)))
    order = Window.partitionBy(key).orderBy("page", "line_no")
    flagged = wide.withColumn("_break", (t == "") | ends).withColumn("_start", F.coalesce(F.lag("_break").over(order), F.lit(True)))
    islands = flagged.withColumn("_island", F.sum(F.col("_start").cast("long")).over(order)).filter("text <> ''")
    # a line that ends in a letter and a hyphen loses the hyphen if another follows, which then stands without a blank
    inside = Window.partitionBy(key, "_island").orderBy("page", "line_no")
    divided = r"\p{L}-$"
    before, after = F.lag("text").over(inside), F.lead("text").over(inside)
    pieces = islands.withColumn("_gap", F.when(before.isNull() | before.rlike(divided), "").otherwise(" ")).withColumn("_own", F.when(after.isNotNull() & t.rlike(divided), F.regexp_replace(t, "-$", "")).otherwise(t))
    grouped = pieces.groupBy(key, "_island").agg(F.sort_array(F.collect_list(F.struct("page", "line_no", F.concat("_gap", "_own").alias("s")))).alias("_rows"))
    glued = F.array_join(F.transform("_rows", lambda r: r["s"]), "")
    clean = strip(resplit_glued(despace_numbers(drop_soft_hyphens(glued))))
    out = grouped.select(key, "_island", clean.alias("text"))
    return out.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_island")) - 1).alias("ord"), "text")
