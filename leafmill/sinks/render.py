"""Pages of a bilingual book from rows, as strings: everything but the archive is done by columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import html_escape, usable

PAGE = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="en">\n<head><meta charset="utf-8"/><title>%s</title>\n<link rel="stylesheet" type="text/css" href="styles.css"/></head>\n<body>\n%s\n</body>\n</html>\n'


def interleaved(paragraphs: DataFrame, translations: DataFrame) -> DataFrame:
    """book, file, idx, en, zh, shown: each paragraph with its translation; ``shown`` says whether that can be used."""
    one = translations.select("sha", "zh")
    joined = paragraphs.select("book", "file", "idx", "en", "sha").join(one, "sha", "left")
    return joined.select("book", "file", "idx", "en", F.coalesce("zh", F.lit("")).alias("zh"), usable(F.col("zh")).alias("shown"))


def body_line(single: bool) -> Column:
    en, zh = F.concat(F.lit("<p>"), html_escape(F.col("en")), F.lit("</p>")), F.concat(F.lit("<p>"), html_escape(F.col("zh")), F.lit("</p>"))
    if single:
        return F.when(F.col("shown"), zh).otherwise(en)
    return F.when(F.col("shown"), F.concat(en, F.lit('\n<p class="zh">'), html_escape(F.col("zh")), F.lit("</p>"))).otherwise(en)


def chapters(rows: DataFrame, titles: DataFrame | None = None, single: bool = False) -> DataFrame:
    """book, ord (from 1, by file), file, title, xhtml. Rows as of ``interleaved``; titles: book, file, title."""
    files = rows.groupBy("book", "file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", body_line(single).alias("s")))), lambda r: r["s"]), "\n").alias("body"))
    numbered = files.withColumn("ord", F.row_number().over(Window.partitionBy("book").orderBy("file")))
    if titles is not None:
        numbered = numbered.join(titles.select("book", "file", F.nullif(F.col("title"), F.lit("")).alias("title")), ["book", "file"], "left")
    else:
        numbered = numbered.withColumn("title", F.lit(None).cast("string"))
    title = F.coalesce("title", F.concat(F.lit("Part "), F.col("ord")))
    head, tail = PAGE.split("%s", 1)[0], PAGE.split("%s")[-1]
    middle = PAGE.split("%s")[1]
    xhtml = F.concat(F.lit(head), html_escape(title), F.lit(middle + "<h2>"), html_escape(title), F.lit("</h2>\n"), F.col("body"), F.lit(tail))
    return numbered.select("book", "ord", "file", title.alias("title"), xhtml.alias("xhtml"))
