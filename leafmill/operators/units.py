"""Paragraphs into batches of about so many words, and the numbers that reading order gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import content_hash, word_count

UNIT_WORDS = 2500


def pack_units(paragraphs: DataFrame, unit_words: int = UNIT_WORDS) -> DataFrame:
    """book, file, idx, unit (from 0 in each file). Paragraphs: book, file, idx, en.

    A unit closes at the paragraph that brings it to ``unit_words`` and never spans files; blank paragraphs are in
    none. The running total starts anew in each unit, so a window sum can't say it; a fold over a file's word counts can."""
    words = word_count(F.col("en"))
    rows = paragraphs.select("book", "file", "idx", words.alias("words")).filter("words > 0")
    start = F.expr("named_struct('ends', cast(array() as array<int>), 'sum', cast(0 as bigint))")

    def step(acc, row):  # only the last paragraph of each full unit is kept, so the state stays short
        total = acc["sum"] + row["words"]
        full = total >= unit_words
        return F.struct(F.when(full, F.array_append(acc["ends"], row["idx"].cast("int"))).otherwise(acc["ends"]).alias("ends"), F.when(full, F.lit(0).cast("long")).otherwise(total).alias("sum"))

    files = rows.groupBy("book", "file").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("words").cast("long").alias("words")))).alias("rows"))
    cut = files.select("book", "file", "rows", F.aggregate("rows", start, step)["ends"].alias("ends"))
    placed = F.transform("rows", lambda r: F.struct(r["idx"].alias("idx"), F.size(F.filter("ends", lambda e: e < r["idx"])).alias("unit")))
    return cut.select("book", "file", F.explode(placed).alias("p")).select("book", "file", "p.idx", "p.unit")


def number_units(packed: DataFrame) -> DataFrame:
    """Adds ``unit_id`` and ``par_id``: contiguous through a book in the order of its files.

    Only the files of a book are put in one order, with their counts; paragraphs get the sum before their file."""
    files = packed.groupBy("book", "file").agg((F.max("unit") + 1).alias("units"), F.count(F.lit(1)).alias("pars"))
    before = Window.partitionBy("book").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offset = files.select("book", "file", F.coalesce(F.sum("units").over(before), F.lit(0)).alias("u0"), F.coalesce(F.sum("pars").over(before), F.lit(0)).alias("p0"))
    inside = F.row_number().over(Window.partitionBy("book", "file").orderBy("idx"))
    return packed.withColumn("_n", inside).join(offset, ["book", "file"]).select("book", "file", "idx", "unit", (F.col("u0") + F.col("unit") + 1).alias("unit_id"), (F.col("p0") + F.col("_n")).alias("par_id"))


def paragraph_table(rows: DataFrame, unit_words: int = UNIT_WORDS) -> tuple[DataFrame, DataFrame]:
    """The paragraphs and units tables of extracted texts (book, file, idx, en)."""
    numbered = number_units(pack_units(rows, unit_words))
    paragraphs = rows.join(numbered, ["book", "file", "idx"]).select("book", F.col("par_id").alias("id"), "file", F.col("idx").cast("int").alias("idx"), "en", content_hash(F.col("en")).alias("sha"), F.col("unit_id").cast("long").alias("unit_id"))
    stem = F.regexp_extract(F.regexp_replace("file", r"^.*/", ""), r"^([^.]*)", 1)
    units = numbered.groupBy("book", "unit_id", "file", "unit").agg(F.count(F.lit(1)).alias("paragraphs")).select(
        "book", F.col("unit_id").cast("long").alias("id"), F.concat(stem, F.lit("#"), "unit").alias("name"), "file", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("error")
    )
    return paragraphs, units
