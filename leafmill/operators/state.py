"""Logs of versions and what is read from them: the standing version, what is still to do, counts, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH = 8


def latest(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key. A maximum, so rows combine before the shuffle; columns of the log stay as they are."""
    rest = [c for c in log.columns if c not in key]
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_translations(log: DataFrame) -> DataFrame:
    return latest(log, ["sha"], [F.col("seq"), F.col("landed_at")])


def latest_units(log: DataFrame) -> DataFrame:
    return latest(log, ["id"], [F.col("updated_at").isNotNull(), F.coalesce(F.col("updated_at"), F.timestamp_micros(F.lit(0))), F.col("landed_at")])


def uncached(paragraphs: DataFrame, translations: DataFrame) -> DataFrame:
    """Paragraphs whose text has no translation yet."""
    return paragraphs.join(translations.select("sha").distinct(), "sha", "left_anti").select(*paragraphs.columns)


def prune(translations: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Translations that some paragraph still needs."""
    return translations.join(paragraphs.select("sha").distinct(), "sha", "left_semi").select(*translations.columns)


def english_of(translations: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Adds ``en``: equal hashes mean equal texts, so any paragraph will do; '' where there is none."""
    one = paragraphs.groupBy("sha").agg(F.min("en").alias("en"))
    return translations.join(one, "sha", "left").withColumn("en", F.coalesce("en", F.lit("")))


def workable(units: DataFrame, most: int = 5) -> DataFrame:
    return units.filter(F.col("state").isin("pending", "failed") & (F.col("attempts") < most))


def histogram(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))


def worklist(translations: DataFrame) -> DataFrame:
    """sha, step: texts nobody has checked go to the rules, flagged ones whose judgement is owed to the judge."""
    step = F.when(F.col("qa_state") == "untested", "l1").when(F.col("qa_state") == "l1flag", "l2")
    return translations.select(*[c for c in ("book", "sha") if c in translations.columns], step.alias("step")).filter("step is not null")


def exact_sample(rows: DataFrame, by: list[str], share: float, order: Column) -> DataFrame:
    """floor(n x share) rows of each group in a fixed random order; all from a share of 1 on, none where it rounds to 0."""
    group = Window.partitionBy(*by)
    ranked = rows.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_rank", F.row_number().over(group.orderBy(order)))
    return ranked.filter((F.lit(share) >= 1) | (F.col("_rank") <= F.floor(F.col("_n") * F.lit(share)))).drop("_n", "_rank")


def batches(rows: DataFrame, by: list[str], order: list[str], size: int = BATCH) -> DataFrame:
    """Adds ``batch``: rows of a group in their order, ``size`` at a time."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))


def dashboard(units: DataFrame, paragraphs: DataFrame, translations: DataFrame) -> DataFrame:
    """One row a book: units, done, stuck, paragraphs, translations, failed. Each table is counted once."""
    one = lambda c: F.sum(c.cast("int"))
    u = units.groupBy("book").agg(F.count(F.lit(1)).alias("units"), one(F.col("state") == "done").alias("done"), one((F.col("state") == "failed") & (F.col("attempts") >= 5)).alias("stuck"))
    p = paragraphs.groupBy("book").agg(F.count(F.lit(1)).alias("paragraphs"))
    t = translations.groupBy("book").agg(F.count(F.lit(1)).alias("translations"), one(F.col("qa_state") == "failed").alias("failed"))
    joined = u.join(p, "book", "full_outer").join(t, "book", "full_outer")
    return joined.select("book", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("units", "done", "stuck", "paragraphs", "translations", "failed")])
