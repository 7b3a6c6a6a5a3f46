"""Keys that hold far more rows than others: find them exactly, and treat them apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOST = 100_000  # hot keys there can be: the list is broadcast (some MB of digests)


def hot_keys(df: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Keys with more than ``threshold`` rows, with their counts. Counting combines on the map side, so a hot key
    sends one row a task. The threshold grows with tables of more than ``threshold * MOST`` rows, so that never more
    than ``MOST`` keys come out; what stays below is a 100,000th of the table and streams through a join."""
    least = max(threshold, -(-df.count() // MOST))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least)


def salted_join(facts: DataFrame, unique: DataFrame, keys: list[str], spread: Column, threshold: int = 100_000, salts: int = 32, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join many rows a key (``facts``) with few rows a key (``unique``, mostly one).

    Keys above ``threshold`` rows get a salt from ``spread`` on the facts' side; the unique side is repeated once a
    salt for those keys only. The other keys keep salt 0. ``hot``: the keys with more rows, where they are known."""
    hot = (hot_keys(facts.select(*keys), keys, threshold) if hot is None else hot).select(*keys, F.lit(True).alias("_hot"))
    salted = facts.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    ).drop("_hot")
    copies = unique.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
