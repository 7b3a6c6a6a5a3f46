"""Duplicates hidden by formatting differences (problem 2).

The canonical key of a text is its letters and digits in lower case, after look-alikes are brought to one form. A text
that consists wholly of labelled fields has also a field key, of its sorted ``label=value`` pairs. A field is split at
its first colon that doesn't stand between digits; its label holds a letter, its value may hold more colons. Texts are
the same if they share either key, and what is the same as the same text is the same: classes are the connected
components of plain keys and field keys.

Rows are collapsed on the digest of the plain key. Keys with more than ``hot`` rows are found exactly, by counts
combined on the map side, and take two levels: a minimum for each key and salt, then for each key. All others take one
shuffle. What follows works on one row a different text; only the way back to the rows is a join on the plain key, with
the hot ones salted again. The representative is the smallest identifier.

Defined results: null texts, and texts without any letter or digit, are no copies of anything; null identifiers are
left out; rows delivered more than once count once; an id with two different texts is in both classes; an empty table
gives no rows; very long texts are keyed whole; columns beyond ``id`` and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.lookalikes import Lookalikes
from leafmill.operators.skew import hot_keys, salted_join
from leafmill.runtime import load, stage

#: What may stand between labelled fields, tried in this order; blanks and line breaks inside a field don't count.
SEPARATORS = (";", r"\|", r"\n", ",")


def letters(text: Column) -> Column:
    """Letters, marks on them and digits, in one case."""
    return F.replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", ""), F.lit("ß"), F.lit("ss"))


def fields(text: Column) -> Column:
    """Sorted ``label=value`` pairs if the text consists wholly of labelled fields, at least two; else null."""

    def by(separator: str) -> Column:
        parts = F.filter(F.split(F.regexp_replace(text, r"(?<=\p{N}):(?=\p{N})", "."), separator), lambda p: p.rlike(r"[\p{L}\p{N}]"))
        pairs = F.transform(parts, lambda p: F.concat(letters(F.split(p, ":").getItem(0)), F.lit("="), letters(p.substr(F.instr(p, ":") + 1, F.length(p)))))
        whole = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(r"^[^:]*\p{L}[^:]*:(?s:.*)[\p{L}\p{N}]"))
        return F.when(whole, F.array_join(F.array_sort(pairs), ";"))

    return F.when(text.contains(":"), F.coalesce(*[by(s) for s in SEPARATORS]))


def canonical_keys(rows: DataFrame, lookalikes: Lookalikes, text: str = "en") -> DataFrame:
    """id, plain (digest of letters and digits), fkey (digest of the fields, or null)."""
    formed = rows.filter(F.col("id").isNotNull() & F.col(text).isNotNull()).select("id", lookalikes.form(F.col(text)).alias("form"))
    keyed = formed.select("id", letters(F.col("form")).alias("letters"), fields(F.col("form")).alias("fields")).filter("letters <> ''")
    return keyed.select("id", F.unhex(F.md5("letters")).alias("plain"), F.unhex(F.md5(F.concat(F.lit("fields "), F.col("fields")))).alias("fkey"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it is connected with) for the nodes of ``edges`` (a, b). Each round takes the
    smallest root of the neighbours and then that root's own, so rounds follow the logarithm of the longest path;
    all sums are combined before they are shuffled and each round is written."""
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = stage(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        hooked = stage(roots.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "hooked")
        jumped = hooked.join(hooked.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root"))
        jumped = stage(jumped, "roots")
        if jumped.filter("root <> was").isEmpty():
            return jumped.select("node", "root")
        roots = jumped.select("node", "root")


def collapse(rows: DataFrame, lookalikes: Lookalikes, text: str = "en", hot: int = 50_000, salts: int = 64) -> DataFrame:
    """id, keep_id (smallest identifier with the same text), copies (how many the text has)."""
    keys = stage(canonical_keys(rows, lookalikes, text).distinct(), "keys")
    often = stage(hot_keys(keys.select("plain"), ["plain"], hot).select("plain", F.lit(True).alias("_hot")), "hot")
    of_key = lambda least, copies: (F.min(least).alias("least"), F.sum(copies).alias("copies"), F.min("fkey").alias("fkey"), F.max("other").alias("other"))
    marked = keys.withColumn("other", F.col("fkey")).join(F.broadcast(often), "plain", "left")
    one_level = marked.filter("_hot is null").groupBy("plain").agg(*of_key("id", F.lit(1)))
    salted = marked.filter("_hot").groupBy("plain", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(*of_key("id", F.lit(1)))
    texts = stage(one_level.unionByName(salted.groupBy("plain").agg(*of_key("least", "copies"))), "texts")

    forked = texts.filter("fkey <> other").select("plain")  # letters that can be cut into fields in more than one way
    if not forked.isEmpty():
        ways = keys.filter("fkey is not null").select("plain", F.col("fkey").alias("b")).distinct()
        edges = ways.join(texts.filter("fkey <> other").select("plain", F.col("fkey").alias("a")), "plain").filter("a <> b")
        joined = components(edges).select(F.col("node").alias("fkey"), "root")
        texts = texts.join(joined, "fkey", "left").withColumn("fkey", F.coalesce("root", "fkey"))
    labelled = texts.filter("fkey is not null")
    classes = labelled.groupBy("fkey").agg(F.min("least").alias("keep_id"), F.sum("copies").alias("copies"))
    kept = labelled.select("plain", "fkey").join(classes, "fkey").select("plain", "keep_id", "copies").unionByName(texts.filter("fkey is null").select("plain", F.col("least").alias("keep_id"), "copies"))
    return salted_join(keys.select("id", "plain"), kept, ["plain"], F.col("id"), how="inner", salts=salts, hot=often).select("id", "keep_id", "copies").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keep_id LONG, id LONG: one row for each further copy of a text."""
    rows = load(spark, sf_dir, "paragraphs").select("id", "en")
    classes = collapse(rows, Lookalikes.fit(rows, "en", usual_first=True))
    return classes.filter("id <> keep_id").select("keep_id", "id").distinct()
