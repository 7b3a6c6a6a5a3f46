"""Proper nouns of a book: candidates by frequency, each with one place where it stands."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import WS, collapse
from leafmill.operators.skew import salted_join
from leafmill.runtime import ship

# What a candidate looks like, words that open sentences, how many candidates and how often.
EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"  # a word border in any alphabet
CANDIDATE = rf"(?<![\p{{L}}\p{{N}}_])([A-Z][a-zA-Z'.]+(?:{WS}+(?:of{WS}+|the{WS}+|de{WS}+)?[A-Z][a-zA-Z'.]+){{0,3}}){EDGE}"
STOPWORDS = ("The", "A", "An", "But", "And", "He", "She", "It", "They", "I", "In", "On", "At", "By", "For", "To", "Of", "His", "Her", "That", "This", "When", "What", "There", "Then", "If", "As", "So", "Now")
MOST, LEAST = 180, 3
AROUND = 60
BOOKS = 2000  # books whose phrases are broadcast


def candidates(paragraphs: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """book, phrase, n, first_par: the most frequent phrases of each book; of equal ones those met first.

    Counting combines on the map side, so a phrase sends one row a task however often it stands."""
    found = paragraphs.select("book", "id", F.posexplode(F.regexp_extract_all("en", F.lit(CANDIDATE), F.lit(1))).alias("pos", "phrase"))
    counted = found.filter(F.col("phrase").contains(" ") | ~F.col("phrase").isin(*STOPWORDS)).groupBy("book", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("n"), "first", "phrase"))
    return counted.withColumn("_rank", rank).filter((F.col("_rank") <= most) & (F.col("n") >= least)).select("book", "phrase", "n", F.col("first.id").alias("first_par"))


def contexts(paragraphs: DataFrame, found: DataFrame, width: int = AROUND) -> DataFrame:
    """book, phrase, ctx: the first place of each phrase with ``width`` characters on either side, '' if it has none.

    A book's phrases, 180 at most, come as one array beside each of its paragraphs; of the text only the snippet goes on,
    and the first place is a minimum, combined on the map side. A book that holds much of all rows is no hot key: the
    arrays are few and are broadcast or, if there are too many books for that, spread by salts."""
    listed = found.groupBy("book").agg(F.collect_list("phrase").alias("phrases"))
    texts = salted_join(paragraphs.select("book", "id", "en"), listed, ["book"], F.col("id"), how="inner") if listed.count() > BOOKS else paragraphs.select("book", "id", "en").join(F.broadcast(listed), "book")
    pairs = texts.select("book", "id", "en", F.explode(F.filter("phrases", lambda p: F.contains(F.col("en"), p))).alias("phrase"))
    lo = F.greatest(F.lit(0), F.expr("instr(en, phrase)") - 1 - width)
    hi = F.expr("instr(en, phrase)") - 1 + F.length("phrase") + width
    snippet = collapse(F.substring("en", lo + 1, hi - lo))
    ctx = F.concat(F.when(lo > 0, F.lit("…")).otherwise(F.lit("")), snippet, F.when(hi < F.length("en"), F.lit("…")).otherwise(F.lit("")))
    first = pairs.select("book", "phrase", "id", ctx.alias("ctx")).groupBy("book", "phrase").agg(F.min(F.struct("id", "ctx"))["ctx"].alias("ctx"))
    return found.select("book", "phrase").join(first, ["book", "phrase"], "left").select("book", "phrase", F.coalesce("ctx", F.lit("")).alias("ctx"))


def build(paragraphs: DataFrame, titles: DataFrame, backend, attempts: int = 3) -> DataFrame:
    """book, en, zh: the glossary of each book from a text model, nothing for a book of which no reply can be read.
    One call a book for at most 180 phrases; books are spread over tasks. titles: book, title."""
    from leafmill.operators.model import GLOSSARY_PROMPT, object_of

    ship(paragraphs.sparkSession)
    asked = contexts(paragraphs, candidates(paragraphs)).groupBy("book").agg(F.sort_array(F.collect_list(F.struct("phrase", "ctx"))).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, title, phrases in zip(batch["book"], batch["title"], batch["asked"]):
                payload = json.dumps({p["phrase"]: p["ctx"] for p in phrases}, ensure_ascii=False)
                said = GLOSSARY_PROMPT + (f' The book is "{title}".' if title else "")
                for _ in range(attempts):
                    try:
                        reply = object_of(backend.complete(said, payload))
                    except ValueError:
                        continue
                    rows += [(book, str(k), str(v)) for k, v in reply.items()]
                    break
            yield pd.DataFrame(rows, columns=["book", "en", "zh"])

    return asked.join(titles.select("book", "title"), "book", "left").select("book", "title", "asked").mapInPandas(run, "book string, en string, zh string")
