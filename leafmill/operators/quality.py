"""Checks of a translation against its source by rule, and what a judge's verdict means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import han_count, is_meta, latin_count, strip, word_count


def rule_flags(en: Column, zh: Column, strict: bool = False) -> Column:
    """Flags of one pair, in a fixed order; ``empty`` stands alone. ``strict`` also flags a text without any Chinese
    character, which the rules otherwise let pass where the source is short."""
    han, latin, words = han_count(zh), latin_count(zh), word_count(en)
    ratio = han / words
    # rounded as exact binary fractions are: a tie can't be hit by a short decimal, so half-even on the decimal text
    shown = F.format_string("%.2f", F.bround(ratio, 2))
    numbers = F.array_distinct(F.regexp_extract_all(en, F.lit(r"(\p{Nd}+)"), F.lit(1)))
    missing = F.array_sort(F.filter(numbers, lambda n: (F.length(n) >= 2) & ~zh.contains(n)))
    flags = F.array(
        F.when(strip(zh) == strip(en), "identical"),
        F.when((han > 0) & (latin > F.lit(0.6) * han), "too_much_latin"),
        F.when((words >= 12) & (ratio < 0.8), F.concat(F.lit("too_short("), shown, F.lit(")"))).when((words >= 12) & (ratio > 2.8), F.concat(F.lit("too_long("), shown, F.lit(")"))),
        F.when(F.size(missing) > 0, F.concat(F.lit("num_missing:"), F.array_join(F.slice(missing, 1, 4), ","))),
        F.when(is_meta(zh), "meta_leak"),
        *([F.when(han == 0, "no_chinese")] if strict else []),
    )
    return F.when(strip(zh) == "", F.array(F.lit("empty"))).otherwise(F.array_compact(flags))


def checked(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``flags``, ``qa_state`` and ``qa_reason`` to rows with ``en`` and ``zh``."""
    flagged = pairs.withColumn("flags", rule_flags(F.col("en"), F.col("zh"), strict))
    some = F.size("flags") > 0
    return flagged.withColumn("qa_state", F.when(some, "l1flag").otherwise("l1ok")).withColumn("qa_reason", F.when(some, F.substring(F.array_join("flags", ";"), 1, 300)))


def is_bad(faithful: Column, missing: Column, hallucinated: Column) -> Column:
    """A verdict that fails a pair: low faithfulness, or middling with something missing or made up. No score counts as 5."""
    score = F.coalesce(faithful, F.lit(5))
    return (score <= 2) | ((F.coalesce(missing, F.lit(False)) | F.coalesce(hallucinated, F.lit(False))) & (score <= 3))


def report(translations: DataFrame, paragraphs: DataFrame, book: str, title: str, most: int = 300) -> str:
    """A page of Markdown: counts by state, then at most ``most`` failed rows with the opening of both texts."""
    own = translations.filter(F.col("book") == book)
    counts = own.groupBy("qa_state").count().orderBy("qa_state").collect()
    from leafmill.operators.state import english_of

    failed = english_of(own.filter("qa_state = 'failed'"), paragraphs).select(F.substring("sha", 1, 8).alias("sha"), "qa_reason", F.substring("en", 1, 160).alias("en"), F.substring("zh", 1, 160).alias("zh"))
    n = sum(r["count"] for r in counts if r.qa_state == "failed")
    out = [f"# QA: {title}", "", f"Texts: {sum(r['count'] for r in counts)}", "", "## States", "", *[f"- {r.qa_state}: {r['count']}" for r in counts], "", f"## To be read by a person: {n}", ""]
    for r in failed.orderBy("sha").limit(most).collect():
        out += [f"- `{r.sha}` {r.qa_reason}", f"  - EN: {r.en}", f"  - ZH: {r.zh}"]
    return "\n".join(out) + "\n"
