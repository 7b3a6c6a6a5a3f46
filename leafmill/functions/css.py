"""Style sheets: which classes a book sets larger than body text, and the style that goes into each page."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The size of body text in each unit.
BODY_SIZE = {"em": 1.0, "rem": 1.0, "%": 100.0, "px": 16.0, "pt": 12.0}
ZH_STYLE = "color: #777; font-size: 0.92em;"
FALLBACK_FONTS = '"PingFang SC", "Noto Sans CJK SC", "Source Han Sans SC", "Microsoft YaHei", sans-serif'

BLOCK = r"([^{}]+\{[^{}]*\})"
SIZE = r"(?i)font-size\s*:\s*([0-9]*\.?[0-9]+)\s*(em|rem|%|px|pt)"
CLASS = r"\.(-?[A-Za-z_][\p{L}\p{N}_-]*)"


def larger_than_body(value: Column, unit: Column) -> Column:
    out = F.lit(False)
    for name, size in BODY_SIZE.items():
        out = out | ((F.lower(unit) == name) & (value.cast("double") > F.lit(size)))
    return out


def large_classes(sheets: DataFrame, text: str = "css") -> DataFrame:
    """Distinct ``class`` of every selector whose first font size is above body size. Other columns stay as keys."""
    keys = [c for c in sheets.columns if c != text]
    block = sheets.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(BLOCK), F.lit(1))).alias("block"))
    parts = block.select(*keys, F.split("block", r"\{").getItem(0).alias("selector"), F.split("block", r"\{").getItem(1).alias("rules"))
    sized = parts.withColumn("value", F.regexp_extract("rules", SIZE, 1)).withColumn("unit", F.regexp_extract("rules", SIZE, 2))
    big = sized.filter((F.col("value") != "") & larger_than_body(F.col("value"), F.col("unit")))
    return big.select(*keys, F.explode(F.regexp_extract_all("selector", F.lit(CLASS), F.lit(1))).alias("class")).distinct()


def reading_style(large: Iterable[str] = (), base_font: str = "Noto Sans SC", normalize: bool = True, zh_style: str = ZH_STYLE) -> str:
    """Style of a page: a font for all of it, one size for body text (enlarged classes keep theirs), the translation's look."""
    rules = []
    if base_font.strip():
        rules.append('body { font-family: "%s", %s; }' % (base_font.strip(), FALLBACK_FONTS))
    if normalize:
        spared = "".join(f":not(.{c})" for c in sorted(set(large)))
        rules.append("body { font-size: 1em !important; }")
        rules.append(", ".join(f"{tag}:not(.zh){spared}" for tag in ("p", "li", "blockquote")) + " { font-size: 1em !important; }")
    return "\n".join([*rules, ".zh { %s }" % zh_style])
