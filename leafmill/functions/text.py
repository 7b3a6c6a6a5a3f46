"""Scalar text functions as Column expressions. Character classes are spelled out, so that Java, Python and RE2 agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split and str.strip know it.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]

# Phrases of a text model that talks about its task instead of doing it; case-sensitive.
META = r"作为(一个)?(AI|人工智能|语言模型)|以下是.*翻译|译文如下|抱歉.{0,5}(无法|不能|不会|没.{0,2}办法)|I (cannot|can't|'m sorry)|```"
# Fixed value: replies that mean the service asks to slow down.
RATE_LIMIT = r"(?i)rate.?limit|overloaded|429|usage limit"


#: The same characters one by one, for functions that take a set and need no regular expression.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WS_CHARS))


def blanked(text: Column) -> Column:
    """Every white space character as a blank: what follows can look for one character instead of a class."""
    return F.translate(text, WS_CHARS, " " * len(WS_CHARS))


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(blanked(text), " {2,}", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(blanked(text), " +"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(blanked(text), F.lit("[^ ]+")), F.lit(0))


def content_hash(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes."""
    return F.sha1(text.cast("binary"))


def shred_fraction(text: Column) -> Column:
    """Share of tokens that are one letter, those apart that are words (a, I)."""
    toks = tokens(text)
    lone = F.size(F.filter(toks, lambda t: (F.length(t) == 1) & t.rlike(r"\p{L}") & ~t.isin("a", "A", "I", "i")))
    return F.when(F.size(toks) > 0, lone / F.size(toks)).otherwise(F.lit(0.0))


def despace_numbers(text: Column) -> Column:
    """Digits that a loose typesetting took apart come together: between digits, before and behind a thousands comma."""
    out = F.regexp_replace(text, r"(?<=\p{Nd}) +(?=\p{Nd})", "")
    out = F.regexp_replace(out, r"(?<=\p{Nd}) +(?=,\p{Nd})", "")
    return F.regexp_replace(out, r"(?<=\p{Nd},) +(?=\p{Nd})", "")


def resplit_glued(text: Column) -> Column:
    """``of`` and ``off`` glued to a following capital are parted again."""
    return F.regexp_replace(text, r"(?U)\b(of|off)(?=[A-Z])", "$1 ")


def drop_soft_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, r"\x{ad} ?", "")


def slug(path: Column, unique: bool = False) -> Column:
    """Name of a run from a path: ASCII letters and digits of the base name, at most 60 characters.

    ``unique`` adds a part of the hash to names that have no ASCII letter at all, which else all become ``book``."""
    base = F.regexp_replace(path, r"^.*/", "")
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    name = F.substring(F.lower(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")), 1, 60)
    fallback = F.concat(F.lit("book-"), F.substring(content_hash(path), 1, 8)) if unique else F.lit("book")
    return F.when(name == "", fallback).otherwise(name)


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))


def latin_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def is_meta(text: Column) -> Column:
    return text.rlike(META)


def usable(zh: Column) -> Column:
    """A translation that can be shown: not blank and no talk about the task."""
    return F.coalesce((F.length(strip(zh)) > 0) & ~is_meta(zh), F.lit(False))


def is_rate_limited(message: Column) -> Column:
    return F.coalesce(message.rlike(RATE_LIMIT), F.lit(False))


def html_escape(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def is_upper(text: Column) -> Column:
    """A cased letter and no lower-case one."""
    return text.rlike(r"[\p{Lu}\p{Lt}]") & ~text.rlike(r"\p{Ll}")


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Nd}"))


def status_line(slug_: Column, total: Column, done: Column, paragraphs: Column, translations: Column, failed: Column, active: Column) -> Column:
    """One line of the dashboard."""
    mark = F.when(active, F.lit("→")).otherwise(F.lit(" "))
    progress = F.when((total > 0) & (done == total), F.lit("done")).otherwise(F.concat_ws("/", done.cast("string"), total.cast("string")))
    tail = F.when(failed > 0, F.concat(F.lit("  qa-failed "), failed.cast("string"))).otherwise(F.lit(""))
    return F.concat(mark, F.lit(" "), F.rpad(slug_, 48, " "), F.lit(" units "), F.lpad(progress, 11, " "), F.lit("  paragraphs "), F.lpad(paragraphs.cast("string"), 8, " "), F.lit("  translations "), F.lpad(translations.cast("string"), 8, " "), tail)
