"""Predicates on lines, headings and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import collapse, digit_count, is_upper, strip, tokens, word_count

# Patterns that decide what a line or a heading is.
PAGE_LINE = r"^(\p{Nd}{1,4}|[ivxlcdmIVXLCDM]{1,8})$"
ROMAN = r"(?i)^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
PAGE_TOKEN = r"(?:\p{Nd}+|(?i:(?=[ivxlcdm])m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})))"
CHAPTER_LINE = r"(?i)^(chapter|part|book|section)[ \t\r\n\f\x{a0}]+[\p{L}\p{N}_]"
TERMINAL = r"[.!?][\"'’”)\]]*$"
HEADING_NUMBER = r"(?i)^(chapter|part|book)[ \t\r\n\f\x{a0}]+([0-9]+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)($|[^\p{L}\p{N}_])"
NUMBERED = r"^[ \t\r\n\f\xa0]*[0-9]+[ \t\r\n\f\xa0]*[.)]"
MATTER_TITLE = r"(?i)^\s*(index|copyright|acknowledge?ments?|bibliography|references|recommended\s+(reading|bibliography)|(table\s+of\s+)?contents|about\s+the\s+author|also\s+by|by\s+the\s+same\s+author|colophon|credits|permissions|praise\s+for|title\s+page)($|[^\p{L}\p{N}_])"
MATTER_BODY = r"(?i)all\s+rights\s+reserved|library\s+of\s+congress|(^|[^\p{L}\p{N}_])ISBN($|[^\p{L}\p{N}_])|no\s+part\s+of\s+this\s+(book|publication)|printed\s+(and\s+bound\s+)?in($|[^\p{L}\p{N}_])|penguin\s+(books|group)|catalogue\s+record\s+for\s+this\s+book"
DEDICATION = r"(?i)^(for|to|in (memory|honor) of|and (for|to))($|[^\p{L}\p{N}_])"
#: What a title begins and ends with inside its quotation marks; the same for columns and for single documents.
TITLE_SHAPE = r"(?s)^['\"“”‘’]*(?![\p{Ll}'\"“”‘’]).*[^.!?…,;:'\"“”‘’]['\"“”‘’]*$"
TITLE_LENGTH, TITLE_WORDS = 60, 12
SKIP_TOKENS = ("cover", "title-page", "titlepage", "toc", "nav", "contents", "copyright", "colophon", "bibliograph", "acknowledg")
OPENERS = "—–-“”\"'‘’"


def is_page_number(token: Column) -> Column:
    """Digits only, or a canonical roman numeral; the whole token."""
    return token.rlike(r"^\p{Nd}+$") | (token.rlike(ROMAN) & (F.length(token) > 0))


def head_key(line: Column) -> Column:
    """A line without page numbers at either end, in lower case: the same for a running head on every page."""
    head = F.regexp_replace(collapse(line), f"^(?:{PAGE_TOKEN}(?: |$))+", "")
    return F.lower(F.regexp_replace(head, f"(?:(?:^| ){PAGE_TOKEN})+$", ""))


def is_page_line(line: Column) -> Column:
    """A line that is a page number and nothing else; roman letters needn't be a canonical numeral here."""
    return strip(line).rlike(PAGE_LINE)


def is_heading(paragraph: Column) -> Column:
    """A numbered chapter heading, or a short title in capitals of two real words at least."""
    p = strip(paragraph)
    words = F.filter(F.regexp_extract_all(p, F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: F.length(w) >= 2)
    capitals = is_upper(p) & (F.size(words) >= 2) & ~F.array_join(words, "").rlike("^[IVXLCDM]+$")
    shape = F.length(p).between(4, 60) & (word_count(p) <= 9) & ~F.substring(p, 1, 1).isin(*OPENERS) & ~p.endswith(":")
    return F.coalesce(shape & (p.rlike(HEADING_NUMBER) | capitals), F.lit(False))


def looks_like_title(text: Column) -> Column:
    """Short, not opening in lower case, and without the end of a sentence."""
    return F.coalesce((F.length(text) <= TITLE_LENGTH) & (word_count(text) <= TITLE_WORDS) & text.rlike(TITLE_SHAPE), F.lit(False))


def path_skipped(path: Column, skip: tuple[str, ...] = SKIP_TOKENS) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for token in skip:
        out = out | low.contains(token)
    return out


def translatable(css_class: Column, visible: Column) -> Column:
    """Text that is to be translated: not an illustration, not a translation already, and with a letter in it."""
    cls = F.coalesce(css_class, F.lit(""))
    return ~cls.contains("illus") & ~F.array_contains(tokens(cls), "zh") & F.coalesce(visible, F.lit("")).rlike(r"\p{L}")


def digit_density(text: Column) -> Column:
    return digit_count(text) / F.greatest(F.lit(1), F.length(text))


def edition_label(single: Column) -> Column:
    return F.when(single, F.lit("ZH")).otherwise(F.lit("Bilingual EN-ZH"))

