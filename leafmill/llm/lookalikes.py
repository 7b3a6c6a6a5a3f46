"""One consistent form for texts that look the same (problem 5).

Look-alikes are strings, not only characters: a ligature is two letters, an accented letter may be a letter and a
mark, an invisible character is nothing. Edges between strings come from the Unicode data by rule (full-width,
ligature, radical and compatibility forms; letter plus mark; special blanks; invisible characters) and from one short
table of letters of other alphabets. Union-find makes them transitive, over every code point of the corpus and the
letter-and-mark sequences that Unicode has one character for, over any look-alike of the letter. Each class is
represented by its most frequent member in the corpus, and texts are rewritten by a multi-pattern automaton, longest
match first, until nothing changes.

The corpus statistics cover all texts; what reaches the driver is one row a code point of the corpus and one for each of
the sequences and ligatures, which are a fixed list: the size of Unicode bounds both, not the corpus. A letter with
marks that no character has is rewritten part by part, after its marks are put in canonical order.

Defined results: a null text has a null form; an empty text is itself; texts without letter, digit or Chinese
character have a form but are left out of pairs; rows delivered more than once count once; rows with the same key are
never paired; a null key is left out of pairs; very long texts are rewritten whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.skew import salted_join
from leafmill.runtime import load, ship, stage

# Letters of other alphabets that look like Latin ones, by alphabet.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW аa еe ѕs іi јj оo рp сc уy хx ԛq ԝw һh ԁd"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv"
HYPHENS = "‐- ‑-"
FOREIGN = {pair[0]: pair[1] for table in (CYRILLIC, GREEK, HYPHENS) for pair in table.split()}


def _ranges(points: list[int]) -> str:
    """The inside of a character set."""
    out, first = [], None
    for p, after in zip(points, [*points[1:], -1]):
        first = p if first is None else first
        if after != p + 1:
            out.append(f"{re.escape(chr(first))}-{re.escape(chr(p))}")
            first = None
    return "".join(out)


@lru_cache(1)
def marks() -> str:
    """All characters that stand on the one before and have a place in its canonical order."""
    return "".join(chr(c) for c in range(0x300, 0x1E950) if unicodedata.combining(chr(c)))


@lru_cache(1)
def _unordered() -> tuple[re.Pattern, re.Pattern]:
    parts = "\u1100-\u11ff"
    some, low = _ranges([ord(c) for c in marks()]), _ranges([ord(c) for c in marks() if c < "\U00010000"])
    # one set of 16-bit characters is looked up in one step, ranges beyond are few texts' matter
    return re.compile(f"[{low}{parts}]|[\U00010000-\U0010ffff]"), re.compile(f"[{some}]{{2,}}|[{parts}]{{2,}}")


def ordered(text: str) -> str:
    """Runs of marks, and of the letters that make up a Korean syllable, in the order and form that Unicode says they are equal to."""
    if text.isascii():
        return text
    some, runs = _unordered()
    return runs.sub(lambda m: unicodedata.normalize("NFC", m.group()), text) if some.search(text) else text


@lru_cache(1)
def marked_classes() -> list[tuple[str, tuple[str, ...]]]:
    """(marks, strings that look the same): for each character that is a letter with marks, all ways to write it, and
    the same marks over the letters that look like its letter."""
    like: dict[str, list[str]] = {}
    for other, plain in FOREIGN.items():
        like.setdefault(plain, [plain]).append(other)
    found: dict[tuple[str, str], set[str]] = {}
    on = set(marks())
    for c in range(0xC0, 0x1D200):
        parts = unicodedata.normalize("NFD", chr(c)) if unicodedata.decomposition(chr(c))[:1] not in ("", "<") else ""
        if len(parts) < 2 or parts[0] in on or not on.issuperset(parts[1:]):
            continue
        base, tail = FOREIGN.get(parts[0], parts[0]), parts[1:]
        strings = found.setdefault((base, tail), set())
        for letter in like.get(base, [base]):
            for order in {"".join(p) for p in permutations(tail)}:
                if unicodedata.normalize("NFD", letter + order) != letter + tail:
                    continue
                for k in range(len(order) + 1):
                    head = unicodedata.normalize("NFC", letter + order[:k])
                    if len(head) == 1:
                        strings.add(head + order[k:])
    return [(tail, tuple(sorted(strings))) for (_, tail), strings in sorted(found.items())]


def invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch == "͏" or "︀" <= ch <= "️"


def looks_like(ch: str) -> str | None:
    """The string that one character looks like, by the rules of the Unicode data; None: only like itself."""
    if invisible(ch):
        return ""
    if unicodedata.category(ch) == "Zs" and ch != " ":
        return " "
    kind, _, form = unicodedata.decomposition(ch).rpartition(">")
    if not kind and not form:
        return None
    plain = unicodedata.normalize("NFKC", ch)
    if kind in ("<wide", "<narrow"):
        return plain if plain.isalnum() else None
    if kind == "<compat":
        return plain if unicodedata.category(ch)[0] in "LN" or "⺀" <= ch <= "⿟" else None
    if not kind:  # canonical: one other character, or a letter and its marks
        return unicodedata.normalize("NFC", ch) if len(form.split()) == 1 else unicodedata.normalize("NFD", ch)
    return None


def ligature_strings() -> list[str]:
    """The letter strings that some one character looks like."""
    found = {looks_like(chr(c)) for c in range(0x80, 0x10000) if unicodedata.decomposition(chr(c)).startswith("<compat>")}
    return sorted(s for s in found if s and len(s) > 1 and s.isalpha())


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        self.parent.setdefault(s, s)
        root = s
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[s] != root:
            self.parent[s], s = root, self.parent[s]
        return root

    def union(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for s in self.parent:
            out.setdefault(self.find(s), []).append(s)
        return out


def usual(s: str) -> bool:
    """Latin letters, composed, or characters of no alphabet: forms that letter case and other rules can work on."""
    return unicodedata.normalize("NFKC", s) == s and all(c.isascii() or not c.isalpha() or unicodedata.name(c, "").startswith(("LATIN", "CJK")) for c in s)


def build_rewrites(counts: dict[str, int], usual_first: bool = False) -> dict[str, str]:
    """String -> its representative, for every string that is not one. ``counts``: code points, and letter-and-mark
    sequences and ligature strings of the corpus. ``usual_first``: frequency decides only among Latin and plain members
    where there are any, which operators need that fold letter case afterwards."""
    classes = Classes()
    todo = [s for s in counts if len(s) == 1]
    seen: set[str] = set()
    while todo:
        s = todo.pop()
        if s in seen or not s:
            continue
        seen.add(s)
        for other in (looks_like(s), FOREIGN.get(s)) if len(s) == 1 else ():
            if other is not None and other != s:
                classes.union(s, other)
                todo.append(other)
    for tail, strings in marked_classes():  # those that can occur: one is there as a character, or all their marks are
        if all(m in counts for m in tail) or any(s in counts for s in strings if len(s) == 1):
            for other in strings[1:]:
                classes.union(strings[0], other)
    out: dict[str, str] = {}
    for group in classes.members().values():
        if len(group) < 2:
            continue
        if "" in group:
            best = ""
        else:  # most frequent; then what Unicode itself maps to; then code order
            best = min(group, key=lambda s: (usual_first and not usual(s), -counts.get(s, 0), s in FOREIGN or (len(s) == 1 and looks_like(s) is not None and len(looks_like(s)) == 1), len(s), s))
        out |= {s: best for s in group if s != best}
    return out


class Rewriter:
    """Greedy rewriting with an Aho-Corasick automaton."""

    def __init__(self, rewrites: dict[str, str]):
        import ahocorasick

        self.touched = re.compile("[" + "".join(re.escape(c) for c in sorted({s[-1] for s in rewrites})) + "]") if rewrites else None
        self.automaton = ahocorasick.Automaton()
        for s, best in rewrites.items():
            self.automaton.add_word(s, (len(s), best))
        if rewrites:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return text
        text = ordered(text)
        if self.touched is None or not self.touched.search(text):
            return text
        seen = {text}
        while True:  # removing an invisible character may bring a letter and its mark together
            out, at = [], 0
            for end, (size, best) in self.automaton.iter_long(text):
                out += (text[at : end + 1 - size], best)
                at = end + 1
            new = ordered("".join(out) + text[at:])
            if new == text:
                return text
            if new in seen:  # no rule leads back, but if one did the smallest would stand for all
                return min(seen)
            seen.add(new)
            text = new


@lru_cache(1)
def _marked():
    """(a mark that ends a sequence, automaton of the letter-and-mark sequences)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    strings = {s for _, group in marked_classes() for s in group if len(s) > 1}
    for s in strings:
        automaton.add_word(s, s)
    automaton.make_automaton()
    return re.compile("[" + _ranges(sorted({ord(s[-1]) for s in strings})) + "]"), automaton


def symbol_counts(texts: list[str], strings: list[str]) -> Counter[str]:
    """Counts of one batch: code points by one bincount over all of them; letter-and-mark sequences only where marks occur."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    by_point = np.bincount(points)
    at = np.flatnonzero(by_point)
    total = Counter({chr(p): int(n) for p, n in zip(at.tolist(), by_point[at].tolist())})
    small = points < 128
    both = np.flatnonzero(small[:-1] & small[1:])
    pairs = np.bincount(points[both] * 128 + points[both + 1], minlength=128 * 128)
    for s in strings:  # of a longer string at most its rarest pair
        if s.isascii():
            total[s] += int(min(pairs[ord(x) * 128 + ord(y)] for x, y in zip(s, s[1:])))
    mark, sequences = _marked()
    if mark.search("".join(c for c in total if not c.isascii())):
        for text in texts:
            if mark.search(text):
                total.update(s for _, s in sequences.iter_long(text))
    return total


def count_symbols(texts: DataFrame, column: str = "text") -> dict[str, int]:
    """Occurrences of each code point, each letter with marks on it that some character has, and each string that a
    ligature looks like."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        strings = ligature_strings()
        for batch in batches:
            values, lo, size = batch["text"].tolist(), 0, 0
            for hi, text in enumerate(values, 1):  # in portions of some million characters
                size += len(text)
                if size > 2_000_000 or hi == len(values):
                    total.update(symbol_counts(values[lo:hi], strings))
                    lo, size = hi, 0
        if total:
            yield pd.DataFrame({"s": list(total), "n": list(total.values())})

    rows = texts.select(F.col(column).alias("text")).filter("text is not null").mapInPandas(count, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return {r.s: r.n for r in rows.collect() if r.n}


class Lookalikes:
    """The fitted classes of a corpus and the column that rewrites texts to their one form."""

    def __init__(self, spark: SparkSession, rewrites: dict[str, str]):
        self.rewrites = rewrites
        ship(spark)

    @classmethod
    def fit(cls, texts: DataFrame, column: str = "text", usual_first: bool = False) -> Lookalikes:
        return cls(texts.sparkSession, build_rewrites(count_symbols(texts, column), usual_first))

    def form(self, text: Column) -> Column:
        """ASCII texts stay in the JVM unless the form of something ASCII isn't. Of the others Python sends back only
        those that change: its character sets take one step a character, where Java's take one for each member."""
        rewrites = self.rewrites

        @F.pandas_udf("string")
        def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = Rewriter(rewrites)
            for batch in batches:
                yield batch.map(lambda t: None if (new := own(t)) == t else new, na_action="ignore")

        if any(s.isascii() for s in rewrites):
            return F.coalesce(rewrite(text), text)
        return F.coalesce(rewrite(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


WORDLIKE = r"[\p{L}\p{N}]"


def _forms(rows: DataFrame, lookalikes: Lookalikes) -> DataFrame:
    """field, key, digests of the text (raw) and of its form, each once. Digests stand for texts, so no text is shuffled."""
    formed = rows.filter(F.col("text").isNotNull() & F.col("key").isNotNull() & F.col("text").rlike(WORDLIKE)).select("field", "key", "text", lookalikes.form(F.col("text")).alias("form"))
    return stage(formed.select("field", "key", F.unhex(F.md5("text")).alias("raw"), F.unhex(F.md5("form")).alias("form")).distinct(), "forms")


def _members(slim: DataFrame) -> DataFrame:
    """The rows whose form has more than one spelling; usually few. Two values a form say which those are."""
    several = slim.groupBy("field", "form").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).filter("a <> b").select("field", "form")
    return stage(slim.join(several, ["field", "form"], "left_semi"), "members")


def same_look_classes(rows: DataFrame, lookalikes: Lookalikes, hot: int = 100_000) -> DataFrame:
    """One row a row of ``rows`` (field, key, text): field, key, class_key (smallest key that looks the same),
    links (how many rows look the same and are spelt otherwise). Sums are combined before they are shuffled, hot forms
    take salts on the way back."""
    slim = _forms(rows, lookalikes)
    spelt = slim.groupBy("field", "form", "raw").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    whole = spelt.groupBy("field", "form").agg(F.min("least").alias("class_key"), F.sum("n").alias("all"))
    counted = salted_join(spelt, whole, ["field", "form"], F.col("raw"), hot, how="inner").select("field", "raw", "class_key", (F.col("all") - F.col("n")).alias("links"))
    return salted_join(slim.select("field", "raw", "key"), counted, ["field", "raw"], F.col("key"), hot, how="inner").select("field", "key", "class_key", "links")


def same_look_pairs(rows: DataFrame, lookalikes: Lookalikes, hot: int = 10_000) -> DataFrame:
    """Pairs of rows (field, key, text) of one field whose texts look the same and differ: field, key_a, key_b.

    First pairs of spellings of one form, then the rows of the rarer spelling, then those of the other: no step makes
    more rows than the result has. Hot forms and spellings are salted."""
    members = _members(_forms(rows, lookalikes))
    spelt = members.groupBy("field", "form", "raw").agg(F.count(F.lit(1)).alias("n"))
    left = spelt.select("field", "form", F.col("raw").alias("r1"), F.col("n").alias("n1"))
    right = spelt.select("field", "form", F.col("raw").alias("r2"), F.col("n").alias("n2"))
    pairs = salted_join(left, right, ["field", "form"], F.col("r1"), hot, how="inner").filter("r1 < r2")
    more = F.col("n1") >= F.col("n2")
    ordered = pairs.select("field", F.when(more, F.col("r2")).otherwise(F.col("r1")).alias("raw"), F.when(more, F.col("r1")).otherwise(F.col("r2")).alias("other"))
    rare = salted_join(members.select("field", "raw", F.col("key").alias("k1")), ordered, ["field", "raw"], F.col("k1"), hot, how="inner")
    found = salted_join(members.select("field", "raw", F.col("key").alias("k2")), rare.select("field", F.col("other").alias("raw"), "k1"), ["field", "raw"], F.col("k2"), hot, how="inner")
    return found.filter("k1 <> k2").select("field", F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field STRING, key_a LONG, key_b LONG."""
    en = load(spark, sf_dir, "paragraphs").select(F.lit("en").alias("field"), F.col("id").alias("key"), F.col("en").alias("text"))
    zh = load(spark, sf_dir, "translations").select(F.lit("zh").alias("field"), F.col("seq").alias("key"), F.col("zh").alias("text"))
    rows = en.unionByName(zh)
    return same_look_pairs(rows, Lookalikes.fit(rows))
