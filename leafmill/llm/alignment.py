"""Sentence alignment in bilingual documents (problem 3).

Anchors are what both languages must share: numbers, names (by a transliteration model
learned from the glossary, or left in Latin letters), and words and phrases of the glossary with all their renderings.
Glossaries err in names, so their renderings count where the model's stands nowhere. An anchor weighs less the more sentences of the other side hold
it. The strongest pairs of sentences are chained by the heaviest increasing subsequence; gaps between the links are
aligned by dynamic programming over 1-1, 1-2 and 2-1 groups; pairs off the chain that are the best of both their
sentences are kept, for sentences that changed places; and sentences still alone join a partner whose anchors they
hold, for merges and splits. A sentence without enough shared anchors stays alone.

Only pairs of sentences with ``LEAST`` weight in common are ever held, and both the chain and the gaps are solved over
them in a tree of prefix maxima: room and time follow the number of shared anchors, not the product of the lengths.
The glossary is joined to the texts by word, all of it; it is broadcast only as long as it is small.

Defined results: a null or empty text on either side gives no pairs; repeated tasks and rows delivered more than once
count once; of several English texts of one id the smallest is taken; very long texts are aligned whole; an empty
table gives no rows; glossary rows without a book are those of no text's own book. Sentence numbers are those of the
text as stored: look-alikes are folded before splitting, which changes no sentence border.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.lookalikes import Lookalikes, Rewriter
from leafmill.llm.transliteration import Transliterator
from leafmill.operators.skew import salted_join
from leafmill.runtime import load, ship, stage

# Titles that end no sentence.
TITLES = ("mr", "mrs", "dr")
#: Titles and how they are written after a name.
TITLE_WORDS = {"mr": ["先生"], "mrs": ["太太", "夫人"], "dr": ["医生", "博士", "大夫"]}

NAMES = 4000  # names from which the transliteration model is fitted, chosen by a hash
SMALL = 50_000  # words up to which the glossary is broadcast; beyond it is joined by a shuffle

EN_END = re.compile(r"(?:\.\.\.|…|[.!?])[”\"'’»]?(?=\s|$)")
ZH_END = re.compile(r"(?:[。！？]|……|…)[。！？…]*[”）]*")
TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[-’'](?=[^\W\d_]))*|\d+(?:[,.]\d{3})*(?!\d)|\d+")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")

PAIR, SIDE, LEAST, FRESH, OWN = 0.58, 0.34, 0.75, 0.75, 0.75
ALONE, APART = 0.45, 0.6  # shares that a pair in a gap, and two Chinese sentences of one English together, must exceed


def english_sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in EN_END.finditer(text):
        if m.group().startswith("."):
            word = re.search(r"(\w+)$", text[at : m.start()])
            if m.group() == "." and word and word.group().lower() in TITLES:
                continue
        if text[at : m.end()].strip():
            out.append(text[at : m.end()])
            at = m.end()
    if text[at:].strip():
        out.append(text[at:])
    return out


def chinese_sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in ZH_END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    if text[at:].strip():
        out.append(text[at:])
    return out


#: A glossary entry for one text: what it says in lower case, its renderings, and whether it is a common word.
Entry = tuple[str, Sequence[str], bool]


class PrefixMax:
    """Largest (value, what) put at places before one."""

    def __init__(self, size: int):
        self.tree: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)

    def put(self, at: int, value: float, what: int) -> None:
        at += 1
        while at < len(self.tree):
            if value > self.tree[at][0]:
                self.tree[at] = (value, what)
            at += at & -at

    def before(self, at: int) -> tuple[float, int]:
        best = (0.0, -1)
        while at:
            if self.tree[at][0] > best[0]:
                best = self.tree[at]
            at &= at - 1
        return best


def places(texts: list[str], forms: set[str], numbers: set[str]) -> dict[str, set[int]]:
    """The texts that hold each form, all found in one pass; a number must not be part of a longer one."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for f in forms | numbers:
        automaton.add_word(f, f)
    found: dict[str, set[int]] = {}
    if not len(automaton):
        return found
    automaton.make_automaton()
    whole, starts, at = "\n".join(texts), [], 0
    for t in texts:
        starts.append(at)
        at += len(t) + 1
    for end, f in automaton.iter(whole):
        if f in numbers:
            first = end + 1 - len(f)
            if (first and whole[first - 1].isdecimal()) or whole[end + 1 : end + 2].isdecimal():
                continue
        found.setdefault(f, set()).add(bisect_right(starts, end) - 1)
    return found


class Aligner:
    """``lexicon``: common words with their renderings, for all texts; more comes with each text."""

    def __init__(self, names: Transliterator, lexicon: dict[str, list[str]]):
        self.names, self.lexicon = names, lexicon

    def anchors(self, sentence: str, common: dict[str, Sequence[str]], named: dict[str, Sequence[str]], phrases: dict[str, list[tuple[list[str], str]]]) -> list[tuple[str, float, tuple[str, ...], bool]]:
        """(term, weight, the ways it may stand in Chinese, whether it is surely a term)."""
        out: dict[str, tuple[float, tuple[str, ...], bool]] = {}
        words, k = TOKEN.findall(sentence.lower()), 0
        while k < len(words):
            w, size = words[k], 1
            for parts, phrase in phrases.get(w, ()):
                if words[k : k + len(parts)] == parts:
                    w, size = phrase, len(parts)
                    break
            k += size
            if w in out:
                continue
            if w[0].isdigit():
                digits = w.replace(",", "")
                out[w] = (1.6 if len(digits) > 1 else 0.6, (digits,), True)
            elif w in common:
                out[w] = (0.8, tuple(common[w]), True)
            elif w in TITLE_WORDS:
                out[w] = (0.3, tuple(TITLE_WORDS[w]), True)
            elif len(w) >= 4 or w in named:
                zh, _ = self.names.write(w)
                if len(zh) >= 2:
                    out[w] = (1.0, (zh, w), False)
                elif w in named:
                    out[w] = (1.0, (w,), False)
        return [(w, weight, forms, sure) for w, (weight, forms, sure) in out.items()]

    def evidence(self, en: list[str], zh: list[str], entries: Sequence[Entry]) -> list[tuple[float, list[tuple[str, float, float, set[int]]]]]:
        """For each English sentence the weight that its anchors ask for, and the anchors: word, weight, weight for each
        Chinese sentence that holds it, and which those are."""
        common = self.lexicon | {low: forms for low, forms, plain in entries if plain}
        named = {low: forms for low, forms, plain in entries if not plain and low not in common}
        phrases: dict[str, list[tuple[list[str], str]]] = {}
        for low in (*common, *named):
            parts = TOKEN.findall(low)
            if len(parts) > 1:
                phrases.setdefault(parts[0], []).append((parts, low))
        for group in phrases.values():
            group.sort(key=lambda p: (-len(p[0]), p[1]))
        asked = [self.anchors(e, common, named, phrases) for e in en]
        plain = [z.lower().replace(",", "") for z in zh]
        terms = {w: (forms, sure) for row in asked for w, _, forms, sure in row}
        numbers = {forms[0] for w, (forms, _) in terms.items() if w[0].isdigit()}
        found = places(plain, {f for w, (forms, _) in terms.items() if not w[0].isdigit() for f in forms if f}, numbers)
        where = {w: set().union(*(found.get(f, ()) for f in forms)) for w, (forms, _) in terms.items()}
        # names that stand nowhere as the model writes them: as the glossary does, then with a syllable missed by either
        lost = {w: forms[:-1] for w, (forms, sure) in terms.items() if not sure and not where[w]}
        given = {w: {z for z in named.get(w, ()) if len(z) >= 2} for w in lost}
        pieces = {w: {z[k : k + part] for z in {*forms, *given[w]} for part in (max(3, math.ceil(0.5 * len(z))),) for k in range(len(z) - part + 1)} for w, forms in lost.items()}
        for ways in (given, pieces):
            if wanted := set().union(*(own for w, own in ways.items() if not where[w])):
                found = places(plain, wanted, set())
                where |= {w: set().union(*(found.get(f, ()) for f in own)) for w, own in ways.items() if not where[w]}
        out = []
        for row in asked:
            total, held = 0.0, []
            for word, weight, _, sure in row:
                at = where[word]
                own = weight / (len(at) ** 0.5 if at else 1.0)
                # a word that stands nowhere speaks against every pair, less so if it may be no name at all
                total += own if at else weight * (0.5 if sure else 0.35)
                held.append((word, weight, own, at))
            out.append((total, held))
        return out

    def align(self, en_text: str | None, zh_text: str | None, entries: Sequence[Entry] = ()) -> list[tuple[int, int]]:
        if not en_text or not zh_text:
            return []
        en, zh = english_sentences(en_text), chinese_sentences(zh_text)
        n, m = len(en), len(zh)
        if not n or not m:
            return []
        known = self.evidence(en, zh, entries)
        cells: list[dict[int, tuple[float, float]]] = []  # of each English sentence: Chinese one -> (mass, share), at least LEAST
        best_j, best_i = [-1] * n, [-1] * m
        top_i: list[tuple[float, int]] = [(0.0, 0)] * m
        for i, (total, held) in enumerate(known):
            strong: dict[int, tuple[float, float]] = {}
            if total > 0 and sum(own for _, _, own, at in held if at) >= LEAST:
                if sum(len(at) for *_, at in held) > 512:
                    mass = np.bincount(np.concatenate([np.fromiter(at, np.int64, len(at)) for *_, at in held]), np.repeat([own for _, _, own, _ in held], [len(at) for *_, at in held]), m)
                    at_least = np.flatnonzero(mass >= LEAST)
                    strong = {j: (x, x / total) for j, x in zip(at_least.tolist(), mass[at_least].tolist())}
                else:
                    sums: dict[int, float] = {}
                    for _, _, own, at in held:
                        for j in at:
                            sums[j] = sums.get(j, 0.0) + own
                    strong = {j: (x, x / total) for j, x in sorted(sums.items()) if x >= LEAST}
            cells.append(strong)
            top = (0.0, 0)
            for j, (x, _) in strong.items():
                near = (x, -abs(j * n - i * m))
                if near > top:
                    top, best_j[i] = near, j
                if near > top_i[j]:
                    top_i[j], best_i[j] = near, i
        good = lambda i, j: j in cells[i] and cells[i][j][1] >= PAIR
        links = [(i, j) for i, j in enumerate(best_j) if j >= 0 and best_i[j] == i and good(i, j)]
        of_en: dict[int, set[int]] = {}
        of_zh: dict[int, set[int]] = {}

        def add(i: int, j: int) -> None:
            of_en.setdefault(i, set()).add(j)
            of_zh.setdefault(j, set()).add(i)

        for i, j in links:  # those off the chain have changed places
            add(i, j)
        chain = self._chain(links, [cells[i][j][0] for i, j in links], m)
        border = [(-1, -1), *chain, (n, m)]
        free_i, free_j = [i for i in range(n) if i not in of_en], [j for j in range(m) if j not in of_zh]
        cut_i, cut_j = [bisect_right(free_i, i) for i, _ in border], [bisect_right(free_j, j) for _, j in border]
        for k in range(len(border) - 1):
            for i, j in self._gap(cells, free_i[cut_i[k] : cut_i[k + 1]], free_j[cut_j[k] : cut_j[k + 1]]):
                add(i, j)
        # merges: an English sentence whose anchors lie in a Chinese one that has a partner already, some beyond the partner's
        for i in range(n):
            j = best_j[i]
            if i not in of_en and j >= 0 and good(i, j):
                taken = {word for k in of_zh.get(j, ()) for word, _, _, at in known[k][1]}
                if sum(w for word, w, _, at in known[i][1] if j in at and word not in taken) >= OWN:
                    add(i, j)
        # splits: a Chinese sentence beside the partner of an English one, with anchors of it that the partner lacks
        for _ in range(2):
            for j in range(m):
                if j in of_zh:
                    continue
                gains = []
                for i in of_zh.get(j - 1, set()) | of_zh.get(j + 1, set()):
                    partners = of_en[i]
                    new = sum(w for _, w, _, at in known[i][1] if j in at and not at & partners)
                    gains.append((new, sum(own for _, _, own, at in known[i][1] if j in at), i))
                if gains and max(gains)[0] >= FRESH:
                    add(max(gains)[2], j)
        for j in range(m):
            i = best_i[j]
            if j not in of_zh and i >= 0 and i not in of_en and cells[i][j][1] >= SIDE:
                add(i, j)
        return sorted((i, j) for i, js in of_en.items() for j in js)

    @staticmethod
    def _chain(links: list[tuple[int, int]], weights: list[float], m: int) -> list[tuple[int, int]]:
        """Heaviest subsequence that increases on both sides (with equal weights the longest)."""
        tree, back, at, top = PrefixMax(m), [], -1, 0.0
        for k, (_, j) in enumerate(links):
            value, before = tree.before(j)
            value += weights[k]
            back.append(before)
            tree.put(j, value, k)
            if value > top:
                at, top = k, value
        out = []
        while at >= 0:
            out.append(links[at])
            at = back[at]
        return out[::-1]

    @staticmethod
    def _gap(cells: list[dict[int, tuple[float, float]]], rows: list[int], cols: list[int]) -> list[tuple[int, int]]:
        """Local dynamic programming over what lies between two links; leaving a sentence alone costs nothing, so only
        groups that gain something are ever steps: (first and last row, first and last column, gain)."""
        if not rows or not cols:
            return []
        place = {j: b for b, j in enumerate(cols)}
        held = [{place[j]: share for j, (_, share) in cells[i].items() if j in place} for i in rows]
        groups: list[list[tuple[int, int, int, float]]] = [[] for _ in rows]
        for a, row in enumerate(held):
            for b, share in row.items():
                if share > ALONE:
                    groups[a].append((a, b, b, share - ALONE))
                    if a + 1 < len(held) and held[a + 1].get(b, 0.0) > ALONE:
                        groups[a].append((a + 1, b, b, share + held[a + 1][b] - 2 * ALONE))
                if b + 1 in row and share + row[b + 1] > APART:
                    groups[a].append((a, b, b + 1, share + row[b + 1] - APART))
        tree, steps = PrefixMax(len(cols)), []
        waiting: dict[int, list[int]] = {}
        at, top = -1, 0.0
        for a in range(len(rows)):
            for last, b, c, gain in groups[a]:
                value, before = tree.before(b)
                steps.append((a, last, b, c, value + gain, before))
                waiting.setdefault(last, []).append(len(steps) - 1)
            for k in waiting.pop(a, ()):
                tree.put(steps[k][3], steps[k][4], k)
                if steps[k][4] > top:
                    at, top = k, steps[k][4]
        out = []
        while at >= 0:
            a, last, b, c, _, before = steps[at]
            out += [(rows[x], cols[y]) for x in range(a, last + 1) for y in range(b, c + 1)]
            at = before
        return out


def glossary_forms(glossary: DataFrame) -> DataFrame:
    """low (lower case), book, zh, n (rows), common (stands in lower case somewhere, so it is no name)."""
    rows = glossary.filter("en is not null and zh is not null").select(F.trim("en").alias("en"), F.trim("zh").alias("zh"), F.lower(F.trim("en")).alias("low"), "book").filter("en <> '' and zh <> ''")
    return rows.groupBy("low", "book", "zh").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("en").rlike(r"^\p{Ll}").cast("int")).alias("common"))


def fit_names(glossary: DataFrame) -> Transliterator:
    """The model of how names are written, from a bounded sample of the glossary's names."""
    forms = glossary_forms(glossary).groupBy("low", "zh").agg(F.sum("n").alias("n"), F.max("common").alias("common"))
    top = forms.groupBy("low").agg(F.max("common").alias("common"), F.max("n").alias("top")).filter("common = 0").orderBy(F.xxhash64("low")).limit(NAMES)
    rows = forms.join(F.broadcast(top.select("low", "top")), "low").filter("n = top").select("low", "zh").limit(4 * NAMES).collect()
    return Transliterator.fit([(r.low, r.zh) for r in rows])


TEXT_WORDS = r"\p{L}+(?:[-’']\p{L}+)*"


def with_entries(tasks: DataFrame, glossary: DataFrame, text: str = "text", small: int = SMALL) -> DataFrame:
    """tasks (par_id, seq, book, ``text``) and the glossary entries whose first word the text has. Common words have the
    renderings of all books, since a rough translation doesn't keep to its book's; names have those of their own book
    where it has the name, else those of all. Out: par_id, seq, entries. A shuffle by word, hot words salted, unless
    the glossary is small enough to be broadcast."""
    forms = stage(glossary_forms(glossary).withColumn("word", F.regexp_extract("low", TEXT_WORDS, 0)).filter("word <> ''"), "glossary")
    shared = stage(forms.groupBy("word", "low").agg(F.max("common").alias("common"), F.collect_set("zh").alias("all")), "shared")
    own = forms.filter("book is not null").groupBy("book", "low").agg(F.collect_set("zh").alias("own"))
    words = tasks.select("par_id", "seq", "book", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TEXT_WORDS), F.lit(0)))).alias("word"))
    if shared.count() <= small and forms.count() <= 4 * small:
        met = words.join(F.broadcast(shared), "word").join(F.broadcast(own), ["book", "low"], "left")
    else:
        met = stage(salted_join(words, shared, ["word"], F.col("par_id"), how="inner"), "met")
        met = salted_join(met, own, ["book", "low"], F.col("par_id"))
    entry = F.struct(F.col("low"), F.array_sort(F.when(F.col("common") == 1, F.col("all")).otherwise(F.coalesce("own", "all"))).alias("forms"), (F.col("common") == 1).alias("plain"))
    return met.groupBy("par_id", "seq").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def pairs_of(tasks: DataFrame, aligner: Aligner, rewrites: dict[str, str]) -> DataFrame:
    """tasks: par_id, en, zh and, if there are any, entries. Out: par_id, en_no, zh_no."""
    ship(tasks.sparkSession)
    shared = tasks.sparkSession.sparkContext.broadcast((aligner, rewrites))
    if "entries" not in tasks.columns:
        tasks = tasks.withColumn("entries", F.lit(None).cast("array<struct<low:string,forms:array<string>,plain:boolean>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, table = shared.value
        form = Rewriter(table)
        for batch in batches:
            rows = []
            for p, en, zh, entries in zip(batch["par_id"].tolist(), batch["en"].tolist(), batch["zh"].tolist(), batch["entries"].tolist()):
                given = [] if entries is None else [(form(e["low"]), [form(z) for z in e["forms"]], e["plain"]) for e in entries]
                rows += [(p, i, j) for i, j in own.align(form(en), form(zh), given)]
            yield pd.DataFrame(rows, columns=["par_id", "en_no", "zh_no"])

    return tasks.select("par_id", "en", "zh", "entries").mapInPandas(run, "par_id long, en_no int, zh_no int")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """par_id LONG, en_no INT, zh_no INT."""
    paragraphs, translations, glossary = load(spark, sf_dir, "paragraphs"), load(spark, sf_dir, "translations"), load(spark, sf_dir, "glossary")
    tasks = load(spark, sf_dir, "review_tasks").select("par_id", "seq").filter("par_id is not null and seq is not null").distinct()
    texts = paragraphs.select(F.col("en").alias("text")).unionByName(translations.select(F.col("zh").alias("text")))
    lookalikes = Lookalikes.fit(texts, usual_first=True)
    en = paragraphs.filter("en is not null").select(F.col("id").alias("par_id"), "en", "book").join(tasks.select("par_id").distinct(), "par_id", "left_semi").groupBy("par_id").agg(F.min(F.struct("en", "book")).alias("first")).select("par_id", "first.en", "first.book")
    zh = translations.select("seq", "zh").join(tasks.select("seq").distinct(), "seq", "left_semi").groupBy("seq").agg(F.min("zh").alias("zh"))
    work = stage(tasks.join(en, "par_id").join(zh, "seq").filter("en is not null and zh is not null").select("par_id", "seq", "book", "en", "zh"), "tasks")
    entries = with_entries(work.select("par_id", "seq", "book", lookalikes.form(F.col("en")).alias("text")), glossary)
    return pairs_of(work.join(entries, ["par_id", "seq"], "left"), Aligner(fit_names(glossary), {}), lookalikes.rewrites).distinct()
