"""Reading level of each document (problem 8).

A Rasch-style latent difficulty model. Document d stands at level t(d), word w at a difficulty given by its base rate
a(w) and slope b(w): its occurrences in n(d) words have the rate n(d) exp(a(w) + b(w) t(d)), so that hard words come
with high levels and easy ones with low. (With one slope for all words, as in Rasch's own model, the level cancels out
of the shares that words have of a text.) Levels and difficulties are estimated in turn: given the words, the level of
every document is the best point of a grid (a pass over the documents); given the levels, the words' parameters follow by
Newton steps from two sums that the pass has gathered over all documents. The turns end when levels have settled: when
the share of words whose document is at another level than before, as far as the distribution shows, is below
``SETTLED``, or after ``TURNS``. The scale starts from graded documents, and after each turn it is fixed on them again.
Cuts between the grades are the points with the fewest grades on the wrong side; between points about as good (raters
err) the one where documents of any kind are rarest.

All words of all documents count. Words are told apart by ``SLOTS`` numbers, which bounds the model, not what it is made
of: beyond some 100,000 different words the rarest share a slot with others, and none is left out. Only the graded
sample is bounded: at most ``GRADED`` graded documents, chosen by a hash, are used to fix scale and cuts.

Defined results: null texts, texts of fewer than ``MIN_WORDS`` words and texts that are not English by their function
words have no row; repeated rows of a document give one row; null grades and grades of unknown documents are ignored,
a repeated grade counts once a rater; with no usable grades the levels are cut at the quartiles; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.lookalikes import Lookalikes
from leafmill.llm.words import WordReader, portions
from leafmill.runtime import load, ship, stage, tune_arrow

# English function words, by which English text is known.
FUNCTION_WORDS = "the of and was in it that to with for as a which on at by this under before after near not one had its is are be from his her their they you i we he she there"
ENGLISH = 0.15
MIN_WORDS = 40
SLOTS = 1 << 18
GRADED = 20_000
TURNS, SETTLED = 12, 0.02
GRADES = 4
SLACK = 0.0075  # share of the graded documents by which a cut may be worse than the best and still count as good
GRID = np.linspace(-3.5, 3.5, 141)
RIDGE, PRIOR = 1.0, 1.0
NOTHING = -1e3
START = 0.3  # slope of a word that is longer than others by one deviation, where there are no grades

VECTOR = "doc_id long, n int, words array<int>, counts array<int>"


def english_vectors(docs: DataFrame, rewrites: dict[str, str]) -> DataFrame:
    """doc_id, number of words, different words (as slots) and their counts, of English documents."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = WordReader(rewrites)
        function = np.sort(own.words([FUNCTION_WORDS]).number)
        for batch in batches:
            for lo, hi in portions(batch["text"].tolist()):
                part = batch.iloc[lo:hi]
                w = own.words(part["text"].tolist())
                n = np.bincount(w.text, minlength=len(part))
                at = np.minimum(np.searchsorted(function, w.number), len(function) - 1)
                share = np.bincount(w.text, function[at] == w.number, len(part)) / np.maximum(n, 1)
                good = (n >= MIN_WORDS) & (share >= ENGLISH)
                keep = good[w.text]
                number, text = (w.number[keep] % np.uint64(SLOTS)).astype(np.int32), w.text[keep]
                order = np.lexsort((number, text))
                number, text = number[order], text[order]
                first = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (text[1:] != text[:-1])])) if len(number) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(number)))
                edge = np.searchsorted(text[first], np.arange(len(part) + 1))
                rows = np.flatnonzero(good)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy()[rows], "n": n[rows],
                    "words": [number[first[edge[i] : edge[i + 1]]] for i in rows],
                    "counts": [count[edge[i] : edge[i + 1]].astype(np.int32) for i in rows],
                })

    return docs.mapInPandas(read, VECTOR)


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, count) of a batch of vectors."""
    size = batch["words"].map(len).to_numpy()
    if not size.sum():
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.repeat(np.arange(len(batch)), size), np.concatenate(batch["words"].to_list()), np.concatenate(batch["counts"].to_list())


def lengths(docs: DataFrame, rewrites: dict[str, str]) -> np.ndarray:
    """Mean number of letters of the words in each slot."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = WordReader(rewrites)
        letters, n = np.zeros(SLOTS), np.zeros(SLOTS)
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in portions(texts):
                w = own.words(texts[lo:hi], lengths=True)
                slot = (w.number % np.uint64(SLOTS)).astype(np.int64)
                letters += np.bincount(slot, w.length, SLOTS)
                n += np.bincount(slot, minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"k": at, "x": letters[at], "n": n[at]})

    rows = docs.select("text").mapInPandas(measure, "k long, x double, n double").groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS)
    out[rows["k"]] = rows["x"] / rows["n"]
    return out


class Difficulty:
    """Parameters of the words and what follows from them. Slots that no word has stay at a rate of nothing."""

    def __init__(self, base: np.ndarray, slope: np.ndarray):
        self.base, self.slope = base, slope
        self._expected: np.ndarray | None = None

    def expected(self) -> np.ndarray:
        """Logarithm of the rates of all words together, at each level of the grid."""
        if self._expected is None:
            used = np.flatnonzero(self.base > NOTHING)
            parts = (used[i : i + 4096, None] for i in range(0, len(used), 4096))
            self._expected = np.log(sum((np.exp(self.base[w] + self.slope[w] * GRID).sum(0) for w in parts), np.full(len(GRID), 1e-300)))
        return self._expected

    def levels(self, batch: pd.DataFrame) -> np.ndarray:
        """Index on the grid of each document's level."""
        doc, word, count = _flat(batch)
        known = self.base[word] > NOTHING
        n = np.bincount(doc, count * known, len(batch))
        pull = np.bincount(doc, count * self.slope[word], len(batch))
        score = pull[:, None] * GRID - n[:, None] * self.expected() - PRIOR * GRID**2 / 2
        return score.argmax(1)

    def turn(self, seen: np.ndarray, leaning: np.ndarray, mass: np.ndarray, at: np.ndarray) -> None:
        """Newton steps for the words: ``seen`` and ``leaning`` are sums of counts and of counts times level, ``mass``
        the number of words of documents at each of the levels ``at``. Words not met before start at their share."""
        self._expected = None
        new = (seen > 0) & (self.base <= NOTHING)
        self.base[new] = np.log(seen[new] / mass.sum())
        used = np.flatnonzero(seen > 0)
        there = mass > 0
        mass, at = mass[there], at[there]
        for i in range(0, len(used), 4096):
            part = used[i : i + 4096]
            base, slope = self.base[part], self.slope[part]
            for _ in range(8):
                rate = np.exp(np.clip(base[:, None] + slope[:, None] * at, -30, 5)) * mass
                s0, s1, s2 = rate.sum(1), rate @ at, rate @ at**2
                da, db = seen[part] - s0, leaning[part] - s1 - RIDGE * slope
                haa, hbb = s0 + 1e-3, s2 + RIDGE
                det = haa * hbb - s1**2
                base = base + np.clip((hbb * da - s1 * db) / det, -1, 1)
                slope = slope + np.clip((haa * db - s1 * da) / det, -1, 1)
            self.base[part], self.slope[part] = base, slope


def gathered(vectors: DataFrame, model: Difficulty, scale: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass: levels of all documents and the sums that the words' turn needs (seen, leaning, mass on the grid).
    A task gives one row for each slot it has met; there are never more rows to fetch than slots."""
    model.expected()
    shared = vectors.sparkSession.sparkContext.broadcast((model, scale))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, (k, c) = shared.value
        seen, leaning, mass = np.zeros(SLOTS), np.zeros(SLOTS), np.zeros(len(GRID))
        for batch in batches:
            at = own.levels(batch)
            level = k * GRID[at] + c
            doc, word, count = _flat(batch)
            seen += np.bincount(word, count, SLOTS)
            leaning += np.bincount(word, count * level[doc], SLOTS)
            mass += np.bincount(at, batch["n"], len(GRID))
        met = np.flatnonzero(seen)
        yield pd.DataFrame({"k": np.concatenate([met, SLOTS + np.arange(len(GRID))]), "x": np.concatenate([seen[met], mass]), "y": np.concatenate([leaning[met], np.zeros(len(GRID))])})

    sums = vectors.mapInPandas(run, "k long, x double, y double").groupBy("k").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toPandas()
    x, y = np.zeros(SLOTS + len(GRID)), np.zeros(SLOTS + len(GRID))
    x[sums["k"]], y[sums["k"]] = sums["x"], sums["y"]
    return x[:SLOTS], y[:SLOTS], x[SLOTS:]


def cuts(level: np.ndarray, grade: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """The points of the grid between the grades."""
    between = (GRID[1:] + GRID[:-1]) / 2
    smooth = np.convolve(mass, np.ones(3), "same")
    rare = smooth[1:] + smooth[:-1]
    out = []
    for g in range(1, GRADES):
        wrong = np.array([((level > c) != (grade > g)).sum() for c in between])
        best = np.flatnonzero(wrong <= wrong.min() + SLACK * len(grade))
        out.append(between[best[rare[best].argmin()]])
    return np.maximum.accumulate(np.array(out))


def quartiles(vectors: DataFrame, model: Difficulty) -> np.ndarray:
    """The points of the grid that cut the documents into equal parts."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "k": shared.value.levels(batch)})

    rows = vectors.mapInPandas(run, "doc_id long, k long").groupBy("doc_id").agg(F.min("k").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).toPandas()
    n = np.zeros(len(GRID))
    n[rows["k"]] = rows["n"]
    return GRID[np.searchsorted(np.cumsum(n) / n.sum(), np.arange(1, GRADES) / GRADES - 1e-9)]


def reading_levels(docs: DataFrame, grades: DataFrame, lookalikes: Lookalikes) -> DataFrame:
    """docs: doc_id, text; grades: doc_id, rater, grade. Out: doc_id, grade."""
    spark = docs.sparkSession
    ship(spark)
    tune_arrow(spark)
    slim = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = stage(english_vectors(slim, lookalikes.rewrites), "vectors")
    if vectors.isEmpty():
        return spark.createDataFrame([], "doc_id long, grade int")

    votes = grades.filter(F.col("grade").between(1, GRADES)).groupBy("doc_id", "rater").agg(F.min("grade").alias("grade")).groupBy("doc_id").agg(F.collect_list("grade").alias("votes"))
    graded = votes.orderBy(F.xxhash64("doc_id")).limit(GRADED)
    sample = vectors.join(F.broadcast(graded), "doc_id").dropDuplicates(["doc_id"]).toPandas()
    model = Difficulty(np.full(SLOTS, NOTHING), np.zeros(SLOTS))
    grade = np.array([median(v) for v in sample["votes"]]) if len(sample) else np.zeros(0)
    middle = (1 + GRADES) / 2
    if len(sample):
        doc, word, count = _flat(sample)
        level = grade - middle
        seen, leaning = np.bincount(word, count, SLOTS), np.bincount(word, count * level[doc], SLOTS)
        at, place = np.unique(level, return_inverse=True)
        mass = np.bincount(place, sample["n"])
    else:  # no grades: the scale starts from the length of words, which only fixes its direction
        seen, leaning, mass = gathered(vectors, model, (1.0, 0.0))
        long = lengths(slim, lookalikes.rewrites)
        mean = np.average(long, weights=seen)
        spread = np.sqrt(np.average((long - mean) ** 2, weights=seen))
        model = Difficulty(np.where(seen > 0, np.log(np.maximum(seen, 0.5) / mass.sum()), NOTHING), np.where(seen > 0, (long - mean) / max(spread, 1e-6) * START, 0.0))
        seen, leaning, mass = gathered(vectors, model, (1.0, 0.0))
        at = GRID
    model.turn(seen, leaning, mass, at)
    scale, before = (1.0, 0.0), None
    for turn in range(TURNS):
        if len(sample) > 2:
            own = GRID[model.levels(sample)]
            if own.std() > 1e-6:
                k, c = np.polyfit(own, grade - middle, 1)
                scale = (float(k), float(c))
        seen, leaning, mass = gathered(vectors, model, scale)
        moved = 1.0 if before is None else np.abs(np.cumsum(mass / mass.sum() - before / before.sum())).max()
        if turn == TURNS - 1 or moved < SETTLED:
            break
        before = mass
        model.turn(seen, leaning, mass, scale[0] * GRID + scale[1])
    if len(sample):
        between = cuts(GRID[model.levels(sample)], grade, mass)
    else:
        between = quartiles(vectors, model)
    model.expected()
    final = spark.sparkContext.broadcast((model, between))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, edges = final.value
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "grade": 1 + (GRID[own.levels(batch)][:, None] > edges).sum(1)})

    return vectors.mapInPandas(assign, "doc_id long, grade int").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id LONG, grade INT."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return reading_levels(docs, load(spark, sf_dir, "grade_labels"), Lookalikes.fit(docs, usual_first=True))
