"""Evaluation texts leaking into training text (problem 7).

Items and documents are read as runs of three words (four Chinese characters), the terms. The items' terms, weighed by
BM25, are in an inverted index with block maxima; windows of the documents are its queries, and every item whose score
can reach its threshold is retrieved. The threshold is what verification needs at least: one term that is no turn of
phrase. Every place where a document and a retrieved item hold the same term is then followed in both directions along
equal words, across single changed, missing or inserted words and across page heads. Passages of at least ten words
(twenty Chinese characters), of which ``DENSITY`` are equal, count, and they must cover a third of the item. Terms that
many items have are turns of phrase: a passage whose intact terms, however few, are such on average doesn't count. So
they are not in the index and nothing need be followed from them.

No higher threshold would do: ten words of which two are changed lie in at most three runs, one of them of three words
or more; twenty characters of which four are changed lie in five runs, one of them of four or more. So a passage that
counts has one intact term at least, and marks inside it may leave no more than that. All places of a batch are
followed at once in arrays, and most end after one step.

No shuffle of documents: they are read once. The index is broadcast, so its size is checked before: beyond ``SHARD``
items or ``SHARD_CHARS`` characters the items are split, each part is brought to the driver by itself and the documents
are read once for each; how common a term is is counted over all items before, so the parts change nothing.

Defined results: null texts and null ids hold nothing; empty texts hold nothing; repeated document rows give the same
rows once; items without enough words for one term cannot leak; ties don't matter since nothing is ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.lookalikes import Lookalikes
from leafmill.llm.words import WordReader, Words, grams, portions
from leafmill.runtime import load, ship, stage, tune_arrow

GRAM, HAN_GRAM = 3, 4
WINDOW, STRIDE = 64, 32
BLOCK = 8
MIN_TERMS = 4.0
MIN_WORDS, MIN_HAN = 10, 20
SHARE = 1 / 3
DENSITY = 0.8
TELLING = 0.6  # weight, in mean terms of the item, of a term that is no turn of phrase, and of a passage's intact terms on average
KEPT = 0.15  # share of an item's weight that ``retrieve`` asks for
K1, B = 1.2, 0.75
SHARD, SHARD_CHARS = 50_000, 50_000_000
HEAD = 14  # words of a page head or line mark that a passage may run across
PAD = 2 * HEAD  # places between two texts, more than a passage may run across
PLACES = 1 << 18  # places followed at a time


@dataclass
class ItemIndex:
    item_id: np.ndarray
    threshold: np.ndarray  # of each item, for a passage
    total: np.ndarray  # weight of all terms of each item
    terms: np.ndarray  # sorted term numbers
    begin: np.ndarray  # postings of term t: begin[t]:begin[t + 1]
    items: np.ndarray
    weight: np.ndarray
    block_begin: np.ndarray  # blocks of term t
    blocks: np.ndarray
    block_max: np.ndarray
    block_threshold: np.ndarray


def build_index(item_ids: list[int], texts: list[str], reader: WordReader) -> ItemIndex:
    w = reader.words(texts)
    number, pos = grams(w, GRAM, HAN_GRAM)
    item = w.text[pos]
    key, tf = np.unique(np.stack([number, item.astype(np.uint64)]), axis=1, return_counts=True)
    terms, begin, df = np.unique(key[0], return_index=True, return_counts=True)
    n = len(texts)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    size = np.maximum(np.bincount(item, minlength=n), 1)
    items = key[1].astype(np.int64)
    norm = K1 * (1 - B + B * size[items] / size.mean())
    weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm)
    total, count = np.bincount(items, weight, n), np.maximum(np.bincount(items, minlength=n), 1)
    threshold = np.where(total > 0, np.minimum(MIN_TERMS, count * SHARE) * total / count, np.inf)
    return _with_blocks(np.array(item_ids), terms, np.append(begin, len(items)), items, weight, threshold, total)


def _with_blocks(item_ids: np.ndarray, terms: np.ndarray, begin: np.ndarray, items: np.ndarray, weight: np.ndarray, threshold: np.ndarray, total: np.ndarray) -> ItemIndex:
    """The index with the largest weight of each term and the least threshold in each block of items."""
    n = len(item_ids)
    blocks = (n + BLOCK - 1) // BLOCK
    bkey = np.repeat(np.arange(len(terms)), np.diff(begin)) * blocks + items // BLOCK
    bterm, bfirst = np.unique(bkey, return_index=True)
    block_max = np.maximum.reduceat(weight, bfirst) if len(bfirst) else weight
    block_begin = np.searchsorted(bterm, np.arange(len(terms) + 1) * blocks)
    padded = np.full(blocks * BLOCK, np.inf)
    padded[:n] = threshold
    return ItemIndex(item_ids, threshold, total, terms, begin, items, weight, block_begin, bterm % blocks, block_max, padded.reshape(blocks, BLOCK).min(1))


def _expand(begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``which`` all indices of its list: (row, index)."""
    count = begin[which + 1] - begin[which]
    row = np.repeat(np.arange(len(which)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[which][row]


def retrieve(index: ItemIndex, number: np.ndarray, pos: np.ndarray, text: np.ndarray, kept: float | None = None) -> np.ndarray:
    """(text, item) of all passages that reach an item's threshold; one row of the result a pair. ``kept``: share of the
    item's weight that all of them together must have."""
    at = np.searchsorted(index.terms, number)
    at[at == len(index.terms)] = 0
    hit = np.flatnonzero(index.terms[at] == number) if len(index.terms) else np.zeros(0, np.int64)
    if not len(hit):
        return np.zeros((0, 2), np.int64)
    term, where, doc = at[hit], pos[hit], text[hit]
    # each position lies in two windows; windows are numbered through all texts so that none spans two
    window = np.concatenate([where // STRIDE, where // STRIDE + 1])
    doc, term = np.tile(doc, 2), np.tile(term, 2)
    most = int(window.max()) + 1
    query = np.unique((doc * most + window) * len(index.terms) + term)
    passage, term = query // len(index.terms), query % len(index.terms)
    _, passage_no = np.unique(passage, return_inverse=True)
    doc = passage // most
    # bound of each block for each passage
    row, entry = _expand(index.block_begin, term)
    blocks = len(index.block_threshold)
    pair = passage_no[row] * blocks + index.blocks[entry]
    pairs, inverse = np.unique(pair, return_inverse=True)
    bound = np.bincount(inverse, index.block_max[entry])
    alive = pairs[bound >= index.block_threshold[pairs % blocks] - 1e-9]
    if not len(alive):
        return np.zeros((0, 2), np.int64)
    # exact scores in the blocks that are left
    touched = np.isin(passage_no, np.unique(alive // blocks))
    term, passage_no, doc = term[touched], passage_no[touched], doc[touched]
    row, entry = _expand(index.begin, term)
    item = index.items[entry]
    keep = np.isin(passage_no[row] * blocks + item // BLOCK, alive)
    row, entry, item = row[keep], entry[keep], item[keep]
    n = len(index.item_id)
    pairs, first, inverse = np.unique(passage_no[row] * n + item, return_index=True, return_inverse=True)
    score = np.bincount(inverse, index.weight[entry])
    good = score >= index.threshold[pairs % n] - 1e-9
    # over all passages of a document that reached the threshold: enough of the item's weight for a third of it
    mine = good[inverse]
    pair_doc = doc[row[first]]
    of = pair_doc[inverse[mine]] * n + item[mine]
    distinct = np.unique(of * len(index.terms) + term[row[mine]], return_index=True)[1]
    found, place = np.unique(of[distinct], return_inverse=True)
    weight = np.bincount(place, index.weight[entry[mine][distinct]], len(found))
    found = found[weight >= (KEPT if kept is None else kept) * index.total[found % n]]
    return np.stack([found // n, found % n], 1)


#: Words to pass over in the item and in the document, and how many must be equal behind: single words changed,
#: missing or inserted; two such side by side; the head of a page or a mark before a line.
SKIPS = ((1, 1, 2), (1, 0, 2), (0, 1, 2), (2, 2, 3), (1, 2, 3), (2, 1, 3), (2, 0, 3), (0, 2, 3), *((k, n, 5) for n in range(3, HEAD) for k in (0, 1)))


@dataclass
class Spread:
    """Texts one behind the other with ``PAD`` places between them, which equal nothing on the other side."""

    word: np.ndarray
    two: np.ndarray  # number of this word and the next
    term: np.ndarray  # number of the term that begins here
    text: np.ndarray
    start: np.ndarray  # sorted places at which terms begin


def spread(w: Words, texts: int, number: np.ndarray, pos: np.ndarray, nothing: int) -> Spread:
    at = np.arange(len(w.number)) + PAD * (w.text + 1)
    word = np.full(len(at) + PAD * (texts + 1), nothing, np.uint64)
    term, text = word.copy(), np.zeros(len(word), np.int64)
    word[at], term[at[pos]], text[at] = w.number, number, w.text
    with np.errstate(over="ignore"):
        two = word * np.uint64(0x9E3779B97F4A7C15)
        two[:-1] ^= word[1:] * np.uint64(0xBF58476D1CE4E5B9)
    return Spread(word, two, term, text, at[pos])


@dataclass
class Items:
    item_id: np.ndarray
    index: ItemIndex  # of the telling terms
    words: Spread  # with the telling terms
    every: np.ndarray  # term at each place, whatever its weight
    weight: np.ndarray  # its weight
    terms: np.ndarray  # sorted numbers of the telling terms
    begin: np.ndarray  # places of term t: begin[t]:begin[t + 1]
    places: np.ndarray
    size: np.ndarray  # words of each item
    first: np.ndarray  # place of its first word
    least: np.ndarray  # words of a passage of it


@dataclass
class Common:
    items: int
    terms: np.ndarray  # sorted numbers of the terms that several items have
    df: np.ndarray


def common(texts: list[str], reader: WordReader) -> Common:
    """How many of all items have each term, as far as more than one has it."""
    terms = [np.zeros(0, np.uint64)]
    for lo, hi in portions(texts):
        w = reader.words(texts[lo:hi])
        number, pos = grams(w, GRAM, HAN_GRAM)
        terms.append(np.unique(np.stack([number, w.text[pos].astype(np.uint64)]), axis=1)[0])
    term, df = np.unique(np.concatenate(terms), return_counts=True)
    return Common(len(texts), term[df > 1], df[df > 1])


def weights(number: np.ndarray, item: np.ndarray, n: int, among: Common) -> np.ndarray:
    """Weight of each term at its place in one of ``n`` items, in mean terms of the item: the rarer among all items, the more."""
    key, place = np.unique(np.stack([number, item.astype(np.uint64)]), axis=1, return_inverse=True)
    df = np.ones(len(key[0]))
    if len(among.terms):
        at = np.minimum(np.searchsorted(among.terms, key[0]), len(among.terms) - 1)
        df = np.where(among.terms[at] == key[0], among.df[at], 1)
    items = key[1].astype(np.int64)
    idf = np.log(1 + (among.items - df + 0.5) / (df + 0.5))
    mean = np.bincount(items, idf, n) / np.maximum(np.bincount(items, minlength=n), 1)
    return (idf / mean[items])[place.ravel()]


def read_items(item_ids: list[int], texts: list[str], reader: WordReader, among: Common) -> Items:
    w = reader.words(texts)
    number, pos = grams(w, GRAM, HAN_GRAM)
    item, n = w.text[pos], len(texts)
    weight = weights(number, item, n, among)
    every = spread(w, n, number, pos, 0)
    share = np.zeros(len(every.term))
    share[every.start] = weight
    telling = weight >= TELLING
    number, pos, item, weight = number[telling], pos[telling], item[telling], weight[telling]
    words = spread(w, n, number, pos, 0)
    order = np.argsort(number, kind="stable")
    terms, begin = np.unique(number[order], return_index=True)
    size = np.bincount(w.text, minlength=n)
    han = np.bincount(w.text, w.han, n) > 0.5 * size
    first = np.cumsum(size) - size + PAD * np.arange(1, n + 1)
    # the inverted index: a posting a term and item, weighed by BM25; one posting's weight is the least that can count
    key, at, tf = np.unique(np.stack([number, item.astype(np.uint64)]), axis=1, return_index=True, return_counts=True)
    held = key[1].astype(np.int64)
    norm = K1 * (1 - B + B * size[held] / max(size.mean(), 1)) if n else np.zeros(0)
    score = weight[at] * tf * (K1 + 1) / (tf + norm)
    least = np.full(n, np.inf)
    np.minimum.at(least, held, score)
    index = _with_blocks(np.array(item_ids), terms, np.searchsorted(key[0], np.append(terms, np.uint64(2**64 - 1))), held, score, least, np.bincount(held, score, n))
    index.begin[-1] = len(held)
    return Items(np.array(item_ids), index, words, every.term, share, terms, np.append(begin, len(number)), words.start[order], size, first, np.where(han, MIN_HAN, MIN_WORDS))


def _follow(a: Spread, b: Spread, i: np.ndarray, j: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow equal words from each (i, j) in the direction ``step``: the last equal word of ``a`` and how many are equal."""
    i, j, last, equal = i.copy(), j.copy(), i - step, np.zeros(len(i), np.int64)
    first = min(step, 0)  # of two words in the direction, the one that stands first
    going = np.arange(len(i))
    while len(going):
        x, y = i[going], j[going]
        same = a.word[x] == b.word[y]
        on = going[same]
        last[on] = i[on]
        equal[on] += 1
        i[on] += step
        j[on] += step
        rest, x, y = going[~same], x[~same], y[~same]
        if not len(rest):
            going = on
            continue
        left = np.ones(len(rest), bool)
        ahead: dict[int, np.ndarray] = {k: a.two[x + step * k + first] for k in range(3)}
        behind: dict[int, np.ndarray] = {k: b.two[y + step * k + first] for k in range(HEAD)}
        for skip_a, skip_b, need in SKIPS:
            c = np.flatnonzero(ahead[skip_a] == behind[skip_b])
            c = c[left[c]]
            for k in range(2, need):
                c = c[a.word[x[c] + step * (skip_a + k)] == b.word[y[c] + step * (skip_b + k)]]
            left[c] = False
            i[rest[c]] += step * skip_a
            j[rest[c]] += step * skip_b
        going = np.concatenate([on, rest[~left]])
    return last, equal


def held(items: Items, docs: Spread) -> np.ndarray:
    """(text, item) of which the text holds passages that cover ``SHARE`` of the item."""
    a = items.words
    number = docs.term[docs.start]
    at = np.searchsorted(items.terms, number)
    at[at == len(items.terms)] = 0
    hit = np.flatnonzero(items.terms[at] == number) if len(items.terms) else np.zeros(0, np.int64)
    term, where = at[hit], docs.start[hit]
    pairs = retrieve(items.index, number[hit], where, docs.text[where], 0.0)
    retrieved = np.sort(pairs[:, 0] * len(items.item_id) + pairs[:, 1])
    passages = [np.zeros((0, 3), np.int64)]
    turn = np.cumsum(items.begin[term + 1] - items.begin[term]) // PLACES
    for lo, hi in zip(*(np.searchsorted(turn, np.unique(turn), side) for side in ("left", "right"))):
        row, entry = _expand(items.begin, term[lo:hi])
        i, j = items.places[entry], where[lo:hi][row]
        begins = a.term[i - 1] != docs.term[j - 1]  # else the place before is in the same run
        i, j = i[begins], j[begins]
        pair = docs.text[j] * len(items.item_id) + a.text[i]
        place = np.minimum(np.searchsorted(retrieved, pair), len(retrieved) - 1)
        i, j = (i[retrieved[place] == pair], j[retrieved[place] == pair]) if len(retrieved) else (i[:0], j[:0])
        right, more = _follow(a, docs, i, j, 1)
        left, fewer = _follow(a, docs, i - 1, j - 1, -1)
        size = right - left + 1
        good = (size >= items.least[a.text[i]]) & (more + fewer >= DENSITY * size - 1e-9)
        passages.append(np.stack([docs.text[j[good]], left[good], right[good]], 1))
    by_pair: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc, left, right in np.unique(np.concatenate(passages), axis=0).tolist():
        by_pair.setdefault((doc, int(a.text[left])), []).append((left, right))
    found, texts, own = [], docs.text[docs.start], (-1, np.zeros(0, np.uint64))
    for (doc, item), parts in by_pair.items():
        if sum(right - left + 1 for left, right in parts) < SHARE * items.size[item]:
            continue  # too little, turns of phrase or not
        of = np.zeros(items.size[item], bool)
        if own[0] != doc:
            own = (doc, np.sort(docs.term[docs.start[slice(*np.searchsorted(texts, [doc, doc + 1]))]]))
        for left, right in parts:
            every = items.every[left : right + 1]
            intact = own[1][np.minimum(np.searchsorted(own[1], every), len(own[1]) - 1)] == every
            if items.weight[left : right + 1][intact].mean() >= TELLING:
                of[left - items.first[item] : right - items.first[item] + 1] = True
        if of.mean() >= SHARE:
            found.append((doc, item))
    return np.array(found, np.int64).reshape(-1, 2)


def leaks(docs: DataFrame, items: DataFrame, lookalikes: Lookalikes) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. Out: doc_id, item_id."""
    spark = docs.sparkSession
    ship(spark)
    tune_arrow(spark)
    reader = WordReader(lookalikes.rewrites)
    whole = stage(items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), "items")
    size = whole.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    shards = max(-(-size.n // SHARD), -(-size.chars // SHARD_CHARS))
    counted = None if shards < 2 else stage(_terms(whole, lookalikes).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "terms")
    parts = []
    slim = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rewrites = lookalikes.rewrites
    for k in range(shards):
        part = whole if counted is None else whole.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        shard = sorted((r.item_id, r.text) for r in part.collect())  # within the sizes above
        if not shard:
            continue
        if counted is None:
            among = common([text for _, text in shard], reader)
        else:
            own = _terms(part, lookalikes).select("term").distinct().join(counted, "term").orderBy("term").toPandas()
            term, df = own["term"].to_numpy(np.int64).view(np.uint64), own["df"].to_numpy(np.int64)
            order = np.argsort(term)
            among = Common(size.n, term[order], df[order])
        shared = spark.sparkContext.broadcast(read_items([r[0] for r in shard], [r[1] for r in shard], reader, among))

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, known = WordReader(rewrites), shared.value
            for batch in batches:
                ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
                for lo, hi in portions(texts):
                    w = own.words(texts[lo:hi])
                    pairs = held(known, spread(w, hi - lo, *grams(w, GRAM, HAN_GRAM), 1))
                    yield pd.DataFrame({"doc_id": ids[lo + pairs[:, 0]], "item_id": known.item_id[pairs[:, 1]]})

        parts.append(slim.mapInPandas(find, "doc_id long, item_id long"))
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return reduce(DataFrame.unionByName, parts).distinct()


def _terms(items: DataFrame, lookalikes: Lookalikes) -> DataFrame:
    """term: one row for each term of each item."""
    rewrites = lookalikes.rewrites

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = WordReader(rewrites)
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in portions(texts):
                w = own.words(texts[lo:hi])
                number, pos = grams(w, GRAM, HAN_GRAM)
                yield pd.DataFrame({"term": np.unique(np.stack([number, w.text[pos].astype(np.uint64)]), axis=1)[0].view(np.int64)})

    return items.select("text").mapInPandas(read, "term long")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id LONG, item_id LONG."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, load(spark, sf_dir, "eval_items"), Lookalikes.fit(docs, usual_first=True))
