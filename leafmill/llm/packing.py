"""Filling fixed-capacity containers with items (problem 6).

Documents are sized in tokens and packed into containers of ``CAPACITY`` tokens by best-fit decreasing, partition by
partition. Dual feasible functions give a lower bound of each partition's containers, and of all together; a partition
that meets its bound is certified and gives away no more than the rests of a few containers. While the sum is above
the bound of the whole, partitions exchange: their loosest containers go to a group of ``FAN`` partitions and are
packed again together, then those of groups of groups, and so on. A new packing is taken only if it needs fewer
containers.

A partition holds about ``TARGET`` tokens, and at most some ``MOST`` documents, whatever the corpus. What one gives to
an exchange holds at most a ``FAN``-th of that, however far it is from its bound, so a group never holds more than a
partition did, at any level.

A text that alone exceeds the capacity is cut into full containers and a rest, and only the rest is packed.

Defined results: a null text has no row; a text without tokens lies in a container of its partition and takes no room;
repeated documents (same id) are packed once, as the longest; an empty table gives no rows; ties go to the smaller id.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.runtime import load, ship, stage

CAPACITY = 2048
TARGET = 4_000_000
MOST = 250_000
FAN = 16
LOOSE = 8  # containers that a partition gives to an exchange for each one above its bound, and at least
ROUNDINGS = 24  # how fine the rounding dual feasible functions go

VOCABULARY = os.path.join(os.environ.get("LEAFMILL_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
# Fixed value: how this vocabulary's texts are cut before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ITEMS = "grp long, bin string, doc_id long, part int, tokens int, opens boolean, give boolean"


def sizes(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens. The vocabulary file is read by the driver and sent along: its size does not depend on the data."""
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [len(encoding.encode_ordinary(t)) for t in batch["text"]]})

    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(count, "doc_id long, tokens long")


def lower_bound(size: np.ndarray, number: np.ndarray, capacity: int) -> int:
    """Least containers that ``number[k]`` items of ``size[k]`` need: the best bound of three families of dual feasible
    functions, in whole numbers. They take items above capacity - a as whole and drop those below a, for every a up to
    half, and the others as they are or rounded down to a k-th by the next finer step; or they count how often a piece
    of l tokens goes into an item, or into what it leaves free."""
    count = np.bincount(size, number, capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    at_least = lambda y: np.concatenate([np.cumsum(y[::-1])[::-1], [0]])
    up = lambda y, unit: -(-y // unit)
    n, w = at_least(count), at_least(count * x)
    half = capacity // 2
    best = int(up(w[0], capacity))
    if not half:
        return best
    a = np.arange(1, half + 1)
    big = n[capacity - a + 1]  # whole
    middle_n, middle_w = n[half + 1] - big, w[half + 1] - w[capacity - a + 1]
    small_w = w[a] - w[half + 1]
    spare = middle_n * capacity - middle_w  # of two middle items none share a container
    best = max(best, int((big + middle_n + up(np.maximum(0, small_w - spare), capacity)).max()))
    for k in range(2, min(ROUNDINGS, capacity) + 1):
        steps, rest = np.divmod((k + 1) * x, capacity)
        rounded = at_least(count * np.where(rest == 0, steps * k, steps * (k + 1)))  # in parts of k (k + 1)
        best = max(best, int(up(big * k * (k + 1) + rounded[a] - rounded[capacity - a + 1], k * (k + 1)).max()))
    sizes = np.flatnonzero(count)
    for i in range(0, half, 256):
        piece = a[i : i + 256, None]
        whole = capacity // piece
        into = np.where(2 * sizes < capacity, 2 * (sizes // piece), np.where(2 * sizes > capacity, 2 * (whole - (capacity - sizes) // piece), whole))
        best = max(best, int(up((into * count[sizes]).sum(1), 2 * whole[:, 0]).max(initial=0)))
    return best


def best_fit_decreasing(size: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item; items are given in the order in which equal ones are to be taken."""
    out = np.zeros(len(size), np.int64)
    rooms: list[int] = []  # different rooms that some container has
    where: dict[int, list[int]] = {}
    used = 0
    for k in np.argsort(-size, kind="stable").tolist():
        s = int(size[k])
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            bins = where[room]
            b = bins.pop()
            if not bins:
                del where[room]
                rooms.pop(at)
        else:
            b, room = used, capacity
            used += 1
        out[k] = b
        left = room - s
        if left in where:
            where[left].append(b)
        else:
            where[left] = [b]
            insort(rooms, left)
    return out


def _offer(rows: pd.DataFrame, capacity: int, target: int, most: int) -> pd.DataFrame:
    """Mark the first item of each container, and the loosest containers as given to the next exchange: ``LOOSE`` for
    each container above the partition's bound (and at least), within a ``FAN``-th of what a partition may hold."""
    size = rows["tokens"].to_numpy()
    number, _ = pd.factorize(rows["bin"])
    fill, items = np.bincount(number, size).astype(np.int64), np.bincount(number)
    gap = max(1, len(fill) - lower_bound(size, np.ones(len(size), np.int64), capacity))
    order = np.lexsort((np.arange(len(fill)), fill))
    within = (np.cumsum(fill[order]) <= max(target // FAN, capacity)) & (np.cumsum(items[order]) <= max(most // FAN, 1)) & (fill[order] < capacity)
    give = np.zeros(len(fill), bool)
    give[order[: gap * LOOSE][within[: gap * LOOSE]]] = True
    opens = np.zeros(len(rows), bool)
    opens[np.unique(number, return_index=True)[1]] = True
    return rows.assign(opens=opens, give=give[number])


def _pack(rows: pd.DataFrame, label: str, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "part"], kind="stable").reset_index(drop=True)
    new = best_fit_decreasing(rows["tokens"].to_numpy(), capacity)
    return rows.assign(bin=[f"{label}-{b}" for b in new])


def _packer(level: int, capacity: int, target: int, most: int):
    """Pack a partition, or what a group of them has exchanged; keep an older packing unless the new one needs fewer."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        label = f"{level}-{rows['grp'].iloc[0]}"
        if not level:
            rows = _pack(rows, label, capacity)
        else:
            old = rows["bin"].nunique()
            size = rows["tokens"].to_numpy()
            if old > lower_bound(size, np.ones(len(size), np.int64), capacity):
                new = _pack(rows, label, capacity)
                if new["bin"].nunique() < old:
                    rows = new
        return _offer(rows, capacity, target, most)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, target: int = TARGET, most: int = MOST, report: list[dict] | None = None) -> DataFrame:
    """items: doc_id, tokens. Out: container, doc_id, part, tokens. ``report`` gets a row for each level: containers
    so far, the bound, groups, and what the largest group held."""
    spark = items.sparkSession
    ship(spark)
    sized = stage(items.groupBy("doc_id").agg(F.max("tokens").alias("tokens")), "sizes")
    whole = sized.filter(F.col("tokens") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("tokens") / capacity).cast("int") - 1)).alias("part"))
    full = whole.select(F.concat(F.lit("full-"), "doc_id", F.lit("-"), "part").alias("container"), "doc_id", "part", F.lit(capacity).alias("tokens"))
    rest = sized.select("doc_id", (F.col("tokens") / capacity).cast("int").alias("part"), (F.col("tokens") % capacity).cast("int").alias("tokens")).filter("tokens > 0 or part = 0")
    histogram = rest.groupBy("tokens").count().toPandas()  # at most as many rows as the capacity has tokens
    if not len(histogram):
        return full
    size, number = histogram["tokens"].to_numpy(), histogram["count"].to_numpy()
    bound = lower_bound(size, number, capacity)
    parts = max(1, int(-(-(size * number).sum() // target)), int(-(-number.sum() // most)))
    moved = rest.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("grp"), F.lit("").alias("bin"), "doc_id", "part", "tokens")

    settled: list[DataFrame] = []
    level, groups, containers = 0, parts, 0
    while True:
        packed = stage(moved.groupBy("grp").applyInPandas(_packer(level, capacity, target, most), ITEMS), f"packed-{level}")
        sums = packed.groupBy("grp").agg(F.sum(F.col("opens").cast("long")).alias("bins"), F.sum((F.col("opens") & F.col("give")).cast("long")).alias("given"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
        row = sums.agg(F.sum("bins").alias("bins"), F.sum("given").alias("given"), F.max("tokens").alias("tokens"), F.max("items").alias("items")).first()
        if not row.bins:
            break
        if report is not None:
            report.append({"level": level, "containers": containers + row.bins, "bound": bound, "groups": groups, "tokens": row.tokens, "items": row.items})
        if groups == 1 or not row.given or containers + row.bins <= bound:  # the last: certified, no packing has fewer
            settled.append(packed)
            break
        settled.append(packed.filter("not give"))
        containers += row.bins - row.given
        moved = packed.filter("give").select(F.floor(F.col("grp") / FAN).cast("long").alias("grp"), "bin", "doc_id", "part", "tokens")
        level, groups = level + 1, -(-groups // FAN)
    out = settled[0]
    for df in settled[1:]:
        out = out.unionByName(df)
    return full.unionByName(out.select(F.col("bin").alias("container"), "doc_id", "part", "tokens"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """container STRING, doc_id LONG, part INT, tokens INT: where each document, or each piece of a longer one, lies."""
    return pack(sizes(load(spark, sf_dir, "documents").select("doc_id", "text")))
