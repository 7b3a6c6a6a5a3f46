"""Calls to a text model: opaque, slow, metered. Everything is behind a ``Backend``; the one that comes along works
offline and always says the same.

A stage that calls a model runs in ``mapInPandas`` over whole units and is written before anything reads it, so that no
recomputation calls the model twice. Retries are the driver's business, not the task scheduler's."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.replies import short_error
from leafmill.runtime import ship

# Fixed value: what stands between paragraphs in a request and in its reply.
SEPARATOR = "@@SEG@@"

GLOSSARY_PROMPT = "Each key of this JSON object may be a proper noun; its value shows where it stands. Return one JSON object that maps every key that is a name of a person, place or institution to its usual Simplified Chinese form, and nothing else."
JUDGE_PROMPT = f"Each block has an English text and its Chinese translation; blocks are parted by a line {SEPARATOR}. Return a JSON array with one object a block, in order: faithful (1 to 5), missing (true or false), hallucinated (true or false)."


#: What a call may fail with; anything else is an error of the program and ends the job.
FAILURES = (OSError, ValueError, subprocess.SubprocessError)


class Backend(Protocol):
    def complete(self, system: str, payload: str) -> str: ...


class Offline:
    """Deterministic stand-in: Latin words become one word, numbers and marks stay; judges find everything faithful."""

    def complete(self, system: str, payload: str) -> str:
        if system == JUDGE_PROMPT:
            return json.dumps([{"faithful": 5, "missing": False, "hallucinated": False} for _ in payload.split(SEPARATOR)])
        if system.startswith(GLOSSARY_PROMPT):
            return json.dumps({k: "译名" for k in json.loads(payload)}, ensure_ascii=False)
        return re.sub(r"[A-Za-z]+", "译文", payload.replace(SEPARATOR, "\0")).replace("\0", SEPARATOR)


class Command:
    """A model behind a command: the system text is its last argument, the payload its input, the reply its output."""

    def __init__(self, command: list[str], timeout: float = 240, envelope: bool = True):
        self.command, self.timeout, self.envelope = command, timeout, envelope

    def complete(self, system: str, payload: str) -> str:
        said = subprocess.run([*self.command, system], input=payload, capture_output=True, text=True, timeout=self.timeout, check=True).stdout
        return text_of(said) if self.envelope else said


def text_of(stdout: str) -> str:
    """The text in an envelope: of a list the last event of type ``result``, of an object its ``result``."""
    data = json.loads(stdout)
    if isinstance(data, list):
        data = next((e for e in reversed(data) if isinstance(e, dict) and e.get("type") == "result"), None)
        if data is None:
            raise ValueError("the reply has no result")
    return data.get("result", "")


def unfenced(text: str) -> str:
    t = text.strip()
    if t.startswith("```"):
        t = re.sub(r"\n?```$", "", re.sub(r"^```[a-zA-Z]*\n?", "", t))
    return t.strip()


def object_of(raw: str) -> dict:
    """One JSON object, alone or inside prose."""
    t = unfenced(raw)
    for part in (t, t[t.find("{") : t.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise ValueError("the reply holds no JSON object")


def translation_prompt(glossary: dict[str, str], title: str = "") -> str:
    lines = [
        "Translate English literature into natural Simplified Chinese" + (f'; this is from "{title}"' if title else "") + ".",
        f"Paragraphs are parted by a line {SEPARATOR}. Translate each, faithfully and whole, with its names, numbers and dates; add and explain nothing.",
        f"Answer with the translations only, as many, in the same order, parted by the same line {SEPARATOR}.",
    ]
    if glossary:
        lines.append("Names: " + "; ".join(f"{en}=>{zh}" for en, zh in glossary.items()))
    return "\n".join(lines)


def halving(items: list, call: Callable[[list], list], alone: Callable) -> list:
    """``call`` for all items at once; where it raises ValueError, for each half, down to ``alone`` for a single item.
    Other errors pass through. One result an item, in order."""
    try:
        return call(items)
    except ValueError:
        if len(items) == 1:
            return [alone(items[0])]
        middle = len(items) // 2
        return halving(items[:middle], call, alone) + halving(items[middle:], call, alone)


def translate(texts: list[str], prompt: str, backend: Backend) -> list[str]:
    def together(part: list[str]) -> list[str]:
        blocks = [b.strip() for b in backend.complete(prompt, f"\n{SEPARATOR}\n".join(part)).split(SEPARATOR)]
        if len(blocks) != len(part):
            blocks = [b for b in blocks if b]
        if len(blocks) != len(part):
            raise ValueError(f"{len(part)} paragraphs sent, {len(blocks)} came back")
        return blocks

    return halving(texts, together, lambda t: backend.complete(prompt, t).replace(SEPARATOR, "").strip())


UNVERIFIED = {"faithful": 0, "missing": False, "hallucinated": False}


def judge(pairs: list[tuple[str, str]], backend: Backend) -> list[dict]:
    def together(part: list[tuple[str, str]]) -> list[dict]:
        payload = f"\n{SEPARATOR}\n".join(f"[{i}]\nEN: {en}\nZH: {zh}" for i, (en, zh) in enumerate(part))
        verdicts = json.loads(unfenced(backend.complete(JUDGE_PROMPT, payload)))
        if not isinstance(verdicts, list) or len(verdicts) != len(part):
            raise ValueError("not one verdict a pair")
        return [v if isinstance(v, dict) else UNVERIFIED for v in verdicts]

    return halving(pairs, together, lambda _: dict(UNVERIFIED))


def translate_units(todo: DataFrame, prompt: str, backend: Backend) -> DataFrame:
    """todo: unit_id, texts array<struct<sha,en>> (one row a unit) and, if units are of several books, book, title and
    names array<struct<en,zh>>, of which each book's own prompt is made. Out: unit_id, sha, zh, error (and book). A unit
    whose call fails has one row with its error and no text; no unit is ever split between tasks."""
    ship(todo.sparkSession)
    books = "names" in todo.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, str] = {}
        for batch in batches:
            rows = []
            for unit in batch.itertuples():
                said, more = prompt, ()
                if books:
                    more = (unit.book,)
                    if unit.book not in own:
                        own = {unit.book: translation_prompt({n["en"]: n["zh"] for n in (() if unit.names is None else unit.names)}, unit.title or "")}
                    said = own[unit.book]
                try:
                    done = translate([t["en"] for t in unit.texts], said, backend)
                    rows += [(unit.unit_id, t["sha"], zh, None, *more) for t, zh in zip(unit.texts, done)]
                except FAILURES as error:  # recorded with the unit; the driver decides about another pass
                    rows.append((unit.unit_id, None, None, short_error(error), *more))
            yield pd.DataFrame(rows, columns=["unit_id", "sha", "zh", "error", *(["book"] if books else [])])

    return todo.mapInPandas(run, "unit_id long, sha string, zh string, error string" + (", book string" if books else ""))


def judge_batches(todo: DataFrame, backend: Backend) -> DataFrame:
    """todo: batch, pairs array<struct<sha,en,zh>>. Out: sha, faithful, missing, hallucinated; nothing for a batch whose call fails."""
    ship(todo.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pairs in batch["pairs"]:
                try:
                    verdicts = judge([(p["en"], p["zh"]) for p in pairs], backend)
                except FAILURES:  # left as it is for the next run
                    continue
                rows += [(p["sha"], v.get("faithful", 5), bool(v.get("missing")), bool(v.get("hallucinated"))) for p, v in zip(pairs, verdicts)]
            yield pd.DataFrame(rows, columns=["sha", "faithful", "missing", "hallucinated"])

    return todo.mapInPandas(run, "sha string, faithful int, missing boolean, hallucinated boolean")


def pending_units(paragraphs: DataFrame, translations: DataFrame, units: DataFrame) -> DataFrame:
    """book, unit_id, texts of the paragraphs that no translation covers, in order. A text that several units hold goes
    to the first of them."""
    from leafmill.operators.state import uncached, workable

    open_ = uncached(paragraphs.join(workable(units).select("book", F.col("id").alias("unit_id")), ["book", "unit_id"], "left_semi"), translations)
    first = open_.groupBy("sha").agg(F.min(F.struct("book", "unit_id", "file", "idx", "en")).alias("p"))
    texts = first.select("p.book", "p.unit_id", F.struct(F.col("p.file").alias("file"), F.col("p.idx").alias("idx"), F.col("sha"), F.col("p.en").alias("en")).alias("t")).groupBy("book", "unit_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return texts.select("book", "unit_id", F.transform("t", lambda t: F.struct(t["sha"].alias("sha"), t["en"].alias("en"))).alias("texts"))
