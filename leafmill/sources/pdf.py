"""The text layer of PDF files, by an external program where it is installed. What the engine needs is only the text:
any table with pages parted by form feeds will do."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import strip
from leafmill.operators.reflow import better_text
from leafmill.runtime import ship

LEAST = 200  # characters on the first pages of a file that has a text layer at all


def available() -> bool:
    return shutil.which("pdftotext") is not None


def texts(spark: SparkSession, path: str, timeout: int = 600) -> DataFrame:
    """source_path, title, opening, normal, raw, error: the title that the file gives itself, the first twelve pages, the
    whole text, and the whole in raw order. A file that the program can't read has its message as error and no text."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, content in zip(batch["source_path"], batch["content"]):

                def say(program: str, *flags: str, content: bytes = content) -> str:
                    return subprocess.run([program, *flags], input=content, capture_output=True, timeout=timeout, check=True).stdout.decode("utf-8", "replace")

                try:
                    parts = [say("pdftotext", "-q", *flags, "-", "-") for flags in (("-f", "1", "-l", "12"), (), ("-raw",))]
                    rows.append((source, title_of(say("pdfinfo", "-")) if shutil.which("pdfinfo") else None, *parts, None))
                except (OSError, subprocess.SubprocessError) as error:
                    said = getattr(error, "stderr", None) or b""
                    rows.append((source, None, "", "", "", said.decode("utf-8", "replace").strip() or str(error)))
            yield pd.DataFrame(rows, columns=["source_path", "title", "opening", "normal", "raw", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    return files.select(F.col("path").alias("source_path"), "content").mapInPandas(run, "source_path string, title string, opening string, normal string, raw string, error string")


def title_of(info: str) -> str | None:
    """The title in what ``pdfinfo`` prints."""
    return next((value.strip() or None for name, _, value in (line.partition(":") for line in info.splitlines()) if name == "Title"), None)


def _has_text(read: DataFrame):
    return F.length(strip(F.coalesce("opening", F.lit("")))) >= LEAST


def best_texts(read: DataFrame) -> DataFrame:
    """source_path, title (the file's own, else its name), text of the files that have a text layer."""
    name = F.regexp_extract("source_path", r"([^/]*?)(\.[^.]*)?$", 1)
    return read.filter(_has_text(read)).select("source_path", F.coalesce("title", name).alias("title"), better_text(F.col("normal"), F.col("raw")).alias("text"))


def unusable(read: DataFrame) -> DataFrame:
    """source_path, error of the files without a text layer."""
    return read.filter(~_has_text(read)).select("source_path", "error")
