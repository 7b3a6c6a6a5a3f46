"""A shelf of books as tables below one folder, and the steps that fill them. Every step can be run again: what is done
already is found in the tables and not done twice."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.css import ZH_STYLE, large_classes, reading_style
from leafmill.functions.rules import SKIP_TOKENS
from leafmill.functions.text import RATE_LIMIT, slug, status_line, word_count
from leafmill.operators import glossary as names
from leafmill.operators import model, quality, reflow, sections, state, toc, units
from leafmill.runtime import stage
from leafmill.sinks import epub as epub_sink
from leafmill.sinks import render
from leafmill.sources import epub as epub_source

SCHEMAS = {
    "books": "title string, source_type string, source_path string, book string",
    "paragraphs": "id long, file string, idx int, en string, sha string, unit_id long, book string",
    "sections": "file string, ord int, title string, book string",
    "units": "id long, name string, file string, state string, attempts int, updated_at timestamp, error string, landed_at timestamp, book string",
    "translations": "sha string, zh string, qa_state string, qa_reason string, seq long, landed_at timestamp, book string",
    "glossary": "en string, zh string, book string",
    "meta": "key string, value string, landed_at timestamp, book string",
    "pages": "file string, ord int, heading string, other_works boolean, chapters array<struct<label:string,anchor:string>>, links array<struct<target:string,title:string>>, book string",
}


WHOLE = "_shelf"  # in place of a book, what is noted of the shelf itself


class Shelf:
    """Tables partitioned by book. ``units`` and ``translations`` are logs: changes are appended, the newest row stands."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def _columns(self, name: str, df: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])

    def replace(self, name: str, df: DataFrame, books: DataFrame | None = None) -> None:
        """The partitions of the books in ``df`` are replaced, those of other books stay; but those among ``books``, the
        books that ``df`` speaks of, that have no row in it lose theirs."""
        rows = stage(self._columns(name, df), name)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book").parquet(f"{self.root}/{name}")
        if books is not None:
            empty = books.select("book").distinct().join(rows.select("book").distinct(), "book", "left_anti")
            escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
            for r in empty.toLocalIterator():
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/book={escape(r.book)}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def append(self, name: str, df: DataFrame) -> None:
        self._columns(name, df.withColumn("landed_at", F.current_timestamp())).write.mode("append").partitionBy("book").parquet(f"{self.root}/{name}")

    def units(self) -> DataFrame:
        return state.latest(self.table("units"), ["book", "id"], [F.col("landed_at"), F.col("attempts")])

    def translations(self) -> DataFrame:
        return state.latest(self.table("translations"), ["sha"], [F.col("seq"), F.col("landed_at")])

    def paragraphs(self) -> DataFrame:
        return self.table("paragraphs")

    def meta(self, book: str, key: str, default: str | None = None) -> str | None:
        """What was last set for a book, or the default."""
        row = self.table("meta").filter((F.col("book") == book) & (F.col("key") == key)).orderBy(F.desc("landed_at")).first()
        return default if row is None else row["value"]

    def set_meta(self, book: str, key: str, value: object) -> None:
        self.append("meta", self.spark.createDataFrame([(book, key, str(value))], "book string, key string, value string"))


def default_root() -> str:
    """The folder of the shelf where none is named: LEAFMILL_HOME, else the user's data folder."""
    home = os.environ.get("LEAFMILL_HOME")
    return home or str(Path(os.environ.get("XDG_DATA_HOME") or Path.home() / ".local" / "share") / "leafmill")


def adopt(old: str, new: str | None = None) -> list[str]:
    """Move what an older folder holds to the shelf's, and return the names. What is there already is never overwritten
    and stays where it was; links to the new place go, and so does the old folder once it is empty."""
    source, target, moved = Path(old), Path(new or default_root()), []
    if not source.is_dir() or source.resolve() == target.resolve():
        return moved
    target.mkdir(parents=True, exist_ok=True)
    for entry in sorted(source.iterdir()):
        place = target / entry.name
        if entry.is_symlink() and place.exists() and entry.resolve() == place.resolve():
            entry.unlink()
        elif not (place.exists() or place.is_symlink()):
            entry.rename(place)
            moved.append(entry.name)
    if not any(source.iterdir()):
        source.rmdir()
    return moved


def resolve(shelf: Shelf, book: str | None = None, source: str | None = None) -> str | None:
    """The book a step works on: the one named, else the one made from a source, else the one last worked on."""
    if not book and source:
        name = shelf.spark.range(1).select(slug(F.lit(source)).alias("s")).first().s
        of_source = shelf.table("books").filter(F.col("source_path").endswith(source) | (F.col("book") == name)).orderBy((~F.col("source_path").endswith(source)), "book").first()
        book = of_source.book if of_source else name
    if book:
        shelf.set_meta(WHOLE, "active", book)
    return book or shelf.meta(WHOLE, "active")


def book_keys(shelf: Shelf, sources: DataFrame) -> DataFrame:
    """source_path, book: a name from the path's last part. Where another source of the shelf has it, or a path before
    in order among these, a part of the path's hash is added, so no two sources are ever one book."""
    named = sources.select("source_path").distinct().withColumn("name", slug(F.col("source_path"), unique=True))
    known = shelf.table("books").filter("source_path is not null").select(F.col("source_path").alias("source_path"), F.col("book").alias("had"))
    held = known.select(F.col("had").alias("name"), F.col("source_path").alias("by")).groupBy("name").agg(F.min("by").alias("by"))
    ranked = named.join(known, "source_path", "left").join(held, "name", "left").withColumn("turn", F.row_number().over(Window.partitionBy("name").orderBy(F.col("had").isNull(), "source_path")))
    free = (F.col("by").isNull() & (F.col("turn") == 1)) | (F.col("by") == F.col("source_path"))
    return ranked.select("source_path", F.coalesce("had", F.when(free, F.col("name")).otherwise(F.concat("name", F.lit("-"), F.substring(F.sha1("source_path"), 1, 10)))).alias("book"))


def _store(shelf: Shelf, rows: DataFrame, unit_words: int, books: DataFrame) -> dict[str, int]:
    """Fill paragraphs and units of ``books`` and forget translations that no paragraph has any more. Returns counts."""
    rows = stage(rows, "extracted")
    if rows.isEmpty():
        raise ValueError("nothing to translate was found: every section is empty, too short (min_words), skipped by its path (skip) or front or back matter (auto_skip)")
    paragraphs, todo = units.paragraph_table(rows, unit_words)
    shelf.replace("paragraphs", paragraphs, books)
    shelf.replace("units", todo.withColumn("landed_at", F.current_timestamp()), books)
    if shelf._exists("translations"):
        before = shelf.table("translations")
        shelf.replace("translations", state.prune(before, shelf.paragraphs()), stage(before.select("book").distinct(), "books"))
    own = shelf.paragraphs().join(F.broadcast(books.select("book").distinct()), "book", "left_semi")
    found = own.agg(F.count(F.lit(1)).alias("paragraphs"), F.countDistinct("book", "unit_id").alias("units"), F.sum(word_count(F.col("en"))).alias("words"))
    return found.first().asDict()


def extract_epubs(shelf: Shelf, path: str, min_words: int = 150, skip: tuple[str, ...] = SKIP_TOKENS, auto_skip: bool = True, unit_words: int = units.UNIT_WORDS) -> dict[str, int]:
    """Every EPUB below a path becomes a book."""
    pages = stage(epub_source.pages(epub_source.archives(shelf.spark, path)), "pages")
    keys = stage(book_keys(shelf, pages), "book-keys")
    own = F.broadcast(keys)  # one row a file of this run
    shelf.replace("books", pages.groupBy("source_path").agg(F.max("title").alias("title")).join(own, "source_path").select("book", "title", F.lit("epub").alias("source_type"), "source_path"))
    shelf.replace("pages", pages.filter("error is null").join(own, "source_path"), keys)
    targets = epub_source.targets(pages.join(own, "source_path"), min_words, skip, auto_skip)
    return _store(shelf, targets.select("book", "file", "idx", "en"), unit_words, keys)


def extract_texts(shelf: Shelf, texts: DataFrame, auto_skip: bool = True, unit_words: int = units.UNIT_WORDS) -> dict[str, int]:
    """Text layers (book, title, text; pages part at form feeds) become books: reflow, trim, chapters, without matter."""
    paragraphs = reflow.paragraphs_of(reflow.lines_of(texts, "book"), "book")
    if auto_skip:
        paragraphs = sections.trim_trailing(stage(paragraphs, "reflowed"), "book")
    split = stage(sections.split_chapters(paragraphs, "book"), "split")
    if auto_skip:
        split = split.join(sections.matter_flags(split, ["book", "section"], F.col("title")).filter(~F.col("matter")), ["book", "section"], "left_semi")
    label = sections.section_label(F.col("section"))
    books = stage(texts.select("book", "title", F.lit("pdf").alias("source_type"), *(["source_path"] if "source_path" in texts.columns else [])), "books")
    shelf.replace("books", books)
    shelf.replace("sections", split.select("book", label.alias("file"), F.col("section").alias("ord"), "title").distinct(), books)
    return _store(shelf, split.select("book", label.alias("file"), F.col("ord").alias("idx"), F.col("text").alias("en")), unit_words, books)


def _of(book: str | None) -> Column:
    return F.lit(True) if book is None else F.col("book") == book


def build_glossary(shelf: Shelf, book: str | None, backend: model.Backend) -> dict[str, str] | int:
    """Ask for the glossary of one book, which is returned, or of all, with the number of entries. A book of which
    nothing came keeps what it has."""
    found = stage(names.build(shelf.paragraphs().filter(_of(book)), shelf.table("books"), backend), "glossary")
    if not found.isEmpty():
        shelf.replace("glossary", found)
    return found.count() if book is None else {r.en: r.zh for r in found.collect()}


def load_glossary(shelf: Shelf, book: str, file: str) -> dict[str, str]:
    """A glossary that was edited by hand, a JSON object, takes the place of the book's."""
    entries = json.loads(Path(file).read_text(encoding="utf-8"))
    shelf.replace("glossary", shelf.spark.createDataFrame([(book, str(k), str(v)) for k, v in entries.items()], "book string, en string, zh string"), shelf.spark.createDataFrame([(book,)], "book string"))
    return entries


def save_glossary(shelf: Shelf, book: str, file: str) -> None:
    entries = {r.en: r.zh for r in shelf.table("glossary").filter(F.col("book") == book).orderBy("en").collect()}
    Path(file).write_text(json.dumps(entries, ensure_ascii=False, indent=1), encoding="utf-8")


def translate(shelf: Shelf, book: str | None, backend: model.Backend, workers: int = 10, most: int = 5, pause: float = 5, wait=time.sleep) -> dict[str, int]:
    """Passes over the open units of a book, or of all books at once, until none is left or a pass gets nowhere. Each
    pass is written before it is read, so no unit is sent twice; after a pass that was told to slow down the next one
    waits, up to 300 seconds."""
    own = _of(book)
    about = shelf.table("books").groupBy("book").agg(F.max("title").alias("title"))
    known = shelf.table("glossary").groupBy("book").agg(F.sort_array(F.collect_list(F.struct("en", "zh"))).alias("names"))
    while True:
        current, paragraphs, cached = shelf.units().filter(own), shelf.paragraphs().filter(own), shelf.translations()
        todo = stage(model.pending_units(paragraphs, cached, current).join(about, "book", "left").join(known, "book", "left"), "todo")
        closed = state.workable(current, most).join(todo.select("book", F.col("unit_id").alias("id")), ["book", "id"], "left_anti")
        shelf.append("units", closed.withColumn("state", F.lit("done")).withColumn("updated_at", F.current_timestamp()))
        n = todo.count()
        if not n:
            break
        done = stage(model.translate_units(todo.repartition(min(n, workers)), "", backend), "pass")
        start = shelf.table("translations").agg(F.coalesce(F.max("seq"), F.lit(0))).head()[0]
        texts = done.filter("sha is not null").select("sha", "zh", F.lit("untested").alias("qa_state"), (F.lit(start) + 1 + F.xxhash64("sha").bitwiseAND(0x7FFFFFFF)).alias("seq"), "book")
        shelf.append("translations", texts)
        ended = done.groupBy("book", F.col("unit_id").alias("id")).agg(F.max("error").alias("error"))
        shelf.append("units", current.drop("error").join(ended, ["book", "id"]).withColumn("state", F.when(F.col("error").isNull(), "done").otherwise("failed")).withColumn("attempts", F.col("attempts") + 1).withColumn("updated_at", F.current_timestamp()))
        slow = not done.filter(F.col("error").rlike(RATE_LIMIT)).isEmpty()
        if slow:
            wait(pause)
            pause = min(pause * 2, 300)
        elif done.filter("error is null").isEmpty():
            break
    return {r.state: r["count"] for r in shelf.units().filter(own).groupBy("state").count().collect()}


def check(shelf: Shelf, book: str | None, backend: model.Backend, share: float = 0.20, seed: str = "seed", report: str | None = None) -> dict[str, int]:
    """Rules on texts nobody has checked; a judge on all flagged ones and a sample of those the rules let pass; failed
    ones are translated once more and taken if the rules find nothing. ``report``: folder for a page of Markdown a book."""
    own = _of(book)
    paragraphs = shelf.paragraphs().filter(own)
    current = shelf.translations().filter(own)
    ruled = stage(quality.checked(state.english_of(current.filter("qa_state = 'untested'"), paragraphs)), "ruled")
    shelf.append("translations", ruled.withColumn("seq", F.col("seq") + 1))
    passed = state.exact_sample(ruled.filter("qa_state = 'l1ok'").select("book", "sha"), ["book"], share, F.sha1(F.concat("sha", F.lit(seed))))
    flagged = shelf.translations().filter(own & (F.col("qa_state") == "l1flag")).select("book", "sha")
    targets = state.english_of(shelf.translations().join(flagged.unionByName(passed).distinct().select("sha"), "sha", "left_semi"), paragraphs)
    batches = state.batches(targets, ["book"], ["sha"]).groupBy("book", "batch").agg(F.collect_list(F.struct("sha", "en", "zh")).alias("pairs"))
    verdicts = stage(model.judge_batches(batches, backend), "verdicts")
    bad = quality.is_bad(F.col("faithful"), F.col("missing"), F.col("hallucinated"))
    reason = F.concat(F.lit("faithful="), "faithful", F.lit(",missing="), F.initcap(F.col("missing").cast("string")), F.lit(",halluc="), F.initcap(F.col("hallucinated").cast("string")))
    judged = targets.join(verdicts, "sha").withColumn("qa_state", F.when(bad, "failed").otherwise("passed")).withColumn("qa_reason", reason).withColumn("seq", F.col("seq") + 1)
    judged = stage(judged, "judged")
    shelf.append("translations", judged)
    again = judged.filter("qa_state = 'failed'").select(F.monotonically_increasing_id().alias("unit_id"), F.array(F.struct("sha", "en")).alias("texts"))
    second = stage(model.translate_units(again, model.translation_prompt({}), backend), "repairs").filter("sha is not null").select("sha", "zh")
    clean = quality.checked(judged.select("book", "sha", "en", "seq").join(second, "sha")).filter("qa_state = 'l1ok'")
    shelf.append("translations", clean.withColumn("qa_state", F.lit("repaired")).withColumn("qa_reason", F.lit("L3 repaired")).withColumn("seq", F.col("seq") + 1))
    if report:
        Path(report).mkdir(parents=True, exist_ok=True)
        for r in shelf.table("books").filter(own).select("book", "title").distinct().toLocalIterator():  # a page a book, each of bounded size
            Path(report, f"{r.book} qa.md").write_text(quality.report(shelf.translations(), paragraphs, r.book, r.title or r.book), encoding="utf-8")
    return {r.qa_state: r["count"] for r in shelf.translations().filter(own).groupBy("qa_state").count().collect()}


def export(shelf: Shelf, book: str | None, single: bool = False, font: str = "Noto Sans SC", normalize: bool = True, zh_style: str = ZH_STYLE) -> DataFrame:
    """book, name, content: the finished archives of one book or of all, made anew or from the source archives."""
    own = _of(book)
    about = shelf.table("books").filter(own)
    rows = stage(render.interleaved(shelf.paragraphs().filter(own), shelf.translations()), "interleaved")
    kinds = {r.source_type for r in about.select("source_type").distinct().collect()}
    made = about.filter("source_type is null or source_type <> 'epub'")
    plain = rows.join(made.select("book"), "book", "left_semi")
    fresh = epub_sink.archives(render.chapters(plain, shelf.table("sections").filter(own), single), about, single, style=reading_style((), font, normalize, zh_style))
    if kinds <= {"pdf", None}:
        return fresh
    paths = about.filter("source_type = 'epub'").select("book", "source_path")
    files = shelf.spark.read.format("binaryFile").load([r.source_path for r in paths.collect()])  # as many names as books
    source = stage(files.select(F.col("path").alias("source_path"), "content").join(paths, "source_path").select("book", "content"), "sources")
    large = large_classes(epub_source.stylesheets(source.withColumnRenamed("book", "source_path"))).groupBy(F.col("source_path").alias("book")).agg(F.sort_array(F.collect_set("class")).alias("large"))
    texts = rows.join(paths.select("book"), "book", "left_semi").select("book", "file", "idx", F.when(F.col("shown"), F.col("zh")).alias("zh"))
    styled = source.join(large, "book", "left").withColumn("large", F.coalesce("large", F.expr("cast(array() as array<string>)")))
    old = epub_sink.repackaged(styled, texts, toc.expanded(shelf.table("pages").filter(own)), single, lambda big: reading_style(big, font, normalize, zh_style))
    return old if kinds == {"epub"} else old.unionByName(fresh)


def status(shelf: Shelf, active: str = "") -> DataFrame:
    """book, line: the dashboard."""
    d = state.dashboard(shelf.units(), shelf.paragraphs(), shelf.translations())
    return d.select("book", status_line(F.col("book"), F.col("units"), F.col("done"), F.col("paragraphs"), F.col("translations"), F.col("failed"), F.col("book") == active).alias("line"))
