"""Processing only new or changed records, by diffs of immutable table versions.

A versioned table is a folder of Parquet files that are never changed, and one small manifest a version. A manifest
names the files its version added, the files it removed and its deletion vectors (file and row position of every row
that ceased to stand, with the row as it was). What changed between two versions is read from the manifests between
them alone: files added, files removed and deletion vectors give the rows before and after, and never the whole table.

A version's files are a run. To take in a slice of a log, the standing rows of the slice's keys are looked up: small
runs are read whole, larger ones are divided by a prefix of the key's hash and only the parts that a key of the slice
falls into are read. Runs of like size are merged once there are ``FAN_IN`` of them, so there are few, a row is
rewritten a logarithmic number of times, and the cost of a commit follows the slice and not the table.

A consumer keeps no separate bookmark: the commit of its output holds the version of the source it has processed. The
commit is one manifest, created exclusively, so a run that dies before it has no effect, and one that is run again
starts from the last version that is in the output. No record is skipped or processed twice.

Defined results for odd input: a row whose key is null is no record and is left out; a row without an order value is
the oldest version of its record; of versions with equal order the one that arrived last stands, and if that is equal
too the one with the greatest tracked values; repeated rows change nothing; an empty slice gives an empty version;
columns of the input beyond those named are ignored, so names such as ``_file`` may clash freely.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.runtime import stage

FAN_IN = 8  # runs of like size that are merged
PART_BYTES = 64 << 20  # of a run's part
SMALL_BYTES, MOST_RUNS = 8 << 20, 32  # small runs are merged only when they come to so much, or are so many
MOST_PARTS = 1 << 16
FILE, POS, BORN = "_vt_file", "_vt_pos", "_vt_born"


@dataclass
class Manifest:
    version: int
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    vectors: list[str] = field(default_factory=list)
    data_change: bool = True
    meta: dict = field(default_factory=dict)


class VersionedTable:
    """``key``: columns that name a record; ``tracked``: columns whose values count; ``order``: column that orders
    the versions of a record. ``part_bytes``, ``small_bytes``: sizes of parts and of runs too small to merge."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], tracked: list[str], order: str | None = None, part_bytes: int = PART_BYTES, small_bytes: int = SMALL_BYTES):
        self.spark, self.path, self.key, self.tracked, self.order = spark, path.rstrip("/"), key, tracked, order
        self.part_bytes, self.small_bytes = part_bytes, small_bytes
        self._cache: dict[int, Manifest] = {}

    # -- files --------------------------------------------------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/_manifests/{version:012d}.json"

    def _files(self, folder: str) -> dict[str, int]:
        """Data files and their bytes."""
        fs, p = self._fs(folder)
        return {s.getPath().toString(): s.getLen() for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().getName()) if s.getPath().getName().startswith("part-") and s.getLen() > 0}

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_manifests")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def latest(self) -> int:
        """The newest version; 0 is the empty table."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> Manifest:
        if version not in self._cache:
            fs, p = self._fs(self._manifest_path(version))
            size = fs.getFileStatus(p).getLen()
            stream = fs.open(p)
            try:
                data = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
            finally:
                stream.close()
            self._cache[version] = Manifest(**json.loads(data.decode()))
        return self._cache[version]

    def _commit(self, manifest: Manifest) -> int:
        """Create the manifest exclusively and whole: of two writers of one version one fails and changes nothing. On
        a local disk by a hard link, on HDFS by a rename, which both refuse a name that is taken; elsewhere by a create
        that must not overwrite, which object stores that can do it turn into a conditional put."""
        fs, p = self._fs(self._manifest_path(manifest.version))
        fs.mkdirs(p.getParent())
        data, scheme = json.dumps(manifest.__dict__).encode(), fs.getUri().getScheme()
        draft = f"{self.path}/_manifests/.{uuid.uuid4().hex}"
        taken = RuntimeError(f"version {manifest.version} of {self.path} was committed by another writer")
        if scheme == "file":
            final = p.toUri().getPath()
            draft = os.path.join(os.path.dirname(final), os.path.basename(draft))
            with open(draft, "wb") as out:
                out.write(data)
            try:
                os.link(draft, final)
            except FileExistsError:
                raise taken from None
            finally:
                os.remove(draft)
        elif scheme in ("hdfs", "viewfs", "webhdfs"):
            part = self.spark._jvm.org.apache.hadoop.fs.Path(draft)
            self._put(fs, part, data)
            if not fs.rename(part, p):
                fs.delete(part, False)
                raise taken
        else:
            try:
                self._put(fs, p, data)
            except Exception as error:
                raise taken from error
        self._cache[manifest.version] = manifest
        return manifest.version

    @staticmethod
    def _put(fs, path, data: bytes) -> None:
        out = fs.create(path, False)
        out.write(data)
        out.close()

    # -- reading ------------------------------------------------------------------------------------------------
    def _columns(self) -> list[str]:
        return [*self.key, *self.tracked, *([self.order] if self.order else []), "_vt_arrived"]

    def _read(self, files: list[str]) -> DataFrame:
        # the manifest has the schema: inferring it would be a job for every read
        return self.spark.read.schema(self._schema()).parquet(*files)

    def _rows(self, files: list[str]) -> DataFrame:
        return self._read(files).withColumns({FILE: F.col("_metadata.file_path"), POS: F.col("_metadata.row_index")})

    def _dead(self, vectors: list[str]) -> DataFrame:
        """The deletion vectors that files carry beside their rows: where the replaced row stands and how it was."""
        return self._read(vectors).filter(F.col("_vt_dead").isNotNull())

    def _schema(self) -> StructType:
        return StructType.fromJson(next(self.manifest(v).meta["schema"] for v in reversed(self.versions()) if "schema" in self.manifest(v).meta))

    def _state(self, version: int) -> tuple[list[str], list[str]]:
        files: dict[str, None] = {}
        vectors: dict[str, None] = {}
        for v in [v for v in self.versions() if v <= version]:
            m = self.manifest(v)
            for f in m.removed:
                files.pop(f, None)
            if not files:  # what the vectors point at is gone
                vectors.clear()
            files.update(dict.fromkeys(m.added))
            vectors.update(dict.fromkeys(m.vectors))
        return list(files), list(vectors)

    def _runs(self, version: int) -> list[tuple[dict[str, int], int]]:
        """(standing files with their bytes, bits of the hash that its parts are divided by) of each run."""
        standing = set(self._state(version)[0])
        out = []
        for v in [v for v in self.versions() if v <= version]:
            m = self.manifest(v)
            files = {f: n for f, n in zip(m.added, m.meta.get("bytes", [0] * len(m.added))) if f in standing}
            if files:
                out.append((files, m.meta.get("bits", 0)))
        return out

    def _part(self, bits: int) -> Column:
        """The part of a run that a key belongs to: the first bits of its hash."""
        return F.shiftrightunsigned(F.xxhash64(*self.key), 64 - bits).cast("int") if bits else F.lit(0)

    def _live(self, files: list[str], vectors: list[str]) -> DataFrame | None:
        if not files:
            return None
        rows = self._rows(files)
        if vectors:
            rows = rows.join(self._dead(vectors).select(F.col("_vt_dead.file").alias(FILE), F.col("_vt_dead.pos").alias(POS)), [FILE, POS], "left_anti")
        return rows

    def read(self, version: int | None = None) -> DataFrame | None:
        """The standing rows of a version; None where the table is still empty."""
        live = self._live(*self._state(self.latest() if version is None else version))
        return None if live is None else live.select(*self._columns())

    # -- writing ------------------------------------------------------------------------------------------------
    def _write(self, df: DataFrame, kind: str, version: int) -> dict[str, int]:
        folder = f"{self.path}/{kind}/{version:012d}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self._files(folder)

    def _rank(self, order: Column, arrived: Column) -> Column:
        return F.struct(order.isNotNull().alias("known"), order.alias("at"), arrived.isNotNull().alias("came"), arrived.alias("arrived"), *[F.col(c) for c in self.tracked])

    def append_log(self, rows: DataFrame, arrived: Column | None = None, meta: dict | None = None) -> int:
        """Take in a slice of a change log as the next version: a record's newest version stands."""
        version = self.latest() + 1
        order = F.col(self.order) if self.order else F.lit(None).cast("long")
        arrived = F.lit(None).cast("timestamp") if arrived is None else arrived
        slim = rows.select(*self.key, *self.tracked, *([order.alias(self.order)] if self.order else []), arrived.alias("_vt_arrived"))
        for k in self.key:
            slim = slim.filter(F.col(k).isNotNull())
        newest = slim.groupBy(*self.key).agg(F.max(self._rank(order, F.col("_vt_arrived"))).alias("new"))
        newest, files, read = self._looked_up(newest, version - 1)
        place = "struct<file:string,pos:bigint,born:bigint>"
        if not files:
            merged = newest.withColumn("dead", F.lit(None).cast(place)).withColumn("old", F.lit(None).cast(newest.schema["new"].dataType))
        else:  # of the rows a key ever had the last born stands, unless its file was removed with it
            dropped = any(m.data_change and m.removed for m in map(self.manifest, self.versions()))
            found = self._live(files, self._state(version - 1)[1]) if dropped else self._rows(files)
            ever = found.select(*self.key, F.struct(F.col(BORN).alias("born"), F.col(FILE).alias("file"), F.col(POS).alias("pos"), self._rank(order, F.col("_vt_arrived")).alias("old")).alias("was"))
            last = newest.join(ever, self.key, "left").groupBy(*self.key).agg(F.max("new").alias("new"), F.max("was").alias("was"))
            dead = F.when(F.col("was").isNotNull(), F.struct(F.col("was.file").alias("file"), F.col("was.pos").alias("pos"), F.col("was.born").alias("born")).cast(place))
            merged = last.select(*self.key, "new", F.col("was.old").alias("old"), dead.alias("dead"))
        fresh = merged.filter(F.col("dead").isNull() | (F.col("new") > F.col("old"))).select(
            *self.key,
            *[F.col(f"new.{c}").alias(c) for c in self.tracked],
            *([F.col("new.at").alias(self.order)] if self.order else []),
            F.col("new.arrived").alias("_vt_arrived"),
            F.lit(version).cast("long").alias(BORN),
            F.col("dead").alias("_vt_dead"),
            F.when(F.col("dead").isNotNull(), F.struct(*[F.col(f"old.{c}").alias(c) for c in self.tracked])).alias("_vt_was"),
        )
        added = self._write(fresh, "data", version)
        own = {"schema": fresh.schema.jsonValue(), "bytes": list(added.values()), "read_files": len(files), "read_bytes": read}
        self._commit(Manifest(version, list(added), [], list(added) if files else [], True, own | (meta or {})))
        return self._merge_runs(version)

    def _looked_up(self, newest: DataFrame, version: int) -> tuple[DataFrame, list[str], int]:
        """The slice, the files that may hold a standing row of its keys, and their bytes."""
        runs = self._runs(version)
        bits = max((b for _, b in runs), default=0)
        if not bits:
            return newest, [f for files, _ in runs for f in files], sum(n for files, _ in runs for n in files.values())
        newest = stage(newest, "slice")
        touched = {r.part for r in newest.select(self._part(bits).alias("part")).distinct().collect()}  # at most MOST_PARTS numbers
        out: dict[str, int] = {}
        for files, own in runs:
            parts = {p >> (bits - own) for p in touched}
            out |= {f: n for f, n in files.items() if not own or int(f.rsplit("/", 1)[1].split("-")[1]) in parts}
        return newest, list(out), sum(out.values())

    def _merge_runs(self, version: int) -> int:
        """Merge runs of like size where there are ``FAN_IN`` of them. Returns the newest version."""
        levels: dict[int, list[dict[str, int]]] = {}
        for files, _ in self._runs(version):
            levels.setdefault(max(0, int(math.log(max(sum(files.values()), 1) / self.small_bytes, FAN_IN)) + 1) if sum(files.values()) >= self.small_bytes else 0, []).append(files)
        for _, runs in sorted(levels.items()):
            size = sum(n for files in runs for n in files.values())
            if len(runs) >= MOST_RUNS or (len(runs) >= FAN_IN and size >= self.small_bytes):
                return self._rewrite([f for files in runs for f in files], size)
        return version

    def remove_files(self, files: list[str]) -> int:
        """Take files, and so the records that stand in them, out of the table."""
        return self._commit(Manifest(self.latest() + 1, [], list(files), [], True))

    def compact(self) -> int:
        """Rewrite the standing rows without dead ones. No record changes: rows keep the version they were born in."""
        files = [(f, n) for run, _ in self._runs(self.latest()) for f, n in run.items()]
        return self._rewrite([f for f, _ in files], sum(n for _, n in files)) if files else self.latest()

    def _rewrite(self, files: list[str], size: int) -> int:
        """Write the standing rows of some files as one run, divided into parts where it is large."""
        version = self.latest() + 1
        live = self._live(files, self._state(version - 1)[1])
        none = {c: F.lit(None).cast(live.schema[c].dataType) for c in ("_vt_dead", "_vt_was")}
        bits = min(max(0, math.ceil(math.log2(max(size, 1) / self.part_bytes))), int(math.log2(MOST_PARTS)))
        rows = live.drop(FILE, POS).withColumns(none)
        added = self._write(rows.repartitionById(1 << bits, self._part(bits)) if bits else rows, "data", version)
        return self._commit(Manifest(version, list(added), files, [], False, {"bytes": list(added.values()), "bits": bits}))

    # -- changes ------------------------------------------------------------------------------------------------
    def changes(self, since: int, upto: int | None = None) -> DataFrame:
        """Net record deltas between two versions: key, ``change`` (new, changed, gone) and the tracked values after.

        Read: the files that the versions between have added, whether or not they were merged since. In each a record
        has one row at most, with the deletion vector of the row it replaced: of those of one record the last gives the
        values after, the vector of the first the values before. A record whose tracked values are the same at both
        ends is not among them, however often it changed between."""
        upto = self.latest() if upto is None else upto
        between = [m for m in (self.manifest(v) for v in self.versions() if since < v <= upto) if m.data_change]
        added = [f for m in between for f in m.added]
        gone = [f for m in between for f in m.removed]
        values = F.struct(*[F.col(c) for c in self.tracked])
        ends = self._ends()
        if added:
            first = F.min_by(F.struct(F.col("_vt_dead.born").alias("born"), F.col("_vt_was").alias("was")), BORN)
            last = F.max(BORN)
            if gone:  # a removed file may be one of those between
                last = F.max(F.when(~F.col(FILE).isin(gone), F.col(BORN)))
            ends = self._rows(added).groupBy(*self.key).agg(F.max_by(values, BORN).alias("now"), first.alias("first"), last.alias("last"))
            ends = ends.select(*self.key, F.when(F.col("last").isNotNull(), F.col("now")).alias("now"), F.col("first.was").alias("was"))
        if gone:
            stood = self._state(since)
            before = self._live([f for f in gone if f in set(stood[0])], stood[1]) if set(gone) & set(stood[0]) else None
            if before is not None:
                ends = ends.join(before.select(*self.key, values.alias("stood")), self.key, "full_outer").select(*self.key, "now", F.coalesce("was", "stood").alias("was"))
        change = F.when(F.col("was").isNull() & F.col("now").isNotNull(), "new").when(F.col("now").isNull() & F.col("was").isNotNull(), "gone").when(~F.col("now").eqNullSafe(F.col("was")), "changed")
        return ends.withColumn("change", change).filter(F.col("change").isNotNull()).select(*self.key, "change", *[F.col(f"now.{c}").alias(c) for c in self.tracked])

    def _ends(self) -> DataFrame:
        values = F.struct(*[F.col(c) for c in self.tracked])
        return self.spark.createDataFrame([], self._schema()).select(*self.key, values.alias("now"), values.alias("was"))


class IncrementalOutput:
    """The output of a consumer. Each commit holds the rows of one run and the version of each source it covers."""

    def __init__(self, spark: SparkSession, path: str):
        self._table = VersionedTable(spark, path, [], [])
        self.spark = spark

    def processed(self, source: str) -> int:
        """The version of ``source`` that the last commit covers; 0 before the first."""
        latest = self._table.latest()
        return int(self._table.manifest(latest).meta["sources"].get(source, 0)) if latest else 0

    def run(self, sources: dict[str, VersionedTable], work) -> int:
        """Process what changed since the last commit. ``work(name, changes)`` gives the rows to keep for each source;
        if it or the write fails nothing is committed and the next run covers the same changes."""
        latest = self._table.latest()
        covered = dict(self._table.manifest(latest).meta["sources"]) if latest else {}
        upto = {name: table.latest() for name, table in sources.items()}
        parts = [work(name, table.changes(covered.get(name, 0), upto[name])) for name, table in sources.items() if upto[name] > covered.get(name, 0)]
        added: list[str] = []
        meta: dict = {"sources": covered | upto}
        if parts:
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            added = list(self._table._write(out, "data", latest + 1))
            meta["schema"] = out.schema.jsonValue()
        return self._table._commit(Manifest(latest + 1, added, [], [], True, meta))

    def read(self) -> DataFrame | None:
        files = [f for v in self._table.versions() for f in self._table.manifest(v).added]
        return self._table._read(files) if files else None
