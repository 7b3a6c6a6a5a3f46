"""What every operator needs of the session: a shared folder, staged tables and the package on the executors."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN_DIRS: dict[str, str] = {}
_SCRATCHED: set[str] = set()


def session(name: str = "leafmill", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is meant for; on a cluster use the cluster's own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where that is unset (tests, one machine) an own folder is made."""
    set_there = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_there:
        return set_there.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(_remove_local, _OWN_DIRS[app])
    return f"file://{_OWN_DIRS[app]}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def _remove_shared(spark: SparkSession, path: str) -> None:
    """At the end of the program, what it has staged; a program that was killed leaves its folder, named by its id."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
    except Exception:  # the JVM is gone already
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, in a folder of the application that goes when the program ends."""
    app = spark.sparkContext.applicationId
    own = f"{shared_dir(spark)}/leafmill/{app}"
    if app not in _SCRATCHED:
        _SCRATCHED.add(app)
        atexit.register(_remove_shared, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives the loss of executors,
    and keeps Python stages from running twice when two later stages read them."""
    path = scratch(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for each application. Arrow batches get their usual size
    again, in case an operator over large rows was built before."""
    tune_arrow(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(Path(root.name) / path.relative_to(root)))
    target = f"{scratch(spark, 'package')}/leafmill_pkg.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)
    try:
        out.write(data.getvalue())
    finally:
        out.close()
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def tune_arrow(spark: SparkSession, rows: int = 2000) -> None:
    """Long texts: keep one Arrow batch to a few MB so that a Python worker's memory stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once, as far as the session knows; used only to choose partition counts."""
    return max(2, spark.sparkContext.defaultParallelism)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
