"""p1: for each successful run the units and translations that are new or changed since the successful run before."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.versioned import IncrementalOutput, VersionedTable
from leafmill.runtime import load, scratch

FOUND = "run_id long, kind string, rec string"


def changed_records(spark: SparkSession, runs: DataFrame, logs: dict[str, tuple[DataFrame, list[str], list[str], str]]) -> DataFrame:
    """Replay a log of runs over change logs that keep arriving.

    ``logs``: kind -> (log with ``landed_at``, key columns, tracked columns, order column). Before each run, whatever
    its outcome, the rows landed since the run before are taken into the versioned table; a run whose outcome is not
    ``ok`` commits no output. ``runs`` has one row a run of the job, so it is read to the driver: it grows with the
    number of runs and not with the data. Runs without a start see nothing; runs that start together are taken by id."""
    root = scratch(spark, "p1")
    sources = {kind: VersionedTable(spark, f"{root}/{kind}", key, tracked, order) for kind, (_, key, tracked, order) in logs.items()}
    output = IncrementalOutput(spark, f"{root}/out")
    done = None
    plan = runs.select("run_id", "started_at", "outcome").distinct().filter("started_at is not null").withColumn("us", F.unix_micros("started_at")).orderBy("us", "run_id").collect()
    for run in plan:
        if done is None or run.us > done:
            upto = F.col("landed_at") <= F.timestamp_micros(F.lit(run.us))  # literals, so that the scan can skip what landed at other times
            cut = upto if done is None else upto & (F.col("landed_at") > F.timestamp_micros(F.lit(done)))
            with ThreadPoolExecutor(len(sources)) as pool:  # the tables are independent; each commit is a few short jobs
                list(pool.map(lambda kind: sources[kind].append_log(logs[kind][0].filter(cut), F.col("landed_at"), {"upto": run.us}), sources))
        done = run.us
        if run.outcome == "ok":
            output.run(sources, lambda kind, changes, run_id=run.run_id: changes.filter("change <> 'gone'").select(F.lit(run_id).cast("long").alias("run_id"), F.lit(kind).alias("kind"), F.col(logs[kind][1][0]).cast("string").alias("rec")))
    found = output.read()
    return spark.createDataFrame([], FOUND) if found is None else found


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_records(
        spark,
        load(spark, sf_dir, "run_log"),
        {
            "unit": (load(spark, sf_dir, "units"), ["id"], ["state", "attempts"], "updated_at"),
            "translation": (load(spark, sf_dir, "translations"), ["sha"], ["qa_state"], "seq"),
        },
    )


P1_SQL = """
with ok as (select run_id, started_at, lag(started_at) over (order by started_at, run_id) as before from (select distinct run_id, started_at, outcome from run_log) where outcome = 'ok' and started_at is not null),
logs as (
  select 'unit' as kind, cast(id as varchar) as rec, updated_at as moved, 0 as seq, landed_at, concat_ws('|', coalesce(state, '~'), coalesce(cast(attempts as varchar), '~')) as v from units where id is not null
  union all
  select 'translation', sha, null, seq, landed_at, coalesce(qa_state, '~') from translations where sha is not null
),
seen as (
  select run_id, before, kind, rec, v, row_number() over (partition by run_id, kind, rec order by moved desc nulls last, seq desc nulls last, landed_at desc, v desc) as n
  from ok join logs on landed_at <= started_at
),
was as (
  select run_id, kind, rec, v, row_number() over (partition by run_id, kind, rec order by moved desc nulls last, seq desc nulls last, landed_at desc, v desc) as n
  from ok join logs on landed_at <= before
)
select a.run_id, a.kind, a.rec from (select * from seen where n = 1) a left join (select * from was where n = 1) b on a.run_id = b.run_id and a.kind = b.kind and a.rec = b.rec
where b.v is null or a.v <> b.v
"""
