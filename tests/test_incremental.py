from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafmill.operators.versioned import IncrementalOutput, VersionedTable
from leafmill.plans.incremental import changed_records

LOG = "id long, state string, attempts int, updated_at timestamp, landed_at timestamp, _vt_file string"
T0 = datetime(2024, 3, 1)


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def log(spark, rows):
    return spark.createDataFrame([(i, s, a, at(u), at(l), "x") for i, s, a, u, l in rows], LOG)


def table(spark, path):
    return VersionedTable(spark, f"file://{path}", ["id"], ["state", "attempts"], "updated_at")


def runs(spark, rows):
    return spark.createDataFrame([(i, at(s), o) for i, s, o in rows], "run_id long, started_at timestamp, outcome string")


def test_changes_are_net(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.append_log(log(spark, [(1, "a", 0, 1, 1), (2, "a", 0, 1, 1), (None, "x", 0, 1, 1), (3, "a", 0, None, 1)]), F.col("landed_at"))
    t.append_log(log(spark, [(1, "b", 1, 2, 2), (2, "z", 0, 0, 2), (3, "b", 0, 0, 2)]), F.col("landed_at"))
    t.append_log(log(spark, [(1, "a", 0, 3, 3), (4, "n", 0, 3, 3)]), F.col("landed_at"))
    assert {(r.id, r.state) for r in t.read().collect()} == {(1, "a"), (2, "a"), (3, "b"), (4, "n")}
    got = lambda a, b: {(r.id, r.change) for r in t.changes(a, b).collect()}
    assert got(0, 1) == {(1, "new"), (2, "new"), (3, "new")}
    assert got(1, 2) == {(1, "changed"), (3, "changed")}
    assert got(1, 3) == {(3, "changed"), (4, "new")}  # 1 changed and changed back
    assert got(3, 3) == set()
    t.compact()
    assert got(1, 4) == {(3, "changed"), (4, "new")} and got(3, 4) == set()
    t.append_log(log(spark, [(2, "c", 9, 9, 9)]), F.col("landed_at"))
    assert got(3, 5) == {(2, "changed")} and got(1, 5) == {(2, "changed"), (3, "changed"), (4, "new")}
    assert t.read().count() == 4


def test_empty_slices_and_two_writers(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.append_log(log(spark, []), F.col("landed_at"))
    assert t.changes(0, 1).count() == 0
    other = table(spark, tmp_path / "t")
    m = other.manifest(1)
    with pytest.raises(RuntimeError):
        t._commit(m)


def test_output_survives_failures(spark, tmp_path):
    t, out = table(spark, tmp_path / "t"), IncrementalOutput(spark, f"file://{tmp_path}/o")
    keep = lambda kind, changes: changes.select("id")
    t.append_log(log(spark, [(1, "a", 0, 1, 1)]), F.col("landed_at"))
    out.run({"u": t}, keep)
    t.append_log(log(spark, [(2, "a", 0, 1, 2)]), F.col("landed_at"))
    with pytest.raises(Exception):
        out.run({"u": t}, lambda kind, changes: changes.select(F.raise_error(F.lit("worker lost")).alias("id")))
    assert out.processed("u") == 1 and out.read().count() == 1
    out.run({"u": t}, keep)
    out.run({"u": t}, keep)  # nothing new
    assert sorted(r.id for r in out.read().collect()) == [1, 2] and out.processed("u") == 2


def test_replay_of_runs(spark):
    units = [(1, "p", 0, 0, 1), (1, "d", 1, 5, 6), (1, "d", 1, 5, 7), (2, "p", 0, 2, 30), (1, "late", 0, -1, 11)]
    got = changed_records(spark, runs(spark, [(1, 2, "ok"), (2, 8, "failed"), (3, 10, "ok"), (4, 12, "ok"), (5, None, "ok"), (6, 31, None)]), {"unit": (log(spark, units), ["id"], ["state", "attempts"], "updated_at")})
    assert {(r.run_id, r.kind, r.rec) for r in got.collect()} == {(1, "unit", "1"), (3, "unit", "1")}
    assert changed_records(spark, runs(spark, []), {"unit": (log(spark, units), ["id"], ["state", "attempts"], "updated_at")}).count() == 0


def test_streaming_takes_each_batch_once(spark, tmp_path):
    from leafmill.streaming.arrivals import ingest

    t = table(spark, tmp_path / "t")
    source = f"file://{tmp_path}/in"
    first = log(spark, [(1, "a", 0, 1, 1)])
    first.write.parquet(source)
    ingest(spark, source, first.schema, t, f"file://{tmp_path}/cp").awaitTermination(60)
    log(spark, [(2, "a", 0, 1, 1)]).write.mode("append").parquet(source)
    ingest(spark, source, first.schema, t, f"file://{tmp_path}/cp").awaitTermination(60)
    assert sorted(r.id for r in t.read().collect()) == [1, 2]


def test_raced_commits_have_one_winner(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from leafmill.operators.versioned import Manifest

    def commit(k):
        try:
            return table(spark, tmp_path / "race")._commit(Manifest(k // 8 + 1, meta={"who": k}))
        except RuntimeError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(commit, range(80)))
    assert [sum(v == k for v in won) for k in range(1, 11)] == [1] * 10
    assert {table(spark, tmp_path / "race").manifest(k).meta["who"] // 8 + 1 for k in range(1, 11)} == set(range(1, 11))


def test_a_commit_reads_in_proportion_to_its_slice(spark, tmp_path):
    """The tenth slice of a hundred keys against tables of two sizes: what it reads doesn't follow the table."""
    read = []
    for n in (8_000, 64_000):
        t = VersionedTable(spark, f"file://{tmp_path}/{n}", ["id"], ["state"], "updated_at", part_bytes=4_000, small_bytes=10_000)
        rows = spark.range(n).select("id", F.sha1(F.col("id").cast("string")).alias("state"), F.lit(T0).alias("updated_at"), F.lit(T0).alias("landed_at"))
        t.append_log(rows, F.col("landed_at"))
        t.compact()
        for k in range(10):
            some = spark.range(4).select((F.col("id") * 977 + 31 * k).alias("id"), F.lit(f"s{k}").alias("state"), F.lit(T0 + timedelta(hours=k + 1)).alias("updated_at"), F.lit(T0).alias("landed_at"))
            t.append_log(some, F.col("landed_at"))
        last = [m for m in map(t.manifest, t.versions()) if m.data_change][-1]
        read.append(last.meta["read_bytes"])
        assert t.read().count() == n and {r.state for r in t.read().filter("id in (279, 1256)").collect()} == {"s9"}
    assert read[1] < 2 * read[0]


def test_merged_runs_change_no_record(spark, tmp_path):
    import random

    rng = random.Random(2)
    t = VersionedTable(spark, f"file://{tmp_path}/t", ["id"], ["state", "attempts"], "updated_at", part_bytes=3_000, small_bytes=1_000)
    standing, upto = [{}], [0]
    for k in range(20):
        rows = [(rng.randrange(60), rng.choice("abc"), rng.randrange(2), k + rng.choice((0, 0, -3)), k) for _ in range(12)]
        t.append_log(log(spark, rows), F.col("landed_at"))
        upto.append(t.latest())
        now = dict(standing[-1])
        for i, s, a, u, l in rows:
            if i not in now or (u, l, s, a) > now[i]:
                now[i] = (u, l, s, a)
        standing.append(now)
    assert any(not t.manifest(v).data_change for v in t.versions()) and max(len(t._runs(v)) for v in t.versions()) < 12
    for a, b in [(0, 20), (3, 17), (9, 10), (12, 20), (19, 20)]:
        got = {(r.id, r.change) for r in t.changes(upto[a], upto[b]).collect()}
        before, after = standing[a], standing[b]
        assert got == {(i, "changed" if i in before else "new") for i in after if i not in before or before[i][2:] != after[i][2:]}
    assert {(r.id, r.state, r.attempts) for r in t.read().collect()} == {(i, v[2], v[3]) for i, v in standing[-1].items()}


def test_removed_files_take_their_records_with_them(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.append_log(log(spark, [(1, "a", 0, 1, 1), (2, "a", 0, 1, 1), (3, "a", 0, 1, 1)]), F.col("landed_at"))
    t.append_log(log(spark, [(1, "b", 0, 2, 2), (4, "a", 0, 2, 2)]), F.col("landed_at"))
    t.remove_files(t.manifest(1).added)
    got = lambda a, b: {(r.id, r.change) for r in t.changes(a, b).collect()}
    assert got(1, 3) == {(1, "changed"), (2, "gone"), (3, "gone"), (4, "new")} and got(2, 3) == {(2, "gone"), (3, "gone")} and got(0, 3) == {(1, "new"), (4, "new")}
    t.append_log(log(spark, [(2, "c", 0, 0, 3)]), F.col("landed_at"))
    assert got(3, 4) == {(2, "new")} and got(2, 4) == {(2, "changed"), (3, "gone")}
    t.remove_files(t.manifest(2).added)
    assert got(4, 5) == {(1, "gone"), (4, "gone")} and {r.id for r in t.read().collect()} == {2}
    t.append_log(log(spark, [(1, "z", 0, 0, 4)]), F.col("landed_at"))
    assert {(r.id, r.state) for r in t.read().collect()} == {(1, "z"), (2, "c")} and got(5, 6) == {(1, "new")}
