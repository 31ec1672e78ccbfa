import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import layout, log_runs, ordered, reports
from pagemill.session import spread

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def requests():
    dice, rows = random.Random(3), []
    for domain, size in [("hot", 1500), ("b", 300), ("c", 20)]:
        second = 0
        for _ in range(size):
            second += dice.choice([0, 1, 3, 10, 30, 70])
            rows.append((domain, START + dt.timedelta(seconds=second), len(rows), dice.random() < 0.4))
    return rows


def by_domain(rows):
    for domain in ["hot", "b", "c"]:
        yield domain, sorted([r for r in rows if r[0] == domain], key=lambda r: (r[1], r[2]))


@pytest.fixture
def log(spark, requests):
    return spark.createDataFrame(requests, "domain string, ts timestamp, request_id long, ok boolean")


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_results_do_not_depend_on_partitions(spark, log, requests, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbers = {r.request_id: r.row_no for r in ordered.numbered(log, ["domain"], ["ts", "request_id"]).collect()}
        runs = {(r.domain, r.successes_before): r for r in log_runs.failure_runs(log).collect()}
        gaps = {r.request_id: r.gap_seconds for r in log_runs.short_gaps(log, 20.0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for domain, rows in by_domain(requests):
        good, last, failed = 0, None, {}
        for number, (_, ts, request, ok) in enumerate(rows, 1):
            assert numbers[request] == number
            gap = (ts - last).total_seconds() if last else 99
            assert gaps.get(request) == (gap if gap < 20 else None)
            last = ts
            good += ok
            if not ok:
                failed.setdefault(good, []).append(ts)
        assert {k for d, k in runs if d == domain} == set(failed)
        for k, times in failed.items():
            run = runs[domain, k]
            assert (run.failures, run.first_failure, run.last_failure, run.recovered) == (len(times), times[0], times[-1], good > k)


def test_null_keys_are_a_group(spark):
    rows = [(None, n) for n in range(50)] + [("k", n) for n in range(50)]
    got = ordered.numbered(spark.createDataFrame(rows, "k string, i long"), ["k"], ["i"])
    assert {(r.k, r["max(row_no)"], r["count(1)"]) for r in got.groupBy("k").agg(F.max("row_no"), F.count("*")).collect()} == {(None, 50, 50), ("k", 50, 50)}


def test_priority_and_chunks(spark):
    tasks = spark.createDataFrame([(n, n % 3, n) for n in range(100)], "task_id long, priority int, seq long")
    got = [r.task_id for r in ordered.priority_order(tasks).orderBy("place").collect()]
    assert got == sorted(range(100), key=lambda n: (-(n % 3), n))
    chunks = ordered.chunk(tasks, ["seq"], 30).groupBy("chunk_no").count().orderBy("chunk_no").collect()
    assert [r["count"] for r in chunks] == [30, 30, 30, 10]
    assert sorted(r.task_id for r in ordered.first_rows(tasks, ["seq"], 7).collect()) == list(range(7))


def free_names(files):
    first = {}
    for _, name, seq in files:
        first.setdefault(name, seq)
    taken, out = set(first), {}
    for _, name, seq in files:
        stem, ext = os.path.splitext(name)
        number, new = 1, name
        while first[name] != seq and new in taken:
            new, number = f"{stem}_{number}{ext}", number + 1
        taken.add(new)
        out[seq] = new
    return out


def test_dup_suffix(spark):
    dice = random.Random(1)
    names = ["a.pdf", "a_1.pdf", "a_2.pdf", "a_4.pdf", "b", "a_1_1.pdf", ".x", "c_02.txt", "c.txt", "c_2.txt"]
    files = [("d", dice.choice(names), n) for n in range(300)]
    got = {r.seq: r.new_name for r in layout.dup_suffix(spark.createDataFrame(files, "dir string, name string, seq long")).collect()}
    assert got == free_names(files)
    assert len(set(got.values())) == 300


def test_organize_defaults(spark):
    files = spark.createDataFrame([(1, None, None, "x?.pdf"), (2, "C: 1", "reading", "x?.pdf")], "seq long, course string, type string, name string")
    got = {r.seq: (r.dir, r.new_name) for r in layout.organize_batch(files, "out").collect()}
    assert got == {1: ("out/Unknown/misc", "x_.pdf"), 2: ("out/C_1/readings", "x_.pdf")}


def test_recent_files_cut_before_the_shuffle(spark):
    files = spark.createDataFrame([("c", f"n{n}", START, n) for n in range(9)], "course string, name string, mtime timestamp, seq long")
    plan = reports.recent_files(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_empty_log(spark):
    empty = spark.createDataFrame([], "domain string, ts timestamp, request_id long, ok boolean, latency double, bytes long")
    row = reports.global_metrics(empty).first()
    assert (row.total_requests, row.avg_latency, row.domains) == (0, 0.0, 0)
    assert log_runs.failure_runs(empty).count() == 0 and log_runs.short_gaps(empty, 5.0).count() == 0


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    spark.range(0, 100_000, 1, 1).write.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = spark.read.parquet(str(tmp_path / "one"))
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        dealt = spread(rows, narrow=True).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r["count"] for r in dealt) == 100_000
    assert max(r["count"] for r in dealt) < 30_000
