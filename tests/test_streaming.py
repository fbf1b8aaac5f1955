"""A stream gives what the batch job gives on the same rows, also after a restart."""

import json

import pytest
from helpers import rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.session import work_path
from tidemark.streaming import jobs
from tidemark.operators.states import State
from tidemark.streaming.logs import BatchLog, HistoryLog, RollupLog, SumLog, UpsertLog


def deliver(df, path):
    df.write.mode("append").parquet(path)


def test_upsert_restart_and_compaction(spark):
    path, check = work_path(spark, "in"), work_path(spark, "check")
    table = UpsertLog(spark, work_path(spark, "t"), ["k"], "v")
    first = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, x string")
    deliver(first, path)
    go = lambda: jobs.run_to_end(jobs.stream_upsert(jobs.file_stream(spark, path, first.schema), table, check))
    go()
    assert rows(table.read()) == [(1, 2, "b"), (2, 1, "c")]
    table.compact()
    deliver(spark.createDataFrame([(2, 5, "d"), (1, 1, "late"), (3, 1, "e")], "k int, v int, x string"), path)
    go()
    want = [(1, 2, "b"), (2, 5, "d"), (3, 1, "e")]
    assert rows(table.read()) == want
    go()  # nothing new
    assert rows(table.read()) == want and rows(table.compact()) == want


def test_replayed_batch_counts_once(spark):
    log = SumLog(spark, work_path(spark, "sums"), ["k"], {"n": F.count(F.lit(1))})
    batch = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    log.apply(batch, 0)
    log.apply(batch, 0)
    log.apply(batch, 1)
    assert rows(log.read()) == [(1, 4), (2, 2)]
    assert rows(log.compact()) == [(1, 4), (2, 2)]
    log.apply(batch, 1)  # delivered again after the compaction
    log.apply(batch, 2)
    assert rows(log.read()) == [(1, 6), (2, 3)] and rows(log.compact()) == [(1, 6), (2, 3)]


def test_trend_matches_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = work_path(spark, "events")
    deliver(events.filter("event_id % 2 = 0"), path)
    deliver(events.filter("event_id % 2 = 1"), path)
    table = UpsertLog(spark, work_path(spark, "trend"), ["time_period"])
    trend = jobs.stream_trend(jobs.file_stream(spark, path, events.schema, max_files=1), "ts", "hour", "60 days", {"n": F.count(F.lit(1))})
    jobs.run_to_end(jobs.stream_trend_table(trend, table))
    want = events.groupBy(F.date_trunc("hour", "ts").alias("time_period")).agg(F.count("*").alias("n"))
    assert rows(table.read(), "time_period", "n") == rows(want)


def test_second_loads_without_a_given_checkpoint(spark):
    """Runs on two deliveries with a compaction between, then another source, which needs a checkpoint of its own."""
    schema = "k int, n int"
    loads = [spark.createDataFrame(r, schema) for r in ([(1, 10), (2, 5)], [(1, 9), (99, 1)], [(1, 1), (7, 7)])]
    one, two = work_path(spark, "one"), work_path(spark, "two")
    out, sums, latest = work_path(spark, "out"), SumLog(spark, work_path(spark, "s"), ["k"], {"n": F.sum("n")}), UpsertLog(spark, work_path(spark, "u"), ["k"])

    def go(path, *checkpoints):
        jobs.run_to_end(jobs.incremental_rollup(jobs.file_stream(spark, path, loads[0].schema), sums, *checkpoints[:1]))
        jobs.run_to_end(jobs.stream_upsert(jobs.file_stream(spark, path, loads[0].schema), latest, *checkpoints[1:]))

    ingest = lambda path: jobs.run_to_end(jobs.stream_ingest(jobs.file_stream(spark, path, loads[0].schema), out))
    deliver(loads[0], one)
    go(one)
    ingest(one)
    sums.compact()
    latest.compact()
    deliver(loads[1], one)
    go(one)
    ingest(one)
    assert spark.read.parquet(out).count() == 4
    assert rows(sums.read()) == [(1, 19), (2, 5), (99, 1)] and rows(latest.read()) == [(1, 9), (2, 5), (99, 1)]
    deliver(loads[2], two)
    go(two, work_path(spark, "c"), work_path(spark, "c"))
    with pytest.raises(StreamingQueryException):  # the file sink would take another source's batches for known ones
        ingest(two)
    assert rows(sums.read()) == [(1, 20), (2, 5), (7, 7), (99, 1)] and rows(latest.compact()) == [(1, 1), (2, 5), (7, 7), (99, 1)]


def test_streams_with_their_own_checkpoints_do_not_meet(spark):
    sums = SumLog(spark, work_path(spark, "s"), ["k"], {"n": F.count(F.lit(1))})
    for _ in range(2):
        path = work_path(spark, "in")
        deliver(spark.createDataFrame([(1,)], "k int"), path)
        jobs.run_to_end(jobs.incremental_rollup(jobs.file_stream(spark, path, spark.createDataFrame([(1,)], "k int").schema), sums, work_path(spark, "c")))
    assert rows(sums.read()) == [(1, 2)]


def test_history_does_not_depend_on_the_order_of_deliveries(spark):
    changes = [(1, "a", "2024-01-01"), (1, "a", "2024-01-03"), (1, "b", "2024-01-02"), (2, "x", "2024-01-05"), (2, "x", "2024-01-06")]
    frames = [spark.createDataFrame([c], "k int, v string, at string").selectExpr("k", "v", "cast(at as timestamp_ntz) as at") for c in changes]
    found = []
    for order in ([0, 1, 2, 3, 4], [4, 1, 0, 3, 2], [2, 3, 1, 4, 0]):
        log = HistoryLog(spark, work_path(spark, "history"), ["k"], ["v"], "at")
        for number, i in enumerate(order):
            log.apply(frames[i], number)
            if number == 2:
                log.compact()
        found.append(rows(log.read().selectExpr("k", "v", "day(valid_from)", "day(valid_to)")))
    assert found[0] == [(1, "a", 1, 2), (1, "a", 3, None), (1, "b", 2, 3), (2, "x", 5, None)] and found[0] == found[1] == found[2]


class Paper(BatchLog):
    """Folders and manifest in memory, so that many batches cost no Spark job."""

    def __init__(self, *args):
        super().__init__(*args)
        self.stored, self.written, self.text = {}, 0, None

    def manifest(self):
        return json.loads(self.text) if self.text else super().manifest()

    def _commit(self, state, dead=()):
        gone, state["dead"] = state["dead"], list(dead)
        self.text = json.dumps(state)
        for name in gone:
            del self.stored[name]

    def _write(self, rows, name):
        self.stored[name] = rows
        self.written += len(rows)

    def _load(self, names):
        return sorted(x for n in names for x in self.stored[n])

    def combine(self, rows):
        return rows


class Rows(list):
    def withColumn(self, *_):
        return self


def test_a_thousand_batches_leave_few_folders(spark):
    log = Paper(spark, work_path(spark, "paper"), 8)
    most = 0
    for i in range(1000):
        assert log.put(Rows([i]), i)
        most = max(most, len(log.manifest()["folders"]))
    assert most <= 8 * 4 and log.rows() == list(range(1000))
    assert len(log.stored) <= most + 8 and log.written <= 1000 * 4  # folded folders go, a row is rewritten once a tier
    assert not log.put(Rows([0]), 999) and log.put(Rows([1000]), 0, "another")


def test_a_crash_between_write_and_commit_loses_nothing(spark, monkeypatch):
    log = SumLog(spark, work_path(spark, "sums"), ["k"], {"n": F.count(F.lit(1))}, fan=3)
    batch = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    log.apply(batch, 0)
    log.apply(batch, 1)
    commit = SumLog._commit

    def dies(at):
        calls = []

        def run(self, state, dead=()):
            calls.append(1)
            if len(calls) == at:
                raise OSError("lost")
            commit(self, state, dead)

        return run

    for at, want in ((1, [(1, 4), (2, 2)]), (2, [(1, 6), (2, 3)])):  # before the batch counts; after it, while tiers are folded
        monkeypatch.setattr(SumLog, "_commit", dies(at))
        with pytest.raises(OSError):
            log.apply(batch, 2)
        assert rows(log.read()) == want
    monkeypatch.setattr(SumLog, "_commit", commit)
    log.apply(batch, 2)
    log.apply(batch, 3)
    assert rows(log.read()) == [(1, 8), (2, 4)] and len(log.manifest()["folders"]) <= 2
    files, where = log._file("manifest")
    assert len([f for f in files.listStatus(where) if f.getPath().getName().endswith((".json", ".claim"))]) <= 3


def test_upserts_through_tiers(spark):
    log = UpsertLog(spark, work_path(spark, "up"), ["k"], "v", fan=2)
    plain = UpsertLog(spark, work_path(spark, "up"), ["k"], None, fan=2)
    for i in range(7):
        batch = spark.createDataFrame([(j, (i * 5 + j) % 7, f"{i}-{j}") for j in range(i, i + 3)] * 2, "k int, v int, x string")
        log.apply(batch, i)
        plain.apply(batch, i)
    every = [(j, (i * 5 + j) % 7, i) for i in range(7) for j in range(i, i + 3)]
    best = {k: max((v, i) for j, v, i in every if j == k) for k in range(9)}
    assert rows(log.read()) == sorted(((k, v, f"{i}-{k}") for k, (v, i) in best.items()), key=str)
    assert rows(plain.read(), "k", "x") == sorted(((k, f"{max(i for j, _, i in every if j == k)}-{k}") for k in range(9)), key=str)


def test_a_settled_history_is_not_put_in_order_again(spark):
    """Reads take settled versions as they are; only keys that the tail names are made anew, and late changes find their place."""
    path = work_path(spark, "history")
    log = HistoryLog(spark, path, ["k"], ["v"], "at", fan=2, buckets=4)
    frame = lambda changes: spark.createDataFrame(changes, "k int, v string, at string").selectExpr("k", "v", "cast(at as timestamp_ntz) as at")
    many = [(k, "a", "2024-01-01") for k in range(40)] + [(k, "b", "2024-01-05") for k in range(40)]
    log.apply(frame(many), 0)
    log.compact()
    before = {b: f["name"] for b, f in log.manifest()["settled"].items()}
    log.apply(frame([(3, "late", "2024-01-03"), (99, "new", "2024-01-02")]), 1)
    got = log.read()
    plan = got._jdf.queryExecution().executedPlan().toString()
    plain = HistoryLog(spark, work_path(spark, "plain"), ["k"], ["v"], "at")
    plain.apply(frame([*many, (3, "late", "2024-01-03"), (99, "new", "2024-01-02")]), 0)
    assert rows(got) == rows(plain.read()) and len(rows(got)) == 82
    # buckets without a change are read as they lie: a union's branch that is a scan and nothing else
    touched = log._touched(frame([(3, "", "2024-01-01"), (99, "", "2024-01-01")]))
    assert len(touched) < 4 and "versions/_bucket" in str(got.inputFiles()) and plan.count("Union") >= 1
    log.compact()
    after = {b: f["name"] for b, f in log.manifest()["settled"].items()}
    assert {int(b) for b in after if after[b] != before.get(b)} == set(touched)  # only its buckets were written
    assert rows(log.read()) == rows(plain.read())
    for i in range(2, 9):
        change = [(i, f"v{i}", f"2024-01-{i + 8:02d}"), (50 + i, "x", "2024-01-01")]
        log.apply(frame(change), i)
        plain.apply(frame(change), i)
    assert rows(log.read()) == rows(plain.read())


def test_states_merge_over_batches(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    states = {"n": State("count"), "total": State("sum", "value"), "mean": State("avg", "value"), "low": State("min", "value"), "high": State("max", "value"),
              "users": State("count_distinct", "user_id"), "about": State("approx_count_distinct", "user_id"),
              "mid": State("approx_quantile", "value"), "top": State("approx_quantile", "value", 0.9), "ids": State("count_distinct", "event_id - 40000")}
    log = RollupLog(spark, work_path(spark, "rollup"), ["event_type"], states, fan=2)
    for i in range(5):
        log.apply(events.filter(f"event_id % 5 = {i}"), i)
    for got, keys in ((log.read(), ["event_type"]), (log.read([]), [])):
        want = {tuple(r[k] for k in keys): r for r in events.groupBy(*keys).agg(
            F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"),
            F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("ids"), F.sort_array(F.collect_list("value")).alias("every")).collect()}
        found = got.collect()
        assert got.columns == [*keys, *states] and len(found) == len(want)
        for r in found:
            w = want[tuple(r[k] for k in keys)]
            assert (r.n, r.low, r.high, r.users, r.ids) == (w.n, w.low, w.high, w.users, w.ids)
            assert r.total == pytest.approx(w.total) and r["mean"] == pytest.approx(w["mean"]) and abs(r.about - w.users) <= 0.03 * w.users + 1
            for name, p in (("mid", 0.5), ("top", 0.9)):
                below = sum(v < r[name] for v in w.every), sum(v <= r[name] for v in w.every)
                assert below[0] / len(w.every) - 0.03 <= p <= below[1] / len(w.every) + 0.03
    with pytest.raises(ValueError):
        State("mode")


def test_states_without_rows(spark):
    log = RollupLog(spark, work_path(spark, "rollup"), ["k"], {"d": State("count_distinct", "x"), "q": State("approx_quantile", "x"), "a": State("avg", "x")})
    log.apply(spark.createDataFrame([(1, None), (2, 5), (None, 5)], "k int, x int"), 0)
    assert rows(log.read()) == [(1, 0, None, None), (2, 1, 5.0, 5.0), (None, 1, 5.0, 5.0)]
    assert rows(log.read([])) == [(1, 5.0, 5.0)]
