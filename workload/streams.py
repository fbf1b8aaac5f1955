"""Streaming jobs, each fed with the whole events or customer table in several deliveries."""

from pyspark.sql import functions as F

from tidemark.session import materialize, work_path
from tidemark.sources import load
from tidemark.streaming import jobs
from tidemark.operators.states import State, build_states, query_projection
from tidemark.streaming.logs import HistoryLog, RollupLog, SumLog, UpsertLog

from .registry import query

CUTS = ["2024-01-08", "2024-01-15", "2024-01-23"]


def _deliveries(t, frames):
    """Write frames one after the other: each becomes one delivery of files."""
    path = work_path(t.spark, "deliveries")
    for frame in frames:
        frame.write.mode("append").parquet(path)
    return path, frames[0].schema


def _by_week(df):
    edges = [None, *CUTS, None]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        part = df
        if lo:
            part = part.filter(F.col("ts") >= F.lit(lo).cast("timestamp_ntz"))
        if hi:
            part = part.filter(F.col("ts") < F.lit(hi).cast("timestamp_ntz"))
        out.append(part)
    return out


def _events(t):
    # watermarks need an instant; the tables hold UTC wall clock times
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_ingest", [250], "select event_id, user_id, event_type, value from events")
def stream_ingest(t):
    path, schema = _deliveries(t, _by_week(t.events))
    out = work_path(t.spark, "ingested")
    jobs.run_to_end(jobs.stream_ingest(jobs.file_stream(t.spark, path, schema, max_files=2), out))
    return t.spark.read.parquet(out).select("event_id", "user_id", "event_type", "value")


@query("stream_upsert", [251], "select user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from events group by 1")
def stream_upsert(t):
    rows = t.events.select("user_id", "event_id", "ts").withColumn("version", F.struct("ts", "event_id"))
    path, schema = _deliveries(t, _by_week(rows))
    table = UpsertLog(t.spark, work_path(t.spark, "upserted"), ["user_id"], "version")
    jobs.run_to_end(jobs.stream_upsert(jobs.file_stream(t.spark, path, schema, max_files=1), table))
    table.compact()
    return table.read().select("user_id", "ts", "event_id")


@query("incremental_rollup", [252, 101], """
    select user_id % 3 as tenant, ts::date as day, event_type, count(*)::bigint as n, sum(round(value * 100)::bigint)::bigint as cents from events group by 1, 2, 3""")
def incremental_rollup(t):
    path, schema = _deliveries(t, _by_week(t.events))
    stream = (jobs.file_stream(t.spark, path, schema, max_files=1).withColumn("day", F.col("ts").cast("date"))
              .withColumn("tenant", F.col("user_id") % 3))
    table = SumLog(t.spark, work_path(t.spark, "rollup"), ["tenant", "day", "event_type"],
                   {"n": F.count(F.lit(1)), "cents": F.sum(F.round(F.col("value") * 100).cast("bigint"))})
    jobs.run_to_end(jobs.incremental_rollup(stream, table))
    return table.read()


@query("stream_dedupe", [253], "select event_id, event_type, value from events")
def stream_dedupe(t):
    # a fifth of the events is delivered a second time, with the next delivery
    weeks = _by_week(_events(t))
    again = [w.filter("event_id % 5 = 0") for w in weeks]
    frames = [weeks[0], *[w.unionByName(a) for w, a in zip(weeks[1:], again)], again[-1]]
    path, schema = _deliveries(t, frames)
    jobs.use_disk_state(t.spark)
    out = work_path(t.spark, "deduped")
    stream = jobs.stream_dedupe(jobs.file_stream(t.spark, path, schema, max_files=4), ["event_id"], "ts", "40 days")
    jobs.run_to_end(jobs.stream_ingest(stream, out))
    return t.spark.read.parquet(out).select("event_id", "event_type", "value")


@query("stream_trend", [254], "select date_trunc('day', ts)::timestamp as time_period, event_type, count(*) as n, max(value) as top from events group by 1, 2")
def stream_trend(t):
    path, schema = _deliveries(t, _by_week(_events(t)))
    jobs.use_disk_state(t.spark)
    trend = jobs.stream_trend(jobs.file_stream(t.spark, path, schema, max_files=2), "ts", "day", "40 days",
                              {"n": F.count(F.lit(1)), "top": F.max("value")}, ["event_type"])
    table = UpsertLog(t.spark, work_path(t.spark, "trend"), ["time_period", "event_type"])
    jobs.run_to_end(jobs.stream_trend_table(trend, table))
    return table.read()


_HISTORY = """
    with v as (select c_custkey, c_mktsegment as segment, timestamp '2024-01-01' as valid_from from customer
      union all select c_custkey, 'MOVED', timestamp '2024-02-01' from customer where c_custkey % 3 = 0 and c_mktsegment <> 'MOVED'
      union all select c_custkey, 'GONE', timestamp '2024-03-01' from customer where c_custkey % 5 = 0)
    select *, lead(valid_from) over (partition by c_custkey order by valid_from) as valid_to from v"""


def _segment_changes(t):
    base = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    at = lambda df, day: df.withColumn("changed_at", F.lit(day).cast("timestamp_ntz"))
    frames = [at(base, "2024-01-01"), at(base.filter("c_custkey % 3 = 0").withColumn("segment", F.lit("MOVED")), "2024-02-01"),
              at(base.filter("c_custkey % 5 = 0").withColumn("segment", F.lit("GONE")), "2024-03-01")]
    return frames


@query("scd2_apply_changes", [16], _HISTORY)
def scd2_apply_changes(t):
    first, second, third = _segment_changes(t)
    known = load.scd2_apply_changes(None, first, ["c_custkey"], ["segment"], "changed_at")
    # the second feed is delivered again together with the third
    return load.scd2_apply_changes(load.scd2_apply_changes(known, second, ["c_custkey"], ["segment"], "changed_at"),
                                   second.unionByName(third), ["c_custkey"], ["segment"], "changed_at")


@query("stream_scd2", [255, 16], _HISTORY)
def stream_scd2(t):
    # the middle change comes last
    first, second, third = _segment_changes(t)
    path, schema = _deliveries(t, [first, third, second])
    table = HistoryLog(t.spark, work_path(t.spark, "scd2"), ["c_custkey"], ["segment"], "changed_at")
    jobs.run_to_end(jobs.stream_scd2(jobs.file_stream(t.spark, path, schema, max_files=1), table))
    return table.compact()


_STATES = {"n": State("count"), "users": State("count_distinct", "user_id"), "mean_value": State("avg", "cast(round(value * 100) as bigint)"),
           "first_ts": State("min", "ts"), "last_ts": State("max", "ts"), "about_users": State("approx_count_distinct", "user_id"),
           "median_id": State("approx_quantile", "event_id"), "p90_id": State("approx_quantile", "event_id", 0.9)}
_FINISHED = """{keys} count(*) as n, count(distinct user_id) as users, round(avg(round(value * 100)::bigint), 6) as mean_value,
      min(ts) as first_ts, max(ts) as last_ts, true as users_near, true as median_near, true as p90_near from events"""


def _near(t, done, keys):
    """Sketches beside what they stand for: within their stated errors, or not."""
    rank = lambda q: F.sum(F.when(F.col("event_id") <= F.col(q), 1).otherwise(0)) / F.count("*")
    name = {k: F.col(f"d.{k}") for k in keys}
    ids = t.events.withColumn("day", F.col("ts").cast("date")).select("event_id", *keys)
    match = [F.col(f"e.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys] or [F.lit(True)]
    both = ids.alias("e").join(F.broadcast(done).alias("d"), match)
    few = F.lit(1) / F.count("*")  # one row's share, where a group is small
    near = both.groupBy(*[c.alias(k) for k, c in name.items()], *[F.col(f"d.{c}") for c in ("n", "users", "mean_value", "first_ts", "last_ts", "about_users")]).agg(
        (F.abs(rank("median_id") - 0.5) <= 0.02 + few).alias("median_near"), (F.abs(rank("p90_id") - 0.9) <= 0.02 + few).alias("p90_near"))
    return near.select(*keys, "n", "users", F.round("mean_value", 6).alias("mean_value"), "first_ts", "last_ts",
                       (F.abs(F.col("about_users") - F.col("users")) <= 0.03 * F.col("users") + 1).alias("users_near"), "median_near", "p90_near")


@query("rollup_states", [252, 101], f"select {_FINISHED.format(keys='event_type,')} group by 1")
def rollup_states(t):
    """Distinct counts, averages and quantiles of a stream, kept by day and asked for by event type."""
    path, schema = _deliveries(t, _by_week(t.events))
    stream = jobs.file_stream(t.spark, path, schema, max_files=1).withColumn("day", F.col("ts").cast("date"))
    table = RollupLog(t.spark, work_path(t.spark, "states"), ["day", "event_type"], _STATES, fan=2)
    jobs.run_to_end(jobs.incremental_rollup(stream, table))
    return _near(t, table.read(["event_type"]), ["event_type"])


@query("projection_states", [101], f"select {_FINISHED.format(keys='ts::date as day,')} group by 1")
def projection_states(t):
    """A projection by day and type answers a question by day."""
    stored = materialize(build_states(t.events.withColumn("day", F.col("ts").cast("date")), ["day", "event_type"], _STATES), "projection")
    return _near(t, query_projection(stored, ["day"], _STATES), ["day"])
