"""Ordered operators give the rows of a plain window, also when a hot group is split."""

from decimal import Decimal

import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ordered as o


@pytest.fixture(scope="module")
def events(spark, sf):
    # user 1 and a NULL user hold most of the rows
    df = spark.read.parquet(f"{sf}/events.parquet")
    user = F.expr("case when event_id % 3 = 0 then 1 when event_id % 7 = 0 then null else user_id end")
    return df.select(user.alias("u"), "ts", "event_id", "event_type", (F.col("value") * 100).cast("bigint").alias("v"))


ORDERS = [["ts", "event_id"], ["-ts", "event_id"], ["event_type", "event_id"], ["v", "event_id"]]


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("partition", [["u"], []])
@pytest.mark.parametrize("hot_rows", [20, 10**6])
def test_row_number(events, order, partition, hot_rows):
    w = Window.partitionBy(*partition).orderBy(*o.sort_columns(order))
    got = o.number_rows(events, partition, order, hot_rows=hot_rows)
    assert rows(got) == rows(events.withColumn("row_number", F.row_number().over(w).cast("bigint")))


@pytest.mark.parametrize("partition", [["u"], []])
def test_rank(events, partition):
    w = Window.partitionBy(*partition).orderBy("event_type")
    want = events.withColumns({"rank": F.rank().over(w).cast("bigint"), "dense_rank": F.dense_rank().over(w).cast("bigint")})
    assert rows(o.rank_rows(events, partition, ["event_type"], hot_rows=20)) == rows(want)


@pytest.mark.parametrize("partition", [["u"], []])
def test_running(events, partition):
    spec = {"s": ("sum", "v"), "c": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v")}
    w = Window.partitionBy(*partition).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = events.withColumns({n: getattr(F, fn)(c).over(w) for n, (fn, c) in spec.items()})
    assert rows(o.running(events, partition, ["ts", "event_id"], spec, hot_rows=20)) == rows(want)


def test_running_starts_with_nulls(spark):
    df = spark.createDataFrame([(i, None if i < 30 else i) for i in range(100)], "k int, v int")
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    got = o.running(df, [], ["k"], {"s": ("sum", "v")}, hot_rows=5)
    assert rows(got) == rows(df.withColumn("s", F.sum("v").over(w)))


@pytest.mark.parametrize("partition", [["u"], []])
@pytest.mark.parametrize("block", [3, 17, 10**6])
def test_framed(events, partition, block):
    fns = {"back": lambda w: F.lag("v", 2).over(w), "ahead": lambda w: F.lead("v").over(w),
           "mean": lambda w: F.sum("v").over(w.rowsBetween(-3, 1))}
    w = Window.partitionBy(*partition).orderBy("ts", "event_id")
    got = o.framed(events, partition, ["ts", "event_id"], fns, before=3, after=1, block_rows=block)
    assert rows(got) == rows(events.withColumns({n: f(w) for n, f in fns.items()}))


@pytest.mark.parametrize("groups", [["u"], []])
@pytest.mark.parametrize("hot_rows", [20, 10**6])
def test_exact_percentiles(events, groups, hot_rows):
    got = o.exact_percentiles(events, groups, "v", {"a": 0.5, "b": 0.9, "c": 0.0, "d": 1.0}, hot_rows=hot_rows)
    want = events.groupBy(*groups).agg(*[F.percentile("v", p).alias(n) for n, p in zip("abcd", (0.5, 0.9, 0.0, 1.0))])
    rounded = lambda df: rows(df.select(*groups, *[F.round(c, 6) for c in "abcd"]))
    assert rounded(got) == rounded(want)


def test_discrete_percentile(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "v double")
    got = o.exact_percentiles(df, [], "v", {"a": 0.5, "b": 0.51, "c": 0.0}, discrete=True)
    assert rows(got) == [(2.0, 3.0, 1.0)]


@pytest.mark.parametrize("hot_rows", [2, 10**6])
def test_quantiles_tell_wide_numbers_apart(spark, hot_rows):
    # beyond 2^53 neighbouring integers, and decimals of that many digits, are the same double
    wide = 2**53
    df = spark.createDataFrame([(wide + i, Decimal(wide + i) / 100) for i in (0, 1, 1, 2, 3)] + [(None, None)], "v bigint, d decimal(20,2)")
    for column, unit in (("v", 1), ("d", Decimal("0.01"))):
        got = o.exact_percentiles(df, [], column, {"a": 0.0, "b": 0.5, "c": 0.8, "d": 1.0}, discrete=True, hot_rows=hot_rows).first()
        assert list(got) == [(wide + i) * unit for i in (0, 1, 2, 3)]
        assert o.count_values(df, [], column).count() == 4
    smooth = o.exact_percentiles(df, [], "v", {"a": 0.5}, hot_rows=hot_rows)
    assert smooth.dtypes == [("a", "double")] and smooth.first().a == float(wide + 1)
    text = df.selectExpr("cast(v % 7 as string) as s")
    assert o.exact_percentiles(text, [], "s", {"a": 1.0}, discrete=True).dtypes == [("a", "double")]


def test_strings_and_chunks_stay_in_order(spark):
    df = spark.range(300).selectExpr("concat('common-prefix-', lpad(id, 4, '0')) as s", "id as v", "if(id % 3 = 0, 'hot', concat('k', id % 40)) as k")
    w = Window.partitionBy("k").orderBy(F.desc("s"))
    assert rows(o.number_rows(df, ["k"], ["-s"], hot_rows=10)) == rows(df.withColumn("row_number", F.row_number().over(w).cast("bigint")))
    chunked = o.in_chunks(df, [], ["s"], 300, 10)
    ends = chunked.groupBy("_chunk").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.count("*").alias("n")).orderBy("_chunk").collect()
    assert len(ends) > 10 and all(x.b < y.a for x, y in zip(ends, ends[1:]))
    assert max(e.n for e in ends) < 60


def test_first_per_group_limits_before_the_shuffle(events):
    plan = o.first_per_group(events, ["u"], ["-ts", "event_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # one on each side of the exchange


def test_ranks_of_a_hot_tie(spark):
    """Two order values in one group: no task ranks more than the counted values."""
    df = spark.range(2000).selectExpr("id", "1 as g", "case when id % 4 = 0 then 1 when id % 4 = 1 then null else 2 end as v")
    w = Window.partitionBy("g").orderBy(F.col("v").desc())
    want = df.withColumns({"rank": F.rank().over(w).cast("bigint"), "dense_rank": F.dense_rank().over(w).cast("bigint")})
    assert rows(o.rank_rows(df, ["g"], ["-v"], hot_rows=100)) == rows(want)


def chunk_sizes(df, monkeypatch, module, run):
    """Rows of the chunks that `run` makes."""
    seen, plain = [], module.in_chunks

    def watched(*args, **kwargs):
        chunked = plain(*args, **kwargs)
        seen.extend(r[1] for r in chunked.groupBy("_chunk").count().collect())
        return chunked

    monkeypatch.setattr(module, "in_chunks", watched)
    return run(df), seen


def test_a_tied_run_spreads_over_chunks(spark, monkeypatch):
    """100 000 equal order values: numbers, running totals and neighbours are those of one order of the rows."""
    df = spark.range(100_000).selectExpr("id", "1 as g", "7 as v").repartition(4)
    got, sizes = chunk_sizes(df, monkeypatch, o, lambda d: o.number_rows(d, ["g"], ["v"], hot_rows=5000))
    assert len(sizes) > 15 and max(sizes) < 10_000
    assert got.agg(F.count_distinct("row_number"), F.min("row_number"), F.max("row_number"), F.count_distinct("id")).first() == (100_000, 1, 100_000, 100_000)
    total = o.running(df, ["g"], ["v"], {"s": ("sum", "v"), "c": ("count", "v")}, hot_rows=5000)
    assert total.agg(F.count_distinct("c"), F.max("s"), F.count_if(F.col("s") != 7 * F.col("c"))).first() == (100_000, 700_000, 0)
    back = o.framed(df, ["g"], ["v"], {"b": lambda w: F.lag("id").over(w)}, before=1, block_rows=5000)
    assert back.agg(F.count_distinct("b"), F.count_if(F.col("b").isNull()), F.count_if(F.col("b") == F.col("id"))).first() == (99_999, 1, 0)


def test_ties_of_some_rows_keep_what_does_not_depend_on_them(spark):
    df = spark.range(3000).selectExpr("id", "id % 2 as g", "id div 500 as v")
    w = Window.partitionBy("g").orderBy("v")
    want = df.withColumn("hi", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(o.running(df, ["g"], ["v"], {"hi": ("max", "v")}, hot_rows=50)) == rows(want)
    before = o.framed(df, ["g"], ["v"], {"b": lambda w: F.lag("v").over(w)}, before=1, block_rows=50)
    assert rows(before.groupBy("g", "v", "b").count()) == rows(df.withColumn("b", F.lag("v").over(w)).groupBy("g", "v", "b").count())
