"""Quality tests on small inputs that must pass or fail."""

import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.quality import checks as q
from tidemark.quality import suite as s


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(1, 0.0, 1.0, "a", "b"), (2, 1.0, 0.0, "b", "ab"), (3, 0.5, 0.5, "c", "abc"), (4, 0.5, 0.5, "c", "abcd")],
                                 "idx int, a double, b double, s string, t string").withColumn("none", F.lit(None).cast("string"))


def ok(df):
    return df.isEmpty()


def test_column_values(data):
    assert ok(q.values_between(data, "a", 0, 1)) and not ok(q.values_between(data, "a", 0, 1, strictly=True))
    assert ok(q.values_null(data, "none")) and q.not_null(data, "none").count() == 4
    assert ok(q.unique(data, "idx")) and rows(q.unique(data, "s")) == [("c", 2)]
    assert q.values_in_set(data, "none", ["x"]).count() == 4  # NULL is not in the set
    assert ok(q.values_not_in_set(data, "none", ["x"])) and ok(q.expression_is_true(data, "none = 'x'"))
    assert ok(q.length_between(data, "t", 1, 4)) and q.length_equal(data, "t", 1).count() == 3
    assert ok(q.match_regex(data, "t", "^[a-d]+$")) and ok(q.match_regex(data, "t", "^[A-D]+$", "i"))
    assert ok(q.match_like_list(data, "t", ["a%", "b%"])) and not ok(q.match_like_list(data, "t", ["a%", "b%"], "all"))
    assert ok(q.not_match_regex_list(data, "t", ["x", "abcd"], "any")) and not ok(q.not_match_regex_list(data, "t", ["x", "abcd"], "all"))


def test_aggregates(data):
    assert ok(q.mean_between(data, "a", 0.5, 0.5)) and ok(q.median_between(data, "a", 0.5, 0.5)) and ok(q.quantile_between(data, "a", 0.95, 0.9, 1))
    assert ok(q.sum_between(data, "a", 2, 2)) and ok(q.stdev_between(data, "a", 0.40, 0.41)) and not ok(q.stdev_between(data, "a", 0.35, 0.36))
    assert ok(q.proportion_unique_between(data, "s", 0.75, 0.75)) and ok(q.unique_count_between(data, "s", 3, 3))
    assert ok(q.distinct_count_equal(data, "s", 3)) and not ok(q.distinct_count_greater_than(data, "s", 3))
    assert ok(q.most_common_value_in_set(data, "s", ["c"])) and rows(q.most_common_value_in_set(data, "s", ["c"], 2)) == [("a", 1)]
    assert ok(q.distinct_values_equal_set(data, "s", ["a", "b", "c"])) and rows(q.distinct_values_contain_set(data, "s", ["a", "z"])) == [("z",)]
    assert q.distinct_values_in_set(data, "none", ["x"]).count() == 1


def test_pairs_and_records(data):
    assert ok(q.multicolumn_sum_equal(data, ["a", "b"], 4)) and ok(q.pair_equal(data, "idx", "idx"))
    assert ok(q.pair_a_greater_than_b(data, "a", "b", row_condition="idx = 2"))
    assert ok(q.pair_in_set(data, "a", "b", [(0.0, 1.0), (1.0, 0.0), (0.5, 0.5)]))
    assert ok(q.compound_columns_unique(data, ["idx", "s"])) and not ok(q.compound_columns_unique(data, ["a", "s"]))
    assert ok(q.compound_columns_unique(data.withColumn("n2", F.col("none")), ["none", "n2"]))  # rows of only NULLs are ignored
    assert rows(q.unique_within_record(data, ["a", "b"]), "idx") == [(3,), (4,)]
    assert ok(q.unique_within_record(data, ["a", "b"], row_condition="idx < 3"))


def test_order(data, spark):
    assert ok(q.values_increasing(data, "idx")) and not ok(q.values_decreasing(data, "idx"))
    assert ok(q.values_increasing(data, "s", "idx", strictly=False)) and not ok(q.values_increasing(data, "s", "idx"))
    seq = spark.createDataFrame([(1, 2), (1, 4), (1, 6), (2, 8), (2, 10)], "a int, x int")
    assert ok(q.sequential_values(seq, "x", 2)) and ok(q.sequential_values(seq, "x", 2, group_by=["a"])) and not ok(q.sequential_values(seq, "x"))
    hours = spark.sql("select explode(sequence(timestamp'2021-01-01 00:00:00', timestamp'2021-01-01 03:00:00', interval 1 hour)) as t")
    assert ok(q.sequential_values(hours, "t", 1, "hour")) and not ok(q.sequential_values(hours, "t", 1, "day"))
    # a hot group that is split gives the same verdict
    long = spark.range(500).selectExpr("id as x", "id % 2 as g")
    assert ok(q.sequential_values(long, "x", 2, group_by=["g"], block_rows=20))
    assert q.sequential_values(long.filter("x <> 250"), "x", 2, group_by=["g"], block_rows=20).count() == 1


def test_ranges(spark):
    r = spark.createDataFrame([(0, 1), (1, 2), (2, 4)], "lo int, hi int")
    assert ok(q.mutually_exclusive_ranges(r, "lo", "hi", gaps="not_allowed")) and not ok(q.mutually_exclusive_ranges(r, "lo", "hi", gaps="required"))
    g = spark.createDataFrame([(1, "2019-01-01", "2019-02-01"), (1, "2019-03-03", "2019-04-01"), (2, "2019-05-06", "2019-07-02"), (2, "2019-07-03", "2019-08-01")],
                              "id int, a string, b string")
    assert ok(q.mutually_exclusive_ranges(g, "a", "b", ["id"], "required")) and not ok(q.mutually_exclusive_ranges(g, "a", "b", ["id"], "not_allowed"))
    z = spark.createDataFrame([(4, "2020-06-06", "2020-06-07"), (4, "2020-06-08", "2020-06-08"), (4, "2020-06-09", "2020-06-10")], "id int, a string, b string")
    assert ok(q.mutually_exclusive_ranges(z, "a", "b", ["id"], "allowed", True)) and not ok(q.mutually_exclusive_ranges(z, "a", "b", ["id"]))
    long = spark.range(300).selectExpr("id as lo", "id + 1 as hi")
    assert ok(q.mutually_exclusive_ranges(long, "lo", "hi", gaps="not_allowed", block_rows=7))


def test_tables(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x int")
    assert rows(q.cardinality_equality(a, "x", b, "x")) == [(1, 2, 1), (2, 1, 2), (3, None, 1)]
    assert ok(q.equality(a, a)) and rows(q.equality(a, b)) == [(3, "b_minus_a")]
    assert rows(q.equal_rowcount(a, b, ["x"]), "x", "diff_count") == [(1, 1), (2, 1), (3, 1)]
    assert ok(q.fewer_rows_than(a, b)) and rows(q.fewer_rows_than(a, a), "row_count_delta") == [(1,)]
    assert rows(q.fewer_rows_than(a, b, ["x"]), "x", "row_count_delta") == [(1, 1)]
    assert ok(q.relationships(a, "x", b, "x")) and rows(q.relationships(b, "x", a, "x")) == [(3,)]
    assert ok(q.relationships_where(b, "x", a, "x", "x <> 3")) and ok(q.row_count_equal_other(a, b.limit(3)))
    assert ok(q.aggregation_equal_other_table(a, b, "sum(x)", tolerance=4)) and not ok(q.aggregation_equal_other_table(a, b, "sum(x)"))
    assert q.referential_sample_check(b, "x", a, "x").first().status == "warn"


def test_null_handling(spark):
    p = spark.createDataFrame([(1, 1), (None, 2), (None, 3), (4, 4), (5, 5), (6, 6), (None, 7), (None, 8), (None, None), (10, 10)], "half int, most int")
    assert ok(q.not_null_proportion(p, "half", 0.5, 0.5)) and ok(q.not_null_proportion(p, "most", 0.9)) and not ok(q.not_null_proportion(p, "half", 0.6))
    assert ok(q.at_least_one(p, "half")) and not ok(q.at_least_one(p.filter("half is null"), "half"))
    assert rows(q.at_least_one(p, "half", ["most"])) == [(2, 0), (3, 0), (7, 0), (8, 0), (None, 0)]
    c = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "a int, x int")
    assert ok(q.not_constant(c, "x")) and rows(q.not_constant(c, "x", ["a"])) == [(2, 1)]


def test_time(spark):
    df = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-10')) as d").filter("d <> date'2024-01-04'")
    assert [str(r[0]) for r in q.data_for_every_n_datepart(df, "d").collect()] == ["2024-01-04"]
    assert ok(q.data_for_every_n_datepart(df, "d", "day", 2)) and ok(q.data_for_every_n_datepart(df, "d", exclusion_condition="period <> date'2024-01-04'"))
    assert ok(q.recent_data(df, "d", "day", 2, "2024-01-11")) and not ok(q.recent_data(df, "d", "day", 1, "2024-01-12"))
    assert not ok(q.recent_data(df.filter("false"), "d", "day", 1, "2024-01-12"))
    assert ok(q.grouped_recent_data(df.withColumn("g", F.lit(1)), ["g"], "d", "day", 1, "2024-01-06"))


def test_moving_stdevs_find_a_spike(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-30')) as d").withColumn("v", 100.0 + F.dayofmonth("d") % 3)
    assert ok(q.within_n_moving_stdevs(days, "v", "d", "2024-01-31", take_diffs=False, take_logs=False))
    spike = days.withColumn("v", F.when(F.dayofmonth("d") == 25, 900.0).otherwise(F.col("v")))
    got = q.within_n_moving_stdevs(spike, "v", "d", "2024-01-31", take_diffs=False, take_logs=False)
    assert [str(r[0]) for r in got.select("metric_period").collect()] == ["2024-01-25"]
    assert q.within_n_stdevs(spike, "v", ["d"], 3).count() == 1


def test_schema(data):
    assert ok(q.column_exists(data, "A", 1)) and not ok(q.column_exists(data, "A", 0)) and not ok(q.column_exists(data, "zz"))
    assert ok(q.column_of_type(data, "idx", "int")) and ok(q.columns_contain_set(data, ["IDX"])) and ok(q.columns_not_contain_set(data, ["zz"]))
    assert ok(q.columns_match_set(data, reversed(data.columns) and data.columns[::-1])) and not ok(q.columns_match_ordered_list(data, data.columns[::-1]))
    assert ok(q.column_count_equal(data, 6)) and ok(q.column_count_equal_other(data, data)) and not ok(q.column_count_between(data, 7))
    assert rows(q.schema_contract(data, {"idx": ("int", False), "none": ("string", False), "a": ("int", True), "zz": ("int", True)})) == [
        ("a", "int", "double", 4), ("none", "not null", "null", 4), ("zz", "int", "missing", 4)]


def test_suite(data, spark):
    tests = s.infer_default_tests(data.withColumnRenamed("idx", "user_id").withColumnRenamed("none", "status"), ["user_id"])
    assert sorted(t.name for t in tests) == ["not_null_status", "not_null_user_id", "unique_user_id"]
    own = [s.not_null("none", severity="WARN"), s.aggregate_between("mean", "a", F.avg("a"), 0.5, 0.5), s.unique("idx"), s.in_range("a", 0, 1)]
    got = s.run_quality_suite(data, "data", own, "2024-01-01", "run")
    assert rows(got, "check_name", "passed", "failed_count") == [("in_range_a", True, 0), ("mean", True, 0), ("not_null_none", False, 4), ("unique_idx", True, 0)]
    assert rows(s.suite_status(got)) == [("data", 4, 0, 1, "warn")]
    scans = got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert scans <= 5  # the row tests and aggregates share one


def test_sequential_values_count_repeats(spark):
    """A repeated value fails once per repeat, as in a plain window, and is one row of the walk."""
    df = spark.range(100_000).selectExpr("case when id < 99990 then 5 else id - 99984 end as x").unionByName(spark.createDataFrame([(None,), (4,)], "x bigint"))
    got = q.sequential_values(df, "x", block_rows=100)
    assert rows(got.groupBy("x", "previous_x").count()) == [(5, 5, 99_989)]
    plain = spark.createDataFrame([(1, 2), (1, 2), (1, 4), (1, 4), (1, 4), (2, 9), (2, None)], "g int, x int")
    w = Window.partitionBy("g").orderBy("x")
    want = plain.withColumn("previous_x", F.lag("x").over(w)).filter("x <> previous_x + 2")
    assert rows(q.sequential_values(plain, "x", 2, group_by=["g"])) == rows(want) and want.count() == 3
