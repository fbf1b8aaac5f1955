"""Small inputs with known results."""

import datetime as dt
import hashlib
import math

from helpers import rows
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import columns as c
from tidemark.operators import reshape, sets, windows
from tidemark.operators.calendars import date_dimension, fiscal_periods, fiscal_year_dates
from tidemark.plans.models import filtered_columns, nullcheck, slugify, snake_case, snake_case_columns, star


def frame(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def test_deduplicate(spark):
    df = frame(spark, [("oak", "cut", 4), ("oak", "cut", 9), ("elm", "plant", 2)], "tree string, work string, day int")
    assert rows(windows.deduplicate(df, ["tree"], ["-day"])) == [("elm", "plant", 2), ("oak", "cut", 9)]


def test_latest_version_keeps_rows_with_nulls(spark):
    df = frame(spark, [(7, None, 3), (7, None, 8), (None, "w", 5)], "k int, a string, v int")
    assert rows(windows.latest_version(df, ["k"], "v")) == [(7, None, 8), (None, "w", 5)]


def test_pivot(spark):
    df = frame(spark, [("north", "dry"), ("north", "wet"), ("north", "so-so!"), ("south", "dry"), ("south", "dry")], "side string, air string")
    assert rows(reshape.pivot(df, ["side"], "air", ["dry", "wet"])) == [("north", 1, 1), ("south", 2, 0)]
    assert reshape.pivot(df, ["side"], "air", ["dry", "so-so!"], slug=True).columns == ["side", "dry", "so_so"]
    assert reshape.pivot_values(df, "air") == ["dry", "so-so!", "wet"]


def test_unpivot(spark):
    df = frame(spark, [(5, "harbour", 12, "calm", "x")], "buoy int, place string, depth int, sea string, note string")
    out = reshape.unpivot(df, ["buoy", "place"], ["note"], "string", "what", "how")
    assert rows(out) == [(5, "harbour", "depth", "12"), (5, "harbour", "sea", "calm")]


def test_unpivot_bool(spark):
    out = reshape.unpivot(frame(spark, [(8, False, None)], "id int, open boolean, y string"), ["id"])
    assert rows(out) == [(8, "open", "false"), (8, "y", None)]


def test_union(spark):
    a = frame(spark, [(4, "barley", "2.5"), (6, "rye", "t")], "lot int, grain string, weight string")
    b = frame(spark, [(4, "silo", 31)], "lot int, store string, weight int")
    out = sets.union_relations({"a": a, "b": b}, source_column=None)
    assert rows(out, "lot", "grain", "store", "weight") == [(4, "barley", None, "2.5"), (4, None, "silo", "31"), (6, "rye", None, "t")]
    assert sets.union_relations({"a": a, "b": b}, exclude=["GRAIN"]).columns == ["source_relation", "lot", "weight", "store"]
    assert rows(sets.union_relations({"a": a, "b": b}, include=["lot"], where="lot = 6")) == [("a", 6)]


def test_surrogate_key(spark):
    """The md5 of the values as text, joined by a hyphen; NULL has a text of its own."""
    null = "_dbt_utils_surrogate_key_null_"
    df = frame(spark, [("k", "2"), ("k", None), (None, None)], "x string, y string")
    digest = lambda *parts: hashlib.md5("-".join(parts).encode()).hexdigest()
    got = [tuple(r) for r in df.select(c.surrogate_key("x"), c.surrogate_key("x", "y")).collect()]
    assert got == [(digest("k"), digest("k", "2")), (digest("k"), digest("k", null)), (digest(null), digest(null, null))]


def test_width_bucket(spark):
    values = [-3.0, 0.0, 9.99, 10.0, 25.0, 49.5, 50.0, 80.0]  # five buckets of ten between 0 and 50
    df = frame(spark, [(v,) for v in values], "a double")
    assert [r[0] for r in df.select(c.width_bucket("a", 0, 50, 5)).collect()] == [0, 1, 1, 2, 3, 5, 6, 6]


def test_series_and_spine(spark):
    assert [r[0] for r in reshape.generate_series(spark, 10).collect()] == list(range(1, 11))
    out = reshape.date_spine(spark, "day", "2018-01-01", "2018-01-10")
    assert [r[0] for r in out.collect()] == [dt.date(2018, 1, d) for d in range(1, 10)]
    assert reshape.date_spine(spark, "month", "2018-01-01", "2018-04-01").count() == 3
    assert reshape.date_spine(spark, "day", "2018-01-02", "2018-01-01").count() == 0


def test_safe_arithmetic(spark):
    df = frame(spark, [(20, 4, 1), (20, None, 1), (None, None, 6)], "a int, b int, c int")
    assert [r[0] for r in df.select(c.safe_add("a", "b", "c")).collect()] == [25, 21, 6]
    assert [r[0] for r in df.select(c.safe_subtract("a", "b", "c")).collect()] == [15, 19, -6]
    pairs = frame(spark, [(8, 0), (21, 7), (None, 3), (4, None), (0, 11)], "n int, d int")
    assert [r[0] for r in pairs.select(c.safe_divide("n", "d")).collect()] == [None, 3, None, None, 0]


def test_haversine(spark):
    # a quarter of a meridian, and two points a degree of latitude apart
    df = frame(spark, [(0.0, 10.0, 90.0, 10.0), (40.0, -3.0, 41.0, -3.0)], "a double, b double, c double, d double")
    got = df.select(F.round(c.haversine_distance("a", "b", "c", "d", "km"))).collect()
    assert all(abs(r[0] / want - 1) < 0.005 for r, want in zip(got, (6371 * math.pi / 2, 6371 * math.pi / 180)))
    miles = df.select(F.round(c.haversine_distance("a", "b", "c", "d") / c.haversine_distance("a", "b", "c", "d", "km"), 3)).first()[0]
    assert miles == 0.621


def test_urls(spark):
    hosts = {"https://shop.example.org/a/b?x=1": "shop.example.org", "http://example.net": "example.net",
             "data.example.com/list?page=2": "data.example.com", "android-app://reader.example/": "reader.example", "example.edu?q=1": "example.edu"}
    df = frame(spark, list(hosts.items()), "u string, h string")
    assert df.filter(~c.url_host("u").eqNullSafe(F.col("h"))).count() == 0
    paths = {"example.edu?q=1": None, "https://shop.example.org/a/b/": "a/b/", "http://example.net/one?x=/two": "one"}
    df = frame(spark, list(paths.items()), "u string, p string")
    assert df.filter(~c.url_path("u").eqNullSafe(F.col("p"))).count() == 0
    df = frame(spark, [("http://example.net/p?size=4&hue=red",), ("http://example.net/p?hue=blue",)], "u string")
    assert rows(df.select(c.url_parameter("u", "hue"), c.url_parameter("u", "size"))) == [("blue", None), ("red", "4")]


def test_column_helpers(spark):
    df = frame(spark, [("a", "", 1), ("", None, 2)], "field_1 string, field_2 string, field_3 int")
    assert rows(nullcheck(df)) == [("a", None, 1), (None, None, 2)]
    assert star(df, ["FIELD_3"], "p_", "_s").columns == ["p_field_1_s", "p_field_2_s"]
    assert filtered_columns(df, ["field_1"]) == ["field_2", "field_3"]
    assert [slugify(x) for x in ("Hello World", "2nd-value!", "a  b")] == ["hello_world", "_2nd_value", "a_b"]
    assert [snake_case(x) for x in ("OrderID", "2 fast", "x" * 80)] == ["order_id", "_2_fast", "x" * 63]


def test_calendar_parts(spark):
    """Parts of a leap day and of a year's first day, a Thursday and a Friday."""
    day = spark.sql("select explode(array(date '2024-02-29', date '2027-01-01')) as date_day")
    want = ["prior_date_day", "next_date_day", "day_of_week_name", "day_of_week_name_short", "day_of_month", "day_of_week", "day_of_week_iso",
            "day_of_year", "week_start_date", "week_end_date", "week_of_year", "iso_week_start_date", "iso_week_end_date", "iso_week_of_year",
            "month_of_year", "month_name", "month_name_short"]
    d = dt.date
    assert rows(date_dimension(day).select(*want)) == [
        (d(2024, 2, 28), d(2024, 3, 1), "Thursday", "Thu", 29, 5, 4, 60, d(2024, 2, 25), d(2024, 3, 2), 9, d(2024, 2, 26), d(2024, 3, 3), 9, 2, "February", "Feb"),
        (d(2026, 12, 31), d(2027, 1, 2), "Friday", "Fri", 1, 6, 5, 1, d(2026, 12, 27), d(2027, 1, 2), 1, d(2026, 12, 28), d(2027, 1, 3), 53, 1, "January", "Jan")]


def test_epochs_and_zones(spark):
    at = dt.datetime(2023, 1, 15, 18, 30, 5)
    seconds = int(at.replace(tzinfo=dt.timezone.utc).timestamp())
    got = frame(spark, [(seconds,)], "e bigint").select(
        cal.from_unixtimestamp("e"), cal.convert_timezone(cal.from_unixtimestamp("e"), "Asia/Tokyo"),
        cal.round_timestamp(cal.from_unixtimestamp("e")), cal.to_unixtimestamp(cal.from_unixtimestamp("e"))).first()
    assert tuple(got) == (at, at + dt.timedelta(hours=9), dt.datetime(2023, 1, 16), seconds)


def test_fiscal_years_tile_the_calendar(spark):
    days = reshape.date_spine(spark, "day", "2010-01-01", "2024-01-01")
    for month in (1, 6, 12):
        for start in (1, 2, 7):
            f = fiscal_year_dates(days, month, start, 1)
            per = f.groupBy("fiscal_year_number").agg(F.count("*").alias("n"), F.max("fiscal_week_of_year").alias("w"), F.min("date_day").alias("a"),
                                                      F.max("date_day").alias("b")).orderBy("a").collect()
            assert {r.n for r in per} <= {364, 371} and all(r.w * 7 == r.n for r in per)
            assert all((y.a - x.b).days == 1 for x, y in zip(per, per[1:]))
            for r in per:  # the year closes on the week end nearest the month's end
                end = dt.date(r.fiscal_year_number + 1, month, 1)
                end = (end.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
                assert abs((r.b - end).days) <= 3


def test_fiscal_periods_are_4_5_4(spark):
    days = reshape.date_spine(spark, "day", "2010-01-01", "2024-01-01")
    weeks = fiscal_periods(days, 1, 1, 1).select("fiscal_year_number", "fiscal_period_number", "fiscal_week_of_year").distinct()
    sizes = {tuple(r) for r in weeks.groupBy("fiscal_year_number", "fiscal_period_number").count().select("fiscal_period_number", "count").collect()}
    assert {n for p, n in sizes if p % 3 == 2} == {5} and {n for p, n in sizes if p % 3 != 2 and p != 12} == {4}
    assert {n for p, n in sizes if p == 12} == {4, 5}  # week 53 joins the last period


def test_to_char_and_regexp(spark):
    df = frame(spark, [("2021-03-04 15:06:07", "banana")], "t string, s string").selectExpr("cast(t as timestamp) as t", "s")
    got = df.select(c.to_char("t", "YYYY-MM-DD HH24:MI:SS"), c.to_char("t", "Day, Mon DD"), c.regexp_position("s", "an", 1, 2),
                    c.regexp_position("s", "an", 3), c.regexp_position("s", "AN", flags="i"), c.regexp_position("s", "x")).first()
    assert tuple(got) == ("2021-03-04 15:06:07", "Thursday, Mar 04", 4, 4, 2, 0)


def test_format_measure(spark):
    df = frame(spark, [(1234567.891,), (-5.0,), (999.0,)], "v double")
    got = df.select(c.format_measure("v", "number"), c.format_measure("v", "currency", 2), c.format_measure("v", "compact", 1),
                    c.format_measure("v", "percent", 0), c.format_measure("v", "decimal", 1, unit=" kg")).collect()
    assert tuple(got[0]) == ("1,234,568", "$1,234,567.89", "1.2M", "123,456,789%", "1,234,567.9 kg")
    assert tuple(got[1])[:2] == ("-5", "-$5.00") and tuple(got[2])[2] == "999.0"


def test_column_names_stay_apart(spark):
    df = frame(spark, [(1, 2, 3, 4)], "`a b` int, `a-b` int, `a b 2` int, `a_b_2` int")
    names = snake_case_columns(df).columns
    assert len(set(names)) == 4 and names[:2] == ["a_b", "a_b_2"]


def test_hash_key64_is_the_xxh64_of_the_joined_text(spark):
    import xxhash

    got = frame(spark, [("k", "2"), (None, "é")], "x string, y string").select(c.hash_key64("x", "y")).collect()
    want = [xxhash.xxh64_intdigest(t, 42) for t in ("k|2", "|é")]
    assert [r[0] % (1 << 64) for r in got] == want
