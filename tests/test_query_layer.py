"""Joins, semantic layer, shapes, metrics and charts on small inputs."""

import ipaddress
import random
import time

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators import charts, filters as f, joins as j, metrics as m, ordered, windows as w
from tidemark.operators.filters import Filter
from tidemark.operators.measures import Measure, aggregate
from tidemark.plans import shapes
from tidemark.plans.models import ModelColumn, ModelJoin, ModelSpec, build_model, snake_case_columns
from tidemark.plans.semantic import (Dimension, Relationship, SemanticLayer, SemanticModel, SemanticQuery, page,
                                     semantic_query)


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(1, 10, "new", 5.0, "t1"), (2, 10, "paid", 7.0, "t1"), (3, 20, "paid", 9.0, "t2"), (4, None, "new", 1.0, "t1")],
                                 "order_id int, customer_id int, status string, total double, tenant_id string")


@pytest.fixture(scope="module")
def layer(spark, sales):
    people = spark.createDataFrame([(10, "ann", 1), (20, "bob", 2)], "id int, name string, city_id int")
    cities = spark.createDataFrame([(1, "rome"), (2, "oslo")], "cid int, city string")
    return SemanticLayer(
        [SemanticModel("sales", sales, [Dimension("status", "status")], [
            Measure("revenue", "sum", "total"), Measure("orders", "count", "order_id"), Measure("buyers", "count_distinct", "customer_id"),
            Measure("typical", "median", "total"), Measure("paid", "sum", "total", filters=(Filter("status", "=", "paid"),))], tenant_column="tenant_id"),
         SemanticModel("people", people, [Dimension("person", "name")], kind="dimension"),
         SemanticModel("cities", cities, [Dimension("city", "city")], kind="dimension")],
        [Relationship("sales", "people", "customer_id", "id"), Relationship("people", "cities", "city_id", "cid")])


def test_semantic_query_over_two_hops(layer):
    out = semantic_query(layer, SemanticQuery(["revenue", "buyers", "paid"], ["city"]))
    assert rows(out) == [("oslo", 9.0, 1, 9.0), ("rome", 12.0, 1, 7.0), (None, 1.0, 0, None)]


def test_semantic_filters_apply_to_unselected_dimensions(layer):
    assert rows(semantic_query(layer, SemanticQuery(["revenue"], ["status"], {"city": "rome"}))) == [("new", 5.0), ("paid", 7.0)]
    assert rows(semantic_query(layer, SemanticQuery(["revenue"], filters=[Filter("person", "in", ["ann", "bob"])]))) == [(21.0,)]


def test_semantic_tenant_median_and_paging(layer):
    assert rows(semantic_query(layer, SemanticQuery(["orders", "typical"], tenant="t1"))) == [(3, 5.0)]
    q = SemanticQuery(["revenue"], ["status"], order_by=["-revenue"], limit=1, offset=1)
    assert rows(semantic_query(layer, q)) == [("new", 6.0)]
    with pytest.raises(ValueError):
        semantic_query(layer, SemanticQuery(["revenue"], ["status"], order_by=["nope"]))
    with pytest.raises(KeyError):
        semantic_query(layer, SemanticQuery(["nope"]))


def test_join_path_both_ways(layer):
    assert [r.right for r in layer.join_path("cities", "sales")] == ["people", "sales"]
    chain = SemanticLayer([], [Relationship(f"m{i}", f"m{i + 1}", "k", "k") for i in range(6)])
    assert len(chain.join_path("m0", "m6")) == 6
    with pytest.raises(ValueError):
        chain.join_path("m0", "elsewhere")


def test_filter_operators(sales):
    keep = lambda *fs: [r[0] for r in rows(f.filter_rows(sales, *fs), "order_id")]
    assert keep(Filter("total", "between", {"start": 5, "end": 7})) == [1, 2] and keep(Filter("total", "outside", (5, 7))) == [3, 4]
    assert keep(Filter("status", "ilike", "PA%")) == [2, 3] and keep(Filter("status", "similar to", "pa")) == []
    assert keep(Filter("customer_id", "is null")) == [4] and keep(Filter("status", "not in", ["new"])) == [2, 3]
    assert keep(Filter("status", "in", [])) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        Filter("a", "drop table", 1).to_column()
    assert f.merge_filters([Filter("a")], [Filter("a"), Filter("b")]) == [Filter("a"), Filter("b")]


def test_row_policies(sales):
    policy = [f.RowPolicy("status", "states", frozenset({"admin"}))]
    assert f.visible_rows(sales, policy, {"states": ["paid"]}).count() == 2
    assert f.visible_rows(sales, policy, {}).count() == 0 and f.visible_rows(sales, policy, {"roles": ["admin"]}).count() == 4


def test_skewed_join_equals_plain_join(spark):
    left = spark.range(2000).selectExpr("case when id % 3 = 0 then 7 when id % 11 = 0 then null else id % 50 end as k", "id as v")
    right = spark.range(40).selectExpr("id as k", "id * 2 as d")
    for how in ("inner", "left"):
        assert rows(j.salted_join(left, right, "k", how, 5), "k", "v", "d") == rows(left.join(right, "k", how), "k", "v", "d")


def test_bounded_cross_join(spark):
    assert j.small_cross_join(spark.range(3).toDF("a"), spark.range(2).toDF("b")).count() == 6
    with pytest.raises(ValueError):
        j.small_cross_join(spark.range(3).toDF("a"), spark.range(20).toDF("b"), 10)


def test_range_lookup_and_open_ends(spark):
    pts = spark.sql("select * from values (1, 'a', date'2024-01-15'), (2, 'a', date'2024-05-01'), (3, 'b', date'2024-01-01') t(id, k, d)")
    rng = spark.sql("select * from values ('a', date'2024-01-01', date'2024-02-01', 10), ('a', date'2024-01-10', null, 20) t(k, s, e, rate)")
    got = lambda strategy: rows(j.range_lookup(pts, rng, "d", "s", "e", {"k": "k"}, ["id"], strategy), "id", "rate")
    assert got("min") == [(1, 10), (2, 20), (3, None)] and got("max") == [(1, 20), (2, 20), (3, None)]


def test_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    root = spark.createDataFrame([("a",)], "node string")
    assert rows(j.lineage_traverse(edges, root)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]  # the cycle ends
    assert rows(j.lineage_traverse(edges, spark.createDataFrame([("d",)], "node string"), "upstream", 2)) == [("b", 2), ("c", 1), ("d", 0)]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, up int")
    assert rows(j.ancestors(tree, "id", "up")) == [(2, 1, 1), (3, 1, 2), (3, 2, 1)]
    chain = spark.range(1, 25).selectExpr("id", "nullif(id - 1, 0) as up")
    assert j.ancestors(chain, "id", "up").count() == 24 * 23 // 2 and j.ancestors(chain, "id", "up", 2).count() == 23 + 22
    with pytest.raises(ValueError):
        j.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "id int, up int"), "id", "up")


def test_ip_lookup(spark):
    nets = spark.createDataFrame([("0.0.0.0/0", "any"), ("10.0.0.0/8", "ten"), ("10.1.0.0/16", "ten-one"), ("192.168.1.7/32", "host")], "prefix string, net string")
    ips = spark.createDataFrame([("10.1.2.3",), ("10.2.0.1",), ("192.168.1.7",), ("8.8.8.8",), (None,)], "ip string")
    assert rows(j.ip_prefix_lookup(ips, nets, "ip"), "ip", "net") == [("10.1.2.3", "ten-one"), ("10.2.0.1", "ten"), ("192.168.1.7", "host"), ("8.8.8.8", "any"), (None, None)]


def test_ip_lookup_of_both_families_in_chunks(spark):
    """Nested prefixes swept in chunks of a few, against every prefix tried for every address."""
    pick = random.Random(8)
    four = [ipaddress.ip_network((pick.getrandbits(32) >> s << s, 32 - s)) for s in (pick.choice([0, 4, 8, 12, 16, 20, 24, 31, 32]) for _ in range(60)) if s <= 32]
    base = int(ipaddress.ip_address("2001:db8::"))
    six = [ipaddress.ip_network(((base | pick.getrandbits(96)) >> s << s, 128 - s)) for s in (pick.choice([0, 1, 16, 40, 63, 64, 65, 90, 100, 128]) for _ in range(60))]
    nested = [n for first in (four[0], six[0], six[3]) for n in (first, *(first.supernet(new_prefix=p) for p in range(0, first.prefixlen, 3)))]
    nets = sorted({str(n) for n in four + six + nested})
    inside = [ipaddress.ip_network(n) for n in nets]
    ips = [str(n[pick.randrange(min(n.num_addresses, 1 << 60))]) for n in inside] + [str(n[0]) for n in inside] + [str(n[-1]) for n in inside]
    ips += [str(ipaddress.ip_address(pick.getrandbits(128))) for _ in range(50)] + [str(ipaddress.ip_address(pick.getrandbits(32))) for _ in range(50)]

    def best(ip):
        fits = [n for n in inside if ipaddress.ip_address(ip) in n]
        return str(max(fits, key=lambda n: n.prefixlen)) if fits else None

    table = spark.createDataFrame([(n, n.upper()) for n in nets] + [("1.2.3.4/33", "bad"), ("x/8", "bad"), ("10.0.0.0", "bad"), ("::/129", "bad"), (None, "bad")], "prefix string, net string")
    want = sorted((ip, best(ip)) for ip in set(ips))
    for size in (7, 10 ** 6):
        found = j.ip_prefix_lookup(spark.createDataFrame([(ip,) for ip in set(ips)], "ip string"), table, "ip", chunk_rows=size)
        assert sorted((r.ip, r.prefix) for r in found.collect()) == want


def test_ip_texts(spark):
    good = {"::": 0, "::1": 1, "1::": 1 << 112, "2001:DB8::ff00:42:8329": int(ipaddress.ip_address("2001:db8::ff00:42:8329")), "1:2:3:4:5:6:7:8": int(ipaddress.ip_address("1:2:3:4:5:6:7:8")),
            "::ffff:1.2.3.4": 0xFFFF01020304, "1.2.3.4": 0xFFFF01020304, "64:ff9b::192.0.2.33": int(ipaddress.ip_address("64:ff9b::192.0.2.33")), "1:2:3:4:5:6:7::": int(ipaddress.ip_address("1:2:3:4:5:6:7::"))}
    bad = ["", "1.2.3", "1.2.3.256", "1.2.3.4.5", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "g::1", "12345::", "fe80::1%eth0", "::1.2.3.400", "1.2.3.4::", " ::1", "99999999999999999999.1.1.1", None]
    found = {r.t: r.k for r in spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", j.ip_key("t").alias("k")).collect()}
    assert all(found[t] is None for t in bad)
    assert {t: ((found[t].hi + (1 << 63)) << 64) | (found[t].lo + (1 << 63)) for t in good} == good


@pytest.fixture(scope="module")
def mixed_ranges(spark):
    """Ranges of a minute, days and decades, open, far, empty and inverted ones, over the same points."""
    pick = random.Random(4)
    start = 1_500_000_000
    points = [(i, i % 3, start + pick.randrange(400 * 86400)) for i in range(4000)]
    ranges = []
    for i in range(300):
        length = pick.choice([0, 59, 60, 3600, 5 * 86400, 10 * 365 * 86400, -10])
        first = start + pick.randrange(-86400, 400 * 86400)
        ranges.append((i, i % 4, first, None if i % 17 == 0 else first + length if i % 19 else 253_370_764_800))
    return (spark.createDataFrame(points, "id int, k int, s bigint").selectExpr("id", "k", "timestamp_seconds(s) as at", "s"),
            spark.createDataFrame(ranges, "r int, k2 int, a bigint, z bigint").selectExpr("r", "k2", "timestamp_seconds(a) as a", "timestamp_seconds(z) as z", "a as ai", "z as zi"))


@pytest.mark.parametrize("keys", [None, {"k": "k2"}])
def test_intervals_of_minutes_and_decades(mixed_ranges, keys):
    points, ranges = mixed_ranges
    pts, rng = points.collect(), ranges.collect()
    want = sorted((p.id, r.r) for r in rng for p in pts if r.ai <= p.s and (r.zi is None or p.s <= r.zi) and (keys is None or p.k == r.k2))
    for at, a, z in (("at", "a", "z"), ("s", "ai", "zi")):
        assert sorted((x.id, x.r) for x in j.interval_join(points, ranges, at, a, z, keys).select("id", "r").collect()) == want
    left = j.interval_join(points, ranges, "at", "a", "z", keys, how="left").select("id", "r").collect()
    assert sorted((x.id, x.r) for x in left if x.r is not None) == want
    assert sorted(x.id for x in left if x.r is None) == sorted({p.id for p in pts} - {i for i, _ in want})
    tried = j.interval_candidates(points, ranges, "at", "a", "z", keys).count()
    assert len(want) <= tried <= 1.25 * len(want) + 300


@pytest.mark.parametrize("keys", [None, {"k": "k2"}])
@pytest.mark.parametrize("hot_rows", [j.HOT_ROWS, 1500])
def test_totals_of_ranges_equal_their_pairs(spark, mixed_ranges, keys, hot_rows):
    """Count, first and last point of a range, with null keys, places and starts, repeated points and ranges, in one piece and in chunks."""
    points, ranges = mixed_ranges
    points = points.unionByName(points.limit(500)).unionByName(points.limit(3).selectExpr("id", "cast(null as int) as k", "at", "s"))
    points = points.unionByName(points.limit(3).selectExpr("id", "k", "cast(null as timestamp) as at", "cast(null as bigint) as s"))
    ranges = ranges.unionByName(ranges.limit(40)).unionByName(ranges.limit(3).selectExpr("r", "cast(null as int) as k2", "a", "z", "ai", "zi"))
    ranges = ranges.unionByName(ranges.limit(3).selectExpr("r", "k2", "cast(null as timestamp) as a", "z", "cast(null as bigint) as ai", "zi"))
    wanted = {"n": "count", "low": "min", "high": "max"}
    at, a, z = ("at", "a", "z") if keys else ("s", "ai", "zi")
    numbered = ranges.select("*", F.hash("r", "k2").alias("copy"))
    pairs = j.interval_join(points, numbered, at, a, z, keys).groupBy("r", "copy").agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
    held = j._range_totals(points, numbered, at, a, z, keys or {}, wanted, hot_rows)
    assert dict(held.dtypes)["low"] == dict(points.dtypes)[at] and len(held.columns) == len(numbered.columns) + 3 - len(keys or {})
    got = held.groupBy("r", "copy").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    assert rows(got, "r", "copy", "n", "low", "high") == rows(pairs, "r", "copy", "n", "low", "high")


def test_totals_of_ranges_make_no_pairs(spark):
    """Fifty thousand points in as many ranges: two billion pairs."""
    points = spark.range(50_000).selectExpr("id as at")
    ranges = spark.range(50_000).selectExpr("id as r", "0 as a", "id + 25000 as z")
    held = j.interval_join(points, ranges, "at", "a", "z", per_range={"n": "count", "low": "min"})
    assert held.agg(F.sum("n"), F.max("low"), F.count("*")).first() == (sum(min(i + 25_001, 50_000) for i in range(50_000)), 0, 50_000)
    for wrong in ({"how": "left", "per_range": {"n": "count"}}, {"per_range": {"n": "median"}}):
        with pytest.raises(ValueError):
            j.interval_join(points, ranges, "at", "a", "z", **wrong)


def test_interval_candidates_do_not_follow_the_span(spark):
    """A thousand short ranges over ten years: a point meets few ranges besides its own."""
    points = spark.range(100_000).selectExpr("id", "timestamp_seconds(1000000000 + id * 3153) as at")
    ranges = spark.range(1000).selectExpr("id as r", "timestamp_seconds(1000000000 + id * 315300) as a", "timestamp_seconds(1000000000 + id * 315300 + 30000) as z")
    found = j.interval_candidates(points, ranges, "at", "a", "z").agg(F.count("*"), F.count_if("_inside")).first()
    assert found[1] == 10_000 and found[0] < 1.3 * found[1]


def test_many_blocks_are_not_broadcast(spark):
    """The planner takes ranges with their blocks for as small as the ranges; thousands of them still go without a shuffle of the points."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    points = spark.range(300_000).selectExpr("id", "id % 30000 as k", "id % 1000 as at")
    ranges = lambda n: spark.range(n).selectExpr("id as k", "id % 7 as a", "id % 7 + 500 as z", "id as r")
    many, few = (j.interval_candidates(points, ranges(n), "at", "a", "z", {"k": "k"}) for n in (30_000, 100))
    assert "BroadcastHashJoin" in plan(few) and "Broadcast" not in plan(many)
    best = j.range_lookup(points, ranges(30_000), "at", "a", "z", {"k": "k"}, ["id"])
    assert "Broadcast" not in plan(best)
    want = F.expr("case when at between k % 7 and k % 7 + 500 then k end")
    assert best.agg(F.count("*"), F.count_if(~F.col("r").eqNullSafe(want))).first() == (300_000, 0)


def test_few_ranges_do_not_cost_a_level():
    """A row per point and level against blocks per range; no range goes far below its own level."""
    assert j._levels_to_use({}, 100) == {}
    assert j._levels_to_use({42: 40_000, 44: 20_000}, 10**9) == {42: 42, 44: 42}
    assert j._levels_to_use({42: 40_000, 44: 20_000}, 10) == {42: 42, 44: 44}
    few = j._levels_to_use({n: 1 for n in range(0, 62, 2)}, 10**12)
    assert all(0 <= n - low <= j.MAX_GAP for n, low in few.items()) and len(set(few.values())) == 5


def test_conversion_of_a_busy_user_goes_by_chunks(spark, monkeypatch):
    events = spark.range(40_000).selectExpr("1 as u", "case when id % 100 = 7 then 'buy' else 'view' end as kind", "timestamp_seconds(id div 4) as ts")
    seen, plain = [], ordered.in_chunks

    def watched(*args, **kwargs):
        chunked = plain(*args, **kwargs)
        seen.extend(r[1] for r in chunked.groupBy("_chunk").count().collect())
        return chunked

    whole = m.conversion_metric(events, "u", "ts", "kind", "view", "buy", 1_000_000).collect()
    monkeypatch.setattr(ordered, "in_chunks", watched)
    assert m.conversion_metric(events, "u", "ts", "kind", "view", "buy", 1_000_000, hot_rows=2000).collect() == whole
    assert len(seen) > 10 and max(seen) < 4000


def test_drill_across_has_no_fan_out(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 5), ("y", 6)], "k string, w int")
    out = j.drill_across([(a, {"k": "k"}, {"v": F.sum("v")}), (b, {"k": "k"}, {"w": F.sum("w")})])
    assert rows(out) == [("x", 3, 5), ("y", None, 6)]


def test_week_trend_starts_on_sunday(spark):
    df = spark.sql("select timestamp_ntz'2024-01-06 23:00:00' as t union all select timestamp_ntz'2024-01-07 01:00:00'")
    out = shapes.trend_query(df, "t", "week", [Measure("n", "count")])
    assert [str(r[0]) for r in rows(out)] == ["2023-12-31", "2024-01-07"]


def test_comparison_total_covers_compared_values_only(sales):
    df = sales.withColumn("status", F.expr("case when order_id = 4 then 'old one' else status end"))
    out = shapes.comparison_query(df, "status", ["new", "old one"], [Measure("v", "sum", "total")])
    assert out.columns == ["v_new", "v_old_one", "v_total"] and rows(out) == [(5.0, 1.0, 6.0)]
    with pytest.raises(ValueError):
        shapes.comparison_query(df, "status", ["new"], [Measure("v", "sum", "total")])


def test_limits_below_one_are_refused(spark):
    df = spark.range(1500).selectExpr("id as k", "id as v")
    with pytest.raises(ValueError):
        shapes.top_n_query(df, "k", Measure("s", "sum", "v"), 0)
    assert page(df, limit=3, offset=2).count() == 3


def test_measures(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    kinds = ["sum", "count", "avg", "min", "max", "count_distinct", "median", "stddev", "variance", "stddev_samp", "var_samp"]
    out = aggregate(df, [], [Measure(k, k, "x") for k in kinds]).first()
    assert [round(v, 6) for v in out] == [6.0, 3, 2.0, 1.0, 3.0, 3, 2.0, 0.816497, 0.666667, 1.0, 1.0]
    assert aggregate(df, [], [Measure("p", "percentile", "x", 25)]).first()[0] == 1.5
    with pytest.raises(ValueError):
        aggregate(df, [], [Measure("z", "mode", "x")])


def test_conversion_counts_each_base_event_once(spark):
    ev = spark.sql("""select * from values (1, 'click', timestamp'2024-01-01 00:00:00'), (1, 'buy', timestamp'2024-01-01 00:59:00'), (1, 'buy', timestamp'2024-01-01 01:00:00'),
        (2, 'click', timestamp'2024-01-01 00:30:00'), (2, 'buy', timestamp'2024-01-01 01:31:00'), (3, 'click', timestamp'2024-01-01 05:00:00'),
        (3, 'buy', timestamp'2024-01-01 05:00:00') t(u, k, ts)""")
    out = m.conversion_metric(ev, "u", "ts", "k", "click", "buy", 3600).first()
    assert (out.base_events, out.converted_events, out.converted_users) == (3, 2, 2)


def test_window_helpers(spark):
    df = spark.range(10).selectExpr("id as k", "id % 2 as g")
    tiles = [r[0] for r in w.ntile(df, [], ["k"], 4, "t").orderBy("k").select("t").collect()]
    assert tiles == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    assert w.top_percent(df, ["-k"], 25).count() == 3
    assert rows(w.percent_of_total(df, "k", ["g"]).filter("k = 8"), "share") == [(0.4,)]
    assert [r[0] for r in rows(w.ntile(df.limit(2), [], ["k"], 4, "t"), "t")] == [1, 2]


def test_model_spec(spark, sales):
    people = spark.createDataFrame([(10, "ann")], "id int, name string")
    spec = ModelSpec({"s": (sales, "total > 1"), "p": people}, [ModelJoin("p", {"customer_id": "id"}, "inner")], [ModelColumn("who", "upper(name)")],
                     group_by=["who"], aggregations={"n": "count(*)", "t": "sum(total)"}, having="n > 1", order_by=["-t"])
    assert rows(build_model(spec)) == [("ANN", 2, 12.0)]
    assert snake_case_columns(sales.selectExpr("total as `A b`", "status as `a-B`")).columns == ["a_b", "a_b_2"]


def test_chart_shapes(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 5.0)], "g string, v double")
    assert rows(charts.box_plot_stats(df, ["g"], "v")) == [("a", 1.0, 2.0, 3.0, 4.0, 4.0, 1), ("b", 5.0, 5.0, 5.0, 5.0, 5.0, 0)]
    assert rows(charts.box_plot_outliers(df, ["g"], "v")) == [("a", 100.0, 1)]
    tree = charts.hierarchy_tree(spark.createDataFrame([("x", None, 1), ("x", "y", 2)], "a string, b string, v int"), ["a", "b"], "v")
    assert rows(tree) == [("x", 1, 3), ("x / y", 2, 2), ("x / ∅", 2, 1)]
    links = charts.flow_links(spark.createDataFrame([("a", "b", 2), ("a", "", 3), ("b", "a", -1)], "s string, t string, v int"), "s", "t", "v")
    assert rows(links) == [("a", "b", 2)]
    with pytest.raises(ValueError):
        charts.heatmap_matrix(df, "g", "v", Measure("n", "count"), max_y=2)
    steps = charts.funnel_steps(spark.createDataFrame([("see",)] * 4 + [("buy",)], "s string"), "s", ["see", "buy"], Measure("n", "count"))
    assert rows(steps) == [(1, "see", 4, None, 1.0), (2, "buy", 1, 0.25, 0.25)]
    assert rows(charts.word_counts(spark.createDataFrame([("Été, été! a1",)], "t string"), "t")) == [("a1", 1), ("été", 2)]


def test_dimension_join_pushes_filters_and_columns(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = shapes.aggregation_query(orders, ["o_orderstatus"], [Measure("t", "sum", "o_totalprice")],
                                    [Filter("o_custkey", "<", 10)])._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_custkey,10)" in plan and "o_orderpriority" not in plan


def test_to_many_dimensions_count_a_row_once_per_group(spark):
    orders = spark.createDataFrame([(1, 10.0, "a"), (2, 7.0, "b"), (3, 1.0, "a")], "oid int, total double, shop string")
    lines = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 3), (2, "x", 4)], "line_order int, flag string, part int")
    parts = spark.createDataFrame([(1, "red"), (2, "red"), (3, "blue"), (4, "blue")], "pid int, colour string")
    layer = SemanticLayer(
        [SemanticModel("orders", orders, [Dimension("shop", "shop")], [Measure("value", "sum", "total"), Measure("n", "count", "oid")]),
         SemanticModel("lines", lines, [Dimension("flag", "flag")], [Measure("rows", "count", "line_order")]),
         SemanticModel("parts", parts, [Dimension("colour", "colour")], kind="dimension")],
        [Relationship("lines", "orders", "line_order", "oid"), Relationship("lines", "parts", "part", "pid")])
    ask = lambda *a, **k: rows(semantic_query(layer, SemanticQuery(*a, **k)))
    assert ask(["value", "n"], ["flag"]) == [("x", 17.0, 2), ("y", 10.0, 1)]
    assert ask(["value"], ["colour"]) == [("blue", 17.0), ("red", 10.0)]
    assert ask(["value"], ["shop"], {"flag": "x"}) == [("a", 10.0), ("b", 7.0)]
    assert ask(["value"], ["flag"], pre_aggregate=True) == ask(["value"], ["flag"])
    assert ask(["rows"], ["shop"]) == [("a", 3), ("b", 1)]


def test_limits_are_honoured_or_refused(spark):
    df = spark.range(120_000).selectExpr("id as k", "id % 3 as v")
    assert page(df, limit=110_000).count() == 110_000
    with pytest.raises(ValueError):
        page(df, limit=10, max_limit=5)
    assert shapes.top_n_query(df, "k", Measure("x", "sum", "v"), 1500).count() == 1500
    assert shapes.aggregation_query(df, ["k"], [Measure("x", "sum", "v")], limit=11_000).count() == 11_000


def test_order_statistics_are_exact_and_keep_every_group(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 2.0), ("b", "p", None), ("c", "p", 5.0)], "g string, h string, x double")
    both = [Measure("m", "median", "x"), Measure("hi", "median", "x", filters=(Filter("h", "=", "q"),)), Measure("p90", "percentile", "x", 90)]
    assert rows(aggregate(df, ["g"], both), "g", "m", "hi") == [("a", 1.5, 2.0), ("b", None, None), ("c", 5.0, None)]
    assert rows(m.hierarchy_rollup(df, ["g"], [Measure("m", "median", "x")])) == [("a", 1.5, 1), ("b", None, 1), ("c", 5.0, 1), (None, 2.0, 0)]
    crossed = rows(m.pivot_with_subtotals(df, "g", "h", ["p", "q"], Measure("m", "median", "x")))
    assert crossed[0] == ("a", 0, 1.0, 2.0, 1.5) and crossed[-1] == (None, 1, 3.0, 2.0, 2.0)
    with pytest.raises(ValueError):
        Measure("m", "median", "x").to_column()


def test_conversion_of_a_busy_user_is_linear(spark):
    events = spark.range(60_000).selectExpr("1 as u", "case when id % 2 = 0 then 'view' else 'buy' end as kind", "timestamp_seconds(id) as ts")
    start = time.time()
    found = m.conversion_metric(events, "u", "ts", "kind", "view", "buy", 10_000_000).first()
    assert (found.base_events, found.converted_events) == (30_000, 30_000) and time.time() - start < 60


def test_conditional_to_many_edges(spark):
    """A measured row counts once in each group that its condition admits, equal rows each by themselves."""
    sales = spark.createDataFrame([(1, 5.0, 3), (1, 5.0, 3), (2, 7.0, 9), (3, 1.0, 0), (None, 2.0, 1)], "k int, total double, least int")
    visits = spark.createDataFrame([(1, "web", 4), (1, "web", 8), (1, "shop", 5), (1, "app", 2), (2, "web", 1), (3, None, 5)], "vk int, place string, score int")
    models = [SemanticModel("sales", sales, [], [Measure("revenue", "sum", "total"), Measure("n", "count", "total"), Measure("top", "max", "total")]),
              SemanticModel("visits", visits, [Dimension("place", "place"), Dimension("points", "score")], kind="dimension")]
    edge = lambda how: Relationship("sales", "visits", "k", "vk", how, "score > least", "one_to_many")
    ask = lambda how, **more: rows(semantic_query(SemanticLayer(models, [edge(how)]), SemanticQuery(["revenue", "n"], ["place"], **more)))
    assert ask("inner") == [("shop", 10.0, 2), ("web", 10.0, 2), (None, 1.0, 1)]
    assert ask("left") == [("shop", 10.0, 2), ("web", 10.0, 2), (None, 10.0, 3)]
    assert ask("left", filters=[Filter("points", ">=", 5)]) == [("shop", 10.0, 2), ("web", 10.0, 2), (None, 1.0, 1)]
    assert rows(semantic_query(SemanticLayer(models, [edge("left")]), SemanticQuery(["top"], ["place"])))[0][0] == "shop"


def test_comparison_names_stay_apart(spark):
    df = spark.createDataFrame([("a b", 1), ("a_b", 2), ("a b", 3)], "k string, v int")
    out = shapes.comparison_query(df, "k", ["a b", "a_b"], [Measure("s", "sum", "v")])
    assert out.columns == ["s_a b", "s_a_b", "s_total"] and rows(out) == [(4, 2, 6)]
