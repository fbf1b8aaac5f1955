"""Quality tests over the given tables; each returns its failing rows."""

from pyspark.sql import functions as F

from tidemark.quality import checks as q, suite as s
from tidemark.session import work_path

from .registry import query

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
LINE_SQL = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem where "


@query("test_unique", [158, 203], "select o_custkey, count(*) as n_records from orders group by 1 having count(*) > 1")
def test_unique(t):
    return q.unique(t.orders, "o_custkey")


@query("test_not_null", [159, 202], """
    select doc_id from documents left join labels using (doc_id) where quality is null""")
def test_not_null(t):
    return q.not_null(t.documents.join(t.labels, "doc_id", "left"), "quality").select("doc_id")


@query("test_values_null", [202], "select doc_id, toxic from documents left join labels using (doc_id) where toxic is not null and lang = 'en'")
def test_values_null(t):
    return q.values_null(t.documents.join(t.labels, "doc_id", "left"), "toxic", "lang = 'en'").select("doc_id", "toxic")


@query("test_accepted_values", [160], """
    select o_orderpriority as value_field, count(*) as n_records from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1""")
def test_accepted_values(t):
    return q.accepted_values(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("test_relationships", [161], "select doc_id from documents where doc_id not in (select doc_id from labels)")
def test_relationships(t):
    return q.relationships(t.documents, "doc_id", t.labels, "doc_id")


@query("test_accepted_range", [162, 196], LINE_SQL + "l_quantity < 3 or l_quantity > 48")
def test_accepted_range(t):
    return q.accepted_range(t.lineitem, "l_quantity", 3, 48).select(*LINE)


@query("test_values_between_strict", [196], LINE_SQL + "l_returnflag = 'N' and not (l_quantity > 2 and l_quantity < 49)")
def test_values_between_strict(t):
    return q.values_between(t.lineitem, "l_quantity", 2, 49, True, "l_returnflag = 'N'").select(*LINE)


@query("test_at_least_one", [163], """
    select source, count(case when quality = 0 then 1 end) as non_null from documents left join labels using (doc_id) group by 1 having count(case when quality = 0 then 1 end) = 0
    union all select 'everything', 0::bigint from (select count(case when n_chars < 0 then 1 end) as c from documents) where c = 0""")
def test_at_least_one(t):
    df = t.documents.join(t.labels, "doc_id", "left").withColumn("bad", F.expr("case when quality = 0 then 1 end"))
    whole = q.at_least_one(t.documents.withColumn("neg", F.expr("case when n_chars < 0 then 1 end")), "neg")
    return q.at_least_one(df, "bad", ["source"]).unionByName(whole.select(F.lit("everything").alias("source"), "non_null"))


@query("test_cardinality_equality", [164], """
    with a as (select o_custkey as value_field, count(*) as rows_a from orders group by 1), b as (select c_custkey as value_field, count(*) as rows_b from customer group by 1)
    select coalesce(a.value_field, b.value_field) as value_field, rows_a, rows_b from a full join b on a.value_field = b.value_field where rows_a is distinct from rows_b""")
def test_cardinality_equality(t):
    return q.cardinality_equality(t.orders, "o_custkey", t.customer, "c_custkey")


@query("test_equal_rowcount", [165], """
    with a as (select user_id % 20 as g, count(*) as n from events where event_type = 'click' group by 1), b as (select user_id % 20 as g, count(*) as n from events where event_type = 'view' and user_id % 20 <> 3 group by 1)
    select coalesce(a.g, b.g) as g, coalesce(a.n, 0) as count_a, coalesce(b.n, 0) as count_b, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) as diff_count from a full join b on a.g = b.g
    where coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def test_equal_rowcount(t):
    e = t.events.withColumn("g", F.col("user_id") % 20)
    return q.equal_rowcount(e.filter("event_type = 'click'"), e.filter("event_type = 'view' and g <> 3"), ["g"])


@query("test_equality", [166], """
    with a as (select c_custkey, c_mktsegment from customer), b as (select c_custkey, case when c_custkey % 97 = 0 then 'X' else c_mktsegment end as c_mktsegment from customer)
    select *, 'a_minus_b' as which_diff from (select * from a except select * from b) union all select *, 'b_minus_a' from (select * from b except select * from a)""")
def test_equality(t):
    changed = t.customer.withColumn("c_mktsegment", F.expr("case when c_custkey % 97 = 0 then 'X' else c_mktsegment end"))
    return q.equality(t.customer, changed, ["c_custkey", "c_mktsegment"])


@query("test_expression_is_true", [167], LINE_SQL + "not (l_quantity * 1000 < l_extendedprice) and l_discount > 0.05")
def test_expression_is_true(t):
    return q.expression_is_true(t.lineitem, "l_quantity * 1000 < l_extendedprice", "l_discount > 0.05D").select(*LINE)


@query("test_fewer_rows_than", [168], """
    with a as (select n_regionkey as g, count(*) as a from supplier join nation on s_nationkey = n_nationkey group by 1), b as (select n_regionkey as g, 5 * count(*) - 5 as b from nation group by 1)
    select a.g, a as count_a, b as count_b, (case when a = b then 1 else a - b end)::bigint as row_count_delta from a join b on a.g = b.g where a >= b""")
def test_fewer_rows_than(t):
    a = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("g"))
    b = t.nation.select(F.col("n_regionkey").alias("g"), F.explode(F.expr("sequence(1, 5)")).alias("i"), "n_nationkey")
    return q.fewer_rows_than(a, b.filter("not (n_nationkey < 5)").select("g").union(t.nation.filter("false").select("n_regionkey")), ["g"])


_RANGES = "select o_custkey, o_orderdate::date as lower_bound, (o_orderdate + interval 60 day)::date as upper_bound from orders"


@query("test_mutually_exclusive_ranges", [169], f"""
    with r as ({_RANGES}), w as (select *, lead(lower_bound) over (partition by o_custkey order by lower_bound, upper_bound) as next_lower_bound from r)
    select *, next_lower_bound is null as is_last_record from w where next_lower_bound is not null and not (upper_bound <= next_lower_bound)""")
def test_mutually_exclusive_ranges(t):
    r = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("d")).withColumn("e", F.date_add("d", 60))
    return q.mutually_exclusive_ranges(r, "d", "e", ["o_custkey"])


@query("test_ranges_without_gaps", [169], f"""
    with r as ({_RANGES}), w as (select *, lead(lower_bound) over (partition by o_custkey order by lower_bound, upper_bound) as next_lower_bound from r)
    select *, next_lower_bound is null as is_last_record from w where next_lower_bound is not null and not (upper_bound = next_lower_bound)""")
def test_ranges_without_gaps(t):
    r = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("d")).withColumn("e", F.date_add("d", 60))
    return q.mutually_exclusive_ranges(r, "d", "e", ["o_custkey"], gaps="not_allowed", zero_length_range_allowed=True)


@query("infer_default_tests", [170], """
    select 'docs' as table_name, 'unique_id' as check_name, (select count(*) from (select l_orderkey from lineitem group by 1 having count(*) > 1)) as failed_count
    union all select 'docs', 'not_null_id', 0 union all select 'docs', 'not_null_part_id', count(*) filter (l_partkey % 50 = 0) from lineitem
    union all select 'docs', 'not_null_status', count(*) filter (l_linestatus = 'F') from lineitem union all select 'docs', 'not_null_price', 0""")
def infer_default_tests(t):
    df = t.lineitem.selectExpr("l_orderkey as id", "nullif(l_partkey, case when l_partkey % 50 = 0 then l_partkey end) as part_id",
                               "nullif(l_linestatus, 'F') as status", "l_extendedprice as price")
    tests = s.infer_default_tests(df, primary_key=["id"], required=["price"])
    return s.run_quality_suite(df, "docs", tests).select("table_name", "check_name", "failed_count")


@query("test_not_accepted_values", [171], "select distinct p_type as value_field from part where p_type in ('PROMO', 'GONE', 'SMALL')")
def test_not_accepted_values(t):
    return q.not_accepted_values(t.part, "p_type", ["PROMO", "GONE", "SMALL"])


@query("test_not_constant", [172], """
    select l_orderkey, count(distinct l_returnflag) as distinct_values from lineitem group by 1 having count(distinct l_returnflag) = 1""")
def test_not_constant(t):
    return q.not_constant(t.lineitem, "l_returnflag", ["l_orderkey"])


@query("test_not_empty_string", [173], "select event_id from events where trim(case when event_type = 'view' then '  ' else event_type end) = ''")
def test_not_empty_string(t):
    return q.not_empty_string(t.events.withColumn("k", F.expr("case when event_type = 'view' then '  ' else event_type end")), "k").select("event_id")


@query("test_not_null_proportion", [174], """
    select source, round(avg(case when quality is null then 0.0 else 1.0 end), 10) as not_null_proportion from documents left join labels using (doc_id)
    group by 1 having avg(case when quality is null then 0.0 else 1.0 end) < 0.4""")
def test_not_null_proportion(t):
    return (q.not_null_proportion(t.documents.join(t.labels, "doc_id", "left"), "quality", 0.4, group_by=["source"])
            .withColumn("not_null_proportion", F.round("not_null_proportion", 10)))


@query("test_recency", [175], "select user_id, max(ts) as most_recent from events group by 1 having max(ts) < timestamp '2024-01-31' - interval 36 hour")
def test_recency(t):
    return q.recency(t.events, "ts", "hour", 36, "2024-01-31", ["user_id"])


@query("test_relationships_where", [176], """
    select o_custkey from orders where o_totalprice > 400000 and o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def test_relationships_where(t):
    return q.relationships_where(t.orders, "o_custkey", t.customer, "c_custkey", "o_totalprice > 400000", "c_mktsegment = 'BUILDING'")


@query("test_sequential_values", [177], """
    with w as (select o_custkey, o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as previous_o_orderkey from orders)
    select * from w where not (o_orderkey = previous_o_orderkey + 1)""")
def test_sequential_values(t):
    return q.sequential_values(t.orders, "o_orderkey", 1, None, ["o_custkey"])


@query("test_sequential_dates", [177], """
    with d as (select distinct date_trunc('minute', ts) as h from events), w as (select h, lag(h) over (order by h) as previous_h from d)
    select * from w where h <> previous_h + interval 1 minute""")
def test_sequential_dates(t):
    hours = t.events.select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("h")).distinct()
    return q.sequential_values(hours, "h", 1, "minute")


@query("test_unique_combination_of_columns", [178], """
    select l_orderkey, l_linenumber, count(*) as n_records from lineitem group by 1, 2 having count(*) > 1""")
def test_unique_combination_of_columns(t):
    return q.unique_combination_of_columns(t.lineitem, ["l_orderkey", "l_linenumber"])


_DC = "select event_type, count(distinct user_id) as expression from events group by 1 having not (count(distinct user_id) {})"


@query("test_distinct_count_greater_than", [179], _DC.format("> 1000"))
def test_distinct_count_greater_than(t):
    return q.distinct_count_greater_than(t.events, "user_id", 1000, ["event_type"])


@query("test_distinct_count_less_than", [180], _DC.format("< 100"))
def test_distinct_count_less_than(t):
    return q.distinct_count_less_than(t.events, "user_id", 100, ["event_type"])


@query("test_distinct_count_equal", [181], _DC.format("= 7"))
def test_distinct_count_equal(t):
    return q.distinct_count_equal(t.events, "user_id", 7, ["event_type"])


@query("test_distinct_count_equal_other_table", [182], """
    with x as (select (select count(distinct doc_id) from documents) as expression, (select count(distinct doc_id) from labels) as compare_expression)
    select *, abs(expression - compare_expression) as expression_difference, round(abs(expression - compare_expression) / expression, 10) as expression_difference_percent from x where expression <> compare_expression""")
def test_distinct_count_equal_other_table(t):
    return (q.distinct_count_equal_other_table(t.documents, "doc_id", t.labels, "doc_id")
            .withColumn("expression_difference_percent", F.round("expression_difference_percent", 10)))


@query("test_distinct_values_in_set", [183], "select distinct lang as value_field from documents where lang not in ('en', 'fr')")
def test_distinct_values_in_set(t):
    return q.distinct_values_in_set(t.documents, "lang", ["en", "fr"])


@query("test_distinct_values_contain_set", [184], """
    select v as value_field from (values ('en'), ('pt'), ('it')) s(v) where v not in (select lang from documents)""")
def test_distinct_values_contain_set(t):
    return q.distinct_values_contain_set(t.documents, "lang", ["en", "pt", "it"])


@query("test_distinct_values_equal_set", [185], """
    with c as (select distinct lang from documents), x as (select unnest(['en', 'fr', 'pt']) as v)
    select coalesce(lang, v) as value_field, lang is not null as in_column, v is not null as in_set from c full join x on lang = v where lang is null or v is null""")
def test_distinct_values_equal_set(t):
    return q.distinct_values_equal_set(t.documents, "lang", ["en", "fr", "pt"])


def _agg(name, op, fn, sql_fn, low, high, column="l_extendedprice", digits=6):
    sql = f"""select l_suppkey, round({sql_fn}, {digits}) as expression from lineitem group by 1 having not ({sql_fn} between {low} and {high})"""

    @query(name, [op], sql)
    def run(t):
        return fn(t.lineitem, column, low, high, ["l_suppkey"]).withColumn("expression", F.round("expression", digits))


_agg("test_max_between", 186, q.max_between, "max(l_extendedprice)", 0, 104800)
_agg("test_mean_between", 187, q.mean_between, "avg(l_extendedprice)", 38000, 38500)
_agg("test_median_between", 188, q.median_between, "median(l_extendedprice)", 35000, 36000)
_agg("test_min_between", 189, q.min_between, "min(l_extendedprice)", 905, 920)
_agg("test_quantile_between", 192, lambda d, c, lo, hi, g: q.quantile_between(d, c, 0.9, lo, hi, g), "quantile_cont(l_extendedprice, 0.9)", 75000, 78000)
_agg("test_stdev_between", 193, q.stdev_between, "stddev_samp(l_extendedprice)", 22000, 23000, digits=4)
_agg("test_sum_between", 194, q.sum_between, "sum(l_extendedprice)", 0, 23000000, digits=2)


@query("test_most_common_value_in_set", [190], """
    with c as (select lang as value_field, count(*) as value_count from documents group by 1 order by value_count desc, lang limit 2)
    select value_field, value_count from c order by value_count asc limit 1""")
def test_most_common_value_in_set(t):
    return q.most_common_value_in_set(t.documents, "lang", ["en"], 2)


@query("test_proportion_unique_between", [191], """
    select l_suppkey, round(count(distinct l_partkey)::double / count(l_partkey), 10) as expression from lineitem group by 1
    having not (count(distinct l_partkey)::double / count(l_partkey) between 0.87 and 0.88)""")
def test_proportion_unique_between(t):
    return (q.proportion_unique_between(t.lineitem, "l_partkey", 0.87, 0.88, ["l_suppkey"])
            .withColumn("expression", F.round("expression", 10)))


@query("test_unique_count_between", [195], """
    select l_suppkey, count(distinct l_partkey) as expression from lineitem group by 1 having not (count(distinct l_partkey) between 500 and 520)""")
def test_unique_count_between(t):
    return q.unique_count_between(t.lineitem, "l_partkey", 500, 520, ["l_suppkey"])


_PREV = """with v as (select {g}{s} as sort_column, {c} as value_field from {t}), w as (select *, lag(value_field) over ({p}order by sort_column, value_field) as value_field_lag from v)
    select * from w where value_field_lag is not null and not (value_field {op} value_field_lag)"""


@query("test_values_decreasing", [197], _PREV.format(g="", s="event_id", c="ts", t="events", p="", op="< "))
def test_values_decreasing(t):
    return q.values_decreasing(t.events, "ts", "event_id")


@query("test_values_increasing", [198], _PREV.format(g="o_custkey, ", s="o_orderkey", c="o_orderdate", t="orders", p="partition by o_custkey ", op=">="))
def test_values_increasing(t):
    return q.values_increasing(t.orders, "o_orderdate", "o_orderkey", False, ["o_custkey"])


@query("test_values_in_set", [199], "select doc_id, quality from documents left join labels using (doc_id) where quality is null or quality not in (1, 2)")
def test_values_in_set(t):
    return q.values_in_set(t.documents.join(t.labels, "doc_id", "left"), "quality", [1, 2]).select("doc_id", "quality")


@query("test_values_not_in_set", [200], "select doc_id, lang from documents where lang in ('de', 'es')")
def test_values_not_in_set(t):
    return q.values_not_in_set(t.documents, "lang", ["de", "es"]).select("doc_id", "lang")


@query("test_column_type", [201], """
    select 'l_quantity' as column_name, 'int|bigint' as expected, 'double' as actual, count(*) as affected_rows from lineitem
    union all select 'l_comment', 'string', 'missing', count(*) from lineitem""")
def test_column_type(t):
    return (q.column_type_in_list(t.lineitem, "l_quantity", ["int", "bigint"]).unionByName(q.column_of_type(t.lineitem, "l_comment", "string"))
            .unionByName(q.column_of_type(t.lineitem, "l_tax", "double")))


@query("test_consistent_casing", [204], """
    with v as (select distinct case when event_id % 7 = 0 then upper(event_type) else event_type end as v from events)
    select lower(v) as inconsistent_value, count(*) as spellings from v group by 1 having count(*) > 1""")
def test_consistent_casing(t):
    df = t.events.withColumn("kind", F.expr("case when event_id % 7 = 0 then upper(event_type) else event_type end"))
    return q.consistent_casing(df, "kind")


@query("test_within_n_stdevs", [205], """
    with g as (select o_custkey, round(sum(o_totalprice), 2) as total from orders group by 1), s as (select avg(total) as m, stddev_samp(total) as sd from g)
    select o_custkey, total, round((total - m) / sd, 8) as sigma from g, s where abs((total - m) / sd) > 2""")
def test_within_n_stdevs(t):
    return (q.within_n_stdevs(t.orders, "o_totalprice", ["o_custkey"], 2)
            .withColumns({"total": F.round("total", 2), "sigma": F.round("sigma", 8)}))


@query("test_within_n_moving_stdevs", [206], """
    with m as (select ts::date as metric_period, event_type, sum(value) as metric_value from events group by 1, 2),
    d as (select *, coalesce(ln(nullif(metric_value, 0)), 0) - coalesce(ln(nullif(lag(metric_value) over (partition by event_type order by metric_period), 0)), 0) as metric_test_value from m),
    r as (select *, avg(metric_test_value) over w as rolling_average, stddev_samp(metric_test_value) over w as rolling_stddev from d
      window w as (partition by event_type order by metric_period rows between 7 preceding and 1 preceding)),
    z as (select *, (metric_test_value - rolling_average) / nullif(rolling_stddev, 0) as metric_sigma from r)
    select metric_period, event_type, round(metric_value, 2) as metric_value, round(metric_sigma, 7) as metric_sigma from z
    where metric_period >= date '2024-01-17' and metric_period < date '2024-01-31' and not (metric_sigma between -1.5 and 1.5)""")
def test_within_n_moving_stdevs(t):
    out = q.within_n_moving_stdevs(t.events, "value", "ts", "2024-01-31", sigma=1.5, group_by=["event_type"])
    return out.select("metric_period", "event_type", F.round("metric_value", 2).alias("metric_value"), F.round("metric_sigma", 7).alias("metric_sigma"))


@query("test_data_for_every_day", [207], """
    with b as (select min(o_orderdate)::date as s, max(o_orderdate)::date as e from orders where o_totalprice > 400000),
    d as (select unnest(generate_series(s, e - 1, interval 1 day))::date as period from b)
    select period from d where period not in (select o_orderdate::date from orders where o_totalprice > 400000)""")
def test_data_for_every_day(t):
    return q.data_for_every_n_datepart(t.orders, "o_orderdate", "day", row_condition="o_totalprice > 400000")


@query("test_data_for_every_3_days", [207], """
    with f as (select o_orderdate::date as d from orders where o_totalprice > 470000), b as (select min(d) as s, max(d) as e from f),
    p as (select unnest(generate_series(s, e - 1, interval 3 day))::date as period from b)
    select period from p where period not in (select (s + (((d - s) // 3) * 3)::int)::date from f, b)""")
def test_data_for_every_3_days(t):
    return q.data_for_every_n_datepart(t.orders, "o_orderdate", "day", 3, row_condition="o_totalprice > 470000")


@query("test_pair_a_greater_than_b", [208], "select o_orderkey, c_custkey from orders join customer on o_custkey = c_custkey where not (o_totalprice > c_acctbal * 5)")
def test_pair_a_greater_than_b(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return q.pair_a_greater_than_b(df, "o_totalprice", "c_acctbal * 5").select("o_orderkey", "c_custkey")


@query("test_pair_equal", [209], LINE_SQL + "not (l_discount = l_tax) and l_linenumber = 1")
def test_pair_equal(t):
    return q.pair_equal(t.lineitem, "l_discount", "l_tax", "l_linenumber = 1").select(*LINE)


@query("test_pair_in_set", [210], LINE_SQL + "not ((l_returnflag = 'A' and l_linestatus = 'F') or (l_returnflag = 'N' and l_linestatus = 'O'))")
def test_pair_in_set(t):
    return q.pair_in_set(t.lineitem, "l_returnflag", "l_linestatus", [("A", "F"), ("N", "O")]).select(*LINE)


@query("test_compound_columns_unique", [211], """
    select l_orderkey, nullif(l_linenumber, 7) as line, count(*) as n_records from lineitem where nullif(l_linenumber, 7) is not null group by 1, 2 having count(*) > 1""")
def test_compound_columns_unique(t):
    df = t.lineitem.withColumn("line", F.expr("nullif(l_linenumber, 7)"))
    return q.compound_columns_unique(df, ["l_orderkey", "line"], "any_value_is_missing")


@query("test_multicolumn_sum_equal", [212], """
    select l_orderkey, sum(l_quantity) + sum(l_linenumber) as expression from lineitem group by 1 having not (sum(l_quantity) + sum(l_linenumber) = 100)""")
def test_multicolumn_sum_equal(t):
    return q.multicolumn_sum_equal(t.lineitem, ["l_quantity", "l_linenumber"], 100, ["l_orderkey"])


@query("test_unique_within_record", [213], """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber = l_suppkey and l_suppkey = l_quantity then 1 else 2 end as distinct_values
    from lineitem where l_linenumber = l_suppkey or l_suppkey = l_quantity or l_linenumber = l_quantity""")
def test_unique_within_record(t):
    df = t.lineitem.withColumn("qty", F.col("l_quantity").cast("bigint"))
    return q.unique_within_record(df, ["l_linenumber", "l_suppkey", "qty"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "distinct_values")


@query("test_length_between", [214], "select doc_id, n_chars from documents where not (length(text) between 300 and 5000)")
def test_length_between(t):
    return q.length_between(t.documents, "text", 300, 5000).select("doc_id", "n_chars")


@query("test_length_equal", [214], "select p_partkey, p_name from part where length(p_name) <> 8")
def test_length_equal(t):
    return q.length_equal(t.part, "p_name", 8).select("p_partkey", "p_name")


_PART = "select p_partkey, p_name from part where "


def _part_test(name, op, sql, fn):
    @query(name, [op], _PART + sql)
    def run(t):
        return fn(t.part).select("p_partkey", "p_name")


_part_test("test_match_like", 215, "p_name not like 'red%'", lambda d: q.match_like(d, "p_name", "red%"))
_part_test("test_not_match_like", 215, "p_name like '%ring'", lambda d: q.not_match_like(d, "p_name", "%ring"))
_part_test("test_match_like_list", 216, "not (p_name like 'red%' or p_name like '%bolt')", lambda d: q.match_like_list(d, "p_name", ["red%", "%bolt"]))
_part_test("test_match_like_list_all", 216, "not (p_name like 's%' and p_name like '%ring')", lambda d: q.match_like_list(d, "p_name", ["s%", "%ring"], "all"))
_part_test("test_not_match_like_list", 216, "p_name like 'red%' and p_name like '%bolt'", lambda d: q.not_match_like_list(d, "p_name", ["red%", "%bolt"]))
_part_test("test_match_regex", 217, "not regexp_matches(p_name, '^[rs]')", lambda d: q.match_regex(d, "p_name", "^[rs]"))
_part_test("test_not_match_regex", 217, "regexp_matches(p_name, '(?i)RING$')", lambda d: q.not_match_regex(d, "p_name", "RING$", "i"))
_part_test("test_match_regex_list", 218, "not (regexp_matches(p_name, '^s') or regexp_matches(p_name, 't$'))", lambda d: q.match_regex_list(d, "p_name", ["^s", "t$"]))
_part_test("test_not_match_regex_list", 218, "regexp_matches(p_name, '^s') or regexp_matches(p_name, 't$')", lambda d: q.not_match_regex_list(d, "p_name", ["^s", "t$"], "all"))


@query("test_column_exists", [219], """
    select 'o_comment' as column_name, 'present' as expected, 'None' as actual, count(*) as affected_rows from orders
    union all select 'o_custkey', 'position 3', '1', count(*) from orders""")
def test_column_exists(t):
    return (q.column_exists(t.orders, "o_comment").unionByName(q.column_exists(t.orders, "o_custkey", 3))
            .unionByName(q.column_exists(t.orders, "O_ORDERKEY", 0)))


@query("test_grouped_recent_data", [220], """
    select user_id, event_type, max(ts) as latest_timestamp from events where ts <= timestamp '2024-01-25 12:00:00' group by 1, 2 having max(ts) < timestamp '2024-01-25 12:00:00' - interval 7 day""")
def test_grouped_recent_data(t):
    return q.grouped_recent_data(t.events, ["user_id", "event_type"], "ts", "day", 7, "2024-01-25 12:00:00")


@query("test_recent_data", [221], """
    select max(ts) as max_timestamp from events where event_type = 'click' union all select timestamp '1970-01-01' from (select max(ts) as m from events where event_type = 'nothing') where m is null""")
def test_recent_data(t):
    return (q.recent_data(t.events, "ts", "hour", 1, "2024-02-01", "event_type = 'click'")
            .unionByName(q.recent_data(t.events, "ts", "day", 1, "2024-02-01", "event_type = 'nothing'")))


@query("test_aggregation_equal_other_table", [222], """
    with a as (select o_custkey as k, round(sum(o_totalprice), 2) as expression from orders group by 1), b as (select c_custkey as k, round(sum(c_acctbal), 2) as compare_expression from customer group by 1)
    select coalesce(a.k, b.k) as k, expression, compare_expression from a full join b on a.k = b.k where abs(coalesce(expression, 0) - coalesce(compare_expression, 0)) / expression > 0.999""")
def test_aggregation_equal_other_table(t):
    a = t.orders.withColumnRenamed("o_custkey", "k")
    out = q.aggregation_equal_other_table(a, t.customer, "round(sum(o_totalprice), 2)", "round(sum(c_acctbal), 2)", ["k"], ["c_custkey"], tolerance_percent=0.999)
    return out.select("k", "expression", "compare_expression")


@query("test_column_count", [223], """
    select '*' as column_name, '5..5 columns' as expected, '6' as actual, count(*) as affected_rows from orders union all
    select '*', '7..9 columns', '6', count(*) from orders union all select '*', '11..11 columns', '6', count(*) from orders""")
def test_column_count(t):
    return (q.column_count_equal(t.orders, 5).unionByName(q.column_count_between(t.orders, 7, 9))
            .unionByName(q.column_count_equal_other(t.orders, t.lineitem)))


@query("test_columns_contain_set", [224], """
    select 'email' as column_name, 'present' as expected, 'missing' as actual, count(*) as affected_rows from customer union all select 'c_name', 'missing', 'present', count(*) from customer""")
def test_columns_contain_set(t):
    return q.columns_contain_set(t.customer, ["C_CUSTKEY", "email"]).unionByName(q.columns_not_contain_set(t.customer, ["c_name", "ssn"]))


@query("test_columns_match", [225], """
    select 'r_comment' as column_name, 'present' as expected, 'missing' as actual, count(*) as affected_rows from region union all
    select 'r_name', 'missing', 'present', count(*) from region union all select 'r_name', '0:r_name', '0:r_regionkey', count(*) from region union all
    select 'r_regionkey', '1:r_regionkey', '1:r_name', count(*) from region""")
def test_columns_match(t):
    return (q.columns_match_set(t.region, ["r_regionkey", "r_comment"])
            .unionByName(q.columns_match_ordered_list(t.region, ["r_name", "r_regionkey"])))


@query("test_row_count_between", [226], "select o_custkey, count(*) as expression from orders group by 1 having not (count(*) between 5 and 14)")
def test_row_count_between(t):
    return q.row_count_between(t.orders, 5, 14, ["o_custkey"])


@query("test_row_count_equal", [227], "select count(*) as expression from pages having count(*) <> 7")
def test_row_count_equal(t):
    return q.row_count_equal(t.pages, 7)


@query("test_row_count_times_factor", [228], """
    with x as (select (select count(*) from lineitem) as expression, (select count(*) * 3 from orders) as compare_expression)
    select *, abs(expression - compare_expression) as expression_difference from x where expression <> compare_expression""")
def test_row_count_times_factor(t):
    return (q.row_count_equal_other(t.lineitem, t.orders, 3).select("expression", "compare_expression", "expression_difference"))


@query("test_singular", [229], "select o_orderkey from orders where o_totalprice > 100 * (select avg(c_acctbal) from customer)")
def test_singular(t):
    return q.singular_test(t.orders, "select o_orderkey from {this} where o_totalprice > 100 * (select avg(c_acctbal) from {c})", c=t.customer)


@query("schema_contract", [230], """
    select 'quality' as column_name, 'not null' as expected, 'null' as actual, count(*) filter (quality is null) as affected_rows from documents left join labels using (doc_id)
    union all select 'n_chars', 'int', 'bigint', count(*) from documents union all select 'title', 'string', 'missing', count(*) from documents""")
def schema_contract(t):
    return q.schema_contract(t.documents.join(t.labels, "doc_id", "left"), {
        "doc_id": ("bigint", False), "quality": ("int", False), "n_chars": ("int", True), "title": ("string", True), "lang": ("string", False)})


def _line_suite(t):
    return [s.not_null("l_orderkey"), s.accepted_values("l_returnflag", ["A", "N"]), s.in_range("l_quantity", 2, 50, severity="WARN"),
            s.matches("l_linestatus", "^[OF]$"), s.expression("discount_under_tax", "l_discount <= l_tax"),
            s.aggregate_between("mean_quantity", "l_quantity", F.avg("l_quantity"), 20, 25),
            s.relationship("l_partkey", t.part.filter("p_size > 25"), "p_partkey"), s.unique("l_orderkey")]


_SUITE = """
    with l as (select * from lineitem)
    select 'not_null_l_orderkey' as check_name, 'ERROR' as severity, true as passed, count(*) as row_count, 0::bigint as failed_count, null as sample_failures from l
    union all select 'accepted_values_l_returnflag', 'ERROR', false, count(*), count(*) filter (l_returnflag = 'R'), 'R' from l
    union all select 'in_range_l_quantity', 'WARN', false, count(*), count(*) filter (l_quantity < 2), '1.0' from l
    union all select 'matches_l_linestatus', 'ERROR', true, count(*), 0, null from l
    union all select 'discount_under_tax', 'ERROR', false, count(*), count(*) filter (l_discount > l_tax), null from l
    union all select 'mean_quantity', 'ERROR', avg(l_quantity) between 20 and 25, count(*), (case when avg(l_quantity) between 20 and 25 then 0 else 1 end)::bigint, null from l
    union all select 'relationship_l_partkey', 'ERROR', false, count(*), count(*) filter (p_partkey is null), min(case when p_partkey is null then l_partkey::varchar end) from l left join (select * from part where p_size > 25) on l_partkey = p_partkey
    union all select 'unique_l_orderkey', 'ERROR', false, (select count(*) from l), count(*), min(l_orderkey::varchar) from (select l_orderkey from l group by 1 having count(*) > 1)"""


@query("run_quality_suite", [231], f"""
    select check_name, severity, passed, row_count, failed_count, case when check_name <> 'mean_quantity' then sample_failures end as sample_failures from ({_SUITE})""")
def run_quality_suite(t):
    path = work_path(t.spark, "quality")
    s.record_results(s.run_quality_suite(t.lineitem, "lineitem", _line_suite(t), "2024-01-31"), path)
    out = t.spark.read.parquet(path)
    sample = F.expr("case when check_name <> 'mean_quantity' then sample_failures end").alias("sample_failures")
    return out.select("check_name", "severity", "passed", "row_count", "failed_count", sample)


@query("quality_suite_status", [231], f"""
    select 'lineitem' as table_name, count(*) as tests, count(*) filter (not passed and severity = 'ERROR') as errors,
      count(*) filter (not passed and severity = 'WARN') as warnings, 'error' as status from ({_SUITE})""")
def quality_suite_status(t):
    return s.suite_status(s.run_quality_suite(t.lineitem, "lineitem", _line_suite(t), "2024-01-31"))


@query("referential_sample_check", [232], "select least(300, count(distinct l_partkey)) as checked, 0::bigint as orphan_count, 'pass' as status from lineitem")
def referential_sample_check(t):
    return q.referential_sample_check(t.lineitem, "l_partkey", t.part, "p_partkey", 300)
