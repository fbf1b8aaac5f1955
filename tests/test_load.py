"""Load strategies: merges, history, incremental loads, files."""

import datetime as dt
import os

import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.quality.checks import mutually_exclusive_ranges, unique
from tidemark.session import work_path
from tidemark.sources import catalog, load, readers, writers


def customers(spark, data):
    return spark.createDataFrame(data, "id int, name string, city string")


def test_merge_newest_wins_and_null_keys_match(spark):
    target = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (None, "n", 5)], "k int, v string, at int")
    batch = spark.createDataFrame([(1, "a2", 6), (1, "a3", 7), (2, "stale", 1), (3, "c", 1), (None, "n2", 9)], "k int, v string, at int")
    assert rows(load.merge_upsert(target, batch, ["k"], "at")) == [(1, "a3", 7), (2, "b", 5), (3, "c", 1), (None, "n2", 9)]
    with pytest.raises(ValueError):
        load.merge_upsert(target, batch, [])


def test_delete_insert_keeps_all_batch_rows(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    assert rows(load.delete_insert(target, batch, ["k"])) == [(1, "x"), (1, "y"), (2, "b")]


def test_scd2_life_cycle(spark):
    first = load.scd2_initial(customers(spark, [(1, "ann", "rome"), (2, "bob", None), (3, "cy", "oslo")]), "2024-01-01")
    batch = customers(spark, [(1, "ann", "paris"), (2, "bob", None), (4, "dee", "bern")])
    once = load.scd2_merge(first, batch, ["id"], ["city"], as_of="2024-02-01", retire_missing=True, current_flag="is_current")
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    assert rows(once) == [(1, "ann", "paris", b, None, True), (1, "ann", "rome", a, b, False), (2, "bob", None, a, None, True),
                          (3, "cy", "oslo", a, b, False), (4, "dee", "bern", b, None, True)]
    again = load.scd2_merge(once, batch, ["id"], ["city"], as_of="2024-03-01", retire_missing=True, current_flag="is_current")
    assert rows(again) == rows(once)


def test_scd2_keeps_missing_keys_by_default(spark):
    first = load.scd2_initial(customers(spark, [(1, "ann", "rome")]), "2024-01-01")
    out = load.scd2_merge(first, customers(spark, [(2, "bob", "oslo")]), ["id"], None, as_of="2024-02-01")
    assert out.filter("valid_to is null").count() == 2


changes = st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["x", "y", None]), st.integers(1, 6)), min_size=1, max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(feed=changes)
def test_change_feed_history(spark, feed):
    feed = list({(k, at): (k, v, at) for k, v, at in feed}.values())
    df = spark.createDataFrame(feed, "k int, v string, at int")
    whole = load.scd2_apply_changes(None, df, ["k"], ["v"], "at")
    want = []
    for k in sorted({f[0] for f in feed}):
        opened = []
        for _, v, at in sorted((f for f in feed if f[0] == k), key=lambda f: f[2]):
            if not opened or opened[-1][1] != v:
                opened.append((k, v, at))
        ends = [o[2] for o in opened[1:]] + [None]
        want += [(*o, e) for o, e in zip(opened, ends)]
    assert sorted(map(str, rows(whole, "k", "v", "valid_from", "valid_to"))) == sorted(map(str, want))
    # one open version per key, versions do not overlap, a replay adds nothing
    assert unique(whole.filter("valid_to is null"), "k").count() == 0
    assert mutually_exclusive_ranges(whole.filter("valid_to is not null"), "valid_from", "valid_to", ["k"]).count() == 0
    assert rows(load.scd2_apply_changes(whole, df, ["k"], ["v"], "at")) == rows(whole)


def test_snapshot_strategies(spark):
    def src(v, day):
        return spark.sql(f"select 1 as k, '{v}' as v, timestamp_ntz '2024-01-{day:02d}' as updated")

    first = load.snapshot_table(None, src("a", 10), ["k"], "timestamp", "updated")
    for day, versions in ((10, 1), (5, 1), (20, 2)):  # the same, an older and a newer time
        found = load.snapshot_table(first, src("b", day), ["k"], "timestamp", "updated")
        assert found.count() == versions
    assert rows(found.selectExpr("v", "day(valid_from)", "day(valid_to)")) == [("a", 10, 20), ("b", 20, None)]
    checked = load.snapshot_table(None, src("a", 10), ["k"], as_of="2024-01-01")
    assert load.snapshot_table(checked, src("b", 10), ["k"], "check", check_columns=["v"], as_of="2024-02-01").count() == 2
    with pytest.raises(ValueError):
        load.snapshot_table(None, src("a", 1), ["k"])


def test_scd2_takes_one_row_of_a_repeated_key(spark):
    first = load.scd2_initial(spark.createDataFrame([(1, "rome", 1)], "id int, city string, seq int"), "2024-01-01")
    batch = spark.createDataFrame([(1, "oslo", 2), (1, "bern", 3), (2, "linz", 1), (2, "linz", 1)], "id int, city string, seq int")
    out = load.scd2_merge(first, batch, ["id"], ["city"], as_of="2024-02-01", newest_by=["-seq"])
    assert rows(out.filter("valid_to is null"), "id", "city") == [(1, "bern"), (2, "linz")]
    assert rows(out.filter("valid_to is not null"), "id", "city") == [(1, "rome")]


def test_merge_with_repeated_target_rows(spark):
    target = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "k int, at int, v string")
    updates = spark.createDataFrame([(1, 3, "new"), (2, 4, "old"), (None, 1, "n")], "k int, at int, v string")
    assert rows(load.merge_upsert(target, updates, ["k"], "at"), "k", "at", "v") == [(1, 3, "new"), (2, 5, "c"), (None, 1, "n")]


@pytest.mark.parametrize("listed", [0, 100])
def test_merge_partitions_keeps_the_null_partition(spark, listed):
    path = work_path(spark, "nulls")
    spark.createDataFrame([(1, 7, "a"), (2, None, "b"), (3, None, "c"), (4, 8, "d")], "k int, p int, v string").write.partitionBy("p").parquet(path)
    updates = spark.createDataFrame([(2, None, "B"), (4, 8, "D"), (5, 9, "e")], "k int, p int, v string")
    for _ in range(2):
        out = load.merge_partitions(spark, path, updates, ["k"], "p", listed=listed)
        assert rows(out, "k", "p", "v") == sorted([(1, 7, "a"), (2, None, "B"), (3, None, "c"), (4, 8, "D"), (5, 9, "e")], key=lambda r: str(r[0]))


def test_files_follow_rows_and_partitions_drop_by_folder(spark):
    path = work_path(spark, "files")
    df = spark.range(1000).selectExpr("1 as hot", "id", "CASE WHEN id < 900 THEN 'a' END AS p")
    df.write.partitionBy("p").parquet(path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        tasks = writers.spread_files(df, "p", 100).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) >= 7 and max(r["count"] for r in tasks) < 450  # the hot key, 900 rows, is dealt out
    assert writers.drop_partition(spark, path, "p", "a") and spark.read.parquet(path).count() == 100
    assert not writers.drop_partition(spark, path, "p", "a")


def test_versions_are_claimed_and_cleaned(spark):
    table = writers.VersionedTable(spark, work_path(spark, "versions"))
    for n in range(4):
        table.publish(spark.range(n + 1))
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{table.path}/v-00000005.claim")
    files = claim.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.createNewFile(claim)  # a writer that died before it wrote
    table.publish(spark.range(9))
    assert table.read().count() == 9 and table.clean(1) == 5 and table._numbers() == [6] and table.read().count() == 9


def test_incremental_models(spark):
    target = spark.createDataFrame([(1, 1), (2, 2)], "k int, at int")
    source = spark.createDataFrame([(1, 1), (2, 3), (3, 4)], "k int, at int")
    assert rows(load.incremental_model(target, source, "at")) == [(1, 1), (2, 2), (2, 3), (3, 4)]
    assert rows(load.incremental_model(target, source, "at", ["k"], "merge")) == [(1, 1), (2, 3), (3, 4)]
    assert rows(load.incremental_model(None, source, "at")) == rows(source)
    assert load.next_cursor(load.incremental_extract(source, "at", 4), "at", 4) == 4


def test_versioned_table_rebuilds_from_itself(spark):
    table = writers.VersionedTable(spark, work_path(spark, "t"))
    assert not table.exists()
    table.publish(spark.range(5).toDF("id"))
    table.publish(writers.delete_where(table.read(), "id = 2"))
    assert rows(table.read()) == [(0,), (1,), (3,), (4,)]


def test_mutations_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "k int, v int")
    assert rows(writers.delete_where(df, "v > 10")) == [(1, None), (2, 5)]
    assert rows(writers.update_where(df, "v > 10", {"v": "0"})) == [(1, None), (2, 5), (3, 0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("junk\nid;name;score\n1;x;NA\n2;;3.5\n")
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), "id int, name string, score double", ";", header_row=1, na_values=["", "NA"])
    assert rows(got) == [(1, "x", None), (2, None, 3.5)]
    (tmp_path / "b.json").write_text('[{"id": 1, "t": "p\\nq"}, {"id": 2}]')
    assert rows(readers.read_json(spark, str(tmp_path / "b.json"), "id int, t string")) == [(1, "p\nq"), (2, None)]


def test_preview_and_projection(spark):
    df = spark.sql("select 1 as a, date'2024-01-02' as d, array(1) as x")
    assert readers.preview(df).dtypes == [("a", "int"), ("d", "string"), ("x", "string")]
    assert readers.project_columns(df, ["d", "zz"]).columns == ["d"]
    with pytest.raises(KeyError):
        readers.run_parameterized(spark, "select {{x}}", {})
    assert readers.run_parameterized(spark, "select {{x}} as v", {"x": "'; drop"}).first()[0] == "'; drop"


@pytest.mark.parametrize("source,dialect,kind", [
    ("varchar(255)", "postgresql", T.StringType()), ("int4", "postgresql", T.IntegerType()), ("int8", "postgresql", T.LongType()),
    ("numeric(18,4)", "postgresql", T.DecimalType(18, 4)), ("numeric", "postgresql", T.DoubleType()), ("decimal", "mysql", T.DecimalType(18, 4)),
    ("double precision", "postgresql", T.DoubleType()), ("real", "postgresql", T.FloatType()), ("timestamp with time zone", "postgresql", T.TimestampType()),
    ("tinyint(1)", "mysql", T.BooleanType()), ("tinyint", "mysql", T.ByteType()), ("float", "mysql", T.FloatType()), ("set", "mysql", T.ArrayType(T.StringType())),
    ("date", "oracle", T.TimestampType()), ("number(10,2)", "oracle", T.DecimalType(10, 2)), ("number", "oracle", T.DoubleType()),
    ("interval day to second", "oracle", T.LongType()), ("tinyint", "mssql", T.ShortType()), ("money", "sqlserver", T.DecimalType(18, 4)),
    ("bit", "sqlserver", T.BooleanType()), (" INTEGER ", "postgres", T.IntegerType()), ("custom_type", "postgresql", T.StringType()),
    (None, "postgresql", T.StringType()), ("time without time zone", "postgresql", T.StringType())])
def test_type_map(source, dialect, kind):
    assert catalog.map_type(source, dialect) == kind


def test_wide_decimals_are_refused(spark):
    with pytest.raises(ValueError):
        catalog.map_type("numeric(40,8)")
    assert catalog.map_type("numeric(40,8)", allow_lossy=True) == T.DecimalType(38, 8)


def test_freshness_levels(spark):
    df = spark.sql("select timestamp'2024-01-30 00:00:00' as t")
    status = lambda as_of: catalog.source_freshness(df, "t", as_of).first().status
    assert [status(d) for d in ("2024-01-30 12:00:00", "2024-01-31 06:00:00", "2024-02-03")] == ["pass", "warn", "error"]
    assert catalog.source_freshness(df.filter("false"), "t", "2024-02-03").first().status == "error"


def test_partitioned_write_sorts_and_spreads(spark, sf):
    path = work_path(spark, "months")
    writers.partitioned_write(spark.read.parquet(f"{sf}/orders.parquet"), path, "o_orderdate", ["o_custkey"], rows_per_file=40)
    back = spark.read.parquet(path)
    assert back.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    plan = back.filter(F.col("month") == "199703")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_json_lines_end_at_line_feeds_only(spark, tmp_path):
    import gzip
    text = '{"a": 1, "b": "x\u2028y\x85z"}\n\n{"a": 2, "b": "q"}\n'
    (tmp_path / "plain.jsonl").write_text(text, encoding="utf-8")
    (tmp_path / "packed.jsonl.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "odd.jsonl").write_bytes(gzip.compress(text.encode()))
    df = readers.read_jsonl_glob(spark, f"{tmp_path}/*", "a int, b string")
    assert rows(df) == [(1, "x\u2028y\x85z")] * 3 + [(2, "q")] * 3
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        readers.read_jsonl_glob(spark, f"{tmp_path}/*", "a int, b string").collect()


def test_csv_encodings_remarks_and_line_breaks(spark, tmp_path):
    (tmp_path / "remarks.csv").write_bytes("a remark; with signs\nanother\nk;v\n1;café\n2;NA\n".encode("iso-8859-1"))
    read = lambda **k: readers.read_csv(spark, f"{tmp_path}/remarks.csv", "k int, v string", ";", "ISO-8859-1", 2, ["", "NA"], **k)
    assert rows(read()) == [(1, "café"), (2, None)]
    (tmp_path / "remarks.csv").write_bytes(b"x\ny\nk;v\n1;a;surplus\n")
    with pytest.raises(Exception):
        read().collect()
    (tmp_path / "breaks.csv").write_text('k,v\n1,"two\nlines"\n2,one\n')
    assert rows(readers.read_csv(spark, f"{tmp_path}/breaks.csv", "k int, v string", multi_line=True)) == [(1, "two\nlines"), (2, "one")]


def test_audit_counts_and_records_failures(spark, tmp_path):
    path = work_path(spark, "audit")
    good = catalog.audited_write(spark.range(10), path, "j", "2024-01-01", valid="id % 2 = 0").first()
    assert (good.rows_read, good.rows_written, good.status) == (10, 5, "success")
    bad = catalog.audited_write(spark.range(10).selectExpr("id / 0 as x"), path, "j", "2024-01-01", "2024-01-02").first()
    assert (bad.rows_written, bad.status, bad.finished_at) == (None, "failed", "2024-01-02") and "DIVIDE_BY_ZERO" in bad.error


def test_skipped_lines_of_a_file_of_several_splits(spark, monkeypatch):
    """Only a file's first split is counted; the others are parsed without Python."""
    path = work_path(spark, "split")
    os.makedirs(path)
    for name in ("a", "b"):
        with open(f"{path}/{name}.csv", "w") as out:
            out.write("# remark\n\"quoted, remark\nkey,name\n" + "".join(f"{i},{name}{i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.read_csv(spark, path, "key int, name string", header_row=2)
        assert got.rdd.getNumPartitions() > 20
        assert rows(got.groupBy(F.substring("name", 1, 1).alias("f")).agg(F.count("*"), F.sum("key"), F.count_distinct("name"))) == [
            (f, 20_000, 199_990_000, 20_000) for f in ("a", "b")]
        plan = got._jdf.queryExecution().executedPlan().toString()
        heads, rest = plan.split("Scan csv")[0], plan.split("Scan csv")[1]
        assert "MapInArrow" in heads and "MapInArrow" not in rest and plan.count("MapInArrow") == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
