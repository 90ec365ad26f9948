import datetime as dt
import pytest
from pyspark.sql import functions as F

from tarnflow.sources import schemas
from tarnflow.sources.catalog import TYPES, Catalog, NotFound, like, sql_type, validate_name
from tarnflow.sources.partitioned import date_predicates, double_predicates, hash_predicates, long_predicates, parse_date, partition_predicates, read_by, read_partitioned, split_predicates
from tarnflow.sources.generator import generated, write_sharded
from tarnflow.sources.reader import read, read_table, rows_until, table_size
from tarnflow.sources.writer import IncompatibleSchema, RepeatedKey, VersionedTable, check_columns, complex_as_json, insert_into, mapped_types, write_table
from tarnflow.streaming.sink import tumbling_counts, write_stream


@pytest.fixture(scope="module")
def all_types(spark):
    i = F.col("id")
    return spark.range(1000).select(
        i.cast("int").alias("id"),
        (i % 2 == 0).alias("bool_col"),
        (i % 10).cast("tinyint").alias("tinyint_col"),
        (i % 10).cast("smallint").alias("smallint_col"),
        (i % 10 * 10).alias("bigint_col"),
        F.rand(47).cast("float").alias("float_col"),
        F.rand(48).alias("double_col"),
        F.format_string("str_%06d", i).alias("string_col"),
        F.date_add(F.lit(dt.date(2000, 1, 1)), i.cast("int")).alias("date_col"),
        F.struct(i.alias("a")).alias("s"),
        F.array(i, i).alias("l"),
    )


def test_names_are_checked():
    assert validate_name("a_1") == "a_1"
    for bad in ("", "1a", "a.b", "../x", "a b", "a;b", None):
        with pytest.raises(ValueError):
            validate_name(bad)


def test_like():
    assert like("T_st%")("test_table") and like(None)("x") and like("%")("")
    assert not like("test")("test_table") and not like("te_t")("teest")
    assert like("a\\_b")("A_b") and not like("a\\_b")("axb") and not like("a.b")("axb")


def test_catalog_over_folders(spark, all_types, tmp_path):
    all_types.repartition(3).write.parquet(f"{tmp_path}/shop/things/y=1")
    all_types.where("id < 10").write.parquet(f"{tmp_path}/shop/few")
    all_types.where("id < 5").write.parquet(f"{tmp_path}/other/few")
    c = Catalog(spark, str(tmp_path))
    assert c.schemas() == ["other", "shop"] and c.schemas("SH%") == ["shop"]
    assert [(e.schema, e.table) for e in c.tables(table_pattern="f_w")] == [("other", "few"), ("shop", "few")]
    assert c.read("shop", "things").count() == 1000 and c.read("SHOP", "Few").count() == 10
    assert c.info_tables(schema_pattern="shop", with_schema=True).count() == 2
    with pytest.raises(NotFound):
        c.read("shop", "none")
    with pytest.raises(NotFound):
        c.info_tables(catalog="elsewhere")
    with pytest.raises(NotFound):
        c.info_tables(kinds=["VIEW"])
    assert c.info_types().count() == len(TYPES) == 15 and c.info_types(code=-5).count() == 1
    assert 'CREATE TABLE shop.few("id" INTEGER' in c.info_ddl("shop", "few").first().ddl
    assert {sql_type(f.dataType) for f in all_types.schema.fields} >= {"STRUCT", "ARRAY", "VARCHAR", "DATE", "REAL"}


@pytest.mark.parametrize("size", [1, 2, 6, 50])
def test_partitioned_reads_lose_nothing(all_types, size):
    rows = all_types.select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"), "double_col", "date_col", "string_col")
    reads = [hash_predicates("string_col", size), hash_predicates("id", size), long_predicates("id", 100, 500, size), long_predicates("id", 5, 5, size), double_predicates("double_col", 0.2, 0.7, size), date_predicates("date_col", "2000-03-01", "2001-01-01", size, "date")]
    for predicates in reads:
        assert len(predicates) <= size
        assert read_by(rows, predicates).count() == 1000


def test_partition_options(spark):
    rows = spark.sql("SELECT 1L AS n, DATE '2024-03-05' AS d, 0.5D AS f, '20240305' AS s, TIMESTAMP_NTZ '2024-03-05 01:02:03' AS t")
    assert split_predicates("a = ';x' ; b IN (1, 2) | c = 3, d = 4") == ["a = ';x'", "b IN (1, 2)", "c = 3", "d = 4"]
    assert partition_predicates(rows, {"partition.predicate1": "a = 1", "partition.predicate2": "a <> 1"}) == ["a = 1", "a <> 1"]
    assert partition_predicates(rows, {}) is None
    assert len(partition_predicates(rows, {"partition.byColumn": "N"})) == 6
    for column, lower, upper in [("n", "1,000", "9000"), ("n", "0.5", "9.5"), ("d", "20240301", "20240401"), ("t", "20240301", "20240401"), ("f", "20240301", "20240401"), ("s", "20240301", "20240401")]:
        options = {"partition.byColumn": column, "partition.lowerBound": lower, "partition.upperBound": upper, "partition.size": "3"}
        assert read_partitioned(rows, options).collect() == rows.collect(), column
    for bad in ({"partition.byColumn": "none"}, {"partition.byColumn": "d", "partition.lowerBound": "soon", "partition.upperBound": "later"}, {"partition.byColumn": "n", "partition.lowerBound": "a", "partition.upperBound": "b"}, {"partition.byColumn": "n", "partition.size": "0"}):
        with pytest.raises(ValueError):
            read_partitioned(rows, bad)
    with pytest.raises(ValueError):
        long_predicates("x", 3, 2)
    assert parse_date("2001-02-03T04:05:06.000+0100") == dt.datetime(2001, 2, 3, 3, 5, 6)
    assert parse_date("25/12/2001 01:02:03") == dt.datetime(2001, 12, 25, 1, 2, 3)
    for text in ("2001-02-03", "02/03/2001", "2001/02/3", "2001.02.03 00:00:00", "20010203"):
        assert parse_date(text) == dt.datetime(2001, 2, 3)
    with pytest.raises(ValueError):
        parse_date("soon")


def test_one_scan_with_the_filters_above(spark, all_types, tmp_path):
    all_types.write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    for options in ({"partition.byColumn": "id", "partition.lowerBound": "0", "partition.upperBound": "1000", "partition.size": "3"}, {"partition.predicates": "id < 300; id >= 300"}):
        rows = read_partitioned(t, options).where("tinyint_col = 3").select("id")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "EqualTo(tinyint_col,3)" in plan and "string_col" not in plan
        assert rows.count() == 100


def test_each_predicate_has_a_partition(spark):
    rows = spark.range(100).withColumn("__part", F.lit(1))
    got = read_by(rows, ["id < 10", "id >= 5 AND id < 30", "id % 50 = 3"]).withColumn("p", F.spark_partition_id()).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.p, []).append(r.id)
    assert sorted(map(sorted, parts.values())) == [list(range(10)), [3, 53], list(range(5, 30))]
    dealt = read_partitioned(rows, {"partition.byColumn": "id", "partition.lowerBound": "0", "partition.upperBound": "100", "partition.size": "4"})
    assert sorted(r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) == [25, 25, 25, 25]


def test_rows_until_stops(spark):
    seen = []
    got = rows_until(spark.range(0, 5000, 1, 50), lambda batch: seen.append(len(batch)) or True, batch=10)
    assert len(got) == 10 and seen == [10]


def test_table_or_query(spark, sf):
    assert read_table(spark, "region", sf).count() == 5
    assert read_table(spark, "(SELECT r_name FROM region WHERE r_regionkey > 2) ", sf).columns == ["r_name"]


def test_reads_by_options(spark, sf):
    rows = read(spark, sf, {"table": "orders", "partition.byColumn": "o_orderkey", "partition.size": "3"})
    assert rows.count() == read_table(spark, "orders", sf).count() and rows.rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        read(spark, sf, {"partition.byColumn": "x"})


def test_sizes_of_tables(spark, sf, tmp_path):
    rows, size = table_size(spark, f"{sf}/orders.parquet")
    assert rows == read_table(spark, "orders", sf).count() and size > 0
    assert table_size(spark, f"{tmp_path}/none") == (-1, -1)
    (tmp_path / "bad.parquet").write_text("this is no Parquet file")
    assert table_size(spark, f"{tmp_path}/bad.parquet")[0] == -1


def test_generated_rows_do_not_hang_on_partitions(spark, tmp_path):
    a = sorted(map(tuple, generated(spark, 100, 5, 1).collect()))
    assert a == sorted(map(tuple, generated(spark, 100, 5, 7).collect())) and a[0][0] == 5
    write_sharded(generated(spark, 100), f"{tmp_path}/shards", 4, "id")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 100 and back.select("shard").distinct().count() == 4


def test_writer(spark, all_types, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/w")
    with pytest.raises(FileNotFoundError):
        t.read()
    t.write(all_types.where("id < 10"))
    t.write(all_types.where("id BETWEEN 10 AND 19"))
    assert t.read().count() == 20
    t.write(t.read().where("id < 3").drop("s"), mode="overwrite")
    assert t.read().count() == 3 and "s" not in t.read().columns
    t.write(spark.createDataFrame([(2, "two"), (None, "none")], "id int, string_col string"), keys=["id"])
    assert sorted((r.id is None, r.id, r.string_col) for r in t.read().collect())[-2:] == [(False, 2, "two"), (True, None, "none")]
    t.write(spark.createDataFrame([(None, "nothing")], "id int, string_col string"), keys=["ID"])
    assert [r.string_col for r in t.read().where("id IS NULL").collect()] == ["nothing"]
    with pytest.raises(ValueError):
        t.write(all_types, mode="overwrite", keys=["id"])
    with pytest.raises(ValueError):
        t.write(all_types, mode="sideways")
    with pytest.raises(IncompatibleSchema):
        t.append(all_types.select(F.col("id").alias("unknown")))
    check_columns(all_types.select(F.col("id").alias("ID")), all_types.schema)


def test_merges_change_the_columns_given_and_refuse_repeated_keys(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/m")
    t.write(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (2, "c", 3.0), (None, "n", 4.0)], "k int, s string, v double"))
    t.write(spark.createDataFrame([(2, 20.0), (3, 30.0), (None, 40.0)], "K int, v double"), keys=["k"])
    want = [(None, "n", 40.0), (1, "a", 1.0), (2, "b", 20.0), (2, "c", 20.0), (3, None, 30.0)]
    assert sorted(map(tuple, t.read().collect()), key=lambda r: (r[0] or 0, r[1] or "")) == want
    with pytest.raises(RepeatedKey):
        t.write(spark.createDataFrame([(1, "x"), (1, "y")], "k int, s string"), keys=["k"])
    assert t.read().count() == 5


def test_a_merge_rewrites_only_the_files_it_touches(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/f")
    for k in range(4):
        t.append(spark.range(10 * k, 10 * k + 10).coalesce(1).withColumn("v", F.lit(0)))
    before = set(t._files(t.version()))
    t.merge(spark.createDataFrame([(13, 1), (99, 1)], "id long, v int"), ["id"])
    after = set(t._files(t.version()))
    assert len(before & after) == 3 and t.read().where("v = 1").count() == 2 and t.read().count() == 41
    assert t.read(4).count() == 40
    assert t.vacuum(keep=1) > 0 and t.versions() == [5] and t.read().count() == 41


def test_writers_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    t = VersionedTable(spark, f"{tmp_path}/c")
    t.write(spark.range(20).withColumn("v", F.lit(-1)))

    def change(k):
        own = VersionedTable(spark, f"{tmp_path}/c")
        if k % 3 == 2:
            own.append(spark.createDataFrame([(100 + k, k)], "id long, v int"))
        else:
            own.merge(spark.createDataFrame([(k, k), (200 + k, k)], "id long, v int"), ["id"])

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(change, range(6)))
    got = {r.id: r.v for r in t.read().collect()}
    want = {k: -1 for k in range(20)} | {100 + k: k for k in (2, 5)} | {n: k for k in (0, 1, 3, 4) for n in (k, 200 + k)}
    assert got == want and t.read().count() == len(want)


def test_a_writer_that_died_with_a_number_stops_no_one(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"{tmp_path}/d")
    t.write(spark.range(3))
    fs, path = t._fs()
    fs.create(path(f"{tmp_path}/d/_c00000002"), False).close()
    import time

    monkeypatch.setattr(time, "sleep", lambda s: None)
    t.append(spark.range(3, 5))
    assert t.read().count() == 5 and t.versions() == [1, 2, 3]
    t.overwrite(spark.range(1))
    assert t.read().count() == 1


def test_write_options_together(spark, tmp_path):
    rows = spark.createDataFrame([(1, (2, "x"), 1.5)], "k int, s struct<a: int, b: string>, f float")
    options = {"write.typeMapping": "int:bigint;float:double", "write.complexAsJson": "true", "batch.size": "10"}
    write_table(spark, f"{tmp_path}/o", spark.range(35).selectExpr("CAST(id AS INT) AS k", "named_struct('a', 1, 'b', 'x') AS s", "CAST(1.5 AS FLOAT) AS f").coalesce(1), options)
    t = VersionedTable(spark, f"{tmp_path}/o")
    assert dict(t.read().dtypes) == {"k": "bigint", "s": "string", "f": "double"} and len(t._files(1)) == 4
    write_table(spark, f"{tmp_path}/o", rows, options | {"merge.byColumn1": "k"})
    assert t.read().count() == 35 and t.read().where("k = 1").first().s == '{"a":2,"b":"x"}'
    insert_into(spark, f"{tmp_path}/o", ["k", "S"], [(50, "it's; --"), (51, None)])
    assert t.read().where("k = 50").first().s == "it's; --" and t.read().count() == 37
    with pytest.raises(IncompatibleSchema):
        insert_into(spark, f"{tmp_path}/o", ["none"], [(1,)])
    with pytest.raises(ValueError):
        insert_into(spark, f"{tmp_path}/o", ["k"], [(1, 2)])


def test_type_mapping_and_json(all_types):
    out = mapped_types(all_types, "int:bigint; float:double")
    assert dict(out.dtypes)["id"] == "bigint" and dict(out.dtypes)["float_col"] == "double"
    row = complex_as_json(all_types).where("id = 3").first()
    assert row.s == '{"a":3}' and row.l == "[3,3]"


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema

    def stream():
        return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)

    assert write_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination(120)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert spark.read.parquet(f"{tmp_path}/out").count() == n
    assert write_stream(stream().withColumn("event_id", F.col("event_id") % 7), f"{tmp_path}/keyed", f"{tmp_path}/c2", keys=["event_id"]).awaitTermination(120)
    assert VersionedTable(spark, f"{tmp_path}/keyed").read().count() == 7
    late = tumbling_counts(stream()).writeStream.outputMode("complete").format("memory").queryName("late").trigger(availableNow=True).start()
    assert late.awaitTermination(120)
    assert spark.table("late").agg(F.sum("n")).first()[0] == n


def test_schemas_follow_the_files(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    spark.range(3).write.parquet(path)
    assert schemas.read_parquet(spark, path).count() == 3 and path in schemas._known
    assert schemas.read_parquet(spark, path).columns == ["id"]
    spark.range(5).selectExpr("id", "id AS more").write.mode("overwrite").parquet(path)
    assert schemas.read_parquet(spark, path).columns == ["id", "more"] and schemas.read_parquet(spark, path).count() == 5
    monkeypatch.setattr(schemas, "MOST_FILES", 0)
    schemas.forget(path)
    assert schemas.read_parquet(spark, path).count() == 5 and path not in schemas._known
    spark.range(2).selectExpr("id", "id % 2 AS part").write.partitionBy("part").parquet(f"{tmp_path}/parts")
    assert schemas.read_parquet(spark, f"{tmp_path}/parts").columns == ["id", "part"] and f"{tmp_path}/parts" not in schemas._known
    schemas.forget()
    assert not schemas._known
