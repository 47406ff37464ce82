from pyspark.sql import functions as F

from tesserae.functions import generate as gen
from tesserae.schemas import PEOPLE_SCHEMA, USER_METRICS_SCHEMA
from tesserae.session import scratch_path
from tesserae.sources import catalog, files


def _ids(spark, n=500):
    return spark.range(0, n, 1, 5)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_three_generators_agree(spark):
    e = gen.people_from_ids(_ids(spark))
    assert [(f.name, f.dataType) for f in e.schema] == [(f.name, f.dataType) for f in PEOPLE_SCHEMA]
    assert _rows(e) == _rows(gen.people_map(_ids(spark))) == _rows(gen.people_vectorized(_ids(spark)))


def test_generator_deterministic_across_partitioning(spark):
    a = gen.people_from_ids(spark.range(0, 300, 1, 2))
    b = gen.people_from_ids(spark.range(0, 300, 1, 7))
    assert _rows(a) == _rows(b)
    assert a.select("id").distinct().count() == 300


def test_amount_range_and_uuid_shape(spark):
    r = gen.people_from_ids(_ids(spark)).agg(F.min("amount"), F.max("amount"),
                                             F.min(F.length("id")), F.max(F.length("id"))).first()
    assert 0 <= r[0] and r[1] < 1000 and r[2] == r[3] == 36


def test_csv_roundtrip_no_header(spark):
    df = gen.people_from_ids(_ids(spark, 50))
    p = scratch_path(spark, "t.csv")
    files.write_csv(df, p, header=False)
    assert _rows(files.read_csv(spark, p, PEOPLE_SCHEMA, header=False)) == _rows(df)


def test_parquet_single_file_and_path_sql(spark):
    df = gen.people_from_ids(_ids(spark, 50))
    p = scratch_path(spark, "t.parquet")
    files.write_parquet(df, p, single_file=True)
    assert spark.read.parquet(p).rdd.getNumPartitions() == 1
    r = files.sql_on_path(spark, "SELECT count(*) AS n FROM {src}", p).first()
    assert r["n"] == 50


def test_schema_sync_adds_never_drops(spark):
    old = spark.createDataFrame([("A", 1, 5, "extra")], "city string, user_id long, session_duration int, note string")
    s = catalog.sync_schema(old, USER_METRICS_SCHEMA)
    assert s.columns == ["city", "user_id", "username", "session_duration", "last_access", "note"]
    assert s.schema["last_access"].dataType == USER_METRICS_SCHEMA["last_access"].dataType


def test_namespace_and_keyed_table(spark):
    from tesserae.schemas import USER_METRICS_KEY
    catalog.create_namespace(spark, "tess_ns", location=scratch_path(spark, "ns"))
    catalog.create_keyed_table(spark, "tess_ns.user_metrics", USER_METRICS_SCHEMA, USER_METRICS_KEY, buckets=4)
    assert catalog.table_key(spark, "tess_ns.user_metrics") == USER_METRICS_KEY
    catalog.drop_table(spark, "tess_ns.user_metrics")
    catalog.drop_namespace(spark, "tess_ns")


def test_sizing_scales_with_input():
    from tesserae.session import sizing
    small = sizing(1 << 30, 8)
    big = sizing(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)


def test_cluster_runner_writes_result(spark):
    from tesserae.plans import run
    from tests.conftest import SF_SMALL
    out = scratch_path(spark, "run-out")
    run.main(["cql_distinct", SF_SMALL, out, "--cores", "4"])
    assert spark.read.parquet(out).count() == spark.read.parquet(f"{SF_SMALL}/nation.parquet").count()


def test_catalog_helpers(spark):
    import uuid
    ns = f"tess_{uuid.uuid4().hex[:6]}"
    catalog.create_namespace(spark, ns, location=scratch_path(spark, ns))
    catalog.use_namespace(spark, ns)
    try:
        spark.range(5).write.saveAsTable("t5")                                     # managed, under the namespace folder
        spark.range(5).write.option("path", scratch_path(spark, "t6")).saveAsTable("t6")  # external
        for t in ("t5", "t6"):
            assert spark.table(f"{ns}.{t}").count() == 5
            catalog.truncate_table(spark, f"{ns}.{t}")
            assert spark.table(f"{ns}.{t}").count() == 0 and spark.table(f"{ns}.{t}").columns == ["id"]
        spark.range(1).createOrReplaceTempView("t7")  # a view of the session is no table of the namespace
        assert catalog.tables_of(spark, ns) == ["t5", "t6"]
        catalog.drop_table(spark, f"{ns}.t5")
        catalog.drop_table(spark, f"{ns}.t5")  # nothing to drop
        assert catalog.tables_of(spark, ns) == ["t6"]
    finally:
        catalog.use_namespace(spark, "default")
        catalog.drop_namespace(spark, ns)
    assert not spark.catalog.databaseExists(ns) and catalog.tables_of(spark, ns) == []
    prof = catalog.lakehouse_profile("iceberg", "/shared/wh")
    assert prof["spark.sql.catalog.local.warehouse"] == "/shared/wh"
    import pytest
    with pytest.raises(ValueError):
        catalog.lakehouse_profile("nope", "/x")


def test_csv_single_file_and_header(spark):
    df = gen.people_from_ids(_ids(spark, 30))
    p = scratch_path(spark, "one.csv")
    files.write_csv(df, p, header=True, single_file=True)
    back = files.read_csv(spark, p, PEOPLE_SCHEMA, header=True)
    assert back.rdd.getNumPartitions() == 1 and _rows(back) == _rows(df)


def test_check_schema(spark):
    df = gen.people_from_ids(_ids(spark, 3))
    assert catalog.check_schema(df, PEOPLE_SCHEMA, exact=True) == []
    bad = df.withColumn("amount", F.col("amount").cast("string")).drop("phone").withColumn("x", F.lit(1))
    assert catalog.check_schema(bad, PEOPLE_SCHEMA, exact=True) == ["missing phone", "amount: string != double", "extra x"]


def test_generator_seed(spark):
    a = gen.people_from_ids(_ids(spark, 20), seed="s1").collect()
    b = gen.people_from_ids(_ids(spark, 20), seed="s2").collect()
    m = gen.people_map(_ids(spark, 20), seed="s2").collect()
    v = gen.people_vectorized(_ids(spark, 20), seed="s2").collect()
    assert sorted(tuple(r) for r in v) == sorted(tuple(r) for r in b)
    assert [r["id"] for r in a] != [r["id"] for r in b]
    assert [r["first_name"] for r in a] == [r["first_name"] for r in b]
    assert sorted(tuple(r) for r in m) == sorted(tuple(r) for r in b)


def test_csv_keeps_every_string(spark, tmp_path):
    rows = [(1, "a\nb"), (2, "c\r\nd"), (3, 'say "x", \'y\''), (4, ""), (5, None), (6, "\\n \\\\n \\"), (7, "  pad\t"), (8, "\\N"), (9, "\0z"),
            (10, "é\u2028\U0001f600"), (11, '"'), (12, "\\\n")]
    df = spark.createDataFrame(rows, "id long, text string")
    for header in (True, False):
        files.write_csv(df, f"{tmp_path}/{header}", header=header)
        got = files.read_csv(spark, f"{tmp_path}/{header}", df.schema, header=header)
        assert sorted(map(tuple, got.collect())) == rows


def test_truncate_external_under_dynamic_overwrite(spark, tmp_path):
    from tesserae.sources import catalog
    spark.range(5).selectExpr("id", "id % 2 as p").write.partitionBy("p").option("path", f"{tmp_path}/t").saveAsTable("trunc_ext")
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        catalog.truncate_table(spark, "trunc_ext")
        spark.catalog.refreshTable("trunc_ext")
        assert spark.table("trunc_ext").count() == 0
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)
        spark.sql("DROP TABLE trunc_ext")


def test_stored_table_gets_missing_columns(spark):
    from pyspark.sql import types as T
    from tesserae.session import scratch_path
    from tesserae.sources import catalog
    spark.range(3).write.option("path", scratch_path(spark, "sync")).saveAsTable("sync_t")
    model = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType())])
    assert catalog.sync_table(spark, "sync_t", model) == ["note"] and catalog.sync_table(spark, "sync_t", model) == []
    assert sorted(tuple(r) for r in spark.table("sync_t").collect()) == [(0, None), (1, None), (2, None)]
    catalog.drop_table(spark, "sync_t")


def test_insert_split_keeps_null_flags(spark):
    from tesserae.operators import documents as doc
    u = spark.createDataFrame([(1, True), (2, False), (3, None)], "_id int, active boolean")
    on = F.coalesce("active", F.lit(False))
    assert doc.insert_many(u.filter(on), u.filter(~on)).count() == 3
