"""Stored layouts: what a read touches, and that results do not depend on it."""

import datetime as dt
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import documents as doc
from tesserae.operators import expiry, graph, keyed, partitions, token_layout
from tesserae.plans.queries import QUERIES
from tesserae.schemas import USER_METRICS_KEY, KeySpec
from tesserae.session import scratch_path
from tesserae.sources import catalog, files
from tesserae.sources import fixtures as fx

from .conftest import SF_SMALL
from .test_keyed import _plan_nodes
from .test_plans import plan

KEY = KeySpec(("city",), ("user_id",))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_scanned(df) -> int:
    """Rows that the file scans of a query gave out: whole row groups and pages that were ruled out do not count."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return sum(n.metrics().apply("numOutputRows").value() for n in _plan_nodes(qe.executedPlan())
               if n.getClass().getSimpleName() == "FileSourceScanExec")


def metrics(spark, n=60_000, cities=40):
    """One city holds a third of all rows."""
    return spark.range(0, n, 1, 4).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % cities).cast("string"))).alias("city"),
        F.col("id").alias("user_id"), F.md5(F.col("id").cast("string")).alias("username"))


# ------------------------------------------------------------------ token order

@pytest.fixture(scope="module")
def by_token(spark):
    path = scratch_path(spark, "tok")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_layout.write_by_token(metrics(spark), path, KEY, row_group_bytes=64 << 10, block_rows=1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    return path


def test_seek_and_page_read_a_small_share(spark, by_token):
    tokens = sorted(r[0] for r in spark.read.parquet(by_token).select("token").distinct().collect())
    assert spark.read.parquet(f"{by_token}-ends").count() > 2
    for start in (tokens[20], tokens[20] + 1, tokens[0] - 1, tokens[-1]):
        hit = token_layout.seek(spark, by_token, KEY, start)
        want = keyed.token_seek(metrics(spark), KEY, start)
        assert rows_of(hit.drop("token")) == rows_of(want)
        assert rows_scanned(hit) < 0.1 * 60_000
    assert rows_of(token_layout.seek(spark, by_token, KEY, tokens[-1] + 1)) == rows_of(token_layout.seek(spark, by_token, KEY, tokens[0]))
    p = plan(token_layout.page(spark, by_token, KEY, 10, start=tokens[5]))
    assert f"GreaterThanOrEqual(token,{tokens[5]})" in p and "LessThanOrEqual(token," in p and "TakeOrderedAndProject" in p


def test_pages_follow_one_another(spark, by_token):
    want = [tuple(r) for r in keyed.with_token(metrics(spark), KEY.partition).select("token", "city", "user_id").orderBy(
        "token", "city", "user_id").collect()]
    got, after, scanned = [], None, 0
    for _ in range(6):
        page = token_layout.page(spark, by_token, KEY, 7000, after=after)
        scanned += rows_scanned(page)
        rows = [(r["token"], r["city"], r["user_id"]) for r in page.collect()]
        got += rows
        after = rows[-1]
    assert got == want[:42_000] and scanned < 1.5 * 42_000
    assert token_layout.page(spark, by_token, KEY, 5, after=want[-1]).count() == 0
    assert token_layout.page(spark, by_token, KEY, 99_999, after=want[-3]).count() == 2
    with pytest.raises(ValueError):
        token_layout.page(spark, by_token, KEY, 5, after=(1,))


def test_many_tokens_are_pruned_to_one_page(spark):
    df = spark.range(0, 200_000, 1, 4).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("city"), F.col("id").alias("user_id"))
    path = token_layout.write_by_token(df, scratch_path(spark, "tok"), KEY, row_group_bytes=64 << 10, block_rows=2000)
    t = spark.read.parquet(path).select("token").orderBy("token").collect()[150_000][0]
    hit = token_layout.page(spark, path, KEY, 20, start=t)
    assert hit.first()["token"] == t and rows_scanned(hit) < 0.05 * 200_000
    empty = token_layout.write_by_token(df.limit(0), scratch_path(spark, "tok"), KEY)
    assert token_layout.seek(spark, empty, KEY, 5).count() == 0


# ---------------------------------------------------------------- bucketed join

def test_stored_tables_join_without_exchange(spark):
    df = QUERIES["keyed_join_stored"](spark, SF_SMALL)
    p = plan(df)
    assert "SortMergeJoin" in p and "Exchange" not in p and p.count("Bucketed: true") == 2
    left, right = scratch_path(spark, "kj"), scratch_path(spark, "kj")
    a, b = (f"kj_{x[-8:]}" for x in (left, right))
    catalog.write_keyed(metrics(spark), a, KEY, 8, left, by="primary")
    catalog.write_keyed(metrics(spark).filter("user_id % 2 = 0").withColumnRenamed("username", "other"), b, KEY, 8, right, by="primary")
    joined = catalog.join_stored(spark, a, b, KEY)
    assert joined.count() == 30_000 and joined.filter("city = 'hot'").count() == 10_000 and "Exchange" not in plan(joined)
    per = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(per) == 8 and max(per) < 1.2 * min(per)  # the hot city lies in all buckets
    assert catalog.buckets_for(0) == 8 and catalog.buckets_for(9 * (256 << 20)) == 16 and catalog.buckets_for(100 << 40) == 1 << 19


# ----------------------------------------------------------------------- expiry

def test_purge_drops_folders_and_rewrites_nothing(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, None), (2, t0), (3, t0 + dt.timedelta(days=1)), (4, t0 + dt.timedelta(days=2, hours=3)), (5, t0 + dt.timedelta(days=2, hours=9)),
            (6, t0 + dt.timedelta(days=9)), (7, None)]
    path = expiry.write_by_expiry(spark.createDataFrame(rows, "id int, expires_at timestamp_ntz"), scratch_path(spark, "ttl"), ["id"])
    live = expiry.read_live(spark, path, "2024-01-03 06:00:00")
    assert "PartitionFilters: [(isnull(expiry_day" in plan(live)
    assert {r["id"] for r in live.collect()} == {1, 5, 6, 7}
    before = {r[0]: r[1] for r in spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()}
    assert expiry.purge(spark, path, "2024-01-03 06:00:00") == ["2024-01-01", "2024-01-02"]
    after = {r[0]: r[1] for r in spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()}
    assert after.items() < before.items() and len(before) - len(after) == 2
    assert {r["id"] for r in expiry.read_all(spark, path).collect()} == {1, 4, 5, 6, 7}  # 4 is of that day: hidden, dropped later
    assert {r["id"] for r in expiry.read_live(spark, path, "2024-01-03 06:00:00").collect()} == {1, 5, 6, 7}
    assert expiry.purge(spark, path, "2024-01-03 06:00:00") == []
    assert expiry.purge(spark, path, "2999-01-01") == ["2024-01-03", "2024-01-10"]
    assert {r["id"] for r in expiry.read_live(spark, path, "2999-01-01").collect()} == {1, 7}


def test_a_day_that_holds_most_rows_takes_several_files(spark):
    path = scratch_path(spark, "ttl")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    expiry.write_by_expiry(metrics(spark).withColumn("expires_at", F.lit(None).cast("timestamp_ntz")), path, KEY.primary)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert spark.read.parquet(path).select("_metadata.file_path").distinct().count() == 4
    assert expiry.read_live(spark, path, "2024-01-01").count() == 60_000


# ---------------------------------------------------------------------- lookups

def test_absent_keys_and_names_read_nothing(spark):
    path = files.write_for_lookup(metrics(spark), scratch_path(spark, "look"), KEY.primary, also=["username"], row_group_bytes=256 << 10)
    t = files.read_parquet(spark, path)
    some = metrics(spark).filter("user_id = 4711").first()
    for found in (keyed.point(t, city=some["city"], user_id=4711), keyed.point(t, username=some["username"])):
        assert rows_of(found) == [tuple(some)] and rows_scanned(found) < 30_000
    absent = F.md5(F.lit("nobody"))
    name = spark.range(1).select(absent).first()[0]  # between the least and the greatest name of every row group
    for missing in (keyed.point(t, username=name), keyed.point(t, city="hot", user_id=4711), keyed.point(t, city="c7x", user_id=4711)):
        assert missing.count() == 0 and rows_scanned(missing) == 0
    plain = scratch_path(spark, "look")
    metrics(spark).repartitionByRange(*KEY.primary).sortWithinPartitions(*KEY.primary).write.option("parquet.block.size", 256 << 10).parquet(plain)
    assert rows_scanned(keyed.point(spark.read.parquet(plain), username=name)) == 60_000  # the filters make the difference


# ------------------------------------------------------------- point mutations

def folders(path):
    return sorted(f for f in os.listdir(path.replace("file:", "")) if f.startswith("_bucket="))


def test_a_point_change_writes_one_folder(spark):
    users = fx.users(spark, SF_SMALL)
    stored = partitions.store(users, scratch_path(spark, "u"), buckets=16)
    base = stored.parts[0][0]
    assert rows_of(partitions.load(spark, stored).select("_id")) == rows_of(users.select("_id"))
    stamp = {f: os.stat(f"{base}/{f}").st_mtime_ns for f in folders(base)}
    path = scratch_path(spark, "u")
    after, touched = partitions.inc(spark, stored, path, 7, "login_count", by=5)
    assert len(touched) == 1 and folders(path) == [f"_bucket={touched[0]}"] and stored.parts == ((base, tuple(range(16))),)
    assert {f: os.stat(f"{base}/{f}").st_mtime_ns for f in folders(base)} == stamp
    old = {r["_id"]: r["login_count"] for r in users.collect()}
    assert {r["_id"]: r["login_count"] for r in partitions.load(spark, after).collect()} == {**old, 7: old[7] + 5}
    one = partitions.by_key(spark, after, 7)
    assert one.first()["login_count"] == old[7] + 5 and f"_bucket#" in plan(one) and one.columns == users.columns
    assert {r["_id"]: r["login_count"] for r in partitions.load(spark, stored).collect()} == old  # the old value still reads


def test_changes_on_changes(spark):
    users = fx.users(spark, SF_SMALL).select("_id", "login_count", "active")
    old = {r["_id"]: tuple(r) for r in users.collect()}
    s = partitions.store(users, scratch_path(spark, "u"), buckets=8)
    s, t1 = partitions.set_first(spark, s, scratch_path(spark, "u"), F.col("login_count") > 500, {"active": None})
    pick = min(i for i, r in old.items() if r[1] > 500)
    assert len(t1) == 1
    s, t2 = partitions.set_where(spark, s, scratch_path(spark, "u"), F.col("_id") < 4, {"note": "low"})
    s, t3 = partitions.delete_where(spark, s, scratch_path(spark, "u"), F.col("_id") == pick)
    assert t3 == t1 and 0 < len(t2) < 8
    got = {r["_id"]: tuple(r) for r in partitions.load(spark, s).collect()}
    assert got == {i: (*r, "low" if i < 4 else None) for i, r in old.items() if i != pick}
    none = partitions.set_first(spark, s, scratch_path(spark, "u"), F.col("login_count") > 10**6, {"active": True})
    assert none == (s, []) and partitions.delete_where(spark, s, scratch_path(spark, "u"), F.lit(None).cast("boolean")) == (s, [])
    s, t4 = partitions.delete_where(spark, s, scratch_path(spark, "u"), F.lit(True))
    assert partitions.load(spark, s).count() == 0 and partitions.load(spark, s).columns == ["_id", "login_count", "active", "note"]
    assert sorted(b for _, bs in s.parts for b in bs) == list(range(8))


def test_an_insert_writes_new_documents_alone(spark):
    users = fx.users(spark, SF_SMALL).select("_id", "login_count", "active")
    old = {r["_id"]: tuple(r) for r in users.collect()}
    base, path = scratch_path(spark, "u"), scratch_path(spark, "u")
    s = partitions.store(users, base, buckets=16)
    stamp = {f: os.stat(f"{base}/{f}").st_mtime_ns for f in folders(base)}
    batch = spark.createDataFrame([(-1, 5, "x"), (-1, 6, "y"), (7, 1, "z"), (None, 2, "w")], "_id long, login_count int, note string")
    after, new, rejected = partitions.insert_unique(spark, s, path, batch, order=["login_count"])
    assert len(new) == 1 and folders(path) == [f"_bucket={new[0]}"] and after.parts == (*s.parts, (path, tuple(new)))
    assert {f: os.stat(f"{base}/{f}").st_mtime_ns for f in folders(base)} == stamp
    assert rows_of(rejected) == rows_of(spark.createDataFrame(
        [(-1, 6, "y", "batch"), (7, 1, "z", "stored"), (None, 2, "w", "no key")], rejected.schema))
    want = {**{i: (*r, None) for i, r in old.items()}, -1: (-1, 5, None, "x")}
    assert {r["_id"]: tuple(r) for r in partitions.load(spark, after).collect()} == want
    assert partitions.by_key(spark, after, -1).first()["note"] == "x" and partitions.load(spark, s).count() == len(old)
    # keys of an earlier insert count as stored; a change of a split bucket, or a compaction, writes it to one path
    again = partitions.insert_unique(spark, after, scratch_path(spark, "u"), batch.filter("_id = -1"))
    assert again[:2] == (after, []) and [r["reason"] for r in again[2].collect()] == ["stored", "stored"]
    changed, touched = partitions.inc(spark, after, scratch_path(spark, "u"), -1, "login_count")
    whole, moved = partitions.compact(spark, after, scratch_path(spark, "u"))
    for t in (changed, whole):
        assert sorted(b for _, bs in t.parts for b in bs) == list(range(16))
    assert touched == moved == new and partitions.compact(spark, whole, scratch_path(spark, "u")) == (whole, [])
    assert {r["_id"]: tuple(r) for r in partitions.load(spark, whole).collect()} == want
    with pytest.raises(ValueError, match="_id"):
        partitions.insert_unique(spark, s, scratch_path(spark, "u"), batch.withColumn("_id", F.col("_id").cast("int")))
    none = partitions.insert_unique(spark, s, scratch_path(spark, "u"), batch.limit(0))
    assert none[:2] == (s, []) and none[2].count() == 0


def test_an_insert_reads_the_keys_of_its_buckets(spark, monkeypatch):
    seen = []
    load = partitions._load
    monkeypatch.setattr(partitions, "_load", lambda spark, stored, only=None: seen.append(only) or load(spark, stored, only))
    users = fx.users(spark, SF_SMALL)
    s = partitions.store(users, scratch_path(spark, "u"), buckets=64)
    s, new, _ = partitions.insert_unique(spark, s, scratch_path(spark, "u"), users.limit(1).withColumn("_id", F.lit(-5).cast("long")))
    assert seen[0] == set(new) and len(new) == 1
    keys = plan(load(spark, s, set(new)).select("_id"))
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", keys)
    assert "ReadSchema: struct<_id:bigint>" in keys


# -------------------------------------------------------------- generations

def test_generations_are_one_scan_and_conflicts_raise(spark):
    a, b, c, d = (scratch_path(spark, "gen") for _ in range(4))
    spark.createDataFrame([(1, ("x", 2.0))], "id long, p struct<job: string, lat: double>").write.parquet(a)
    spark.createDataFrame([(2, ("y", "z"), True)], "id long, p struct<job: string, company: string>, active boolean").write.parquet(b)
    spark.createDataFrame([("3",)], "id string").write.parquet(c)
    spark.createDataFrame([(4, 1)], "id long, Active int").write.parquet(d)
    df = catalog.read_generations(spark, [a, b])
    assert rows_of(df.select("id", "p.*", "active")) == [(1, "x", 2.0, None, None), (2, "y", None, "z", True)]
    p = plan(df.filter("id > 1").select("id", "p.job"))
    assert p.count("FileScan") == 1 and "GreaterThan(id,1)" in p and "p:struct<job:string>" in p
    with pytest.raises(ValueError, match="id: bigint in one generation, string in another"):
        catalog.read_generations(spark, [a, c])
    with pytest.raises(ValueError, match="case"):
        catalog.read_generations(spark, [b, d])
    model = T.StructType([T.StructField("note", T.StringType()), T.StructField("id", T.LongType())])
    assert catalog.read_generations(spark, [a], model).columns == ["note", "id", "p"]
    assert catalog.read_generations(spark, [], model).count() == 0


# ------------------------------------------------------------------- insertion

def test_insert_keeps_keys_unique(spark):
    stored = spark.createDataFrame([(1, "old"), (2, "old")], "_id long, v string")
    batch = spark.createDataFrame([(1, "a", 0), (3, "b", 5), (3, "c", 1), (4, "same", 0), (4, "same", 0), (4, "same", 0), (None, "n", 0), (None, "n", 0)],
                                  "_id long, v string, seq int")
    after, rejected = doc.insert_unique(stored, batch, order=["seq"])
    assert rows_of(after.select("_id", "v")) == [(1, "old"), (2, "old"), (3, "c"), (4, "same")]
    assert Counter((r["_id"], r["v"], r["reason"]) for r in rejected.collect()) == {
        (1, "a", "stored"): 1, (3, "b", "batch"): 1, (4, "same", "batch"): 2, (None, "n", "no key"): 2}
    again, left = doc.insert_unique(after.select("_id", "v"), batch.drop("seq"))
    assert rows_of(again) == rows_of(after.select("_id", "v")) and left.count() == 8
    none, no = doc.insert_unique(stored, batch.limit(0))
    assert none.count() == 2 and no.count() == 0


def test_insert_with_a_hot_key_of_nested_documents(spark):
    batch = spark.range(0, 30_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).cast("long").alias("_id"),
        F.struct(F.col("id").alias("n"), F.array(F.lit("t")).alias("tags")).alias("profile"), F.col("id").alias("seq"))
    stored = spark.createDataFrame([(1,), (2,)], "_id long")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        after, rejected = doc.insert_unique(stored, batch, order=["seq"])
        assert after.filter("_id = -1").select("profile.n").collect() == [(0,)] and after.count() == 2 + 20_001 - 2
        assert {r["reason"]: r["n"] for r in rejected.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {"batch": 9999, "stored": 2}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# --------------------------------------------------------------------- graph

def test_every_pair_has_the_same_chance(spark):
    """50 ids, 1,225 pairs, 50,000 draws of one pair each: chi-square with 1,224 degrees of freedom."""
    nodes = spark.range(100, 150).repartition(7)
    counts = Counter()
    ranks = graph.ranked_ids(nodes)
    assert sorted(tuple(r) for r in ranks.collect()) == [(100 + k, k) for k in range(50)]
    for seed in range(40):
        counts.update(tuple(r) for r in graph.sample_pairs(nodes, draws=30, seed=f"s{seed}").collect())
    more = graph.sample_pairs(nodes, draws=20_000, seed="all")
    assert more.count() == 1225  # each is met
    assert len({x for p in counts for x in p}) == 50 and all(a < b for a, b in counts)
    # draws themselves, before repeated ones are dropped
    total = 50
    k = spark.range(50_000)
    from tesserae.functions.scalars import fast_token
    a = F.pmod(fast_token(F.concat(F.lit("q:"), F.col("id").cast("string"), F.lit(":a"))), F.lit(total))
    b = F.pmod(fast_token(F.concat(F.lit("q:"), F.col("id").cast("string"), F.lit(":b"))), F.lit(total - 1))
    d = k.select(a.alias("a"), b.alias("b")).select("a", (F.col("b") + (F.col("b") >= F.col("a")).cast("long")).alias("b"))
    per = d.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).groupBy("x", "y").count().collect()
    assert len(per) == 1225
    chi = sum((r["count"] - 50_000 / 1225) ** 2 for r in per) / (50_000 / 1225)
    assert 1224 - 4 * (2 * 1224) ** 0.5 < chi < 1224 + 4 * (2 * 1224) ** 0.5


def test_detach_delete_shuffles_stored_edges_once(spark):
    """A hub holds a third of all edges and is doomed, or not; with broadcast off the edges are shuffled by src alone."""
    half = spark.range(1, 30_001).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 700 + 1).cast("long").alias("src"),
                                         (F.col("id") + 1000).alias("dst")).distinct()
    catalog.write_keyed(graph.symmetric_closure(half, normalized=True), "edges_t", KeySpec(("src",), ("dst",)), 8, scratch_path(spark, "e"), by="primary")
    edges = spark.table("edges_t")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for doomed in (spark.range(0, 1), spark.range(5, 2000), spark.range(0)):
            left = graph.detach_delete_stored(edges, doomed)
            p = final(left)
            if "Exchange" in p:  # (nothing is left of the plan where nobody is doomed)
                assert len(re.findall(r"Exchange hashpartitioning\(src#\d+L, \d+\)", p)) == 1, p  # edges, by one end
                assert len(re.findall(r"Exchange hashpartitioning\(src#\d+L, dst#\d+L, 8\)", p)) == 1, p  # only the edges found
                assert len(re.findall(r"FileScan.*Bucketed: true", p)) == 1 and p.count("Exchange hash") == 3, p
            _, want = graph.detach_delete(spark.range(1), edges, doomed)
            assert rows_of(left) == rows_of(want)
        assert "skew=true" in final(graph.detach_delete_stored(edges, spark.range(0, 1)))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_merge_edges_both_ways_is_the_general_merge(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (5, 5), (6, None), (7, 8), (8, 7)], "src long, dst long")
    stored = spark.createDataFrame([(1, 2), (2, 1), (9, 1), (1, 9)], "src long, dst long")
    clean = graph.unordered_pairs(pairs)
    assert rows_of(graph.merge_edges(stored, pairs, both_ways=True)) == rows_of(graph.merge_edges(stored, clean))


def test_change_is_read_once(spark):
    for name in ("upsert_lww", "upsert_batch"):
        p = final(QUERIES[name](spark, SF_SMALL))
        assert sum("FileScan" in line and "l_orderkey" in line for line in p.split("\n")) == 1 and "ReusedExchange" in p, p


def test_two_loads_share_one_aggregate(spark):
    for name in ("graph_merge_edges", "graph_delete_edges"):
        p = final(QUERIES[name](spark, SF_SMALL))
        assert p.count("partial_min(shipdate") + p.count("partial_min(l_shipdate") == 1, p


def final(df):
    from tesserae.plans.report import final_plan
    return final_plan(df).split("== Initial Plan ==")[0]
