
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import documents as doc
from tesserae.operators import mutate, rank
from tesserae.schemas import USERS_SCHEMA
from tesserae.plans.queries import job_stats


def _users(spark):
    rows = [
        (1, "adam", "a@x", {"job": "Engineer", "company": "C", "location": {"lat": 10.0, "lng": 1.0}}, ["work", "home"], 600, "2024-01-01T00:00:00", True),
        (2, "ADAM", "b@x", {"job": "engineering lead", "company": "C", "location": {"lat": -5.0, "lng": 2.0}}, ["sport"], 900, None, True),
        (3, "Bob", "c@x", None, None, None, None, True),
        (4, "éva", "d@x", {"job": "Baker", "company": None, "location": None}, ["work"], 501, None, False),
        (5, "Eva", "e@x", {"job": None, "company": "D", "location": {"lat": 0.0, "lng": 0.0}}, [], 700, None, True),
        (6, "ZED", "f@x", {"job": "Baker", "company": "D", "location": {"lat": 1.0, "lng": 0.0}}, ["music", "work"], 10, None, True),
    ]
    return spark.createDataFrame(rows, USERS_SCHEMA)


def test_conjunction_and_missing_fields(spark):
    u = _users(spark)
    got = {r["_id"] for r in doc.match(u, F.col("active"), F.col("login_count") > 500).collect()}
    assert got == {1, 2, 5}  # null login_count (3) and inactive (4) excluded
    assert doc.count_matching(u, F.col("active"), F.col("login_count") > 500).first()["n"] == 3


def test_nested_path_missing_profile(spark):
    u = _users(spark)
    # doc 3 has no profile, doc 4 no location: neither matches, nothing raises
    assert doc.count_matching(u, F.col("profile.location.lat") > 0).first()["n"] == 2


def test_array_membership_null_tags(spark):
    u = _users(spark)
    got = sorted(r["_id"] for r in doc.match(u, doc.contains("tags", "work")).collect())
    assert got == [1, 4, 6]


def test_regex_case_insensitive(spark):
    u = _users(spark)
    got = sorted(r["_id"] for r in doc.match(u, doc.regex("profile.job", ".*engineer.*", True)).collect())
    assert got == [1, 2]
    got = sorted(r["_id"] for r in doc.match(u, doc.regex("profile.job", ".*engineer.*", False)).collect())
    assert got == [2]


def test_projection_keeps_nesting(spark):
    p = doc.project(_users(spark), ["name", "email", "profile.job"])
    assert p.columns == ["name", "email", "profile"]
    assert p.schema["profile"].dataType.fieldNames() == ["job"]
    assert "_id" not in p.columns


def test_pipeline_null_group_and_shape(spark):
    r = job_stats(_users(spark))
    assert r.columns == ["job_title", "stats"]
    rows = {x["job_title"]: x["stats"] for x in r.collect()}
    # missing profile (3) and null job (5) both land in the null group
    assert rows[None]["total_users"] == 2 and rows[None]["average"] == 700.0
    assert rows["Baker"]["total_users"] == 1  # 4 is inactive
    assert list(rows)[0] == "engineering lead"  # highest average first


def test_find_one_is_deterministic(spark):
    assert doc.find_one(_users(spark), F.col("login_count") > 550).first()["_id"] == 1


def test_field_default(spark):
    u = _users(spark)
    r = {x["_id"]: (x["c"], x["m"]) for x in u.select("_id", doc.field(u, "login_count", 0).alias("c"),
                                                    doc.field(u, "nope.deep", 0).alias("m")).collect()}
    assert r[3] == (0, 0) and r[1] == (600, 0)


def test_collation_sort_case_blind_accent_aware(spark):
    r = [x["name"] for x in rank.collation_sort(_users(spark), "name", tie=["_id"]).collect()]
    assert r == ["adam", "ADAM", "Bob", "Eva", "éva", "ZED"]
    plain = [x["name"] for x in _users(spark).orderBy("name").collect()]
    assert plain[:2] == ["ADAM", "Bob"]


def test_inc_missing_field_starts_at_zero(spark):
    u = _users(spark)
    r = mutate.inc(u, 3, "login_count").filter("_id = 3").first()
    assert r["login_count"] == 1
    r = mutate.inc(u, 1, "visits", 2).select("_id", "visits").orderBy("_id").collect()
    assert r[0]["visits"] == 2 and r[1]["visits"] is None
    after = mutate.inc_and_return(u, 1, "login_count", return_document="after").collect()
    assert len(after) == 1 and after[0]["login_count"] == 601


def test_set_many_sparse_field_and_counts(spark):
    u = _users(spark)
    pred = doc.regex("profile.job", ".*baker.*", True)
    r = {x["_id"]: x["is_technical"] for x in mutate.set_where(u, pred, {"is_technical": True}).collect()}
    assert r == {1: None, 2: None, 3: None, 4: True, 5: None, 6: True}
    c = mutate.update_counts(u, F.col("login_count") > 550, {"active": True}).first()
    assert (c["matched_count"], c["modified_count"]) == (3, 0)
    c = mutate.update_counts(u, F.col("login_count") > 500, {"active": False}).first()
    assert (c["matched_count"], c["modified_count"]) == (4, 3)


def test_set_first_only_one_and_no_insert(spark):
    u = _users(spark)
    r = mutate.set_first(u, F.col("profile.job") == "Baker", {"active": False}).orderBy("_id").collect()
    assert [x["active"] for x in r] == [True, True, True, False, True, True]  # 4 was already False; 6 untouched
    none = mutate.set_first(u, F.col("email") == "example@user.com", {"active": False})
    assert none.count() == 6 and none.filter(~F.col("active")).count() == 1


def test_delete_all(spark):
    u = _users(spark)
    assert mutate.delete_counts(u).first()["deleted_count"] == 6
    e = mutate.delete_all(u)
    assert e.count() == 0 and e.schema == u.schema


def test_insert_many_unions_schemas(spark):
    u = _users(spark).select(F.col("_id").cast("string").alias("_id"), "name")
    new = spark.createDataFrame([("Kim", 3)], "name string, login_count int")
    r = doc.insert_many(u, new)
    assert r.count() == 7 and "login_count" in r.columns
    assert len(r.filter(F.col("name") == "Kim").first()["_id"]) == 36
    import pytest
    with pytest.raises(ValueError):
        doc.insert_many(_users(spark), new)


def test_flatten(spark):
    f = doc.flatten(_users(spark))
    assert "profile_location_lat" in f.columns and "profile_job" in f.columns


def test_insert_many_deterministic_ids(spark):
    new = spark.createDataFrame([("Kim", 3), ("Lee", 4)], "name string, login_count int")
    a = {r["name"]: r["_id"] for r in doc.insert_many(None, new, id_from=["name"]).collect()}
    b = {r["name"]: r["_id"] for r in doc.insert_many(None, new.repartition(2), id_from=["name"]).collect()}
    assert a == b and len(set(a.values())) == 2


def test_bounded_preview(spark):
    import pytest
    p = rank.to_pandas_preview(_users(spark), 3, order=["_id"])
    assert list(p["_id"]) == [1, 2, 3]
    with pytest.raises(ValueError):
        rank.to_pandas_preview(_users(spark), 10**9)


def test_set_where_sees_the_stored_document(spark):
    df = spark.createDataFrame([(5, 0), (0, 0), (None, 3)], "a long, b long")
    out = mutate.set_where(df, F.col("a") > 1, {"a": 0, "b": 9, "c": F.col("a") + F.col("b")})
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(0, 9, 5), (0, 0, None), (None, 3, None)], key=str)


def _changed(before, after):
    return {r["_id"]: (r["change"], tuple(r["fields"])) for r in mutate.changes(before, after).collect()}


def test_read_back_of_a_change(spark):
    u = _users(spark)
    after = mutate.set_where(mutate.delete_where(u, F.col("_id") == 6), F.col("login_count") > 600, {"active": False, "is_new": True})
    after = after.unionByName(_users(spark).filter("_id = 6").withColumn("_id", F.lit(None).cast("long")), allowMissingColumns=True)
    assert _changed(u, after) == {2: ("changed", ("active", "is_new")), 5: ("changed", ("active", "is_new")),
                                  6: ("removed", ()), None: ("added", ())}
    # null against null is no change, null against a value is one; a field deep inside counts as its top field
    moved = u.withColumn("profile", F.col("profile").withField("location.lat", F.lit(1.0)))
    assert _changed(u, moved) == {k: ("changed", ("profile",)) for k in (1, 2, 5)}
    # a field that is gone reads as null
    assert _changed(u, u.drop("last_login")) == {1: ("changed", ("last_login",))}
    assert _changed(u, u) == _changed(u, u.repartition(3)) == {}


def test_read_back_of_empty_states_and_odd_names(spark):
    u, none = _users(spark), _users(spark).limit(0)
    assert _changed(none, none) == {}
    assert _changed(none, u) == {k: ("added", ()) for k in range(1, 7)}
    assert _changed(u, none) == {k: ("removed", ()) for k in range(1, 7)}
    keys = u.select("_id")
    assert _changed(keys, keys.filter("_id < 6")) == {6: ("removed", ())}
    odd = u.select("_id", F.col("name").alias("a.b"), F.col("email").alias("_old"), F.col("tags").alias("_key"))
    assert _changed(odd, odd.withColumn("_old", F.upper("_old"))) == {k: ("changed", ("_old",)) for k in range(1, 7)}


def test_read_back_is_one_equi_join(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        u = _users(spark)
        p = mutate.changes(u, mutate.inc(u, 2, "login_count"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert p.count("SortMergeJoin") + p.count("ShuffledHashJoin") == 1 and "NestedLoop" not in p
    assert p.count("Exchange hashpartitioning") == 2
