"""Registered queries: one per operator of the inventory, each reading the
driver tables (or frames Spark derives from them), with a DuckDB oracle
where the result is SQL-expressible.

Output conventions (so both engines hash equal values): structs are
flattened to ``a_b`` columns, arrays are joined to text, dates are ISO text,
doubles from aggregates are rounded, counts are bigint.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import generate as gen
from ..functions.scalars import bernoulli, bounded_int, iso_date, iso_text, key_token, unit_double, upper_half
from ..operators import documents as doc
from ..operators import expiry, graph, keyed, kv, layout, mutate, partitions, rank, token_layout
from ..schemas import EDGE_KEY, PEOPLE_SCHEMA, USER_METRICS_KEY, USER_METRICS_SCHEMA
from ..session import scratch_path
from ..sources import catalog, files, fixtures as fx
from ..sources.tables import read_table, table_path
from .oracle_views import key_token_sql as kt
from .oracle_views import with_views as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def q(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------- helpers

USER_COLS_SQL = ("_id, name, email, job AS profile_job, company AS profile_company, lat AS profile_location_lat, "
                 "lng AS profile_location_lng, array_to_string(tags, ',') AS tags, login_count, last_login, active")


def doc_out(df: DataFrame) -> DataFrame:
    """Flatten a users frame for comparison (tags joined with ',')."""
    d = df.withColumn("tags", F.array_join("tags", ",")) if "tags" in df.columns else df
    return doc.flatten(d)


def _users(spark, sf):
    return fx.users(spark, sf)


PEOPLE_GEN_SQL = """SELECT concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS id,
 concat('w', CAST(k % 3 AS VARCHAR)) AS worker,
 TIMESTAMP '2020-01-01 00:00:00' + to_seconds(CAST((k * 7919) % 157680000 AS BIGINT)) AS "timestamp",
 first_name, last_name,
 concat(lower(first_name), '.', lower(last_name), CAST(k AS VARCHAR), '@example.org') AS email,
 concat('555-', lpad(CAST((k * 7) % 10000 AS VARCHAR), 4, '0')) AS phone,
 CAST((k * 7919) % 100000 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS amount
FROM (SELECT o_orderkey AS k, md5(concat('people', CAST(o_orderkey AS VARCHAR))) AS h,
 ['Ada','Ben','Cleo','Dan','Eva','Finn','Gia','Hugo','Iris','Jon','Kai','Lena','Milo','Nora','Otto','Pia'][CAST((o_orderkey * 31) % 16 + 1 AS INT)] AS first_name,
 ['Alder','Birch','Cedar','Dogwood','Elm','Fir','Gum','Hazel','Ilex','Juniper','Kapok','Larch','Maple'][CAST((o_orderkey * 17) % 13 + 1 AS INT)] AS last_name
 FROM orders) g"""


def _order_ids(spark, sf):
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))


# ------------------------------------------------------ sources and sinks

@q("schema_of_people", W("SELECT * FROM people", "people"))
def schema_of_people(spark, sf):
    return catalog.conform(fx.people(spark, sf), PEOPLE_SCHEMA)


@q("gen_range", "SELECT unnest(range(o_orderkey * 3, o_orderkey * 3 + 3)) AS id FROM orders")
def gen_range(spark, sf):
    return gen.ids_per_row(read_table(spark, sf, "orders"), "o_orderkey", 3)


@q("gen_people_expr", PEOPLE_GEN_SQL)
def gen_people_expr(spark, sf):
    return gen.people_from_ids(_order_ids(spark, sf))


@q("gen_people_map", PEOPLE_GEN_SQL)
def gen_people_map(spark, sf):
    return gen.people_map(_order_ids(spark, sf))


@q("gen_people_vec", PEOPLE_GEN_SQL)
def gen_people_vec(spark, sf):
    return gen.people_vectorized(_order_ids(spark, sf))


@q("struct_expand", PEOPLE_GEN_SQL)
def struct_expand(spark, sf):
    return _order_ids(spark, sf).withColumn("data", gen.people_struct_expr()).select("data.*")


@q("csv_roundtrip", W("SELECT * FROM people", "people"))
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "people.csv")
    files.write_csv(fx.people(spark, sf), path, header=False)
    return files.read_csv(spark, path, PEOPLE_SCHEMA, header=False)


@q("csv_roundtrip_text", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip_text(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = scratch_path(spark, "documents.csv")
    files.write_csv(docs, path)
    return files.read_csv(spark, path, docs.schema)


@q("parquet_roundtrip", W("SELECT * FROM people", "people"))
def parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "people.parquet")
    files.write_parquet(fx.people(spark, sf), path)
    return files.read_parquet(spark, path)


@q("scan_count", "SELECT count(*) AS row_count FROM lineitem")
def scan_count(spark, sf):
    return read_table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("row_count"))


SPEND_SQL = "SELECT last_name, round(sum(amount), 2) AS spent, count(*) AS n_orders FROM people GROUP BY last_name"


@q("sql_view_agg", W(SPEND_SQL, "people"))
def sql_view_agg(spark, sf):
    fx.people(spark, sf).createOrReplaceTempView("buyers")
    return spark.sql("SELECT last_name, round(sum(amount), 2) AS spent, count(*) AS n_orders FROM buyers GROUP BY last_name")


@q("sql_path_scan", W(SPEND_SQL, "people"))
def sql_path_scan(spark, sf):
    return files.sql_on_path(spark, """
        SELECT concat('last', CAST(o_custkey % 97 AS STRING)) AS last_name, round(sum(o_totalprice), 2) AS spent,
          count(*) AS n_orders FROM {src} GROUP BY 1""", table_path(sf, "orders"))


@q("preview", W("SELECT * FROM people ORDER BY id LIMIT 20", "people"))
def preview(spark, sf):
    return rank.preview(fx.people(spark, sf), 20, order=["id"])


@q("doc_insert", W(f"SELECT {USER_COLS_SQL} FROM users", "users"))
def doc_insert(spark, sf):
    u = _users(spark, sf)
    active = F.coalesce("active", F.lit(False))
    return doc_out(doc.insert_many(u.filter(active), u.filter(~active)))


@q("keyed_table", W("SELECT * FROM user_metrics", "user_metrics"))
def keyed_table(spark, sf):
    return keyed.clustered_layout(fx.user_metrics(spark, sf), USER_METRICS_KEY)


@q("schema_sync", W("""SELECT city, user_id, CAST(NULL AS VARCHAR) AS username, session_duration,
 CAST(NULL AS TIMESTAMP) AS last_access FROM user_metrics""", "user_metrics"))
def schema_sync(spark, sf):
    old = fx.user_metrics(spark, sf).select("city", "user_id", "session_duration")
    return catalog.sync_schema(old, USER_METRICS_SCHEMA)


# ------------------------------------------------------------- documents

def job_stats(users: DataFrame) -> DataFrame:
    return doc.pipeline(users, [
        lambda d: doc.match(d, F.col("active")),
        lambda d: doc.group(d, F.col("profile.job"), logins=F.avg("login_count"), members=F.count(F.lit(1))),
        lambda d: d.orderBy(F.desc("logins"), F.asc_nulls_first("_id")),
        lambda d: doc.restructure(d, {"job_title": "_id", "stats": {"average": "logins", "total_users": "members"}}),
        lambda d: d.limit(100),
    ])


@q("doc_pipeline", W("""SELECT job AS job_title, round(avg(login_count), 6) AS stats_average, count(*) AS stats_total_users
FROM users_flat WHERE active GROUP BY job ORDER BY avg(login_count) DESC LIMIT 100""", "users_flat"))
def doc_pipeline(spark, sf):
    r = doc.flatten(job_stats(_users(spark, sf)))
    return r.withColumn("stats_average", F.round("stats_average", 6))


@q("doc_pipeline_limit", W("""SELECT concat(job, '/', company) AS job_title, round(avg(login_count), 6) AS stats_average, count(*) AS stats_total_users
FROM users_flat WHERE active GROUP BY job, company ORDER BY avg(login_count) DESC, concat(job, '/', company) LIMIT 100""", "users_flat"))
def doc_pipeline_limit(spark, sf):
    """The same stages over more groups than the limit lets through."""
    r = doc.flatten(doc.pipeline(_users(spark, sf), [
        lambda d: doc.match(d, F.col("active")),
        lambda d: doc.group(d, F.concat_ws("/", "profile.job", "profile.company"), logins=F.avg("login_count"), members=F.count(F.lit(1))),
        lambda d: d.orderBy(F.desc("logins"), F.asc_nulls_first("_id")).limit(100),
        lambda d: doc.restructure(d, {"job_title": "_id", "stats": {"average": "logins", "total_users": "members"}}),
    ]))
    return r.withColumn("stats_average", F.round("stats_average", 6))


@q("doc_filter_and", W(f"SELECT {USER_COLS_SQL} FROM users WHERE active AND login_count > 500", "users"))
def doc_filter_and(spark, sf):
    u = _users(spark, sf)
    return doc_out(doc.match(u, F.col("active"), F.col("login_count") > 500))


@q("doc_filter_count", W("SELECT count(*) AS n FROM users_flat WHERE active AND login_count > 500", "users_flat"))
def doc_filter_count(spark, sf):
    return doc.count_matching(_users(spark, sf), F.col("active"), F.col("login_count") > 500)


@q("doc_nested_count", W("SELECT count(*) AS n FROM users_flat WHERE lat > 0", "users_flat"))
def doc_nested_count(spark, sf):
    return doc.count_matching(_users(spark, sf), F.col("profile.location.lat") > 0)


@q("doc_array_contains", W("""SELECT name, email, job AS profile_job FROM users
WHERE list_contains(tags, 'work') ORDER BY _id LIMIT 100""", "users"))
def doc_array_contains(spark, sf):
    u = doc.match(_users(spark, sf), doc.contains("tags", "work"))
    return doc.flatten(doc.project(u.orderBy("_id"), ["name", "email", "profile.job"]).limit(100))


@q("doc_regex", W(f"SELECT {USER_COLS_SQL} FROM users WHERE regexp_matches(job, '(?i).*mach.*')", "users"))
def doc_regex(spark, sf):
    u = _users(spark, sf)
    return doc_out(doc.match(u, doc.regex("profile.job", ".*mach.*", ignore_case=True)))


@q("doc_project", W("SELECT name, email, job AS profile_job FROM users_flat", "users_flat"))
def doc_project(spark, sf):
    return doc.flatten(doc.project(_users(spark, sf), ["name", "email", "profile.job"]))


@q("doc_find_one", W(f"SELECT {USER_COLS_SQL} FROM users WHERE active ORDER BY _id LIMIT 1", "users"))
def doc_find_one(spark, sf):
    return doc_out(doc.find_one(_users(spark, sf), F.col("active")))


@q("doc_by_id", W(f"SELECT {USER_COLS_SQL} FROM users WHERE _id = 42", "users"))
def doc_by_id(spark, sf):
    return doc_out(doc.by_id(_users(spark, sf), 42))


@q("doc_default", W("SELECT _id, coalesce(login_count, 0) AS login_count, 0 AS score FROM users_flat", "users_flat"))
def doc_default(spark, sf):
    u = _users(spark, sf)
    return u.select("_id", doc.field(u, "login_count", 0).alias("login_count"),
                    doc.field(u, "score", 0).alias("score"))


@q("doc_collation_sort", W("SELECT _id, name FROM users_flat ORDER BY lower(name), _id LIMIT 100", "users_flat"))
def doc_collation_sort(spark, sf):
    return rank.collation_sort(_users(spark, sf), "name", 100, tie=["_id"]).select("_id", "name")


@q("struct_build", W(f"SELECT {USER_COLS_SQL} FROM users", "users"))
def struct_build(spark, sf):
    return doc_out(_users(spark, sf))


@q("array_build", W("SELECT _id, array_to_string(tags, ',') AS tags, CAST(len(tags) AS INT) AS n_tags FROM users", "users"))
def array_build(spark, sf):
    u = fx.users_flat(spark, sf).select("_id", fx.tags_expr().alias("tags"))
    return u.select("_id", F.array_join("tags", ",").alias("tags"), F.size("tags").alias("n_tags"))


@q("unwind", W("""SELECT _id, first_tag, CAST(pos AS INT) AS pos, tag FROM
 (SELECT _id, tags[1] AS first_tag, unnest(range(len(tags))) AS pos, unnest(tags) AS tag FROM users)""",
               "users"))
def unwind(spark, sf):
    u = fx.users_flat(spark, sf).select("_id", fx.tags_expr().alias("tags"))
    return u.select("_id", F.col("tags")[0].alias("first_tag"), F.posexplode("tags").alias("pos", "tag"))


@q("scalar_fns", """SELECT c_custkey, CAST(1 + (c_custkey * 7919) % 3600 AS INT) AS session_duration,
 CAST(10 + (c_custkey * 7919) % 991 AS INT) AS login_count,
 round(CAST((c_custkey * 7919) % 100000 AS DOUBLE) * 0.01, 6) AS amount,
 c_custkey % 4 <> 0 AS active,
 CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name,
 strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST((c_custkey * 7919) % 31536000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS last_login,
 CAST(CAST(concat(CAST(2020 + c_custkey % 5 AS VARCHAR), '-0', CAST(1 + c_custkey % 9 AS VARCHAR), '-1', CAST(c_custkey % 10 AS VARCHAR)) AS DATE) AS VARCHAR) AS joined
FROM customer""")
def scalar_fns(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=F.pmod(k * 7919, F.lit(31536000)).cast("int"))
    iso = F.concat((2020 + k % 5).cast("string"), F.lit("-0"), (1 + k % 9).cast("string"), F.lit("-1"),
                   (k % 10).cast("string"))
    return c.select(
        "c_custkey",
        bounded_int(k, 1, 3600).alias("session_duration"),
        bounded_int(k, 10, 1000).alias("login_count"),
        F.round(unit_double(k, 1000.0), 6).alias("amount"),
        bernoulli(k, 4).alias("active"),
        upper_half("c_name", k).alias("name"),
        iso_text(ts).alias("last_login"),
        iso_date(iso).cast("string").alias("joined"),
    )


# ---------------------------------------------------- document mutations

@q("doc_inc", W("""SELECT _id, CASE WHEN _id = 7 THEN coalesce(login_count, 0) + 1 ELSE login_count END AS login_count
FROM users_flat""", "users_flat"))
def doc_inc(spark, sf):
    return mutate.inc(_users(spark, sf), 7, "login_count").select("_id", "login_count")


@q("doc_find_inc", W("""SELECT u._id, u.login_count + CASE WHEN u._id = m.pick THEN 1 ELSE 0 END AS login_count,
 u._id = m.pick AS found FROM users_flat u, (SELECT min(_id) AS pick FROM users_flat WHERE active AND login_count > 500) m""",
                       "users_flat"))
def doc_find_inc(spark, sf):
    """Find one active user, increment their logins, read the change back next to the old value."""
    u = _users(spark, sf).select("_id", "active", "login_count", F.col("login_count").alias("old"))
    r = mutate.inc_first(u, F.col("active") & (F.col("login_count") > 500), "login_count")
    return r.select("_id", "login_count", (F.col("login_count") == F.col("old") + 1).alias("found"))


@q("doc_inc_after", W(f"""SELECT _id, name, email, job AS profile_job, company AS profile_company, lat AS profile_location_lat,
 lng AS profile_location_lng, array_to_string(tags, ',') AS tags, coalesce(login_count, 0) + 1 AS login_count, last_login, active
FROM users WHERE _id = 7""", "users"))
def doc_inc_after(spark, sf):
    return doc_out(mutate.inc_and_return(_users(spark, sf), 7, "login_count", return_document="after"))


@q("doc_set_many", W("""SELECT _id, CASE WHEN regexp_matches(job, '(?i).*mach.*') THEN true ELSE NULL END AS is_technical
FROM users_flat""", "users_flat"))
def doc_set_many(spark, sf):
    u = _users(spark, sf)
    r = mutate.set_where(u, doc.regex("profile.job", ".*mach.*", True), {"is_technical": True})
    return r.select("_id", "is_technical")


@q("doc_set_many_fields", W("""SELECT _id, CASE WHEN login_count > 500 THEN 0 ELSE login_count END AS login_count,
 CASE WHEN login_count > 500 THEN false ELSE active END AS active FROM users_flat""", "users_flat"))
def doc_set_many_fields(spark, sf):
    # the predicate reads a field that the update sets
    r = mutate.set_where(_users(spark, sf), F.col("login_count") > 500, {"login_count": 0, "active": False})
    return r.select("_id", "login_count", "active")


@q("doc_set_one", W("""SELECT _id, CASE WHEN _id = (SELECT min(_id) FROM users_flat WHERE login_count > 990) THEN false
 ELSE active END AS active FROM users_flat""", "users_flat"))
def doc_set_one(spark, sf):
    u = _users(spark, sf)
    return mutate.set_first(u, F.col("login_count") > 990, {"active": False}).select("_id", "active")


@q("update_counts", W("""SELECT count(*) FILTER (WHERE login_count > 900) AS matched_count,
 count(*) FILTER (WHERE login_count > 900 AND active IS DISTINCT FROM false) AS modified_count FROM users_flat""",
                      "users_flat"))
def update_counts(spark, sf):
    return mutate.update_counts(_users(spark, sf), F.col("login_count") > 900, {"active": False})


@q("doc_delete_all", W("SELECT count(*) AS deleted_count FROM users_flat", "users_flat"))
def doc_delete_all(spark, sf):
    return mutate.delete_counts(_users(spark, sf))


@q("doc_after_delete_all", W("SELECT count(*) AS count_before, CAST(0 AS BIGINT) AS count_after FROM users_flat",
                             "users_flat"))
def doc_after_delete_all(spark, sf):
    return mutate.delete_all_counts(_users(spark, sf))


# ------------------------------------------------------------ keyed rows

@q("cql_count", W("SELECT count(*) AS count FROM user_metrics", "user_metrics"))
def cql_count(spark, sf):
    return fx.user_metrics(spark, sf).agg(F.count(F.lit(1)).alias("count"))


@q("cql_limit", W(f"SELECT * FROM user_metrics ORDER BY {kt('city')}, city, user_id LIMIT 100", "user_metrics"))
def cql_limit(spark, sf):
    return keyed.scan_in_token_order(fx.user_metrics(spark, sf), USER_METRICS_KEY, 100, token=key_token)


@q("cql_distinct", W("SELECT DISTINCT city FROM user_metrics", "user_metrics"))
def cql_distinct(spark, sf):
    return keyed.distinct_partitions(fx.user_metrics(spark, sf), USER_METRICS_KEY)


@q("cql_range_filter", W("SELECT * FROM user_metrics WHERE session_duration >= 120", "user_metrics"))
def cql_range_filter(spark, sf):
    return fx.user_metrics(spark, sf).filter(F.col("session_duration") >= 120)


SEEK_TOKEN = 1 << 59
SEEK_SQL = (f"SELECT * FROM user_metrics ORDER BY ({kt('city')} < {SEEK_TOKEN}), {kt('city')}, city, user_id LIMIT 1")


@q("token_seek", W(SEEK_SQL, "user_metrics"))
def token_seek(spark, sf):
    return keyed.token_seek(fx.user_metrics(spark, sf), USER_METRICS_KEY, SEEK_TOKEN, token=key_token)


@q("cql_point", W(f"SELECT m.* FROM user_metrics m JOIN ({SEEK_SQL}) s ON m.city = s.city AND m.user_id = s.user_id",
                  "user_metrics"))
def cql_point(spark, sf):
    um = fx.user_metrics(spark, sf)
    hit = keyed.token_seek(um, USER_METRICS_KEY, SEEK_TOKEN, token=key_token).select("city", "user_id")
    # the seek result is one row: broadcast is size-proven
    return um.join(F.broadcast(hit), ["city", "user_id"]).select(*um.columns)


@q("cql_point_key", W("SELECT * FROM user_metrics WHERE city = 'NATION_12' AND user_id = 422", "user_metrics"))
def cql_point_key(spark, sf):
    return keyed.point(fx.user_metrics(spark, sf), city="NATION_12", user_id=422)


UPSERT_SQL = """SELECT city, user_id, username, session_duration, last_access FROM (
 SELECT *, row_number() OVER (PARTITION BY city, user_id ORDER BY b DESC, last_access DESC, seq DESC NULLS LAST,
   username DESC, session_duration DESC) AS rn
 FROM (SELECT *, CAST(NULL AS BIGINT) AS seq, 0 AS b FROM user_metrics
       UNION ALL SELECT *, 1 AS b FROM metric_changes {more})) WHERE rn = 1"""


@q("upsert_lww", W(UPSERT_SQL.format(more=""), "user_metrics", "metric_changes"))
def upsert_lww(spark, sf):
    return keyed.upsert(fx.user_metrics(spark, sf), fx.metric_changes(spark, sf), USER_METRICS_KEY, ("last_access", "seq"))


@q("upsert_batch", W(UPSERT_SQL.format(more="""UNION ALL SELECT city, user_id, upper(username) AS username,
 session_duration, last_access, CAST(0 AS BIGINT) AS seq, 2 AS b FROM user_metrics WHERE session_duration >= 3000"""),
                     "user_metrics", "metric_changes"))
def upsert_batch(spark, sf):
    um = fx.user_metrics(spark, sf)
    b2 = (um.filter(F.col("session_duration") >= 3000).withColumn("username", F.upper("username"))
          .withColumn("seq", F.lit(0).cast("long")))
    return keyed.upsert(um, [fx.metric_changes(spark, sf), b2], USER_METRICS_KEY, ("last_access", "seq"))


TTL_AS_OF = "1999-01-01 00:00:00"


@q("ttl_live", W(f"""SELECT * FROM (SELECT *, CASE WHEN session_duration < 600 THEN last_access + INTERVAL 86400 SECOND
 ELSE NULL END AS expires_at FROM user_metrics) WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{TTL_AS_OF}'""",
                 "user_metrics"))
def ttl_live(spark, sf):
    um = fx.user_metrics(spark, sf)
    return keyed.live(keyed.with_ttl(um, 86400, "last_access", where=F.col("session_duration") < 600), TTL_AS_OF)


@q("cql_delete", W("SELECT * FROM user_metrics WHERE NOT (session_duration >= 120)", "user_metrics"))
def cql_delete(spark, sf):
    return keyed.delete_where(fx.user_metrics(spark, sf), F.col("session_duration") >= 120)


# --------------------------------------------------------------- key-value

@q("kv_set", W("SELECT * FROM kv_store", "kv_store"))
def kv_set(spark, sf):
    return kv.kv_set(None, fx.kv_writes(spark, sf))


@q("kv_get", W("SELECT r.key, s.value FROM kv_requests r LEFT JOIN kv_store s ON r.key = s.key", "kv_requests", "kv_store"))
def kv_get(spark, sf):
    store = kv.kv_set(None, fx.kv_writes(spark, sf))
    return kv.kv_get(store, fx.kv_requests(spark, sf))


@q("kv_set_existing", W("""SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key
 ORDER BY seq % 2 DESC, ts DESC, seq DESC) AS rn FROM kv_writes) WHERE rn = 1""", "kv_writes"))
def kv_set_existing(spark, sf):
    """Odd events written onto the store that the even ones made: written keys change, the rest stay."""
    w = fx.kv_writes(spark, sf)
    store = kv.kv_set(None, w.filter(F.col("seq") % 2 == 0))
    return kv.kv_set(store, w.filter(F.col("seq") % 2 == 1))


@q("kv_flush", W("SELECT count(*) AS keys_before, CAST(0 AS BIGINT) AS keys_after FROM kv_store", "kv_store"))
def kv_flush(spark, sf):
    return kv.flush_counts(kv.kv_set(None, fx.kv_writes(spark, sf)))


@q("kv_node_stats", W("""SELECT n.node, n.role, CAST(count(a.event_id) AS BIGINT) AS calls, count(a.event_id) > 0 AS handled
FROM kv_nodes n LEFT JOIN access_log a ON n.node = a.node AND a.cmd = 'view' GROUP BY n.node, n.role""",
                      "kv_nodes", "access_log"))
def kv_node_stats(spark, sf):
    return kv.node_stats(fx.kv_nodes(spark, sf), fx.access_log(spark, sf), cmd="view")


STATS_RESET = "2024-01-16 00:00:00"


@q("kv_node_stats_since", W(f"""SELECT n.node, n.role, CAST(count(a.event_id) AS BIGINT) AS calls,
 count(a.event_id) > 0 AS handled FROM kv_nodes n LEFT JOIN access_log a
 ON n.node = a.node AND a.cmd = 'click' AND a.ts >= TIMESTAMP '{STATS_RESET}' GROUP BY n.node, n.role""",
                            "kv_nodes", "access_log"))
def kv_node_stats_since(spark, sf):
    """Calls of one command per node, counted from a statistics reset on."""
    return kv.node_stats(fx.kv_nodes(spark, sf), fx.access_log(spark, sf), cmd="click", since=STATS_RESET)


@q("kv_command_stats", W("""SELECT n.node, n.role, CAST(count(a.event_id) FILTER (WHERE a.cmd = 'view') AS BIGINT) AS view_calls,
 CAST(count(DISTINCT a.cmd) AS INT) AS n_commands
FROM kv_nodes n LEFT JOIN access_log a ON n.node = a.node GROUP BY n.node, n.role""", "kv_nodes", "access_log"))
def kv_command_stats(spark, sf):
    """Per-node command statistics map, read back with defaults."""
    s = kv.command_stats(fx.kv_nodes(spark, sf), fx.access_log(spark, sf))
    return s.select("node", "role", kv.calls_of("stats", "view").alias("view_calls"), F.size("stats").alias("n_commands"))


# ------------------------------------------------------------------ graph

@q("graph_pairs_gen", W("SELECT a, b FROM raw_pairs", "raw_pairs"))
def graph_pairs_gen(spark, sf):
    return fx.raw_pairs(spark, sf).select("a", "b")


@q("graph_sample_pairs", W(f"""SELECT DISTINCT least(x.id, y.id) AS src, greatest(x.id, y.id) AS dst FROM (
 SELECT a, b + CASE WHEN b >= a THEN 1 ELSE 0 END AS b FROM (
  SELECT {kt("concat('pairs:', CAST(j AS VARCHAR), ':a')")} % n AS a, {kt("concat('pairs:', CAST(j AS VARCHAR), ':b')")} % (n - 1) AS b
  FROM (SELECT n, unnest(range(n)) AS j FROM (SELECT count(*) AS n FROM nodes) c) d) e) f
 JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM nodes) x ON f.a = x.k
 JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM nodes) y ON f.b = y.k""", "nodes"))
def graph_sample_pairs(spark, sf):
    """As many free draws of two different nodes as there are nodes."""
    return graph.sample_pairs(fx.nodes(spark, sf), token=key_token)


@q("graph_pairs", W("SELECT * FROM pairs", "pairs"))
def graph_pairs(spark, sf):
    return fx.pairs(spark, sf)


@q("graph_symmetric", W("SELECT * FROM edges", "edges"))
def graph_symmetric(spark, sf):
    return fx.edges(spark, sf)


@q("graph_node_ids", W("SELECT id FROM nodes", "nodes"))
def graph_node_ids(spark, sf):
    return graph.node_ids(fx.nodes(spark, sf))


@q("graph_nodes", W("SELECT id, name, email, job, city, CAST(CAST(joined_iso AS DATE) AS VARCHAR) AS joined FROM nodes", "nodes"))
def graph_nodes(spark, sf):
    n = fx.nodes(spark, sf)
    return n.select("id", "name", "email", "job", "city", iso_date("joined_iso").cast("string").alias("joined"))


@q("graph_resolve", W("""SELECT p.src, p.dst, a.name AS src_name, b.name AS dst_name FROM pairs p
JOIN nodes a ON p.src = a.id JOIN nodes b ON p.dst = b.id WHERE a.job <> 'ECONOMY' AND b.job <> 'ECONOMY'""",
                      "pairs", "nodes"))
def graph_resolve(spark, sf):
    known = fx.nodes(spark, sf).filter(F.col("job") != "ECONOMY")
    return graph.resolve_pairs(fx.pairs(spark, sf), known)


@q("graph_merge_nodes", W("""SELECT coalesce(c.id, i.id) AS id,
 CASE WHEN i.id IS NOT NULL THEN upper(i.name) ELSE c.name END AS name,
 CASE WHEN i.id IS NOT NULL THEN concat('new.', i.email) ELSE c.email END AS email,
 CASE WHEN i.id IS NOT NULL THEN i.job ELSE c.job END AS job,
 CASE WHEN i.id IS NOT NULL THEN i.city ELSE c.city END AS city,
 CAST(CASE WHEN i.id IS NOT NULL THEN CAST(i.joined_iso AS DATE) ELSE CAST(c.joined_iso AS DATE) END AS VARCHAR) AS joined
FROM (SELECT * FROM nodes WHERE job <> 'LARGE') c FULL OUTER JOIN (SELECT * FROM nodes WHERE job <> 'SMALL') i ON c.id = i.id""",
                          "nodes"))
def graph_merge_nodes(spark, sf):
    n = fx.nodes(spark, sf).withColumn("joined", iso_date("joined_iso")).drop("joined_iso")
    cur = n.filter(F.col("job") != "LARGE")
    inc = (n.filter(F.col("job") != "SMALL").withColumn("name", F.upper("name"))
           .withColumn("email", F.concat(F.lit("new."), F.col("email"))))
    m = graph.merge_nodes(cur, inc, ["name", "email", "job", "city", "joined"])
    return m.withColumn("joined", F.col("joined").cast("string"))


PAIRS_CUTOFF = "1998-06-01 00:00:00"


@q("graph_merge_edges", W("SELECT * FROM old_edges UNION SELECT * FROM edges", "old_edges", "edges"))
def graph_merge_edges(spark, sf):
    seen = fx.pairs_seen(spark, sf)
    old = seen.filter(F.col("since") < F.lit(PAIRS_CUTOFF).cast("timestamp_ntz")).select("src", "dst")
    return graph.merge_edges(graph.symmetric_closure(old, normalized=True), seen.select("src", "dst"), both_ways=True)


@q("graph_detach_delete", W("""SELECT e.src, e.dst FROM edges e WHERE e.src NOT IN (SELECT id FROM nodes WHERE job = 'ECONOMY')
 AND e.dst NOT IN (SELECT id FROM nodes WHERE job = 'ECONOMY')""", "edges", "nodes"))
def graph_detach_delete(spark, sf):
    n = fx.nodes(spark, sf)
    _, e = graph.detach_delete(n, fx.edges(spark, sf), n.filter(F.col("job") == "ECONOMY"))
    return e


@q("graph_detach_delete_nodes", W("SELECT id, name FROM nodes WHERE job <> 'ECONOMY'", "nodes"))
def graph_detach_delete_nodes(spark, sf):
    n = fx.nodes(spark, sf)
    rest, _ = graph.detach_delete(n, fx.edges(spark, sf), n.filter(F.col("job") == "ECONOMY"))
    return rest.select("id", "name")


@q("graph_delete_edges", W("SELECT * FROM edges EXCEPT SELECT * FROM old_edges", "edges", "old_edges"))
def graph_delete_edges(spark, sf):
    seen = graph.symmetric_closure(fx.pairs_seen(spark, sf), normalized=True)
    return graph.delete_edges(seen.select("src", "dst"), seen.filter(F.col("since") < F.lit(PAIRS_CUTOFF).cast("timestamp_ntz")))


# ------------------------------------------------- groups, top-k, layout

@q("group_count", W("SELECT first_name, count(*) AS count FROM people GROUP BY first_name", "people"))
def group_count(spark, sf):
    return rank.group_count(fx.people(spark, sf), "first_name")


@q("topk_latest", W('SELECT * FROM people ORDER BY "timestamp" DESC, id LIMIT 10', "people"))
def topk_latest(spark, sf):
    return rank.latest(fx.people(spark, sf), "timestamp", 10, tie=["id"])


@q("topk_group", W("""SELECT first_name, count(*) AS count FROM people GROUP BY first_name
ORDER BY count DESC, first_name LIMIT 10""", "people"))
def topk_group(spark, sf):
    return rank.top_groups(fx.people(spark, sf), "first_name", 10)


# the layout reports name physical partitions; the queries add them up to totals that any layout must give

@q("partition_stats", W("SELECT worker, CAST(count(*) AS BIGINT) AS rows, true AS spread FROM people GROUP BY worker",
                        "people"))
def partition_stats(spark, sf):
    per = layout.partition_stats(fx.people(spark, sf).repartition(layout.partitions_for(spark)), ["worker"])
    return per.groupBy("worker").agg(F.sum("count").alias("rows"), (F.count(F.lit(1)) > 1).alias("spread"))


@q("partition_skew", W("SELECT count(*) AS rows, true AS in_bounds FROM people", "people"))
def partition_skew(spark, sf):
    n = layout.partitions_for(spark)
    r = layout.skew_report(fx.people(spark, sf).repartition(n))
    return r.select("rows", ((F.col("partitions") <= n) & (F.col("min_rows") <= F.col("avg_rows"))
                             & (F.col("avg_rows") <= F.col("max_rows")) & (F.col("skew") < 2)).alias("in_bounds"))


@q("clustered_layout", W("SELECT city, count(*) AS rows, CAST(0 AS BIGINT) AS out_of_order FROM user_metrics GROUP BY city",
                         "user_metrics"))
def clustered_layout(spark, sf):
    lay = keyed.clustered_layout(fx.user_metrics(spark, sf), USER_METRICS_KEY, layout.partitions_for(spark, 8))
    return layout.order_faults(lay, USER_METRICS_KEY.primary, ["city"])


# -------------------------------------------------------------- streaming

@q("stream_kv_set", W("SELECT * FROM kv_store", "kv_store"))
def stream_kv_set(spark, sf):
    from ..streaming.upsert import stream_kv_writes
    return stream_kv_writes(spark, sf)


@q("stream_kv_compacted", W("SELECT * FROM kv_store", "kv_store"))
def stream_kv_compacted(spark, sf):
    """The same stream, its batch folders folded into one at a new path, which is what is read."""
    from ..streaming.upsert import stream_kv_writes
    return stream_kv_writes(spark, sf, compacted=True)


# ------------------------------------------------------------ no match, hosts

@q("doc_set_one_nomatch", W("SELECT _id, active FROM users_flat", "users_flat"))
def doc_set_one_nomatch(spark, sf):
    """An update that matches no document: nothing changes and nothing is inserted."""
    u = _users(spark, sf)
    return mutate.set_first(u, F.col("email") == "nobody@example.org", {"active": False}).select("_id", "active")


@q("partition_hosts", "SELECT count(*) AS rows, true AS every_host_named FROM orders")
def partition_hosts(spark, sf):
    """Rows per (executor host, partition) of the executor-side generator, added up."""
    people = gen.people_map(_order_ids(spark, sf).repartition(layout.partitions_for(spark)), hostname_worker=True)
    per = layout.partition_stats(people, ["worker"])
    return per.agg(F.sum("count").alias("rows"), F.bool_and(F.length("worker") > 0).alias("every_host_named"))


# ---------------------------------------------------- tables written in between

@q("upsert_written", W(UPSERT_SQL.format(more=""), "user_metrics", "metric_changes"))
def upsert_written(spark, sf):
    """The table, then its next state, each written to a path of its own; the second is read."""
    before, after = scratch_path(spark, "user-metrics"), scratch_path(spark, "user-metrics")
    files.write_parquet(fx.user_metrics(spark, sf), before)
    cur = files.read_parquet(spark, before)
    files.write_parquet(keyed.upsert(cur, fx.metric_changes(spark, sf), USER_METRICS_KEY, ("last_access", "seq")), after)
    return files.read_parquet(spark, after)


@q("keyed_bucket_counts", W("SELECT city, count(*) AS rows FROM user_metrics GROUP BY city", "user_metrics"))
def keyed_bucket_counts(spark, sf):
    """Rows per partition key: partial counts, then one small shuffle."""
    return fx.user_metrics(spark, sf).groupBy("city").agg(F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------------- stored layouts

def _stored_by_token(spark, sf):
    path = scratch_path(spark, "user-metrics-by-token")
    return token_layout.write_by_token(fx.user_metrics(spark, sf), path, USER_METRICS_KEY, key_token)


@q("token_seek_stored", W(SEEK_SQL, "user_metrics"))
def token_seek_stored(spark, sf):
    """The seek over a table stored in token order: both ends of the tokens read reach the scan."""
    return token_layout.seek(spark, _stored_by_token(spark, sf), USER_METRICS_KEY, SEEK_TOKEN).drop("token")


PAGE = 100


@q("token_page_stored", W(f"""SELECT *, {kt('city')} AS token FROM user_metrics
 ORDER BY {kt('city')}, city, user_id LIMIT {PAGE} OFFSET {2 * PAGE}""", "user_metrics"))
def token_page_stored(spark, sf):
    """The third page of a scan in token order, each page resumed after the last row of the one before."""
    path, after, order = _stored_by_token(spark, sf), None, ["token", *USER_METRICS_KEY.primary]
    for _ in range(2):
        last = token_layout.page(spark, path, USER_METRICS_KEY, PAGE, after=after).agg(F.max(F.struct(*order)).alias("at")).first()["at"]
        after = tuple(last)
    return token_layout.page(spark, path, USER_METRICS_KEY, PAGE, after=after)


@q("keyed_join_stored", W("""SELECT m.city, m.user_id, m.username, m.session_duration, c.changes, c.longest FROM user_metrics m
 JOIN (SELECT city, user_id, count(*) AS changes, max(session_duration) AS longest FROM metric_changes GROUP BY city, user_id) c
 ON m.city = c.city AND m.user_id = c.user_id""", "user_metrics", "metric_changes"))
def keyed_join_stored(spark, sf):
    """Two stored tables joined on the full key, bucket by bucket."""
    buckets = catalog.buckets_for(files.size_bytes(spark, table_path(sf, "lineitem")))
    changes = fx.metric_changes(spark, sf).groupBy(*USER_METRICS_KEY.primary).agg(
        F.count(F.lit(1)).alias("changes"), F.max("session_duration").alias("longest"))
    names = []
    for df in (fx.user_metrics(spark, sf).drop("last_access"), changes):
        location = scratch_path(spark, "keyed")
        names.append("tesserae_" + location.rsplit("/", 1)[-1].replace("-", "_"))
        catalog.write_keyed(df, names[-1], USER_METRICS_KEY, buckets, location, by="primary")
    return catalog.join_stored(spark, *names, USER_METRICS_KEY)


@q("graph_detach_delete_stored", W("""SELECT e.src, e.dst FROM edges e WHERE e.src NOT IN (SELECT id FROM nodes WHERE job = 'ECONOMY')
 AND e.dst NOT IN (SELECT id FROM nodes WHERE job = 'ECONOMY')""", "edges", "nodes"))
def graph_detach_delete_stored(spark, sf):
    """Nodes and their edges taken from a stored edge table: its edges are shuffled once."""
    location = scratch_path(spark, "edges")
    name = "tesserae_" + location.rsplit("/", 1)[-1].replace("-", "_")
    buckets = catalog.buckets_for(files.size_bytes(spark, table_path(sf, "lineitem")))
    catalog.write_keyed(fx.edges(spark, sf), name, EDGE_KEY, buckets, location, by="primary")
    return graph.detach_delete_stored(spark.table(name), fx.nodes(spark, sf).filter(F.col("job") == "ECONOMY"))


PURGE_AS_OF = "1999-01-01 12:00:00"


@q("ttl_purge", W(f"""SELECT *, expires_at IS NULL OR expires_at > TIMESTAMP '{PURGE_AS_OF}' AS alive FROM (
 SELECT *, CASE WHEN session_duration < 3000 THEN TIMESTAMP '1998-12-27 00:00:00' + to_seconds(session_duration * 240 + 86400)
  ELSE NULL END AS expires_at FROM user_metrics)
 WHERE expires_at IS NULL OR CAST(expires_at AS DATE) >= DATE '1999-01-01'""", "user_metrics"))
def ttl_purge(spark, sf):
    """Rows left after a purge of the folders of past days, and whether a reader still sees them."""
    um, path = fx.user_metrics(spark, sf), scratch_path(spark, "user-metrics-ttl")
    written = F.lit("1998-12-27 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("session_duration") * 240)
    expiry.write_by_expiry(keyed.with_ttl(um, 86400, written, where=F.col("session_duration") < 3000), path, USER_METRICS_KEY.primary)
    expiry.purge(spark, path, PURGE_AS_OF)
    left = expiry.read_all(spark, path)
    return left.withColumn("alive", F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(PURGE_AS_OF).cast("timestamp_ntz")))


@q("ttl_live_stored", W(f"""SELECT * FROM (SELECT *, CASE WHEN session_duration < 3000
 THEN TIMESTAMP '1998-12-27 00:00:00' + to_seconds(session_duration * 240 + 86400) ELSE NULL END AS expires_at FROM user_metrics)
 WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{PURGE_AS_OF}'""", "user_metrics"))
def ttl_live_stored(spark, sf):
    """Live rows of the same layout before any purge: folders of past days are pruned."""
    um, path = fx.user_metrics(spark, sf), scratch_path(spark, "user-metrics-ttl")
    written = F.lit("1998-12-27 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("session_duration") * 240)
    expiry.write_by_expiry(keyed.with_ttl(um, 86400, written, where=F.col("session_duration") < 3000), path, USER_METRICS_KEY.primary)
    return expiry.read_live(spark, path, PURGE_AS_OF)


def _lookup_table(spark, sf):
    path = scratch_path(spark, "user-metrics-lookup")
    files.write_for_lookup(fx.user_metrics(spark, sf), path, USER_METRICS_KEY.primary, also=["username"])
    return files.read_parquet(spark, path)


@q("cql_point_stored", W("SELECT * FROM user_metrics WHERE city = 'NATION_12' AND user_id = 422", "user_metrics"))
def cql_point_stored(spark, sf):
    return keyed.point(_lookup_table(spark, sf), city="NATION_12", user_id=422)


@q("cql_by_username", W("SELECT * FROM user_metrics WHERE username = (SELECT c_name FROM customer WHERE c_custkey = 7)", "user_metrics"))
def cql_by_username(spark, sf):
    """Lookup by a secondary index: the Bloom filters on a column that is not in the key."""
    name = read_table(spark, sf, "customer").filter(F.col("c_custkey") == 7).select("c_name").first()[0]
    return keyed.point(_lookup_table(spark, sf), username=name)


@q("schema_sync_files", W("""SELECT city, user_id, CASE WHEN user_id % 2 = 1 THEN username END AS username, session_duration,
 CASE WHEN user_id % 2 = 1 THEN last_access END AS last_access, CASE WHEN user_id % 2 = 0 THEN concat('from ', city) END AS note
 FROM user_metrics""", "user_metrics"))
def schema_sync_files(spark, sf):
    """Two generations of files, the older without two of the model's columns and with one of its own, read as one."""
    um = fx.user_metrics(spark, sf)
    old, new = scratch_path(spark, "generation"), scratch_path(spark, "generation")
    files.write_parquet(um.filter(F.col("user_id") % 2 == 0).select("city", "user_id", "session_duration",
                                                                   F.concat(F.lit("from "), F.col("city")).alias("note")), old)
    files.write_parquet(um.filter(F.col("user_id") % 2 == 1), new)
    return catalog.read_generations(spark, [old, new], USER_METRICS_SCHEMA)


def _stored_users(spark, sf):
    buckets = catalog.buckets_for(files.size_bytes(spark, table_path(sf, "customer")), least=16)
    return partitions.store(_users(spark, sf), scratch_path(spark, "users"), buckets=buckets)


@q("doc_inc_stored", W("""SELECT _id, CASE WHEN _id = 7 THEN coalesce(login_count, 0) + 1 ELSE login_count END AS login_count
FROM users_flat""", "users_flat"))
def doc_inc_stored(spark, sf):
    """One document of a stored collection changes: one folder is written, the others are read where they are."""
    stored, _ = partitions.inc(spark, _stored_users(spark, sf), scratch_path(spark, "users"), 7, "login_count")
    return partitions.load(spark, stored).select("_id", "login_count")


@q("doc_changes_stored", W("""SELECT _id, CASE WHEN _id = 7 THEN coalesce(login_count, 0) + 1 ELSE login_count END AS login_count,
 CASE WHEN _id = (SELECT min(_id) FROM users_flat WHERE login_count > 990) THEN false ELSE active END AS active,
 CASE WHEN job = 'MACHINERY' THEN true END AS is_technical FROM users_flat
 WHERE _id <> (SELECT max(_id) FROM users_flat)""", "users_flat"))
def doc_changes_stored(spark, sf):
    """An increment, a set on the first match, a set of a new field on all matches and a deletion, one after another."""
    stored, last = _stored_users(spark, sf), _users(spark, sf).agg(F.max("_id")).first()[0]
    stored, _ = partitions.inc(spark, stored, scratch_path(spark, "users"), 7, "login_count")
    stored, _ = partitions.set_first(spark, stored, scratch_path(spark, "users"), F.col("login_count") > 990, {"active": False})
    stored, _ = partitions.set_where(spark, stored, scratch_path(spark, "users"), F.col("profile.job") == "MACHINERY", {"is_technical": True})
    stored, _ = partitions.delete_where(spark, stored, scratch_path(spark, "users"), F.col("_id") == last)
    return partitions.load(spark, stored).select("_id", "login_count", "active", "is_technical")


BATCH_SQL = """SELECT _id, lower(email) AS email, login_count, 0 AS seq FROM users_flat WHERE login_count > 300
 UNION ALL SELECT _id, upper(email) AS email, login_count, 1 AS seq FROM users_flat WHERE login_count > 600
 UNION ALL SELECT CAST(NULL AS BIGINT) AS _id, email, login_count, 2 AS seq FROM users_flat WHERE login_count > 990"""


INSERT_SQL = f"""SELECT _id, email, login_count, CASE WHEN _id IS NULL THEN 'no key' WHEN stored THEN 'stored' WHEN rn > 1 THEN 'batch'
 ELSE 'inserted' END AS outcome FROM (SELECT b._id, b.email, b.login_count, u._id IS NOT NULL AS stored,
  row_number() OVER (PARTITION BY b._id ORDER BY b.seq) AS rn FROM ({BATCH_SQL}) b
  LEFT JOIN (SELECT _id FROM users_flat WHERE active) u ON b._id = u._id)
 UNION ALL SELECT _id, email, login_count, 'kept' AS outcome FROM users_flat WHERE active"""


def _insert_batch(u):
    part = lambda pred, email, seq: u.filter(pred).select("_id", email.alias("email"), "login_count", F.lit(seq).alias("seq"))
    return (part(F.col("login_count") > 300, F.lower("email"), 0).union(part(F.col("login_count") > 600, F.upper("email"), 1))
            .union(part(F.col("login_count") > 990, F.col("email"), 2).withColumn("_id", F.lit(None).cast("long"))))


def _outcomes(after, rejected):
    after = after.select("_id", "email", "login_count", F.coalesce("outcome", F.lit("inserted")).alias("outcome"))
    return after.union(rejected.select("_id", "email", "login_count", "reason"))


@q("doc_insert_unique", W(INSERT_SQL, "users_flat"))
def doc_insert_unique(spark, sf):
    """A batch with keys that are stored, that repeat within it, and that are missing."""
    u = _users(spark, sf).select("_id", "email", "login_count", "active")
    stored = u.filter("active").select("_id", "email", "login_count", F.lit("kept").alias("outcome"))
    return _outcomes(*doc.insert_unique(stored, _insert_batch(u), order=["seq"]))


@q("doc_insert_stored", W(INSERT_SQL, "users_flat"))
def doc_insert_stored(spark, sf):
    """The same batch put into a stored collection, of which only keys are read; its split buckets are then compacted."""
    u = _users(spark, sf).select("_id", "email", "login_count", "active")
    buckets = catalog.buckets_for(files.size_bytes(spark, table_path(sf, "customer")), least=16)
    stored = partitions.store(u.filter("active").select("_id", "email", "login_count", F.lit("kept").alias("outcome")),
                              scratch_path(spark, "users"), buckets=buckets)
    stored, _, rejected = partitions.insert_unique(spark, stored, scratch_path(spark, "users"), _insert_batch(u), order=["seq"])
    stored, _ = partitions.compact(spark, stored, scratch_path(spark, "users"))
    return _outcomes(partitions.load(spark, stored), rejected)


#: Names that differ in case or accents alone, in every combination that the collation has to order.
NAMES = ["eva", "Eva", "éva", "ÉVA", "zoe", "Zoë", "ADAM", "ádám", "adam", "Ádam", "adám"]
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


@q("doc_collation_accents", W(f"""SELECT _id, name FROM (SELECT _id, concat({NAMES_SQL}[CAST((_id * 7) % 11 + 1 AS INT)], ' ',
 CAST(_id % 97 AS VARCHAR)) AS name FROM users_flat) ORDER BY strip_accents(lower(name)), lower(name), _id LIMIT 100""", "users_flat"))
def doc_collation_accents(spark, sf):
    """Case-blind, accent-aware order: letters first, then accents, then the tie."""
    k = F.col("_id")
    name = F.concat_ws(" ", F.element_at(F.array(*[F.lit(n) for n in NAMES]), ((k * 7) % 11 + 1).cast("int")), (k % 97).cast("string"))
    return rank.collation_sort(_users(spark, sf).select("_id", name.alias("name")), "name", 100, tie=["_id"])


@q("doc_read_back", W("""SELECT _id, 'removed' AS change, '' AS fields FROM users_flat WHERE login_count > 950
 UNION ALL SELECT _id, 'changed' AS change, CASE WHEN active THEN 'active,is_technical' ELSE 'is_technical' END AS fields
 FROM users_flat WHERE login_count <= 950 AND job = 'MACHINERY'
 UNION ALL SELECT -1 - _id AS _id, 'added' AS change, '' AS fields FROM users_flat WHERE _id % 50 = 0""", "users_flat"))
def doc_read_back(spark, sf):
    """What a set, a deletion and an insert did to a stored collection, read back and compared with the state before."""
    before, users = _stored_users(spark, sf), _users(spark, sf)
    stored, _ = partitions.set_where(spark, before, scratch_path(spark, "users"), F.col("profile.job") == "MACHINERY",
                                     {"active": False, "is_technical": True})
    stored, _ = partitions.delete_where(spark, stored, scratch_path(spark, "users"), F.col("login_count") > 950)
    after = doc.insert_many(partitions.load(spark, stored), users.filter(F.col("_id") % 50 == 0).withColumn("_id", -1 - F.col("_id")))
    return mutate.changes(partitions.load(spark, before), after).withColumn("fields", F.array_join("fields", ","))


@q("namespace_tables", W("""SELECT 'first' AS namespace, 'history' AS table_name, city, count(*) AS n FROM user_metrics
 WHERE user_id % 2 = 1 AND session_duration > 1800 GROUP BY city
 UNION ALL SELECT 'second' AS namespace, CASE WHEN user_id % 2 = 0 THEN 'current' ELSE 'history' END AS table_name, city, count(*) AS n
 FROM user_metrics GROUP BY user_id % 2, city""", "user_metrics"))
def namespace_tables(spark, sf):
    """Three namespaces of like-named tables: a table dropped and one emptied and loaded again in the first, nothing
    done in the second, the third dropped with its tables. Counts over all tables that are left."""
    root, before = scratch_path(spark, "namespaces"), spark.catalog.currentDatabase()
    rows = fx.user_metrics(spark, sf).select("city", "user_id", "session_duration")
    of = {label: f"tesserae_{label}_{root.rsplit('-', 1)[-1]}" for label in ("first", "second", "third")}
    left = []
    try:
        for label, name in of.items():
            catalog.create_namespace(spark, name, f"{root}/{label}")
            catalog.use_namespace(spark, name)
            for table, odd in (("current", 0), ("history", 1)):
                rows.filter(F.col("user_id") % 2 == odd).write.saveAsTable(table)
        catalog.use_namespace(spark, of["first"])
        catalog.drop_table(spark, "current")
        catalog.truncate_table(spark, "history")
        rows.filter((F.col("user_id") % 2 == 1) & (F.col("session_duration") > 1800)).write.insertInto("history")
        catalog.drop_namespace(spark, of["third"])
        for label, name in of.items():
            for table in catalog.tables_of(spark, name):
                counts = rank.group_count(spark.table(f"{name}.{table}"), "city", "n")
                left.append(counts.select(F.lit(label).alias("namespace"), F.lit(table).alias("table_name"), "city", "n"))
    finally:
        catalog.use_namespace(spark, before)
    return reduce(DataFrame.unionByName, left)


@q("single_file_report", W("SELECT city, count(*) AS n, 1 AS files FROM user_metrics GROUP BY city", "user_metrics"))
def single_file_report(spark, sf):
    """A small report written as one file: only its groups go through one task, the rows are counted where they lie."""
    counts, path = rank.group_count(fx.user_metrics(spark, sf), "city", "n"), scratch_path(spark, "report.csv")
    files.write_csv(counts, path, single_file=True)
    report = files.read_csv(spark, path, counts.schema)
    return report.withColumn("files", F.lit(len(report.inputFiles())))


@q("ttl_live_now", W("""SELECT * FROM (SELECT *, last_access + to_seconds(900000000) AS expires_at FROM user_metrics)
 WHERE expires_at > CAST(now() AS TIMESTAMP)""", "user_metrics"))
def ttl_live_now(spark, sf):
    """Rows alive at the time of the query: lives of 28 years, some of which end about now."""
    return keyed.live(keyed.with_ttl(fx.user_metrics(spark, sf), 900_000_000, "last_access"))
