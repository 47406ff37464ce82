"""DuckDB text of the fixture views (same rows as ``tesserae.sources.fixtures``),
used as CTEs in the SQL oracles."""

from __future__ import annotations

# DuckDB twin of tesserae.functions.scalars.key_token
def key_token_sql(expr: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 15)) AS BIGINT)"


VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "people": ("""SELECT CAST(o_orderkey AS VARCHAR) AS id, concat('w', CAST(o_orderkey % 3 AS VARCHAR)) AS worker,
 o_orderdate AS "timestamp", concat('first', CAST(o_custkey % 50 AS VARCHAR)) AS first_name,
 concat('last', CAST(o_custkey % 97 AS VARCHAR)) AS last_name, concat('u', CAST(o_orderkey AS VARCHAR), '@example.org') AS email,
 concat('555-', CAST(o_orderkey AS VARCHAR)) AS phone, o_totalprice AS amount FROM orders""", ()),
    "user_metrics": ("""SELECT n_name AS city, o_orderkey AS user_id, c_name AS username,
 CAST(1 + (o_orderkey * 7919) % 3600 AS INT) AS session_duration, o_orderdate AS last_access
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""", ()),
    "users_flat": ("""SELECT c_custkey AS _id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name,
 concat('user', CAST(c_custkey AS VARCHAR), '@example.org') AS email, c_mktsegment AS job, n_name AS company,
 CAST((c_custkey * 37) % 181 - 90 AS DOUBLE) AS lat, CAST((c_custkey * 53) % 361 - 180 AS DOUBLE) AS lng,
 CAST(1 + (c_custkey * 7919) % 1000 AS INT) AS login_count,
 strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST((c_custkey * 7919) % 31536000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS last_login,
 c_custkey % 4 <> 0 AS active
 FROM customer JOIN nation ON c_nationkey = n_nationkey""", ()),
    "users": ("""SELECT *, list_transform(range(1, CAST(3 + _id % 4 AS INT)),
 lambda i: ['work','home','sport','music','travel','food','news'][CAST((_id * i * 3 + i) % 7 + 1 AS INT)]) AS tags FROM users_flat""",
              ("users_flat",)),
    "nodes": ("""SELECT p_partkey AS id, p_name AS name, concat('p', CAST(p_partkey AS VARCHAR), '@example.org') AS email,
 p_type AS job, p_brand AS city, concat(CAST(2020 + p_partkey % 5 AS VARCHAR), '-0', CAST(1 + p_partkey % 9 AS VARCHAR),
 '-1', CAST(p_partkey % 10 AS VARCHAR)) AS joined_iso FROM part""", ()),
    "raw_pairs": ("""SELECT l.l_partkey AS a, m.anchor AS b, l.l_shipdate AS shipdate FROM lineitem l
 JOIN (SELECT l_orderkey, min(l_partkey) AS anchor FROM lineitem GROUP BY l_orderkey) m ON l.l_orderkey = m.l_orderkey""", ()),
    "pairs": ("SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM raw_pairs WHERE a <> b", ("raw_pairs",)),
    "edges": ("SELECT src, dst FROM pairs UNION SELECT dst AS src, src AS dst FROM pairs", ("pairs",)),
    "old_pairs": ("""SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM raw_pairs
 WHERE a <> b AND shipdate < TIMESTAMP '1998-06-01 00:00:00'""", ("raw_pairs",)),
    "old_edges": ("SELECT src, dst FROM old_pairs UNION SELECT dst AS src, src AS dst FROM old_pairs", ("old_pairs",)),
    "kv_nodes": ("""SELECT n_nationkey AS node, CASE WHEN n_nationkey % 2 = 0 THEN 'master' ELSE 'slave' END AS role
 FROM nation""", ()),
    "access_log": ("""SELECT event_id, concat('k', CAST(event_id % 6 AS VARCHAR)) AS key, CAST(1 + 2 * (event_id % 12) AS INT) AS node,
 event_type AS cmd, ts FROM events""", ()),
    "kv_writes": ("""SELECT concat('u', CAST(user_id AS VARCHAR)) AS key, CAST(event_id AS VARCHAR) AS value, ts, event_id AS seq
 FROM events""", ()),
    "kv_store": ("""SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC, value DESC) AS rn
 FROM kv_writes) WHERE rn = 1""", ("kv_writes",)),
    "kv_requests": ("SELECT concat('u', CAST(c_custkey AS VARCHAR)) AS key FROM customer", ()),
    "metric_changes": ("""SELECT u.city, u.user_id, u.username,
 CAST(1 + (l.l_orderkey * 31 + l.l_linenumber * 7 + l.l_partkey) % 3600 AS INT) AS session_duration,
 l.l_shipdate AS last_access, CAST(l.l_linenumber AS BIGINT) AS seq
 FROM lineitem l JOIN user_metrics u ON l.l_orderkey = u.user_id""", ("user_metrics",)),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def need(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][1]:
            need(d)
        order.append(n)

    for n in names:
        need(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in order)
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{b[5:]}"
    return f"WITH {ctes}\n{body}"
