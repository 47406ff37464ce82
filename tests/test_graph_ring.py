
from tesserae.operators import graph


def _set(df):
    return {tuple(r) for r in df.collect()}


def test_unordered_pairs(spark):
    raw = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, None), (5, 1)], "a long, b long")
    assert _set(graph.unordered_pairs(raw, "a", "b")) == {(1, 2), (1, 5)}


def test_symmetric_closure_is_own_closure(spark):
    p = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    c = graph.symmetric_closure(p)
    assert _set(c) == {(1, 2), (2, 1), (2, 3), (3, 2)}
    assert _set(graph.symmetric_closure(c)) == _set(c)
    assert c.count() == 4


def test_merge_edges_idempotent_no_duplicates(spark):
    existing = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")
    m = graph.merge_edges(existing, pairs)
    assert m.count() == 4 and _set(m) == {(1, 2), (2, 1), (3, 4), (4, 3)}
    assert _set(graph.merge_edges(m, pairs)) == _set(m) and graph.merge_edges(m, pairs).count() == 4


def test_resolve_drops_unknown_ends(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    pairs = spark.createDataFrame([(1, 2), (1, 9)], "src long, dst long")
    assert _set(graph.resolve_pairs(pairs, nodes)) == {(1, 2, "a", "b")}


def test_merge_nodes_match_or_create(spark):
    cur = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, keep string")
    inc = spark.createDataFrame([(2, "B"), (3, "C")], "id long, name string")
    r = {x["id"]: (x["name"], x["keep"]) for x in graph.merge_nodes(cur, inc, ["name"]).collect()}
    assert r == {1: ("a", "x"), 2: ("B", "y"), 3: ("C", None)}


def test_detach_delete_leaves_no_dangling_edge(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "src long, dst long")
    doomed = spark.createDataFrame([(2,), (4,)], "id long")  # 4 has no edges
    n, e = graph.detach_delete(nodes, edges, doomed)
    assert _set(n) == {(1,), (3,)} and e.count() == 0
    n2, e2 = graph.detach_delete(nodes, edges, spark.createDataFrame([(4,)], "id long"))
    assert n2.count() == 3 and e2.count() == 4
    left = {r[0] for r in n.collect()}
    assert all(a in left and b in left for a, b in e.collect())


def test_delete_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert _set(graph.delete_edges(edges, spark.createDataFrame([(1, 2)], "src long, dst long"))) == {(2, 1)}


def test_sample_pairs_distinct_seeded_and_limited(spark):
    nodes = spark.range(0, 500).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    p = _set(graph.sample_pairs(nodes, draws=1000))
    assert all(0 <= a < b < 500 for a, b in p) and len({x for e in p for x in e}) > 480 and 980 < len(p) <= 1000
    assert p == _set(graph.sample_pairs(nodes.repartition(7), draws=1000))
    assert p != _set(graph.sample_pairs(nodes, draws=1000, seed="other"))
    few = _set(graph.sample_pairs(nodes, draws=1000, n=20))
    assert len(few) == 20 and few < p
    assert len(_set(graph.sample_pairs(nodes))) > 490  # as many draws as ids
    assert _set(graph.sample_pairs(nodes.limit(0))) == set() and _set(graph.sample_pairs(spark.range(1))) == set()
    assert _set(graph.sample_pairs(spark.range(2))) == {(0, 1)}
