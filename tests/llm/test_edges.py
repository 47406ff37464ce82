"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import zlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import decontam, hilbert, mixing, rule_ensemble, secret_scan, simhash, substrings, token_files, topk, url_filter
from tesserae.llm.common import scratch
from tests.llm.conftest import words

TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))
DIMS = list(corpus_pipeline.SHARD_DIMENSIONS)


def test_mix(odd, empty):
    out = mixing.mix(odd, {"src1": 3.0}, rest=1.0)
    assert {"Copy", "copy"} & set(out.columns) == {"copy"} and "a.b" in out.columns
    rows = out.collect()
    per = Counter((r["doc_id"], r["text"]) for r in rows)
    assert all(per[(r["doc_id"], r["text"])] % r["n_copies"] == 0 for r in rows)
    assert mixing.mix(empty, {"src1": 1.0}).count() == 0
    assert mixing.mix(odd.where("text is null"), {}).count() == 0


def test_tokens(spark, odd, empty):
    folder = scratch(spark, "t")
    token_files.write_token_files(odd, folder, TOKENIZER)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    assert len(rows) == odd.count()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i))
    assert sum(r["n_tokens"] == 1 for r in rows) == 4  # null, empty and blank texts: the end id alone
    folder = scratch(spark, "t")
    token_files.write_token_files(empty, folder, TOKENIZER)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_simhash(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {2}
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[6] == 5 and by[8] == 7 and by[1] == 1
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(set(by.values()))
    nameless = odd.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.keep_one(nameless).count() == len({r["fingerprint"] for r in simhash.near_duplicates(nameless).collect()})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_secrets(odd, empty):
    out = secret_scan.digest(*secret_scan.scan(odd, F.col("source"), F.col("lang"))).collect()
    assert len(out) == odd.count()
    hit = next(r for r in out if r["doc_id"] == 11)
    assert (hit["n_assign"], hit["n_access"], hit["n_hex"]) == (1, 1, 0)
    assert hit["spans"] == "assign:0:25,live:11:25,access:30:50,live:30:50"
    assert hit["base_sha256"] == hashlib.sha256(b"assign:0:25,access:30:50").hexdigest()
    assert {r["base_sha256"] for r in out if r["doc_id"] != 11} == {hashlib.sha256(b"").hexdigest()}
    assert secret_scan.digest(*secret_scan.scan(empty, F.col("source"), F.col("lang"))).count() == 0


def test_a_null_owner_is_not_the_empty_one(spark):
    text = "password = abcdefghijk123"
    def owners(*names):
        df = spark.createDataFrame([(k, text, n, "r") for k, n in enumerate(names)], "doc_id long, text string, owner string, repo string")
        return {(r["owners"], r["repositories"], r["live"]) for r in secret_scan.scan(df, F.col("owner"), F.col("repo"))[1].collect()}
    assert owners(None, "") == {(2, 2, False)} and owners(None, None) == {(1, 1, True)} and owners("", "") == {(1, 1, True)}


def test_shards(odd, empty):
    out = hilbert.shard(odd, DIMS, shards=4)
    assert sum(c.lower() == "shard" for c in out.columns) == 1 and "a.b" in out.columns
    rows = out.collect()
    assert max(Counter(r["shard"] for r in rows).values()) - min(Counter(r["shard"] for r in rows).values()) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in rows)
    assert hilbert.shard(odd.limit(2), DIMS, shards=24).select("slot").distinct().collect()[0][0] == 0
    assert hilbert.shard(empty, DIMS).count() == 0


def test_top_k(spark):
    v = "vec_id long, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 2.0], None), (2, [1.0, 2.0], 1), (3, None, 1), (4, [], 1),
                                (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (None, [9.0, 9.0], 1), (8, [3e30, 1.0], 1),
                                (100, [-1.0, 0.5], 2), (200, [1.0, 1.0, 1.0], 2)], v)
    rows = topk.top_k(df, F.col("vec_id") % 100 == 0, k=3).collect()
    got = {q: [(r["rank"], r["vec_id"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100, 200)}
    assert got == {0: [(1, 8), (2, 1), (3, 2)], 100: [(1, 0), (2, 1), (3, 2)], 200: []}
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 1"), F.col("vec_id") % 100 == 0).count() == 0


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(1, words(60, 2), "x"), (None, "Alpha beta gamma delta.", "x"), (2, None, "x"), (3, "", "x"), (4, "one", "x"),
                                   (1, words(60, 2), "x")], "item_id long, text string, wh string")
    out = decontam.flags(odd, bench).collect()
    assert len(out) == odd.count()
    assert Counter(r["doc_id"] for r in out if r["contaminated"]) == Counter([7, 8, None, 9, 12])
    clean = decontam.remove_contaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 5
    assert decontam.flags(empty, bench).count() == 0
    assert decontam.remove_contaminated(odd, bench.where("false")).count() == odd.count()


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (2, "no host", ""), (3, "HTTP://A.Example.ORG/es/x?y", "<p>x"), (3, "HTTP://A.Example.ORG/es/x?y", "<p>x"),
         (None, "x://example.org", "z"), (5, "x://b.com/fr/" + "q" * 5000, None), (6, "a://b\nc/d\ne?f://g", "t")], "page_id long, url string, html string")
    rules = [url_filter.Rule("allow", "org/"), url_filter.Rule("block", "example.org/es/"), url_filter.Rule("allow", "com/fr/")]
    got = [(r["page_id"], r["host"], r["path"][:8], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "", "", None, "block"), (2, "", "", None, "block"), (3, "a.example.org", "/es/x", "example.org/es/", "block"),
        (3, "a.example.org", "/es/x", "example.org/es/", "block"), (None, "example.org", "", None, got[[g[0] for g in got].index(None)][4]),
        (5, "b.com", "/fr/qqqq", "com/fr/", "allow"), (6, "b\nc", "/d\ne", None, got[[g[0] for g in got].index(6)][4])], key=str)
    assert url_filter.judge(pages.where("false"), rules).count() == 0


def test_substrings(odd, empty):
    rows = substrings.remove_repeats(odd).collect()
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in rows}
    assert len(rows) == odd.count()
    assert got[(6, 30_000)] == 30_000 and got[(5, 30_000)] == 0
    assert got[(8, 60)] == got[(None, 60)] == 60 and got[(7, 60)] == 0 and got[(12, 105)] >= 60 and got[(1, 4)] == 0
    twice = substrings.remove_repeats(odd.unionByName(odd)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in twice) == Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in [*rows, *rows])
    assert substrings.remove_repeats(empty).count() == 0


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, "x"), (5, 0, "x"), (5, None, "x"), (7, 1, "x"), (7, 0, "x"), (None, 0, "x")],
                                   "doc_id long, quality int, text string")
    model = rule_ensemble.train(odd, labels)
    out = rule_ensemble.classify(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert rule_ensemble.keep_good(odd, model).columns == odd.columns
    again = rule_ensemble.train(odd.unionByName(odd).unionByName(odd), labels.unionByName(labels))
    assert (again.intercept, again.rules) == (model.intercept, model.rules)  # repeated rows count once
    none = rule_ensemble.train(odd, labels.where("false"))
    assert {r["score"] for r in rule_ensemble.classify(odd, none).collect()} == {0.5}
    assert rule_ensemble.classify(empty, model).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, empty, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    small = "/root/testdata/sf0.001"
    for start in (docs, docs.where("false")):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, small)
            path = f"{tmp_path}/{name}-{start is docs}"
            now.write.parquet(path)
            now = spark.read.parquet(path)
            if name != "shard":
                assert now.columns == docs.columns
    assert now.count() == 0
