"""The operators applied to their whole tables with production parameters, and
their DuckDB oracles where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import backtrack_bpe, conversation_repair, decontam, hilbert, mixing, rule_ensemble, secret_scan, simhash, spelling, substrings, token_files, topk, url_filter
from tesserae.llm.common import scratch, table

URL_RULES = (
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
)


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), corpus_pipeline.MIX_WEIGHTS, rest=corpus_pipeline.MIX_REST).select(
        "doc_id", "source", "copy", "n_copies", "shuffle_key", "text")


def op2_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    folder = scratch(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer, end_id=1)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=3, k=3, seed=42)


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, spans = secret_scan.scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    return secret_scan.digest(found, spans)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"), list(corpus_pipeline.SHARD_DIMENSIONS), shards=24, keep_rows=False)


def op6_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rule_ensemble.classify(docs, rule_ensemble.train(docs, labels))


def op11_backtrack_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    docs = table(spark, sf_dir, "documents")
    return backtrack_bpe.digest(backtrack_bpe.round_trip(docs, tokenizer, keep=["doc_id"]))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(table(spark, sf_dir, "documents"), typo_every=199))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(conversation_repair.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_poisson_mix, op2_token_files, op3_simhash, op4_secret_ownership, op5_hilbert_shards, op6_va_topk,
              op7_template_decontamination, op8_url_words, op9_substring_dedup, op10_rule_ensemble, op11_backtrack_bpe, op12_spelling_variants, op13_conversation_repair)
} | {"pipeline": corpus_pipeline.run}

_MIX_WEIGHTS = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in corpus_pipeline.MIX_WEIGHTS.items())
_MIX_LISTED = ", ".join(f"'{s}'" for s in corpus_pipeline.MIX_WEIGHTS)
_OP1 = f"""
WITH w(g, w) AS (VALUES {_MIX_WEIGHTS}, (NULL, {corpus_pipeline.MIX_REST!r}::DOUBLE)),
d AS (SELECT *, CASE WHEN source IN ({_MIX_LISTED}) THEN source END AS g FROM documents),
s AS (SELECT g, sum(coalesce(strlen(text), 0)) AS n FROM d GROUP BY g HAVING sum(coalesce(strlen(text), 0)) > 0),
r AS (SELECT s.g, w.w / sum(w.w) OVER () * sum(s.n) OVER () / s.n AS rate FROM s JOIN w ON s.g IS NOT DISTINCT FROM w.g),
p AS (SELECT g, k, sum(exp(-rate + CASE WHEN rate > 0 THEN k * ln(rate) ELSE 0 END - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS cdf
      FROM (SELECT g, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) AS k FROM r)),
u AS (SELECT doc_id, source, text, g, ('0x' || substr(md5('42:count:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM d),
c AS (SELECT doc_id, source, text, (SELECT count(*) FROM p WHERE p.g IS NOT DISTINCT FROM u.g AND p.cdf <= u.u)::INTEGER AS n_copies FROM u),
x AS (SELECT doc_id, source, text, n_copies, unnest(range(0, n_copies))::INTEGER AS copy FROM c WHERE n_copies > 0)
SELECT doc_id, source, copy, n_copies,
       substr(md5('42:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 16) AS shuffle_key, text FROM x
"""


def _secret_kind(k: secret_scan.Kind, rank: int) -> str:
    p = k.pattern.replace("'", "''")
    return f"SELECT rid, {rank} AS rank, '{k.name}' AS kind, {k.value} AS g, {k.least} AS least, '{p}' AS p, " \
           f"regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS gap FROM d"


_OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS owner, '=' || concat_ws('/', source, lang) AS repo,
                  coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_secret_kind(k, n) for n, k in enumerate(secret_scan.KINDS))}),
e AS (SELECT rid, rank, kind, g, least, m, gap, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
v AS (SELECT rid, rank, kind, least, m[i] AS hit,
             list_sum(list_transform(gap[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS e,
             CASE WHEN g = 2 THEN regexp_extract(m[i], '{secret_scan.KINDS[0].pattern.replace("'", "''")}', 2) ELSE m[i] END AS value FROM e),
s AS (SELECT v.rid, rank, kind, (e - length(hit))::BIGINT AS s, e::BIGINT AS e, (e - length(value))::BIGINT AS vs, value, owner, repo
      FROM v JOIN d USING (rid) WHERE length(value) >= least),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT owner || chr(1) || repo) AS repos FROM s GROUP BY value),
j AS (SELECT s.*, regexp_matches(lower(s.value), '[a-z]') AND regexp_matches(lower(s.value), '[0-9]')
             AND len(list_distinct(string_split(s.value, ''))) >= 6
             AND NOT regexp_matches(lower(s.value), '{'|'.join(secret_scan.PLACEHOLDERS)}') AND owners <= 1 AND repos <= 2 AS live
      FROM s JOIN o USING (value)),
a AS (SELECT rid, rank, kind, s, e, live, true AS base FROM j UNION ALL
      SELECT DISTINCT rid, 3, 'live', vs, e, true, false FROM j WHERE live),
b AS (SELECT rid, count(*) FILTER (base AND rank = 0) AS n_assign, count(*) FILTER (base AND rank = 1) AS n_access,
             count(*) FILTER (base AND rank = 2) AS n_hex, count(*) FILTER (base AND live) AS n_live, count(*) FILTER (base) AS n,
             coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (base), '') AS base_list,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM a GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_live, 0) AS n_live, coalesce(n - n_live, 0) AS n_example, sha256(coalesce(base_list, '')) AS base_sha256,
       coalesce(spans, '') AS spans FROM d LEFT JOIN b USING (rid)
"""

_OP6 = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.id % 100 = 0 AND c.id <> q.id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP9 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS did,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, did, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
h AS (SELECT p.rid, p.did, p.s, md5(array_to_string(d.w[p.s:p.s + 19], ' ')) AS h FROM p JOIN d USING (rid)),
m AS (SELECT h, min((did, s)) AS first FROM h GROUP BY h HAVING count(*) > 1),
x AS (SELECT DISTINCT rid, unnest(range(s, s + 20)) AS i FROM h JOIN m USING (h) WHERE (did, s) > first),
g AS (SELECT rid, list(i) AS gone FROM x GROUP BY rid),
k AS (SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS r, w, gone, rid FROM d LEFT JOIN g USING (rid)),
e AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM k),
t AS (SELECT e.rid, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN x USING (rid, i) GROUP BY e.rid)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN t USING (rid)
"""

ORACLES: dict[str, str] = {
    "op1_poisson_mix": _OP1, "op4_secret_ownership": _OP4, "op6_va_topk": _OP6, "op9_substring_dedup": _OP9,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
