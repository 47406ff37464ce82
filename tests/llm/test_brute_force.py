"""Operators against brute force, exact round trips and held-out labels."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tesserae.llm import decontam, hilbert, mixing, queries, rule_ensemble, simhash, substrings, token_files, topk, url_filter
from tesserae.llm import words as W
from tesserae.llm.common import bitmap, in_bitmap, scratch, table
from tesserae.llm.components import components
from tesserae.plans.check import canon, duck
from tests.llm.conftest import SMALL, words

TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(SMALL).execute(queries.ORACLES[name])
    assert got == canon([c[0] for c in cur.description], cur.fetchall())


def test_token_query_and_selective_reads(spark, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    tok, start = Tokenizer.from_file(TOKENIZER), 0
    got = {r["doc_id"]: r for r in queries.op2_token_files(spark, SMALL).collect()}
    assert len(got) == len(texts)
    for i in sorted(texts):
        ids = np.array(tok.encode(texts[i], add_special_tokens=False).ids + [1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder = scratch(spark, "t")
    token_files.write_token_files(documents, folder, TOKENIZER)
    some = token_files.read_token_files(spark, folder, 50, 59, with_ids=True).collect()
    assert sorted(r["doc_id"] for r in some) == [i for i in sorted(texts) if 50 <= i <= 59]
    assert all(list(r["ids"]) == tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1] for r in some)


def test_frames_are_read_by_many_tasks(spark, tmp_path, documents):
    folder = f"file://{tmp_path}/tok"
    token_files.write_token_files(documents.repartitionByRange(64, "doc_id"), folder, TOKENIZER)
    n = token_files.frames(spark, folder).agg(F.count("*"), F.sum("size")).first()
    rows = token_files.read_token_files(spark, folder, task_bytes=n[1] // 8)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and rows.rdd.getNumPartitions() in (8, 9)
    assert token_files.read_token_files(spark, folder).rdd.getNumPartitions() == 1  # less than TASK_BYTES in all
    assert rows.count() == documents.count()


def test_token_frames_are_plain_zstandard_with_checked_content(spark, documents, tmp_path):
    import zstandard
    folder = f"file://{tmp_path}/tok"
    token_files.write_token_files(documents.repartition(2), folder, TOKENIZER)
    frame = token_files.frames(spark, folder).first()
    where, path = token_files.fs.FileSystem.from_uri(frame["path"])
    with open(path, "rb") as f:
        whole = f.read()
    assert zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=False).read()
    bad = bytearray(whole)
    bad[frame["offset"] + frame["size"] // 2] ^= 255
    with open(path, "wb") as f:
        f.write(bad)
    with pytest.raises(Exception):
        token_files.read_frame(where, path, frame["offset"], frame["size"], frame["checksum"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b.", "'s", "T,", " ", "é", "\u0301", "\t", "\n", "\u3000", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "$", "À", "Σ.", "ς", "\x1c", ".", ",", "Re"]), max_size=40).map("".join), max_size=4))
def test_pieces_give_the_ids_of_the_whole(texts):
    tok = Tokenizer.from_file(TOKENIZER)
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert token_files.encode(texts, TOKENIZER) == want


def test_every_letter_before_a_closing_mark():
    tok = Tokenizer.from_file(TOKENIZER)
    texts = [f"BELED\u0130YES\u0130{m} x\u09df{m} \ufb1d{m} \u0958{m}" for m in ".,"]
    texts += [f"{before}{chr(c)}{m}" for c in range(128, 0x110000) if chr(c).isalpha() for before, m in (("", "."), ("e", ","))]
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    got = token_files.encode(texts, TOKENIZER)
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_words_of_letters_go_to_the_tokenizer_many_at_once(monkeypatch):
    names = ["".join(x) for x in itertools.product("aäBçß", "eÉnt", "rsñx", "abcd")]
    texts = [" ".join(names[k::7]) + tail for k, tail in enumerate(["", ".", " x1 Ωmega", "\t'tis", "\r\nd'or,", "\x0bª", "\x0c!"])] + ["", " \t\n", "\x1c"]
    tok, sent = Tokenizer.from_file(TOKENIZER), []
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    known = token_files._Pieces(TOKENIZER)
    known.texts = lambda texts: (sent.extend(texts), token_files._Pieces.texts(known, texts))[1]
    monkeypatch.setitem(token_files._known, TOKENIZER, known)
    assert token_files.encode(texts, TOKENIZER) == want and len(sent) < len(names) // 4
    monkeypatch.setattr(token_files, "CACHE_PIECES", 50)  # starts afresh, again and again
    monkeypatch.setattr(token_files, "TEXT_BYTES", 300)
    assert token_files.encode(texts, TOKENIZER) == want
    known.clear()
    known.ends[:] = False  # no id is seen to end a word: each goes alone
    assert token_files.encode(texts, TOKENIZER) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from([b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x85", b"\xff", b"\xc3\xa9", b"a", b"b."]), max_size=20).map(b"".join), max_size=6), st.integers(0, 2))
def test_coded_words_are_the_flat_ones(texts, cut):
    column = pa.array([b"x y", b" z"][:cut] + texts, pa.binary()).slice(cut)
    distinct, codes, counts = W.coded(column)
    said = distinct.view(pa.binary()).to_pylist()
    flat, many = W.flat(texts)
    assert [said[k] for k in codes] == flat and counts.tolist() == many.tolist() and len(set(said)) == len(said)


def test_runs_of_rows():
    assert list(W.runs(np.array([3, 0, 4, 9, 0, 1]), 7)) == [(0, 3), (3, 4), (4, 6)]
    assert list(W.runs(np.array([], np.int64), 7)) == [] and list(W.runs(np.zeros(3, np.int64), 7)) == [(0, 3)]


def _fingerprint(text):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    sh = [b" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else ([b" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query(spark, documents):
    rows = documents.collect()
    fp = {r["doc_id"]: _fingerprint(r["text"]) for r in rows}
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_simhash_never_broadcasts_keys(spark):
    p = _plan(simhash.links(spark.range(9).select(F.col("id").alias("fp"))))  # Spark sees a table that is small enough
    assert "SortMergeJoin" in p and "Broadcast" not in p



@pytest.mark.parametrize("distance", [1, 2, 3, 4, 5])
def test_links_miss_no_pair(spark, distance):
    r = np.random.default_rng(distance)
    base = r.integers(0, 1 << 63, 20, dtype=np.int64)
    fps = list({int(x) ^ int(sum(1 << int(b) for b in r.choice(63, r.integers(0, 6), replace=False))) for x in base for _ in range(30)})
    fps += [-x for x in fps[:50]]
    want = {(min(a, b), max(a, b)) for k, a in enumerate(fps) for b in fps[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance and a != b}
    got = simhash.links(spark.createDataFrame([(x,) for x in set(fps)], "fp long"), distance).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_pipeline_broadcasts_no_keys_or_windows(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(simhash, "components", lambda df: seen.append(_plan(df)) or components(df))
    corpus_pipeline.near_duplicates(spark, documents, SMALL)
    assert len(seen) == 1 and "SortMergeJoin" in seen[0] and "Broadcast" not in seen[0]
    p = _plan(decontam.contaminated(documents, table(spark, SMALL, "benchmark")))
    assert re.search(r"SortMergeJoin \[[^\]]*doc_id#[^\]]*wh#", p)  # the documents' windows, small as their files are


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (300, 300), (None, 5), (7, 7)] + [(1000, k) for k in range(1001, 1300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100, 1000: 1000, **{k: 1000 for k in range(1001, 1300)}}


def test_the_root_of_a_star_is_split(spark, monkeypatch):
    """A star of 300,000 leaves: the joins of its edges to the smallest neighbours split the root."""
    from tesserae.llm import components as module
    from tesserae.plans.report import final_plan
    plans = []

    def watched(df, name, keep=module.saved):
        if name == "large":
            plans.append(final_plan(df).split("== Initial Plan ==")[0])
        return keep(df, name)

    monkeypatch.setattr(module, "saved", watched)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = components(spark.range(1, 300_001).selectExpr("id as a", "0L as b"))
        assert got.where("root = 0").count() == 300_001
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert plans and all("SortMergeJoin(skew=true)" in p for p in plans), plans[0]


def test_mixing_reaches_the_weights(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = mixing.mix(docs, {"src0": 0.5, "src1": 0.1}, rest=0.4)
    size = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(F.octet_length("text"))).collect()}
    total = sum(size.values())
    assert abs(size["src0"] / total - 0.5) < 0.06 and abs(size["src1"] / total - 0.1) < 0.04
    keys = [r[0] for r in out.select("shuffle_key").collect()]
    assert len(set(keys)) == len(keys)
    assert sorted(map(tuple, out.select("doc_id", "copy").collect())) == sorted(
        map(tuple, mixing.mix(docs.repartition(7), {"src0": 0.5, "src1": 0.1}, rest=0.4).select("doc_id", "copy").collect()))


@pytest.mark.parametrize("mean", [0.0, 0.3, 4.0, 900.0, 1e6])
def test_poisson_cdf(spark, mean):
    r = mixing.poisson_bands(spark.createDataFrame([(None, mean)], "__g string, rate double")).first()
    first, cdf = r["__first"], r["__cdf"]
    want = np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean else 1.0 for k in range(first, first + len(cdf))])
    assert np.allclose(cdf, want, atol=1e-9) and cdf[-1] > 1 - 1e-9 and len(cdf) < 100 + 25 * math.sqrt(mean)
    if first:
        assert cdf[0] < 1e-25


def test_a_tiny_source_is_repeated_very_often(spark):
    """Rates of a million are drawn and exploded in bounded arrays."""
    docs = spark.createDataFrame([(1, "x", "tiny")] + [(k, "y" * 100_000, "big") for k in range(2, 22)], "doc_id long, text string, source string")
    out = mixing.mix(docs, {"tiny": 0.5, "big": 0.5}).where("source = 'tiny'")
    r = out.agg(F.count("*"), F.countDistinct("copy"), F.max("copy"), F.max("n_copies"), F.max("rate")).first()
    assert r[0] == r[1] == r[2] + 1 == r[3] and abs(r[3] - 1e6) < 6000 and abs(r[4] - 1e6) < 1


def test_hilbert_curve_is_a_continuous_bijection():
    for dims, bits in ((2, 3), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = hilbert.hilbert_index(grid, bits)
        assert sorted(order) == list(range(len(grid)))
        path = grid[np.argsort(order)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shard_query(spark, documents, tmp_path):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    rows = queries.op5_hilbert_shards(spark, SMALL).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    per = Counter(r["shard"] for r in rows)
    assert set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 1
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(24) for k in range(per[s])]
    out = hilbert.shard(documents, list(corpus_pipeline.SHARD_DIMENSIONS))
    hilbert.write_shards(out, f"{tmp_path}/shards")
    span = hilbert.spans(out, ["n_chars"])
    low = sorted(len(t) for t in texts.values())[10]
    read = hilbert.read_where(spark, f"{tmp_path}/shards", span, "n_chars", 0, low)
    assert sorted(r[0] for r in read.select("doc_id").collect()) == sorted(
        r[0] for r in documents.where(F.col("n_chars").between(0, low)).select("doc_id").collect())
    assert span.where(F.col("min_n_chars") <= low).count() < 24  # some shards are skipped


def test_shards_follow_the_curve_and_prune_on_every_dimension(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = hilbert.shard(docs, list(corpus_pipeline.SHARD_DIMENSIONS))
    rows = out.select("doc_id", "shard", "slot", "source", "lang", "n_chars").collect()
    span = hilbert.spans(out, ["source", "lang", "n_chars"]).collect()
    for c in ("source", "lang", "n_chars"):
        values = sorted({r[c] for r in rows if r[c] is not None})
        share = [sum(s[f"min_{c}"] <= v <= s[f"max_{c}"] for s in span) / len(span) for v in values]
        assert sum(share) / len(share) < (0.7 if c == "lang" else 0.6), (c, share)  # of all shards, a reader of one value lists these
    # brute force: cells from exact counts of ordered values, the curve index from its own definition
    def cells(c, n=16):
        vs = [r[c] for r in rows if r[c] is not None]
        count, before, cell = Counter(vs), 0, {}
        for v in sorted(count):
            cell[v] = min(n - 1, int((before + count[v] / 2) * n // len(vs)))
            before += count[v]
        order = {x: k for k, x in enumerate(sorted(set(cell.values())))}
        return {v: order[x] * n // len(order) for v, x in cell.items()}
    source, lang = cells("source"), cells("lang")
    cuts = docs.agg(F.percentile_approx(F.col("n_chars").cast("double"), [k / 16 for k in range(1, 16)], 10_000)).first()[0]
    cuts = sorted(set(cuts))
    axes = np.array([[source.get(r["source"], 0), lang.get(r["lang"], 0), sum(r["n_chars"] >= x for x in cuts) * 16 // (len(cuts) + 1)] for r in rows])
    index = hilbert.hilbert_index(axes, 4)
    by_place = [int(i) for _, i in sorted(zip([(r["shard"], r["slot"]) for r in rows], index))]
    assert by_place == sorted(by_place)


def test_top_k_blocks(spark):
    df = table(spark, SMALL, "embeddings")
    want = sorted(map(tuple, queries.op6_va_topk(spark, SMALL).collect()))
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, block_rows=60, block_queries=2)
    assert sorted(map(tuple, got.collect())) == want


def test_few_exact_vectors_are_read(spark, monkeypatch):
    """Of all (query, vector) pairs the cells leave a small share in question; the rest are never read exactly."""
    df, read = table(spark, "/root/testdata/sf0.1", "embeddings"), []
    scores = topk._scores
    monkeypatch.setattr(topk, "_scores", lambda pairs, rows: read.append(pairs) or scores(pairs, rows))
    rows = topk.top_k(df, F.col("vec_id") % 100 == 0).count()
    n = df.count()
    assert rows == 10 * -(-n // 100) and len(read) == 2
    exact = sum(p.count() for p in read)
    assert rows <= exact < 0.02 * n * (n / 100), exact / (n * n / 100)


def test_top_k_of_odd_vectors(spark):
    """Ranges near the ends of 64 bits, ties everywhere, ids repeated over many rows and blocks, lengths mixed."""
    r = random.Random(1)
    rows = [(k % 70, [float(r.choice((-2, -1, 0, 1, 2))) for _ in range(4)]) for k in range(300)]
    rows += [(100 + k, [r.choice((1e300, -1e300, 5e15, -3.0, 0.0)) for _ in range(3)]) for k in range(40)]
    rows += [(200 + k, [r.uniform(-1, 1) * 10 ** r.randrange(0, 14) for _ in range(5)]) for k in range(60)] + [(7, [0.5] * 2)] * 500
    clamp = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    ints = {}
    for i, v in rows:
        w = [clamp(math.floor(x * 1024)) for x in v]
        ints[i] = min(ints.get(i, w), w)
    want = set()
    for q in ints:
        if q % 10 == 0:
            best = sorted((-clamp(sum(a * b for a, b in zip(ints[q], v))), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:4]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for blocks in ((65_536, 1024), (20, 3)):
        got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=4, block_rows=blocks[0], block_queries=blocks[1])
        assert {tuple(x) for x in got.collect()} == want


def _contains(text, item):
    return f" {' '.join(item.split())} " in f" {' '.join(text.split())} "


def test_decontamination_query(spark, documents):
    items = [r["text"] for r in table(spark, SMALL, "benchmark").collect()]
    exact = {r["doc_id"] for r in documents.collect() if any(_contains(r["text"], t) for t in items)}
    got = {r["doc_id"]: r for r in queries.op7_template_decontamination(spark, SMALL).collect()}
    assert len(got) == documents.count() and exact <= {i for i, r in got.items() if r["contaminated"]}
    # brute force over plain words: whatever is flagged shares most 5-word windows of an item
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}

    def grams(t):
        ws = [re.sub(r"^\W+|\W+$", "", w).lower() for w in t.split()]
        return {tuple(ws[k:k + 5]) for k in range(len(ws) - 4)}
    for i in (i for i, r in got.items() if r["contaminated"]):
        assert max(len(grams(t) & grams(texts[i])) / len(grams(t)) for t in items) >= 0.7


def _template(text):
    """(core, options) of each word: what it may stand for, by the rules of the docstrings."""
    out, ws = [], text.split()
    for k, w in enumerate(ws):
        core = re.sub(r"^\W+|\W+$", "", w) or w
        number = lambda x: re.fullmatch(r"[$€£+-]?\d[\d.,:/]*%?", x.strip(".,;:!?()[]\"'")) is not None
        if number(w):
            options = ["<number>"]
        elif core.lower() in decontam.UNITS:
            options = ["<unit>"] if k and number(ws[k - 1]) else [core.lower()]
        elif core[:1].isupper():
            begins = k == 0 or ws[k - 1][-1] in ".!?:;" or ws[k - 1][-2:-1] in (".", "!", "?")
            options = ["<name>", core.lower()] if begins else ["<name>"]
        else:
            options = [core.lower()]
        out.append((core.lower(), options))
    return out


def _template_windows(text):
    """[{key: slots}] of the five-word windows at each place, in all readings."""
    t, out = _template(text), []
    for k in range(len(t) - 4):
        here, some = t[k:k + 5], {}
        for read in itertools.product(*[o for _, o in here]):
            held = tuple(c if x.startswith("<") and x != c else "" for (c, _), x in zip(here, read))
            if all(held):
                some[("words", *[c for c, _ in here])] = ()
            else:
                some[read] = held
        out.append(some)
    return out


def test_a_word_is_judged_once_for_all_its_places(monkeypatch):
    seen, judge = [], decontam._word
    monkeypatch.setattr(decontam, "_word", lambda w: (seen.append(w), judge(w))[1])
    monkeypatch.setattr(decontam, "_known", decontam._Words())
    texts = ["Ann has 3 km, Bob 4.", None, "", "  ann_ has (3) _km \u0663 x\u0301. \u2167% 5% \u20ac7", "Ann Bob: has\x1c3\x0b4"] * 20
    column = pa.array(texts).cast(pa.binary())

    def said():
        parts = list(decontam._templates(column))
        return [np.concatenate([getattr(t, k) for _, t in parts]).tolist() for k in ("core", "kind", "opener", "counts")], [at for at, _ in parts]
    whole, first = said()
    assert len(seen) == len(set(seen)) and first == [0]
    flat = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert len(whole[0]) == len(flat) and whole[3] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    cores = [re.sub(r"^\W+|\W+$", "", w) or w for w in flat]
    assert whole[0] == [xxhash.xxh64_intdigest(c.lower()) for c in cores]
    number = [re.fullmatch(r"[$€£+-]?\d[\d.,:/]*%?", w.strip(".,;:!?()[]\"'")) is not None for w in flat]
    assert [k == decontam._NUM for k in whole[1]] == number
    monkeypatch.setattr(decontam, "TEXT_BYTES", 90)
    monkeypatch.setattr(decontam, "AT_ONCE", 7)
    monkeypatch.setattr(decontam, "CACHE_WORDS", 9)  # starts afresh, again and again
    parts, first = said()
    assert parts == whole and len(first) > 20


def test_decontamination_between_two_bounds(spark, documents):
    """Brute force over all documents, items, shifts and passages: what holds an item at one shift, with
    consistent slots, is flagged; what is flagged has enough windows of the item in one passage, each at a place of its own."""
    sf = SMALL
    items = {r["item_id"]: _template_windows(r["text"]) for r in table(spark, sf, "benchmark").collect() if len(r["text"].split()) >= 5}
    r, extra = random.Random(11), {}
    for k, row in enumerate(table(spark, sf, "benchmark").collect()):  # copies with numbers, words and whole stretches changed
        ws = row["text"].split()
        for p in (0.02, 0.05, 0.1):
            extra[-(10 * k + int(100 * p) + 1)] = " ".join(w if r.random() > p else f"other{r.randrange(99)}" for w in ws)
    docs = {d["doc_id"]: d["text"] or "" for d in documents.collect()} | extra
    must, may = set(), set()
    for i, text in docs.items():
        windows = _template_windows(text)
        for item, wanted in items.items():
            need = math.ceil(0.8 * len(wanted) - 1e-9)
            at = defaultdict(list)
            for q, some in enumerate(wanted):
                for key in some:
                    at[key].append(q)
            met = defaultdict(set)  # place in the document: item windows met there
            for p, some in enumerate(windows):
                for key in some:
                    if key in at:
                        met[p].update(at[key])
            if len({q for qs in met.values() for q in qs}) < need:
                continue
            shifts = Counter(p - q for p, qs in met.items() for q in qs)
            for shift, n in shifts.items():
                if n >= need:
                    slots = Counter()
                    for p, qs in met.items():
                        if p - shift in qs:
                            key = next(key for key in windows[p] if key in wanted[p - shift])
                            slots.update((x, y) for x, y in zip(wanted[p - shift][key], windows[p][key]) if x and y)
                    left, right = Counter(x for x, _ in slots), Counter(y for _, y in slots)
                    sure = sum(c for (x, y), c in slots.items() if left[x] == right[y] == 1)
                    if sure >= 0.8 * sum(slots.values()):
                        must.add(i)
            length = 2 * max(len(wanted), 100)
            for begin in met:
                inside = {p: qs for p, qs in met.items() if begin <= p < begin + length}
                if len({q for qs in inside.values() for q in qs}) >= need and len(inside) >= need:
                    may.add(i)
    df = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    got = {x["doc_id"] for x in decontam.flags(df, table(spark, sf, "benchmark")).collect() if x["contaminated"]}
    assert must <= got <= may and len(must) > 20 and len(may - must) < 0.2 * len(may)


def test_reparameterised_questions(spark):
    item = "A train leaves Paris at 60 km per hour and then meets Alice after 3 hours, so how far has the train gone when Alice waves at 60 trees"
    same = item.replace("60", "75").replace("Alice", "Bob").replace("Paris", "Rome").replace("km", "miles")
    broken = ("A train leaves Paris at 75 km per hour and then meets Bob after 3 hours, "
              "so how far has the train gone when Carol waves at 12 trees")
    docs = spark.createDataFrame([(1, f"so it goes. {item} and more"), (2, f"Intro words here. {same}. The end."), (3, f"Once more. {broken}"),
                                  (4, words(200, 9))], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontam.flags(docs, bench).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_verbatim_copies_with_recurring_windows(spark):
    items = ["Sort the numbers 41 17 93 28 65 52 39 74 from smallest to largest.", "Seat at one table Tom Anna Lena Kate Paul Jim Ben Sue Max and Eve tonight",
             "5 5 7 9 5 7 7 3 5 9 1 5"]
    docs = [(k, f"{words(k, k)}. {items[k % 3]} {words(9, k)}") for k in range(9)]
    docs += [(20, f"8 2 {items[2]} 4 4 6"), (21, "5 5 7 9 5 1 2 3 4 6 8 9")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["overlap"], r["consistency"]) for r in got} == {(k, k % 3): (1.0, 1.0) for k in range(9)} | {(20, 2): (1.0, 1.0)}


def test_number_tables_are_no_copies(spark):
    """Windows of placeholders alone count by their words: tables of other numbers are clean, copies are not."""
    import time
    r = random.Random(4)
    nums = lambda n, top=100: " ".join(str(r.randrange(top)) for _ in range(n))
    listed = nums(40)
    items = {1: f"Sort {nums(12)} now", 2: listed, 3: "Seat Tom Anna Lena Kate Paul Jim Ben Sue Max and Eve"}
    docs = {1: f"prices {nums(40, 1000)} end", 2: f"{words(9, 1)} {listed} {words(9, 2)}", 3: nums(100_000), 4: f"so {items[1]}",
            5: "Meet Ann Rob Tim Zoe Liz Ron Pam Guy Ted and Ivy", 6: " ".join(["7"] * 50_000), 7: f"{nums(200)} {items[1]} {nums(200)}"}
    t = time.perf_counter()
    got = decontam.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
                                spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(2, 2), (4, 1), (7, 1)} and time.perf_counter() - t < 150


def test_recall_of_reparameterised_items(spark):
    """Numbers and names of generated questions are replaced one to one, and the question is put into other text."""
    r = random.Random(6)
    names, others = [f"{a}{b}" for a in ("An", "Be", "Ka", "Lo") for b in ("na", "rt", "lo", "mi")], [f"{a}{b}" for a in ("Ti", "Zo", "Ru") for b in ("da", "lf", "ne", "xo", "ki", "gu")]
    items, docs, want = [], [], set()
    for k in range(60):
        parts = []
        for _ in range(r.randrange(4, 8)):
            parts.append(f"{words(r.randrange(3, 7), r.randrange(10**6), 3000)} {r.choice(names)} {words(r.randrange(2, 5), r.randrange(10**6), 3000)} {r.randrange(10, 99)}")
        item = ", then ".join(parts) + "?"
        swap = dict(zip(names, r.sample(others, len(names)))) | {str(n): str(n + 137) for n in range(10, 99)}
        new = " ".join(swap.get(w.strip(",?"), w.strip(",?")) + w[len(w.rstrip(",?")):] for w in item.split())
        items.append((k, item))
        docs += [(2 * k, f"{words(30, k)} {new} {words(20, k + 1)}"), (2 * k + 1, f"{words(60, k + 7, 3000)} {r.choice(names)} {r.randrange(99)}")]
        want.add((2 * k, k))
        assert new != item
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_copies_with_words_put_in(spark):
    item = words(57, 77, 5000).split()
    docs = [(100 * more + at, f"{words(at, 5)} {' '.join(item[:28])} {words(more, 6)} {' '.join(item[28:])} {words(12, 8)}")
            for more in (0, 6, 9, 10, 30, 55, 90) for at in range(11)]
    docs += [(-1, " ".join(item[:40])), (-2, f"{' '.join(item[:28])} {words(400, 9)} {' '.join(item[28:])}")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["overlap"] for r in got} == {i: 1.0 if i < 100 else 49 / 53 for i, _ in docs if i >= 0}


def test_names_that_open_a_sentence(spark):
    item = "Tom has 5 red apples. Anna gives him 3 more apples today. Lena then takes 2 of them away. How many apples are left?"
    other = item.replace("Tom", "Bert").replace("Anna", "Mia").replace("Lena", "Paula")
    mixed = item.replace("Tom", "Bert").replace("Anna", "Bert").replace("Lena", "Bert").replace("How", "Bert")
    short = "Name the three longest rivers of Asia"
    tiny = ["Who wrote Hamlet?", "42 km", "Paris"]
    docs = [(1, f"{words(20, 3)}. {other} {words(9, 4)}"), (2, f"{words(9, 5)} {other}"), (3, f"A heading\n{short}\n{words(9, 6)}"),
            (4, f"A quiz. {tiny[0]} {words(9, 7)}"), (5, f"They asked Who wrote Macbeth {words(5, 8)}"), (6, f"Anna wrote Hamlet. {words(9, 9)}"),
            (7, f"{words(6, 1)} 42 km {words(3, 2)}"), (8, f"{words(6, 1)} 17 km {words(3, 2)}"), (9, "17 km"), (10, f"{words(7, 1)} in Paris."),
            (11, f"{words(7, 1)} in Rome."), (12, mixed)]
    bench = [(1, item), (2, short), *((3 + k, t) for k, t in enumerate(tiny))]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [
        (1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (7, 4), (9, 4), (10, 5)]


def test_shared_phrases_make_no_pairs(spark):
    phrase = words(30, 5, 500)
    bench = spark.createDataFrame([(k, f"{phrase} {words(20, 100 + k, 5000)}") for k in range(200)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{words(10, k)} {phrase}") for k in range(300)], "doc_id long, text string")
    assert decontam.contaminated(docs, bench).count() == 0


def test_url_words():
    s = url_filter.Segmenter({"cheap": 50, "pills": 40, "free": 30, "bets": 20, "online": 60, "on": 90, "line": 40})
    assert s.split("cheappillsonline") == ["cheap", "pills", "online"] and s.split("freebets") == ["free", "bets"] and s.split("") == []

    def best(name):
        if not name:
            return 0.0
        return max(s.cost(name[:k]) + best(name[k:]) for k in range(1, len(name) + 1))
    for name in ("onlinebets", "zzcheapq", "freeonline"):
        assert math.isclose(sum(map(s.cost, s.split(name))), best(name))


def test_rare_words_split_hosts_in_large_vocabularies(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = [f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:4]]  # 70,304, once each
    pages = spark.createDataFrame([(1, "http://zebralamp.com/x/kettlespoon7", "zebra lamp kettle spoon " + " ".join(rare))], "page_id long, url string, html string")
    got = url_filter.judge(pages, [url_filter.Rule("allow", "com/")]).first()
    assert got["words"].split()[:2] == ["h:zebra", "h:lamp"] and got["words"].split()[-3:] == ["p:kettle", "p:spoon", "p:0"]


def test_url_query(spark):
    rows = queries.op8_url_words(spark, "/root/testdata/sf0.01").collect()
    urls = {r["page_id"]: r["url"] for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    rules = {r.text: r.verdict for r in queries.URL_RULES}
    model, seen = defaultdict(Counter), Counter()
    for r in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r["page_id"]])
        host, path = m[1].lower(), m[2]
        fit = [t for t in rules if (host + "/" == t.partition("/")[0] + "/" or host.endswith("." + t.partition("/")[0]))
               and path.startswith("/" + t.partition("/")[2])]
        rule = max(fit, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (rules[rule] if rule else "block" if r["odds"] > 0 else "allow")
        if rule:
            model[rules[rule]].update(r["words"].split())
            seen[rules[rule]] += 1
    for w, n in url_filter.SEEDS.items():
        model["block"][f"h:{w}"] += n
    v = len(set(model["block"]) | set(model["allow"])) + 1
    nb, na = sum(model["block"].values()), sum(model["allow"].values())
    for r in rows:
        odds = math.log((seen["block"] + 1) / (seen["allow"] + 1)) + sum(
            math.log((model["block"][t] + 1) / (nb + v)) - math.log((model["allow"][t] + 1) / (na + v)) for t in r["words"].split())
        assert math.isclose(odds, r["odds"], abs_tol=1e-9)


def test_split_is_the_best_of_all(spark):
    """Exhaustive over all splits of short names; found words and own counts mixed."""
    r = random.Random(2)
    for _ in range(60):
        counts = {"".join(r.choice("ab") for _ in range(r.randrange(1, 5))): r.randrange(1, 30) for _ in range(6)}
        name = "".join(r.choice("abc") for _ in range(r.randrange(0, 10)))
        whole = url_filter.Segmenter(counts)
        own = dict(list(counts.items())[:3])
        found = [(i, w, n) for w, n in counts.items() if w not in own for i in range(len(name)) if name.startswith(w, i)]
        got = url_filter.Segmenter(own, whole.total).split(name, found)
        ways = [[]] if not name else [[name[i:j] for i, j in zip((0, *c), (*c, len(name)))] for k in range(len(name)) for c in itertools.combinations(range(1, len(name)), k)]
        assert "".join(got) == name and math.isclose(sum(map(whole.cost, got)), max(sum(map(whole.cost, w)) for w in ways), abs_tol=1e-9)


def test_model_verdicts_on_held_out_pages(spark):
    """Pages that rules decide, a fifth of them kept from the model: it has to give the rules' verdicts."""
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0
    rows = url_filter.judge(pages, queries.URL_RULES, learn=~held).join(pages.select("page_id", held.alias("held")), "page_id").where(
        "held and rule is not null").select("verdict", "odds").collect()
    right = sum((r["odds"] > 0) == (r["verdict"] == "block") for r in rows)
    assert len(rows) > 100 and right / len(rows) >= 0.9


def test_long_labels_and_words(spark):
    """A path of 200,000 random letters, a word of 30,000, and one url in most rows."""
    r = random.Random(8)
    long, word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "".join(r.choice("xyz") for _ in range(30_000))
    rows = [(1, f"http://zebralamp.com/{long}", f"zebra lamp {word} " + " ".join(long[k:k + 5] for k in range(0, 5000, 5))),
            (2, f"http://lamp{word}.net/a", "x")] + [(k, None, "zebra") for k in range(3, 3000)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), []).collect()}
    assert len(got) == 2999 and got[2]["words"].split()[:2] == ["h:lamp", f"h:{word}"]
    assert "".join(w[2:] for w in got[1]["words"].split() if w.startswith("p:")) == long and got[1]["words"].startswith("h:zebra h:lamp h:com p:")
    assert {got[k]["words"] for k in range(3, 3000)} == {""}


@pytest.mark.parametrize("sketch", [18, 19])
def test_substrings_of_few_words(spark, sketch):
    """A vocabulary so small that windows repeat within and across documents."""
    texts = [(i, words(90, i // 3, 2) + " " + words(40, i % 7, 3)) for i in range(40)] + [(99, "a " * 70)]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"),
                                                             max_sketch_bits=sketch).collect()}
    seen = set()
    for i, t in sorted(texts):
        ws, gone = t.split(), set()
        for k in range(len(ws) - 19):
            w = tuple(ws[k:k + 20])
            if w in seen:
                gone.update(range(k, k + 20))
            seen.add(w)
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert bytes(got[i]["kept"]).decode() == kept


def test_substrings_of_long_passages(spark, monkeypatch):
    """Passages repeated whole, cut at either end, in an equal place and within a text: stretches of windows, not
    single windows, are kept for the exact pass, and only a stretch's first place gives up its windows."""
    rows = {}

    def counted(df, name, real=substrings.saved):
        out = real(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(substrings, "saved", counted)
    r = random.Random(11)
    said = [f"w{r.randrange(50_000)}" for _ in range(300)]
    texts = [(None, " ".join(said[5:120])), (7, " ".join(said[:60])), (7, " ".join(said[:60] + ["end"])), (5, " ".join(said[250:300] * 2))]
    for i in range(10, 50):
        a, b = r.randrange(140), r.randrange(160, 300)
        texts.append((i, " ".join([f"x{i}", f"y{i}", *said[a:b], f"z{i}"])))
    got = {(r["doc_id"], r["n_words"]): r for r in substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    order, first = [((math.inf if i is None else i), t.split()) for i, t in texts], {}
    for i, ws in order:
        for k in range(len(ws) - 19):
            w = tuple(ws[k:k + 20])
            first[w] = min(first.get(w, (math.inf, math.inf)), (i, k))
    for (i, ws), (doc_id, _) in zip(order, texts, strict=True):
        gone = {j for k in range(len(ws) - 19) if (i, k) > first[tuple(ws[k:k + 20])] for j in range(k, k + 20)}
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        assert (got[doc_id, len(ws)]["n_removed"], got[doc_id, len(ws)]["kept_sha256"]) == (len(gone), hashlib.sha256(kept.encode()).hexdigest())
    repeated = sum(len(ws) - 19 for _, ws in order)
    assert 0 < rows["windows"] < repeated / 4 and 0 < rows["stretches"] < rows["windows"] / 2


def test_bitmaps_grow_with_their_members():
    assert [substrings.map_bits(n) for n in (0, 10**6, 2**21, 2**22, 10**8, 10**12)] == [24, 24, 25, 26, 28, 28]


def test_bitmap(spark):
    df = spark.createDataFrame([(x,) for x in (-1, 0, 5, 2**62, -(2**63))], "h long")
    data = bitmap(df, "h", 10)
    assert len(data) == 128
    assert [r[0] for r in df.select(in_bitmap(spark, data, F.col("h"))).collect()] == [True] * 5
    assert spark.range(1).select(in_bitmap(spark, data, F.lit(77).cast("long"))).first()[0] is False


def test_bitmap_of_many_blocks(spark):
    h = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 4000, dtype=np.int64)
    df = spark.createDataFrame([(int(x),) for x in h], "h long")
    for bits in (6, 12, 18, 21):
        want = np.zeros(1 << bits, np.uint8)
        want[h & ((1 << bits) - 1)] = 1
        assert bytes(bitmap(df, "h", bits)) == np.packbits(want, bitorder="little").tobytes()
    assert not any(bitmap(df.limit(0), "h", 12))


def test_a_full_bitmap_takes_little_more_than_itself_on_the_driver(spark):
    df = spark.range(1 << 18).select((F.col("id") * 64).alias("h"))  # a bit in each word of 64
    tracemalloc.start()
    data = bitmap(df, "h", 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) == 1 << 21 and peak < 4 << 21


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    rows = [r for r in queries.op10_rule_ensemble(spark, sf).collect()]
    assert len(rows) == table(spark, sf, "documents").count()
    test = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in test]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_rules_compile_to_the_same_scores(spark, documents):
    labels = table(spark, SMALL, "labels")
    model = rule_ensemble.train(documents, labels)
    assert model.rules and all(1 <= len(r) <= 3 for r, _ in model.rules)
    got = {r["doc_id"]: r["score"] for r in rule_ensemble.classify(documents, model).collect()}
    rows = documents.collect()
    want = model.score(np.array([rule_ensemble.statistics((r["text"] or "").encode()) for r in rows]))
    assert np.allclose([got[r["doc_id"]] for r in rows], want)


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    docs = {r["doc_id"]: r for r in table(spark, SMALL, "documents").collect()}
    good = {r["doc_id"] for r in queries.op10_rule_ensemble(spark, SMALL).collect() if r["predicted"] == 1}
    fps = {i: _fingerprint(docs[i]["text"]) for i in good}
    classes = {}
    for i in sorted(good):
        near = {classes[j] for j in classes if (fps[i] ^ fps[j]).bit_count() <= 3}
        classes[i] = min(near, default=i)
        for j in classes:
            if classes[j] in near:
                classes[j] = classes[i]
    kept = set(classes.values())
    leaks = {r["doc_id"] for r in queries.op7_template_decontamination(spark, SMALL).collect() if r["contaminated"]}
    kept -= leaks
    assert {r["doc_id"] for r in rows} <= kept
    size = Counter()
    for i in kept:
        s = docs[i]["source"]
        size[s if s in corpus_pipeline.MIX_WEIGHTS else None] += len(docs[i]["text"].encode())
    weight = {g: corpus_pipeline.MIX_WEIGHTS.get(g, corpus_pipeline.MIX_REST) for g in size}
    want = Counter()
    for i in kept:
        g = docs[i]["source"] if docs[i]["source"] in corpus_pipeline.MIX_WEIGHTS else None
        rate = weight[g] / sum(weight.values()) * sum(size.values()) / size[g]
        u = int(hashlib.md5(f"42:count:{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        if k:
            want[i] = k
    assert Counter(r["doc_id"] for r in rows) == want
    per = Counter(r["shard"] for r in rows)
    assert max(per.values()) - min(per.values()) <= 1
    assert all(r["text"] == docs[r["doc_id"]]["text"] for r in rows)
