"""Backtracking byte-pair encoding against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import backtrack_bpe, queries
from tests.llm.conftest import SMALL

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
WORD = str(public_tokenizers.path("word_bpe_49k.json"))


def check(path, texts):
    tok, v = Tokenizer.from_file(path), backtrack_bpe.vocabulary(path)
    want = tok.encode_batch_fast(texts, add_special_tokens=False)
    got = [v.encode(t) for t in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]
    assert v.decode(got) == tok.decode_batch([w.ids for w in want], skip_special_tokens=False)


def test_query_against_the_library(spark, documents):
    tok = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: r for r in queries.op11_backtrack_bpe(spark, SMALL).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


ODD = ["a", "b.", "'s", "'RE", "T,", " ", "é", "́", "\t", "\n", "　", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "1", "$",
       "À", "Σ.", "ς", "\x1c", "\x85", "\x00", "İ", "ß", "\U0001f642", "aaaa", "the", "ing", "য়", "Re", " "]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=40).map("".join), max_size=4))
def test_odd_texts(name, texts):
    check(str(public_tokenizers.path(name)), texts)


@pytest.mark.parametrize("name", FILES)
def test_every_character_and_long_runs(name):
    texts = [f"x {chr(c)}y{chr(c)}." for c in range(1, 0x20000 if name == FILES[0] else 0x3000) if not 0xD800 <= c <= 0xDFFF]
    texts += ["a" * n for n in range(200)] + ["ha" * 60 + "e" * n for n in range(60)] + ["é́" * n for n in range(40)]
    check(str(public_tokenizers.path(name)), texts)


def test_a_long_word_takes_linear_time():
    import time
    v = backtrack_bpe.vocabulary(WORD)
    seconds = []
    for n in (100_000, 400_000):
        t = time.perf_counter()
        v.encode(("abcdefgh" * (n // 8))[:n])
        seconds.append(time.perf_counter() - t)
    assert seconds[1] < 12 * seconds[0]
    check(WORD, ["abcdefgh" * 20_000, "aaab" * 20_000])


def test_merges_decide_where_longest_match_would_not():
    """Words on which taking the longest token first is wrong, so that tokens are taken back."""
    v, tok = backtrack_bpe.vocabulary(WORD), Tokenizer.from_file(WORD)
    wrong = 0
    for t in list(tok.get_vocab())[600:20_000:7]:
        word = t.replace("</w>", "") + "ingly"
        ids, rest, greedy = tok.encode(word).ids, word, []
        while rest:
            n = next(n for n in range(len(rest), 0, -1) if (rest[:n] + "</w>" * (n == len(rest))) in tok.get_vocab() or n == 1)
            greedy.append(rest[:n])
            rest = rest[n:]
        wrong += [tok.id_to_token(i).replace("</w>", "") for i in ids] != greedy
        if wrong > 20:
            break
        assert np.frombuffer(v.encode(word), "<u4").tolist() == ids
    assert wrong > 5


def test_edges(spark, odd, empty):
    tok = Tokenizer.from_file(WORD)
    docs = odd.withColumn("N_Tokens", F.lit("old"))
    out = backtrack_bpe.round_trip(docs, WORD)
    assert [c for c in out.columns if c.lower() == "n_tokens"] == ["n_tokens"] and "a.b" in out.columns and "Copy" in out.columns
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    two = backtrack_bpe.decode(backtrack_bpe.encode(docs, WORD, keep=["doc_id"]), WORD)
    assert two.columns == ["doc_id", "n_tokens", "ids", "decoded"] and two.count() == len(rows)
    assert sorted(r["decoded"] for r in two.collect()) == sorted(r["decoded"] for r in rows)
    lost = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert backtrack_bpe.decode(lost, WORD).first()["decoded"] == ""
    assert backtrack_bpe.digest(backtrack_bpe.round_trip(empty, WORD)).count() == 0
