"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import queries, spelling
from tests.llm.conftest import SMALL


def count(rows, typo_every=None, least=6, times=5):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(ch.lower() if ch.isascii() else ch for ch in w)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if typo_every and h % typo_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                c[w] += 1
    return {w: k for w, k in c.items() if k >= times}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(n):
    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_against_brute_force(spark, documents):
    want = variants(count([(r["doc_id"], r["text"]) for r in documents.collect()], 199))
    got = rows_of(queries.op12_spelling_variants(spark, SMALL))
    assert got == want and sum(r[1] is not None for r in got) > 5


def table_of(spark, n):
    return spark.createDataFrame(sorted(n.items()), "word string, n long")


@pytest.mark.parametrize("groups,block,neighbours", [(3, 4096, 16384), (8, 4096, 16384), (1, 7, 11), (2, 1, 1), (4, 16, 5)])
def test_blocks_and_parts_lose_no_pair(spark, monkeypatch, groups, block, neighbours):
    """Few letters make large blocks of near words; blocks split over several parts, or over one word each."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "NEIGHBOURS", neighbours)
    r = random.Random(groups)
    size = 40 if block == 1 else 250
    n = {"".join(r.choice("abcézÿ") for _ in range(r.randrange(3, 8))): 5 ** r.randrange(6) for _ in range(size)}
    assert rows_of(spelling.group_variants(table_of(spark, n), groups=groups)) == variants(n)


def test_long_chain_and_ties(spark):
    chain = {"a" * k: 5 ** (k - 6) for k in range(6, 20)}  # fourteen words, each the form of the one before
    ties = {"kitten": 1, "kittens": 10, "mitten": 10, "kitte": 10}
    n = chain | ties
    got = rows_of(spelling.group_variants(table_of(spark, n)))
    assert got == variants(n)
    by = {r[0]: r for r in got}
    assert by["aaaaaa"][2] == "a" * 19 and by["kitten"][1] == "kitte"  # smallest of three of equal n


def test_very_long_words(spark):
    long = "".join(random.Random(3).choice("abcdefg") for _ in range(200_000))
    n = {long: 1, long[:-1]: 7, long[:5] + "x" + long[6:]: 50, long[::-1]: 3, "abcdef": 5}
    got = rows_of(spelling.group_variants(table_of(spark, n)))
    assert got == variants(n) and sum(r[1] is not None for r in got) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=4, max_size=5), min_size=1, max_size=12), st.integers(0, 1))
def test_products_are_squared_distances(words, longer):
    a = [w for w in words if len(w) == 4] or ["abab"]
    b = [w for w in words if len(w) == 4 + longer] or ["abab" + "a" * longer]
    got = {(int(x), int(y)) for i, j in spelling._product_pairs(spelling._codes(a), spelling._codes(b)) for x, y in zip(i, j)}
    dist = lambda x, y: sum((x.count(c) - y.count(c)) ** 2 for c in "abé")
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if dist(x, y) <= 2}
    pairs = [(x, y) for x in a for y in b]
    ok = spelling._one_edit(spelling._codes([x for x, _ in pairs]), spelling._codes([y for _, y in pairs]))
    assert ok.tolist() == [one_edit(x, y) for x, y in pairs]


def test_edges(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for typos in (None, 3):
        got = {r["word"]: r["n"] for r in spelling.word_counts(odd, least_letters=1, least_count=1, typo_every=typos).collect()}
        assert got == count(rows, typos, 1, 1)
    mixed = [(1, "ÉCOLE école École x́abcdef—abcdefĀghijkl 你好abcdef ÷×÷×÷×"), (None, "abcdef"), (2, None), (3, "")]
    df = spark.createDataFrame(mixed, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(df, least_count=1, least_letters=4).collect()}
    assert got == count(mixed, None, 4, 1) and got["abcdef"] == 4 and got["École"] == 2
    out = spelling.group_variants(spelling.word_counts(empty))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
    one = rows_of(spelling.group_variants(table_of(spark, {"single": 9})))
    assert one == [("single", None, "single", 9, 0, None)]
    with pytest.raises(ValueError):
        spelling.group_variants(table_of(spark, {}), times=1)


def test_a_hot_word_is_a_few_rows(spark):
    df = spark.range(0, 3000, 1, 3).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('orange orange ', 50), 'oranges oranges') as text")
    out = spelling.word_counts(df)
    assert {r["word"]: r["n"] for r in out.collect()} == {"orange": 100_000, "oranges": 4000}
