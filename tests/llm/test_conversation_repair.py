"""Conversation repair against exhaustive search and a plain dynamic programme."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest

from tesserae.llm import conversation_repair as cr
from tesserae.llm import queries
from tesserae.llm.common import table
from tests.llm.conftest import SMALL

WS = " \t\n\x0b\x0c\r"


def damaged(rows):
    """{conv_id: rows} of (conv_id, turn, role, text) after damage, in order."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        out[c] += []
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(x for x in text if x not in ".!?")
        if k == 4:
            role = "user"
        out[c] += [(t, role, text)] * (2 if k == 3 else 1)
    for c in out:
        out[c].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(WS)
        out.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, edits) and the repaired rows, by a plain programme over rows that keeps whole strings."""
    nxt = {"0": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"0": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for at, (cost, edits, lines) in list(best.items()):
                new = (cost + 3, edits + "I", lines + ((name[nxt[at]], ""),))
                if nxt[at] not in best or new[:2] < best[nxt[at]][:2]:
                    best[nxt[at]] = new
        return best

    for (_, role, text), fault in zip(rows, faults(rows)):
        more = {}

        def offer(at, new):
            if at not in more or new[:2] < more[at][:2]:
                more[at] = new

        for at, (cost, edits, lines) in insert(dict(best)).items():
            offer(at, (cost + 4, edits + "D", lines))
            if fault in ("b", "d"):
                continue
            extra = 3 * (fault == "t")
            offer(nxt[at], (cost + 3 + extra, edits + "R", lines + ((name[nxt[at]], text),)))
            if role[:1] == nxt[at] or (at == "0" and role[:1] == "s"):
                offer(role[0], (cost + extra, edits + "K", lines + ((role, text),)))
        best = more
    best = insert(dict(best))
    return min(best[k] for k in ("0", "a") if k in best)


def expected(rows):
    out = []
    for c, rs in damaged(rows).items():
        f, turns = faults(rs), [r[0] for r in rs if r[0] is not None]
        cost, audit, lines = cheapest(rs)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("b"), f.count("d"), f.count("t"),
                    illegal, cost, audit, sha))
    return sorted(out, key=str)


def got(df):
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == cols
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_query_against_a_plain_programme(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    assert got(queries.op13_conversation_repair(spark, sf)) == want
    assert len({w[7] for w in want}) > 15 and any(w[5] for w in want)


def every_repair(symbols):
    """All repairs with at most two insertions in a row, as (cost, edits)."""
    nxt = {"0": "u", "s": "u", "u": "a", "a": "u"}
    ways = [("0", 0, "")]
    for k, x in enumerate(symbols + "$"):
        more = []
        for at, cost, edits in ways:
            for n in range(3):
                if x == "$":
                    if at in "0a":
                        more.append((at, cost, edits))
                else:
                    extra = 3 * x.isupper()
                    more.append((at, cost + 4, edits + "D"))
                    if x != "x":
                        more.append((nxt[at], cost + 3 + extra, edits + "R"))
                        if x.lower() == nxt[at] or (x.lower() == "s" and at == "0"):
                            more.append((x.lower(), cost + extra, edits + "K"))
                at, cost, edits = nxt[at], cost + 3, edits + "I"
        ways = more
    return min((cost, edits) for _, cost, edits in ways)


def test_every_short_sequence_against_all_repairs():
    plain = cr.Repairer([])
    paired = cr.Repairer([("u", "a"), ("x", "x"), ("Ā", "Ā"), ("s", "u"), ("U", "a"), ("Ă", "ā")])
    for n in range(5):
        for symbols in itertools.product("suaoSUx" if n == 4 else cr.SYMBOLS, repeat=n):
            s = "".join(symbols)
            assert plain.repair(s) == paired.repair(s) == every_repair(s), s


def test_grammar_is_shared_and_changes_nothing(spark):
    r = random.Random(5)
    many = ["".join(r.choices("uaUAsox", [9, 9, 2, 2, 1, 1, 2], k=r.randrange(0, 60))) for _ in range(400)]
    rules = cr.learn_grammar(spark.createDataFrame([(s,) for s in many] + [(None,)], "symbols string"))
    assert 20 < len(rules) <= cr.MAX_RULES
    machine, plain = cr.Repairer(rules), cr.Repairer([])
    assert sum(len(machine.compress(s)) for s in many) < 0.55 * sum(map(len, many))
    assert [machine.repair(s) for s in many] == [plain.repair(s) for s in many]
    assert cr.learn_grammar(spark.createDataFrame([], "symbols string")) == []
    assert len(cr.learn_grammar(spark.createDataFrame([("ua" * 500,)], "symbols string"), max_rules=3)) == 3


def test_long_conversations_are_cut_and_folded(spark):
    """One conversation holds most rows; its segments lie in many tasks."""
    r = random.Random(9)
    rows = [(1, k // 2, r.choice(["user", "assistant", "tool"]), r.choice(["Yes.", "no", "So? ", f"t{k}!", f"t{k}", " ", None])) for k in range(12_000)]
    rows += [(c, t, r.choice(["system", "user", "assistant"]), f"{t}.") for c in range(2, 30) for t in range(r.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = expected(rows)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the tasks of a large input
    try:
        assert got(cr.digest(cr.damage(df))) == want
        parts = cr.segments(cr.damage(df)).where("conv = 1").selectExpr("part", "length(symbols) as n").collect()
        assert len({p["part"] for p in parts}) > 2 and max(p["n"] for p in parts) <= 4096
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_hot_repeats_and_a_sequential_rope(spark):
    """A million copies of one row are one narrow row; they cost a segment of symbols for each SEGMENT of them."""
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 1_000_000), (1, 1, "assistant", "Yes.", 1)],
                               "conv_id long, turn long, role string, text string, copies long")
    row = cr.digest(df).first()
    assert (row["duplicate"], row["illegal"], row["cost"]) == (999_999, 999_999, 4 * 999_999)
    assert row["audit"] == "D" * 0 + "K" + "D" * 999_999 + "K" and row["gaps"] == 0
    assert [(x["role"], x["text"]) for x in sorted(cr.repair(df).collect(), key=lambda x: x["at"])] == [("user", "Hi."), ("assistant", "Yes.")]


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, Conv string, kind string, Digest string"
    long = "word " * 100_000
    rows = [(None, None, None, None), (None, 3, "user", "a."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "user", None),
            (1, 5, "assistant", ""), (1, 7, "", "b."), (2, 1, "system", "only."), (3, 1, "user", long), (3, 2, "assistant", long + "."),
            (4, 2, "user", "é 　"), (4, 2, "user", "　."), (5, -3, "assistant", "x!\n\t"), (5, 9, "System", "x!"), (6, None, None, "z.")]
    rows += [(c, t, "user", "same.") for c in range(10, 60) for t in ((0, 1) if c < 20 else (0,))]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).repartition(4)
    out = got(cr.digest(cr.damage(df)))
    assert out == expected(rows) and len(out) == len({r[0] for r in rows})
    gone = [c for c, rs in damaged(rows).items() if not rs]
    assert gone
    for c in gone:
        assert next(r for r in out if r[0] == c)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    lines = defaultdict(list)
    for r in sorted(cr.repair(cr.damage(df)).collect(), key=lambda r: r["at"]):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(lines[r[0]]).encode()).hexdigest() == r[8] for r in out)
    assert cr.digest(cr.damage(df.where("false"))).count() == 0 and cr.repair(df.where("false")).count() == 0
