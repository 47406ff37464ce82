"""Cheapest repair of conversations by a min-plus dynamic programme over a shared grammar.

A row of a conversation is one of nine symbols (its role's initial, whether its text is
cut off, or that it has to go). What a row can do to a conversation is a transfer
matrix over the four places a legal conversation may be at: nothing yet, after the
system row, after a user row, after an assistant row. Its entries hold the least cost and
the edits that reach it. Re-Pair replaces the pairs of symbols that are most frequent in
all conversations by rules, round by round; the matrix of a rule is the min-plus
product of the matrices of its two sides, made once and used in every
conversation that has the rule. Edits are kept as ropes (pairs of smaller ropes).

Ties go to the edits that come first in ASCII order. Two ropes over the same rows from one place
never begin alike and end in different places: each letter fixes the next place, and both end in a
row's letter. So their order is the order of their first parts, or of
their second parts where the first is the same, and ranks kept beside the costs decide it without reading them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import saved

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
CUT_OFF = 3
#: Symbols of one segment: longer conversations are cut, so that no row grows with a conversation.
SEGMENT = 4096
#: Rules of the grammar, rounds over the corpus, and pairs that reach the driver in a round.
MAX_RULES, MAX_ROUNDS, MAX_PAIRS = 128, 12, 256
#: Rule sequences whose repair a worker remembers.
REMEMBERED = 200_000
#: White space is \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
GONE, SYMBOLS = "x", "suaoSUAOx"
_FIRST_RULE = 0x100
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


# ------------------------------------------------------------ transfer matrices

@dataclass(frozen=True)
class Entry:
    """Cheapest way from one place to another: cost, edits as a rope, and its rank in
    ASCII order among the ways from the same place."""

    cost: int
    rope: object
    rank: int


Matrix = dict[int, dict[int, Entry]]


def _ranked(row: dict[int, tuple[int, object, object]]) -> dict[int, Entry]:
    order = {k: r for r, k in enumerate(sorted({key for _, _, key in row.values()}))}
    return {to: Entry(cost, rope, order[key]) for to, (cost, rope, key) in row.items()}


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions before the row, then what becomes of the row itself."""
    out: Matrix = {}
    extra = CUT_OFF if symbol.isupper() else 0
    for begin in range(4):
        row: dict[int, tuple[int, object, object]] = {}
        at, cost, edits, seen = begin, 0, "", set()
        while at not in seen:
            seen.add(at)
            ways = [(at, DELETE, "D")]
            if symbol != GONE:
                ways.append((_NEXT[at], REROLE + extra, "R"))
                kept = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(symbol.lower())
                if kept == _NEXT[at] or (kept == SYSTEM and at == START):
                    ways.append((kept, KEEP + extra, "K"))
            for to, price, letter in ways:
                new = (cost + price, edits + letter, edits + letter)
                if to not in row or (new[0], new[1]) < (row[to][0], row[to][1]):
                    row[to] = new
            at, cost, edits = _NEXT[at], cost + INSERT, edits + "I"
        out[begin] = _ranked(row)
    return out


def product(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product; equal costs go to the edits that come first."""
    out: Matrix = {}
    for begin, ways in left.items():
        row: dict[int, tuple[int, object, object]] = {}
        for via, a in ways.items():
            for to, b in right[via].items():
                new = (a.cost + b.cost, (a.rope, b.rope), (a.rank, b.rank))
                if to not in row or (new[0], new[2]) < (row[to][0], row[to][2]):
                    row[to] = new
        out[begin] = _ranked(row)
    return out


def letters(rope: object) -> str:
    """The edits of a rope, without recursion: a long conversation's rope is deep."""
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo.extend((r[1], r[0]))
    return "".join(out)


class Repairer:
    """Matrices of all symbols and rules, bottom-up, and the repair of whole sequences with them."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = [(left + right, chr(_FIRST_RULE + i)) for i, (left, right) in enumerate(rules)]
        self.matrix = {s: symbol_matrix(s) for s in SYMBOLS}
        for pair, name in self.rules:
            self.matrix[name] = product(self.matrix[pair[0]], self.matrix[pair[1]])
        for m in list(self.matrix.values()):  # ropes of rules are short: their letters are laid out once
            for row in m.values():
                for to, e in row.items():
                    row[to] = Entry(e.cost, letters(e.rope), e.rank)
        self.known: dict[str, tuple[int, str]] = {}

    def compress(self, symbols: str) -> str:
        for pair, name in self.rules:
            symbols = symbols.replace(pair, name)
        return symbols

    @staticmethod
    def begin() -> dict[int, Entry]:
        return {START: Entry(0, "", 0)}

    def extend(self, ways: dict[int, Entry], compressed: str) -> dict[int, Entry]:
        """The cheapest ways after more (compressed) symbols."""
        for name in compressed:
            ways = product({START: ways}, self.matrix[name])[START]
        return ways

    @staticmethod
    def finish(ways: dict[int, Entry]) -> tuple[int, str]:
        """Cost and edits of the cheapest way that ends legally."""
        ends = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
        at = min(ways, key=lambda k: (ways[k].cost + INSERT * ends[k], ways[k].rank))
        return ways[at].cost + INSERT * ends[at], letters(ways[at].rope) + "I" * ends[at]

    def repair(self, symbols: str) -> tuple[int, str]:
        """Cost and edits of one whole sequence of symbols."""
        found = self.known.get(symbols)
        if found is None:
            found = self.finish(self.extend(self.begin(), self.compress(symbols)))
            if len(symbols) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[symbols] = found
        return found


# ------------------------------------------------------------------------ rows

def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` of rows broken in a repeatable way, by the crc32 of
    ``conv_id:turn`` modulo 20: 0 drops the row (no copies), 1 empties its text, 2 takes its ``.!?`` away, 3
    repeats it (two copies), 4 makes its role user. Nulls read as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        F.when(k == 1, F.lit("")).when(k == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text")).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def _rows(conversations: DataFrame) -> DataFrame:
    """Rows in the form that all steps read. ``copies`` is one where there is no such column."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.coalesce(F.col("copies"), F.lit(1)) if "copies" in conversations.columns else F.lit(1)
    return conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                space("role").alias("role"), space("text").alias("text"), copies.cast("long").alias("copies")
                                ).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def _symbols(rows: DataFrame) -> DataFrame:
    """One narrow row per distinct row of a conversation: its symbol, number of copies, and whether an
    earlier turn holds its role and text. Texts themselves are not shuffled, only their MD5."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    whole = F.substring(end, -1, 1).isin(".", "!", "?")
    symbol = F.when(end == "", F.lit(GONE)).when(whole, kind).otherwise(F.upper(kind))
    distinct = saved(
        rows.select("conv", "turn", "role", "digest", initial.alias("initial"), symbol.alias("symbol"), "copies")
        .groupBy("conv", "turn", "role", "digest", "initial", "symbol").agg(F.sum("copies").alias("copies")), "repair-rows")
    # a text told in several turns of a conversation; a copy in one turn shows in its copies
    again = saved(
        distinct.where((F.col("symbol") != GONE) & (F.col("copies") > 0)).groupBy("conv", "role", "digest")
        .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
        .select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("first.turn").alias("_t")), "repair-again")
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    return distinct.join(again, same, "left").select(
        "conv", "turn", "role", "digest", "initial", "symbol", "copies",
        (F.col("_r").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_t"))).alias("again"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SEGMENTS = ("conv long, part int, no int, symbols string, blank long, duplicate long, truncated long, illegal long, "
             "turns long, first_turn long, last_turn long, head string, tail string")


class _Segment:
    def __init__(self, conv: int | None):
        self.conv, self.symbols, self.head, self.tail = conv, [], None, None
        self.count = dict.fromkeys(_COUNTS, 0)
        self.size, self.turns, self.first_turn, self.last_turn = 0, 0, None, None

    def add(self, turn: int | None, initial: str, symbol: str, again: bool, copies: int) -> None:
        """A row, or as many equal rows as fit; the first of them may be no copy."""
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if symbol == GONE:
            self.count["blank"] += copies
            self.symbols.append(GONE * copies)
        else:
            self.symbols.append(GONE * copies if again else symbol + GONE * (copies - 1))
            self.count["duplicate"] += copies - (not again)
            self.count["truncated"] += not again and symbol.isupper()
        if self.tail is not None:
            self.count["illegal"] += self.tail + initial not in ("su", "ua", "au")
        self.count["illegal"] += copies - 1  # no row may follow its like
        self.head = initial if self.head is None else self.head
        self.tail = initial
        self.size += copies

    def row(self, part: int, no: int) -> tuple:
        return (self.conv, part, no, "".join(self.symbols), *self.count.values(), self.turns, self.first_turn, self.last_turn, self.head, self.tail)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_SEGMENT_ARROW = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("no", pa.int32()), ("symbols", pa.string())]
                           + [(c, pa.int64()) for c in (*_COUNTS, "turns", "first_turn", "last_turn")]
                           + [("head", pa.string()), ("tail", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted narrow rows to segments: part is the task, so segments of a conversation are in order."""
    part, no, out, now = TaskContext.get().partitionId(), 0, [], None
    for b in batches:
        for conv, turn, initial, symbol, copies, again in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row(part, no))
                    no += 1
                now = _Segment(conv)
            while copies:
                some = min(copies, max(1, SEGMENT - now.size))
                now.add(turn, initial, symbol, again, some)
                copies, again = copies - some, True
                if now.size >= SEGMENT:
                    out.append(now.row(part, no))
                    no, now = no + 1, _Segment(conv)
            if len(out) >= 2000:
                yield _table(out, _SEGMENT_ARROW)
                out = []
    if now is not None:
        out.append(now.row(part, no))
    if out:
        yield _table(out, _SEGMENT_ARROW)


def segments(conversations: DataFrame) -> DataFrame:
    """Symbols of every conversation in row order (turn, nulls first; then role and the MD5 of the text), in
    segments of at most SEGMENT rows, with their counts of faults. Ranges of (conversation, turn) are dealt to the tasks, so a
    conversation that holds a third of all rows is spread over many of them."""
    order = ["conv", "turn", "role", "digest"]
    rows = _symbols(_rows(conversations)).repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(rows.select("conv", "turn", "initial", "symbol", "copies", "again").mapInArrow(_cut, _SEGMENTS), "repair-segments")


# --------------------------------------------------------------------- grammar

def learn_grammar(symbols: DataFrame, max_rules: int = MAX_RULES, max_rounds: int = MAX_ROUNDS) -> list[tuple[str, str]]:
    """Re-Pair over the column ``symbols`` of all rows: each round counts the pairs of neighbours in what the
    rules so far leave, and the most frequent pairs that share no symbol become rules, while a pair
    occurs at least twice. At most MAX_PAIRS counts reach the driver in a round."""
    rules: list[tuple[str, str]] = []
    for _ in range(max_rounds):
        if len(rules) >= max_rules:
            break
        now = list(rules)

        def count(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            names = [(a + b, chr(_FIRST_RULE + i)) for i, (a, b) in enumerate(now)]
            pairs: Counter = Counter()
            for b in batches:
                text = "\n".join(s or "" for s in b.column(0).to_pylist())
                for pair, name in names:
                    text = text.replace(pair, name)
                found = Counter(zip(text, text[1:]))
                for a, z in found:
                    if a != "\n" and z != "\n":
                        pairs[a + z] += found[a, z] if a != z else text.count(a + z)  # runs hold half as many
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["pair", "n"])

        top = symbols.select("symbols").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(
            "n > 1").orderBy(F.desc("n"), "pair").limit(MAX_PAIRS).collect()
        used: set[str] = set()
        for r in top:
            a, z = r["pair"]
            if not used & {a, z} and len(rules) < max_rules:
                rules.append((a, z))
                used |= {a, z}
        if not used:
            break
    return rules


# ---------------------------------------------------------------------- repair

_AUDITS = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_AUDIT_ARROW = pa.schema([(c, pa.int64()) for c in ("conv", "gaps", *_COUNTS, "cost")] + [("audit", pa.string())])


def audits(parts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """One row per conversation of ``segments``: gaps, faults, least cost, edits. The segments of a conversation
    are folded one after another, at most one of them in memory."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, out, now = Repairer(rules), [], None

        def done() -> tuple:
            c, ways, only, count, turns, low, high, tail = now
            cost, edits = machine.repair(only) if ways is None else machine.finish(ways)
            return (c, high - low + 1 - turns if turns else 0, *count, cost, edits)

        for b in batches:
            for r in b.to_pylist():
                count = [r[c] for c in _COUNTS]
                if now is None or now[0] != r["conv"]:
                    if now is not None:
                        out.append(done())
                    now = [r["conv"], None, r["symbols"], count, r["turns"], r["first_turn"], r["last_turn"], r["tail"]]
                    if len(out) >= 2000:
                        yield _table(out, _AUDIT_ARROW)
                        out = []
                    continue
                if now[1] is None:
                    now[1], now[2] = machine.extend(machine.begin(), machine.compress(now[2])), None
                now[1] = machine.extend(now[1], machine.compress(r["symbols"]))
                now[3] = [x + y for x, y in zip(now[3], count, strict=True)]
                if r["head"] is not None:
                    if now[7] is not None:
                        now[3][3] += now[7] + r["head"] not in ("su", "ua", "au")
                    now[7] = r["tail"]
                if r["turns"]:
                    now[4] += r["turns"] - (r["first_turn"] == now[6])
                    now[5] = r["first_turn"] if now[5] is None else now[5]
                    now[6] = r["last_turn"]
        if now is not None:
            out.append(done())
        if out:
            yield _table(out, _AUDIT_ARROW)

    order = ["conv", "part", "no"]
    return parts.repartition("conv").sortWithinPartitions(*order).mapInArrow(fold, _AUDITS)


def _lines(audit: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) for each row that a repair leaves, and (D, role, text) for each it deletes."""
    at, k = START, 0
    roles = {USER: "user", ASSISTANT: "assistant"}
    for role, text, copies in rows:
        for _ in range(copies):
            while audit[k] == "I":
                at, k = _NEXT[at], k + 1
                yield "I", roles[at], ""
            edit, k = audit[k], k + 1
            if edit == "R":
                at = _NEXT[at]
                role = roles[at]
            elif edit == "K":
                at = SYSTEM if role[:1] == "s" else _NEXT[at]
            yield edit, role, text
    while k < len(audit):
        at, k = _NEXT[at], k + 1
        yield "I", roles[at], ""


def _stream(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with texts, each conversation's audit before them, in the order that the symbols were in."""
    stats = [c.split()[0] for c in _AUDITS.split(", ")][1:]
    rows = _rows(conversations).where("copies > 0").select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "text", "copies")
    return rows.unionByName(found.withColumn("kind", F.lit(0)), allowMissingColumns=True).repartition("conv").sortWithinPartitions(
        "conv", "kind", "turn", "role", "digest").select("conv", "kind", "role", "text", "copies", *stats)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str, int]]]]:
    """(audit row, rows) of each conversation; its rows are read as they come, and have to be read to the end."""
    stream = (r for b in batches for r in b.to_pylist())
    ahead = next(stream, None)
    while ahead is not None:
        head = ahead

        def rows() -> Iterator[tuple[str, str, int]]:
            nonlocal ahead
            ahead = next(stream, None)
            while ahead is not None and ahead["kind"] == 1:
                yield ahead["role"], ahead["text"], ahead["copies"]
                ahead = next(stream, None)

        yield head, rows()


def _solved(conversations: DataFrame) -> DataFrame:
    parts = segments(conversations)
    return saved(audits(parts, learn_grammar(parts)), "repair-audits")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), edit (K, R or I), role, text: the rows of every conversation after its cheapest repair.

    Kept rows cost nothing, a new role (user or assistant) 3, a deleted row 4, an inserted empty row 3, and a
    row left cut off 3 more; blank rows and rows whose role and text came before in the conversation have to go. What is
    left reads system at most once and first, then user and assistant in turn, ending with an assistant, or is
    empty. Null roles and texts read as one space, null turns come first, null conversation ids are one
    conversation; rows of one turn come by role, then by the MD5 of their text. Extra columns are left out (but for
    ``copies``, a number of copies of each row; rows of no copies only name their conversation). An empty table gives an empty one.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        out = []
        for head, rows in _conversations(batches):
            n = 0
            for edit, role, text in _lines(head["audit"], rows):
                if edit != "D":
                    out.append((head["conv"], n, edit, role, text))
                    n += 1
                if len(out) >= 1000:
                    yield _table(out, schema)
                    out = []
        if out:
            yield _table(out, schema)

    return _stream(conversations, _solved(conversations)).mapInArrow(write, "conv_id long, at long, edit string, role string, text string")


def digest(conversations: DataFrame) -> DataFrame:
    """One row for every conversation: conv_id, gaps (turns missing between the least and the greatest), numbers of
    blank, duplicate, truncated rows (the first fault of each counts) and illegal neighbours, least cost, audit (the edits in
    order) and the SHA-256 of the repaired ``role:text`` lines. See ``repair`` for nulls and order. A conversation's lines are
    hashed one after another as they come, never held together."""
    names = [c.split()[0] for c in _AUDITS.split(", ")][1:]
    schema = pa.schema([("conv_id", pa.int64()), *[_AUDIT_ARROW.field(c) for c in names], ("repaired_sha256", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for head, rows in _conversations(batches):
            total, glue = hashlib.sha256(), ""
            for edit, role, text in _lines(head["audit"], rows):
                if edit != "D":
                    total.update(f"{glue}{role}:{text}".encode())
                    glue = "\n"
            out.append((head["conv"], *[head[c] for c in names], total.hexdigest()))
            if len(out) >= 1000:
                yield _table(out, schema)
                out = []
        if out:
            yield _table(out, schema)

    return _stream(conversations, _solved(conversations)).mapInArrow(
        write, "conv_id long, " + _AUDITS.split(", ", 1)[1] + ", repaired_sha256 string")
