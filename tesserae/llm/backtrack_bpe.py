"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

The encoder never merges. For a word (one piece that the vocabulary's own
pre-tokenizer cuts out) an Aho-Corasick automaton finds, in one pass from the
right, the longest token that starts at each place. Tokens are then laid from the
left: the longest one that may follow the last token is taken, else the next
shorter prefix that is a token, else the last token is taken back and its end is
closed for good. Two tokens may follow each other if merging their two strings by
the merge ranks would never join across the seam; that is read off the table of
mergeable pairs by undoing the younger of the two tokens step by step. Each place
is closed at most once, so a word takes time linear in its length, and what is
left at the end is exactly the result of the merges.

The decoder keeps all token strings end to end in one byte array with an offset
table; a batch of ids becomes one gather of byte ranges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct pieces, and pairs of tokens, that a Python worker remembers; beyond that it starts afresh.
CACHE_PIECES, CACHE_PAIRS = 1_000_000, 2_000_000
#: Characters of text that one Arrow batch of results covers (a longer text has a batch of its own).
BATCH_CHARS = 1 << 21
#: Added to the code of a word's last character where a vocabulary marks word ends.
_WORD_END = 0x1000
_loaded: dict[str, Vocabulary] = {}


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """A tokenizer file prepared for backtracking: ranks, splits, automaton, offset table."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get(
                "byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain byte-pair vocabularies with exact merges are meant here")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.normalizer, self.pre_tokenizer = tok.normalizer, tok.pre_tokenizer
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or are normalized are not meant here")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._tables(model["vocab"], model["merges"])
        self._offsets(tok, spec)
        self._ascii_rule(spec)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        self.pairs: dict[int, bool] = {}

    def _symbols(self, token: str) -> str:
        """A token with its word end as one character for each symbol that merging starts from."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + _WORD_END)
        return token

    def _tables(self, vocab: dict[str, int], merges: list) -> None:
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = [a + b for a, b in merges]
        if len(set(made)) != len(made):
            raise ValueError("a token is made by two merges, so its rank is not its age")
        base = [t for t in vocab if len(self._symbols(t)) == 1]
        order = base + made  # by age: what merging starts from, then the merges by rank
        age = {t: i for i, t in enumerate(order)}
        self.ids = np.array([vocab[t] for t in order], "<u4")
        self.split = [(i, i) for i in range(len(base))] + [(age[a], age[b]) for a, b in merges]
        self.join = {(age[a] << 32) | age[b]: len(base) + r for r, (a, b) in enumerate(merges)}
        text = [self._symbols(t) for t in order]
        self.length = list(map(len, text))
        # a token that merging its own symbols does not give can never occur
        fine = [True] * len(base)
        for t in range(len(base), len(order)):
            a, b = self.split[t]
            fine.append(fine[a] and fine[b] and self.compatible(a, b, t))
        self.age = {s: i for i, s in enumerate(text) if fine[i]}
        self.shorter = [next((self.age[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.age), -1) for s in text]
        self.automaton = ahocorasick.Automaton()
        for s, i in self.age.items():
            self.automaton.add_word(s[::-1], i)
        self.automaton.make_automaton()

    def compatible(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether no merge older than ``limit`` joins across the seam of tokens a, b: walk back
        through the states that merging passed, undoing the younger side, and look up the pair at the seam."""
        join, split = self.join, self.split
        while True:
            if join.get((a << 32) | b, limit) < limit:
                return False
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def encode_word(self, word: str) -> list[int]:
        """Ages of the tokens of one word, given as symbols."""
        whole = self.age.get(word)
        if whole is not None:
            return [whole]
        n, length, shorter, pairs = len(word), self.length, self.shorter, self.pairs
        longest: list[int] = [-1] * n
        for end, token in self.automaton.iter(word[::-1]):  # the longest match that ends there comes first
            if longest[n - 1 - end] < 0:
                longest[n - 1 - end] = token
        closed = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                if not closed[at + length[token]]:
                    if last < 0:
                        break
                    key = (last << 32) | token
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= CACHE_PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            elif last < 0:
                raise ValueError("the vocabulary lacks a token for a single symbol")
            else:
                closed[at] = 1
                out.pop()
                at -= length[last]
                token = last
        return out

    def _ascii_rule(self, spec: dict) -> None:
        """For ASCII text the file's normalizer and pattern can be run by ``re``: letters, digits and
        white space are then plain classes. Any other set-up leaves this to the library."""
        self.ascii_words = None
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
            return
        if cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            return
        if steps[1]["pattern"] != {"Regex": "\\s+"} or steps[1]["content"] != " ":
            return
        pattern = cuts[0]["pattern"].get("Regex", "\\p")
        for old, new in (("\\p{L}", "a-zA-Z"), ("\\p{N}", "0-9"), ("\\s", "\\t-\\r ")):
            pattern = pattern.replace(old, new)
        if "\\p" not in pattern:
            self.ascii_words = re.compile(pattern, re.ASCII)

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a text without spaces at which it may be cut, as little-endian uint32."""
        out = []
        for part in self.cut.split(piece) if self.cut else [piece]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            if self.ascii_words and part.isascii():
                words = [w if w.isprintable() else w.translate(_BYTES) for w in self.ascii_words.findall(part.lower())]
            else:
                words = [w for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part) if self.normalizer else part)]
            for w in words:
                ids = self.words.get(w)
                if ids is None:
                    symbols = w[:-1] + chr(ord(w[-1]) + _WORD_END) if self.suffix else w
                    ids = self.ids[self.encode_word(symbols)].tobytes()
                    if len(w) <= 64:
                        if len(self.words) >= CACHE_PIECES:
                            self.words.clear()
                        self.words[w] = ids
                out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text. Where the vocabulary drops white space, a text is cut at spaces and
        line feeds, which no word and no normalization reaches across, and each distinct piece is encoded once."""
        if not self.ascii_words:
            return self.encode_piece(text)
        known, found = self.pieces, []
        for p in text.replace("\n", " ").split(" "):
            ids = known.get(p)
            if ids is None:
                ids = self.encode_piece(p)
                if len(p) <= 64:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                        known[""] = b""
                    known[p] = ids
            found.append(ids)
        return b"".join(found)

    def _offsets(self, tok, spec: dict) -> None:
        strings = {i: t for t, i in tok.get_vocab(with_added_tokens=True).items()}
        self.bytes_out = bool(spec.get("decoder"))
        if self.bytes_out:
            if spec["decoder"]["type"] != "ByteLevel":
                raise ValueError("only byte-level decoders, or none, are meant here")
            back = {c: b for b, c in enumerate(_byte_chars())}
            special = set(self.special.values())
            table = {i: t.encode() if i in special else bytes(back[c] for c in t) for i, t in strings.items()}
        else:  # without a decoder the library joins the token strings by spaces
            table = {i: t.encode() + b" " for i, t in strings.items()}
        size = max(table) + 1
        lens = np.array([len(table.get(i, b"")) for i in range(size)], np.int64)
        self.offset = np.concatenate((np.zeros(1, np.int64), np.cumsum(lens)))
        self.blob = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, texts: list[bytes]) -> list[str]:
        """Texts of id sequences (little-endian uint32), special tokens included; ids beyond the vocabulary give nothing."""
        ids = np.frombuffer(b"".join(texts), "<u4").astype(np.int64)
        counts = np.array([len(t) // 4 for t in texts], np.int64)
        ids = np.minimum(ids, len(self.offset) - 1)
        start = self.offset[ids]
        lens = self.offset[np.minimum(ids + 1, len(self.offset) - 1)] - start
        ends = np.cumsum(lens)
        data = self.blob[np.repeat(start - (ends - lens), lens) + np.arange(int(lens.sum()))].tobytes()
        bounds = np.concatenate((np.zeros(1, np.int64), ends))[np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))].tolist()
        if self.bytes_out:
            return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        return [data[a : b - 1].decode() if b > a else "" for a, b in zip(bounds, bounds[1:])]


_BYTES = {b: c for b, c in enumerate(_byte_chars()) if b < 128}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about BATCH_CHARS characters."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_CHARS:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _added(df: DataFrame, source: str, made: T.StructType, make: Callable[[list], list[pa.Array]], keep: Sequence[str] | None) -> DataFrame:
    """Columns ``keep`` of ``df`` (none named: all) with the columns ``made``, computed from ``source`` in batches
    of bounded text; columns of those names, in any case, are replaced."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in made.names]
    # one struct: names of carried columns cannot clash with the ones made
    carried = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c.replace('`', '``')}`") for c in keep]).alias("__row")
    packed = df.select(carried, F.col(f"`{source}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, end in _slices([len(t or "") for t in texts]):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), *make(texts[first:end])], names=["__row", *made.names])

    out = packed.mapInArrow(run, T.StructType([packed.schema["__row"], *made.fields]))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in keep], *made.names)


_ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
_DECODED = T.StructType([T.StructField("decoded", T.StringType())])


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_tokens`` and ``ids`` (token ids as little-endian uint32, binary)
    of every whole text, as the tokenizers library encodes it without special tokens around it; strings of
    special tokens inside a text are those tokens.

    Null and empty texts have no ids; repeated rows stay as they are; an empty table gives an empty
    one. Nothing is shuffled: a row's ids depend on the row alone.
    """

    def make(texts: list[str | None]) -> list[pa.Array]:
        v = vocabulary(tokenizer)
        ids = [v.encode(t or "") for t in texts]
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]

    return _added(docs, text, _ENCODED, make, keep)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """``encoded`` (or its columns ``keep``) with ``decoded``, the text of each row's ids, special tokens kept.
    Null ids give an empty text."""

    def make(rows: list[bytes | None]) -> list[pa.Array]:
        return [pa.array(vocabulary(tokenizer).decode([r or b"" for r in rows]), pa.string())]

    return _added(encoded, ids, _DECODED, make, keep)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``encode`` and then ``decode`` in one pass over the rows: ``n_tokens``, ``ids``, ``decoded``."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        v = vocabulary(tokenizer)
        ids = [v.encode(t or "") for t in texts]
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(v.decode(ids), pa.string())]

    return _added(docs, text, T.StructType([*_ENCODED.fields, *_DECODED.fields]), make, keep)


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the rows of ``round_trip``."""
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
