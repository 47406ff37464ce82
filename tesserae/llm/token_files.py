"""Token-id files: independent zstandard frames with a trailing seek table.

One file is

    data frame, data frame, ..., index (skippable frame), seek table (skippable frame)

- A data frame is a zstandard frame of its own (content size and checksum in it)
  over: uint32 n, n times int64 id, n bytes has-id, n times uint32 number of
  tokens, then all token ids as uint32; everything little-endian.
- The index (magic 0x184D2A5D) has for each data frame uint32 documents,
  uint64 tokens, int64 first id, int64 last id.
- The seek table (magic 0x184D2A5E) has for every frame before it uint32
  compressed size, uint32 decompressed size, uint32 checksum (low half of the
  XXH64 of the content); then uint32 frames, one descriptor byte 0x80,
  magic 0x8F92EAB1.

Readers fetch the tail, choose frames by id, and read and decompress only those.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyarrow import fs

from tesserae.llm import words as W

_INDEX, _SEEK, _END = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
FRAME_TOKENS = 1 << 18
#: Compressed bytes of frames that one task reads, while that takes no more than MOST_TASKS tasks.
TASK_BYTES, MOST_TASKS = 4 << 20, 50_000
#: Distinct pieces whose ids a Python worker remembers; then it starts afresh.
CACHE_PIECES = 1_200_000
#: Bytes of text whose pieces are told apart at once, and pieces whose ids are joined at once.
TEXT_BYTES, JOINED_PIECES = 16 << 20, 500_000
#: Words of these letters are parted by white space alone, so that many go to the tokenizer as one text.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
WORDS_A_TEXT = 64
_known: dict[str, _Pieces] = {}
_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


@functools.cache
def _stays_letter(char: str) -> bool:
    """Whether a character is a letter and still is one after NFC and lower case; some
    become a letter and a combining mark, which would join a mark after them."""
    got = unicodedata.normalize("NFC", char).lower()
    return char.isalpha() and len(got) == 1 and got.isalpha()


def _core(piece: str) -> tuple[str, str]:
    """A piece without one closing full stop or comma after a letter that stays one, in lower case
    if it is all ASCII letters, and that mark: the vocabularies meant here part letters from
    marks and lower-case all, so their ids follow from these two."""
    mark = piece[-1:] if piece[-1:] in (".", ",") and _stays_letter(piece[-2:-1]) else ""
    core = piece[:-1] if mark else piece
    return (core.lower() if core.isascii() and core.isalpha() else core), mark


class _Pieces:
    """The pieces that a worker knows: a row for each, and its ids as one stretch of ``ids``."""

    def __init__(self, tokenizer: str):
        self.tok = _tokenizer(tokenizer)
        suffix = json.loads(self.tok.to_str())["model"].get("end_of_word_suffix")
        vocab = self.tok.get_vocab() if suffix else {}
        self.ends = np.zeros(max(vocab.values(), default=-1) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = bool(vocab)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.start, self.count = array("I"), array("q"), array("q")
        self.put("", array("I"))

    def put(self, piece: str, ids: array) -> None:
        self.row[piece] = len(self.start)
        self.start.append(len(self.ids))
        self.count.append(len(ids))
        self.ids.extend(ids)

    def get(self, piece: str) -> array:
        k = self.row[piece]
        return self.ids[self.start[k] : self.start[k] + self.count[k]]

    def rows(self, pieces: list[str]) -> np.ndarray:
        """The row of each of the distinct ``pieces``; new ones are encoded."""
        new = [p for p in pieces if p not in self.row]
        if len(self.row) + len(new) > CACHE_PIECES:
            self.clear()
            new = [p for p in pieces if p]
        parts = list(map(_core, new))
        self.encode(list({x for pair in parts for x in pair}.difference(self.row)))
        for p, (core, mark) in zip(new, parts, strict=True):
            if p not in self.row:
                self.put(p, self.get(core) + self.get(mark) if mark else self.get(core))
        return np.fromiter(map(self.row.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, cores: list[str]) -> None:
        """Words of letters go many to a text, cut after each id that ends a word; where that
        does not yield as many words, and for all other cores, each is a text of its own."""
        plain = list(filter(_LETTERS.fullmatch, cores)) if len(self.ends) else []
        alone = list(set(cores).difference(plain))
        groups = [plain[i : i + WORDS_A_TEXT] for i in range(0, len(plain), WORDS_A_TEXT)]
        for group, ids in zip(groups, self.texts(list(map(" ".join, groups))), strict=True):
            cuts = (np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1).tolist()
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                alone += group
                continue
            for word, a, b in zip(group, [0, *cuts], cuts, strict=False):
                self.put(word, ids[a:b])
        for core, ids in zip(alone, self.texts(alone), strict=True):
            self.put(core, ids)

    def texts(self, texts: list[str]) -> Iterator[array]:
        for i in range(0, len(texts), 20_000):
            for e in self.tok.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False):
                yield array("I", e.ids)


def encode_column(texts: pa.Array, tokenizer: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, token ids end to end, number of ids of each) of runs of texts, without special tokens.

    The vocabularies meant here drop white space and never join across it, so a
    text's ids are those of its pieces between ASCII white space, end to end;
    each distinct piece is encoded once and remembered.
    """
    known = _known.get(tokenizer) or _known.setdefault(tokenizer, _Pieces(tokenizer))
    for at, to in W.runs(W.sizes(texts), TEXT_BYTES):
        pieces, codes, counts = W.coded(texts.slice(at, to - at))
        row = known.rows(pieces.to_numpy(zero_copy_only=False).tolist())
        start, count = np.frombuffer(known.start, np.int64)[row], np.frombuffer(known.count, np.int64)[row]
        ids, past = np.frombuffer(known.ids, np.uint32) if known.ids else np.zeros(0, np.uint32), np.concatenate(([0], np.cumsum(counts)))
        for k, end in W.runs(counts, JOINED_PIECES):
            code = codes[past[k] : past[end]]
            n = count[code]
            total = np.concatenate(([0], np.cumsum(n)))
            yield at + k, ids[np.repeat(start[code] - total[:-1], n) + np.arange(total[-1])], np.diff(total[past[k : end + 1] - past[k]])
        del ids  # its memory may be moved for new pieces


def encode(texts: list[str], tokenizer: str) -> list[bytes]:
    """Token ids of each text as little-endian uint32, without special tokens."""
    return [ids for _, part in _encoded(pa.array(texts, pa.string()), tokenizer) for ids in part]


def _encoded(texts: pa.Array, tokenizer: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first text, ids of each as bytes) of runs of texts."""
    for at, ids, counts in encode_column(texts, tokenizer):
        raw, end = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
        yield at, [raw[a:b] for a, b in zip((end - 4 * counts).tolist(), end.tolist(), strict=True)]


class _File:
    """Writes one file under a name of this attempt, then moves it to its final name."""

    def __init__(self, folder: str, name: str, level: int):
        self.fs, root = fs.FileSystem.from_uri(folder)
        self.final, self.temp = f"{root}/{name}", f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.docs: list[tuple[int | None, bytes]] = []
        self.tokens, self.index, self.seek = 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, ids))
        self.tokens += len(ids) // 4
        if self.tokens >= FRAME_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        ids = [i or 0 for i, _ in self.docs]
        data = b"".join([struct.pack("<I", len(ids)), np.array(ids, "<i8").tobytes(),
                         bytes(i is not None for i, _ in self.docs),
                         np.array([len(b) // 4 for _, b in self.docs], "<u4").tobytes(), *(b for _, b in self.docs)])
        frame = self.zip.compress(data)
        self.out.write(frame)
        self.seek.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.index.append((len(ids), self.tokens, ids[0], ids[-1]))
        self.docs, self.tokens = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<IQqq", *x) for x in self.index)
        self.out.write(struct.pack("<II", _INDEX, len(index)) + index)
        self.seek.append((len(index) + 8, 0, 0))
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, _END)
        self.out.write(struct.pack("<II", _SEEK, len(table)) + table)
        self.out.close()
        self.fs.move(self.temp, self.final)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1,
                      doc_id: str = "doc_id", text: str = "text", level: int = 3) -> None:
    """Encode every whole text and write the ids to files in ``folder``, in
    ascending id order over the file names.

    One range shuffle on the id (then a hash of the text, so equal ids can part)
    sorts the rows; each task writes one file and publishes it by a rename to a
    name fixed by its partition, so a task that runs again replaces its file.
    Null texts count as empty, null ids come first, repeated ids stay as they
    are; an empty table writes no file.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    order = [F.col("i").asc_nulls_first(), F.xxhash64("t")]
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for at, part in _encoded(b.column(1), tokenizer):
                for i, ids in zip(b.column(0).slice(at, len(part)).to_pylist(), part, strict=True):
                    out = out or _File(folder, f"part-{TaskContext.get().partitionId():06d}.tok.zst", level)
                    out.add(i, ids + end)
        if out:
            out.close()
        yield from ()

    src.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "done int").write.format("noop").mode(
        "overwrite").save()


def _tail(folder_fs: fs.FileSystem, path: str) -> Iterator[tuple]:
    """(frame, offset, compressed size, checksum, documents, tokens before in this file, tokens, first id, last id)"""
    with folder_fs.open_input_file(path) as f:
        n, _, end = struct.unpack("<IBI", f.read_at(9, f.size() - 9))
        if end != _END:
            raise ValueError(f"{path} has no seek table")
        sizes = np.frombuffer(f.read_at(12 * n, f.size() - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        starts = np.cumsum(sizes[:, 0]) - sizes[:, 0]
        index = f.read_at(int(sizes[-1, 0]) - 8, int(starts[-1]) + 8)
    before = 0
    for k, (docs, tokens, first, last) in enumerate(struct.iter_unpack("<IQqq", index)):
        yield k, int(starts[k]), int(sizes[k, 0]), int(sizes[k, 2]), docs, before, tokens, first, last
        before += tokens


def read_frame(folder_fs: fs.FileSystem, path: str, offset: int, size: int, checksum: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, tokens per document and token ids of one frame; raises on a bad checksum."""
    with folder_fs.open_input_file(path) as f:
        data = zstandard.ZstdDecompressor().decompress(f.read_at(size, offset))
    if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
        raise ValueError(f"{path}: bad checksum at {offset}")
    n = struct.unpack_from("<I", data)[0]
    ids, has = np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "u1", n, 4 + 8 * n)
    lens = np.frombuffer(data, "<u4", n, 4 + 9 * n).astype(np.int64)
    return [int(i) if h else None for i, h in zip(ids, has, strict=True)], lens, np.frombuffer(data, "<u4", -1, 4 + 13 * n)


FRAME_SCHEMA = "path string, frame int, offset long, size long, checksum long, n_docs long, before long, tokens long, first_id long, last_id long"


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """One row per data frame of the files in ``folder``, from the files' tails alone."""
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok.zst").load(folder).select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                where, path = fs.FileSystem.from_uri(uri)
                rows = [(uri, *x) for x in _tail(where, path)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int32()] + [pa.int64()] * 8, strict=True)],
                    names=[c.split()[0] for c in FRAME_SCHEMA.split(", ")])

    return files.mapInArrow(read, FRAME_SCHEMA)


def read_token_files(spark: SparkSession, folder: str, first_id: int | None = None, last_id: int | None = None,
                     with_ids: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Documents of the files in ``folder``: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32, path, frame, and ``ids`` if asked for.

    With ``first_id`` / ``last_id`` only frames that can hold such documents are
    read and decompressed. Each frame is a row of its own, and rows are dealt to as many tasks
    as the frames' compressed bytes ask for (about ``task_bytes`` each): the rows themselves are so small that
    adaptive execution would fold them into one.
    """
    all_frames = frames(spark, folder)
    totals = all_frames.groupBy("path").agg(F.sum("tokens").alias("n"))  # one row per file
    begin = totals.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("begin"))
    wanted = all_frames
    if first_id is not None:
        wanted = wanted.where(F.col("last_id") >= first_id)
    if last_id is not None:
        wanted = wanted.where(F.col("first_id") <= last_id)
    wanted = wanted.join(begin, "path").select("path", "frame", "offset", "size", "checksum",
                                               (F.col("begin") + F.col("before")).alias("begin"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, path string, frame int" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                where, path = fs.FileSystem.from_uri(r["path"])
                ids, lens, tokens = read_frame(where, path, r["offset"], r["size"], r["checksum"])
                begin = np.cumsum(lens) - lens
                raw = memoryview(np.ascontiguousarray(tokens)).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(begin.tolist(), lens.tolist(), strict=True)]
                n = len(ids)
                cols = [pa.array(ids, pa.int64()), pa.array(begin + r["begin"]), pa.array(lens), pa.array(crc, pa.int64()),
                        pa.array([r["path"]] * n), pa.array([r["frame"]] * n, pa.int32())]
                if with_ids:
                    offsets = pa.array(np.concatenate((begin, [len(tokens)])).astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(offsets, pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    size = wanted.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, min(MOST_TASKS, -(-size // task_bytes)))
    out = wanted.repartition(tasks, "path", "frame").mapInArrow(read, schema)
    if first_id is not None:
        out = out.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        out = out.where(F.col("doc_id") <= last_id)
    return out
