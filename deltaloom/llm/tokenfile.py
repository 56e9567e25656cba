"""Token ids as compressed binary blocks: a static range asymmetric numeral system.

One frequency table, counted over the ids of all documents, is shared by every block and stored with the files. A block holds
whole documents and is decoded without any other block: ``LANES`` coders are interleaved (token i belongs to lane i mod
LANES), so encoding and decoding step through a block with array operations. A block also holds checkpoints, the coders'
states and the position in the words at every ``EVERY``-th step, and ends in a checksum; a reader decodes the stretches
between all checkpoints side by side, or starts from one of them.

Block layout, little-endian: magic ``DLT2``; uint32 number of documents, tokens, words, checkpoints, CRC-32 of the table;
int64 doc_id and uint8 null flag and uint32 length of each document; uint64 states at the start; checkpoints (uint32 step,
uint32 word, uint64 states); uint32 words; uint32 CRC-32 of all that.

A folder has ``table`` (id, n: how often each id of the vocabulary occurs, and the end id) and ``blocks``, rows (part, block,
data) of a Parquet data set in the shared folder. Nothing else is needed to read the ids back. Documents are ranged over the
parts by doc_id, and files are named in that order, so that files, rows and documents ascend by doc_id. Spark's writers commit
them, so a lost executor repeats its task.

Hot ids: rows that share a doc_id, or have none, are ranged by a hash of their ids and by the place where they were read, so
that however many there are they spread over parts.

Defined results: a null or empty text has the end id only; null doc_ids come last; rows with the same doc_id are ordered by a
hash of their ids; rows that repeat are written each; an empty table gives no block; other columns are ignored, whatever their
names. Special tokens' strings in a text are special tokens, as in the library. A text of any length is one document of one
block, so a task holds one whole document at least.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import WRITTEN, map_text, shared_dir, written

MAGIC, LANES, EVERY, BLOCK, SCALE = b"DLT2", 2_048, 64, 524_288, 20
LOW = np.uint64(1 << 31)


class Model:
    """Frequencies of the ids, scaled to 2^SCALE; only ids that occur have a share."""

    def __init__(self, counts: np.ndarray):
        self.mark = zlib.crc32(np.asarray(counts, "<i8").tobytes())
        counts = np.asarray(counts, np.float64)
        used = counts > 0
        total, size = counts.sum(), 1 << SCALE
        freq = np.where(used, np.maximum(1, np.floor(counts / max(total, 1) * size)), 0).astype(np.int64)
        over = int(freq.sum()) - size if used.any() else 0
        order = np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
        at = 0
        while over > 0:  # take from the largest; a share never falls under 1
            take = min(over, int(freq[order[at]]) - 1, max(1, int(freq[order[at]]) // 2))
            freq[order[at]] -= take
            over -= take
            at = (at + 1) % max(1, int(used.sum()))
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """States, words in reading order, checkpoints (step, words read before it, states)."""
        n = len(ids)
        rows = -(-n // LANES)
        state, words, marks = np.full(LANES, LOW, np.uint64), [], []
        for step in range(rows - 1, -1, -1):
            part = ids[step * LANES : (step + 1) * LANES]
            x, f, c = state[: len(part)], self.freq[part], self.start[part]
            full = x >= (f << np.uint64(63 - SCALE))
            if full.any():
                words.append(x[full].astype(np.uint32))
                x = np.where(full, x >> np.uint64(32), x)
            else:
                words.append(np.empty(0, np.uint32))
            q = x // f
            state[: len(part)] = (q << np.uint64(SCALE)) + (x - q * f) + c
            if step % EVERY == 0 and step:
                marks.append((step, state.copy()))
        words.reverse()
        read = np.concatenate([[0], np.cumsum([len(w) for w in words])]) if words else np.zeros(1, np.int64)
        checkpoints = [(step, int(read[step]), x) for step, x in reversed(marks)]
        return state, np.concatenate(words) if words else np.empty(0, np.uint32), checkpoints

    def decode(self, n: int, starts: list[tuple[int, int, np.ndarray]], words: np.ndarray) -> np.ndarray:
        """The ids from the first of ``starts`` on, all stretches between these (step, word, states) at once."""
        rows, first = -(-n // LANES), starts[0][0]
        out = np.zeros((rows - first, LANES), np.uint32)
        step, at = (np.array(x, np.int64) for x in zip(*[(s, w) for s, w, _ in starts]))
        state = np.stack([x for _, _, x in starts])
        many = np.diff(np.append(step, rows))
        mask = np.uint64((1 << SCALE) - 1)
        words = words.astype(np.uint64)
        for i in range(int(many.max(initial=0))):
            live = int((many > i).sum())  # stretches are equally long, but for the last one
            if live < len(state):
                state, at, step = state[:live], at[:live], step[:live]
            x = state
            slot = x & mask
            s = self.symbol[slot]
            if int(step[-1]) + i == rows - 1 and (over := rows * LANES - n):  # lanes without a token stand still
                s[-1, LANES - over :] = 0
                new = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.start[s]
                new[-1, LANES - over :] = LOW
                x = new
            else:
                x = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.start[s]
            out[step + i - first] = s
            low = x < LOW
            found = low.sum(1)
            row, lane = np.nonzero(low)
            if len(row):
                x[row, lane] = (x[row, lane] << np.uint64(32)) | words[np.repeat(at - np.cumsum(found) + found, found) + np.arange(len(row))]
                at = at + found
            state = x
        return out.ravel()[: n - first * LANES]


def pack(model: Model, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    state, words, marks = model.encode(flat)
    parts = [
        MAGIC,
        struct.pack("<5I", len(ids), len(flat), len(words), len(marks), model.mark),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array([len(x) for x in ids], "<u4").tobytes(),
        state.astype("<u8").tobytes(),
        *[struct.pack("<2I", step, at) + x.astype("<u8").tobytes() for step, at, x in marks],
        words.astype("<u4").tobytes(),
    ]
    data = b"".join(parts)
    return data + struct.pack("<I", zlib.crc32(data))


def unpack(model: Model, data: bytes, checkpoint: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a block; with ``checkpoint``, the ids from that checkpoint on."""
    if data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a token block, or its checksum fails")
    docs, n, n_words, n_marks, table = struct.unpack_from("<5I", data, 4)
    if table != model.mark:
        raise ValueError("the block was written with another frequency table")
    at = 24

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, count, at)
        at += found.nbytes
        return found

    doc_ids, null, sizes, state, marks = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u8", LANES), []
    for _ in range(n_marks):
        step, word = take("<u4", 2).tolist()
        marks.append((step, word, take("<u8", LANES)))
    words = take("<u4", n_words)
    starts = [(0, 0, state), *marks] if checkpoint is None else marks[checkpoint:]
    ids = model.decode(n, starts, words) if n else np.empty(0, np.uint32)
    return [None if x else d for d, x in zip(doc_ids.tolist(), null.tolist())], sizes, ids


class ByteEncoder:
    """Ids of texts as the ``tokenizers`` library gives them for a byte-level vocabulary file.

    Where ids follow the order of the merges, as in such files they do, ``tiktoken`` gives the same ids several times
    faster from the same vocabulary. It recurses on long runs, so it only gets texts whose runs of blanks and of other
    characters are shorter than ``RUN``; all others, texts with special tokens' strings and any other file go to the library.
    """

    #: What the library's byte-level pre-tokeniser cuts.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    RUN = 2_000
    BLANK, OTHER = re.compile(r"[^\S\x1c-\x1f]"), re.compile(r"[\S\x1c-\x1f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = self._fast(path)

    def _fast(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        ids = [vocab[a + b] for a, b in pairs]
        byte_level = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not byte_level or ids != sorted(set(ids)) or len(vocab) != len(ids) + 256 or min(ids) < 256:
            return None
        letter = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(letter.__getitem__, token)): i for token, i in vocab.items() if token not in self.special}
        return tiktoken.Encoding("from-file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def has_long_run(self, text: str) -> bool:
        """Is there a run of ``RUN`` characters? It would hold a whole stretch of half that length, as counted from the start."""
        half = self.RUN // 2
        return any(not (self.BLANK.search(text, i, i + half) and self.OTHER.search(text, i, i + half)) for i in range(0, len(text) - half + 1, half))

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special) or self.has_long_run(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def texts(self, texts: list[str | None], end: int | None, kind: str = "<u2") -> list[bytes]:
        """Little-endian ids of each text, followed by ``end``."""
        last = b"" if end is None else np.array([end], kind).tobytes()
        if sys.byteorder == "little":
            code = {"<u2": "H", "<u4": "I"}[kind]
            return [array(code, self.ids(t)).tobytes() + last if t else last for t in texts]
        return [np.array(self.ids(t), kind).tobytes() + last if t else last for t in texts]


def vocabulary_size(path: str, end: int | None) -> int:
    """One more than the largest id that can occur."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return 1 + max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec["added_tokens"]], 0 if end is None else end])


def kind_of(vocabulary: int) -> str:
    """How ids are kept between the encoder and the blocks."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def token_rows(docs: DataFrame, path: str, end: int | None, kind: str) -> DataFrame:
    """(doc_id, tie, place, ids): ids as little-endian numbers; a hash of them; where the row was read."""

    def make():
        encoder = ByteEncoder(path)
        place = 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal place
            ids = encoder.texts(batch.column("text").to_pylist(), end, kind)
            place += len(ids)
            ties = np.array([xxhash.xxh64_intdigest(x) for x in ids], np.uint64).view(np.int64)
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "tie": pa.array(ties), "place": pa.array(np.arange(place - len(ids), place)), "ids": pa.array(ids, pa.binary())})

        return step

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, tie long, place long, ids binary")


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; as many rows reach the driver as the vocabulary has ids."""
    kind = kind_of(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=vocabulary)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.int64())})

    out = np.zeros(vocabulary, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def write_tokens(docs: DataFrame, path: str, end: int | None = 2, file_tokens: int = 8_000_000, folder: str | None = None) -> str:
    """Encode every document and write the table and the blocks; returns the folder.

    ``file_tokens``: tokens in a file, about; a file has the blocks of one part.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary_size(path, end)
    kind = kind_of(vocabulary)
    if folder is None:
        folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
        WRITTEN.append(folder)
    tokens = written(token_rows(docs, path, end, kind), "tokens")
    counts = id_counts(tokens, vocabulary)
    spark.createDataFrame(pa.table({"id": pa.array(np.arange(vocabulary)), "n": pa.array(counts)})).coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(counts)  # the vocabulary bounds it

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = Model(shared.value)
        part, number, doc_ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            data = pack(model, doc_ids, held)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                if size >= BLOCK:
                    yield flush()
                    number, doc_ids, held, size = number + 1, [], [], 0
                ids = np.frombuffer(raw, kind).astype(np.uint32)
                doc_ids.append(d)
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()

    order = (F.col("doc_id").asc_nulls_last(), F.col("tie").asc(), F.col("place").asc())
    parts = max(1, min(20_000, int(counts.sum()) // file_tokens))
    ordered = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    ordered.mapInArrow(blocks, "part int, block int, data binary").write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    return folder


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``folder``; with ``with_ids`` also ids (array of int)."""
    table = spark.read.schema("id long, n long").parquet(f"{folder}/table").toArrow()  # as many rows as the vocabulary has ids
    counts = np.zeros(table.num_rows, np.int64)
    counts[table["id"].to_numpy()] = table["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    schema = "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            for part, block, data in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("data")):
                doc_ids, sizes, ids = unpack(model, data.as_py())
                ends = np.cumsum(sizes.astype(np.int64))
                starts, raw = ends - sizes, memoryview(ids.astype("<u4").tobytes())
                columns = {
                    "part": pa.array([part] * len(sizes), pa.int32()),
                    "block": pa.array([block] * len(sizes), pa.int32()),
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "inside": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(sizes.astype(np.int64), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([ids[a:b].tolist() for a, b in zip(starts.tolist(), ends.tolist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    found = written(spark.read.schema("part int, block int, data binary").parquet(f"{folder}/blocks").mapInArrow(run, schema), "token-index")
    # blocks are few (one for each 524,288 tokens); parts fewer
    blocks = found.groupBy("part", "block").agg(F.sum("n_tokens").alias("in_block"))
    parts = blocks.groupBy("part").agg(F.sum("in_block").alias("in_part"))
    before = parts.select(F.col("part"), (F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_part")).alias("part_start"))
    inside = blocks.select("part", "block", (F.sum("in_block").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_block")).alias("block_start"))
    rows = found.join(inside.join(before, "part"), ["part", "block"])
    return rows.select("doc_id", (F.col("part_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
