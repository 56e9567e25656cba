"""Passages of benchmark items in documents: every word of a document inside a window of consecutive item words.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.

1. Items are cut into pieces of ``PIECE`` words, each with the first ``window - 1`` words of the next one, and pieces are dealt
   to blocks of about ``BLOCK_WORDS`` words. The driver fetches one block at a time: its distinct windows, the items of each and
   its vocabulary have a bounded size and go to the workers with the function. Usual benchmarks are one block; more blocks
   are as many passes over the documents.
2. A shard is about ``SHARD_BYTES`` of documents, one whole text at least. Its words become numbers of the block's vocabulary;
   words outside it separate stretches, and stretches shorter than the shortest window can't hold one. Equal texts of a
   shard are one.
3. The shard's stretches are indexed: Burrows-Wheeler transform in a wavelet tree, with every 16th place. Windows are searched
   backwards through the ranks, all of a block at once, and each occurrence is located by walking to a sampled place.
4. Occurrences are merged to spans of words, and their windows name the items of a document.

No text is shuffled. With several blocks, the spans of a row meet by (doc_id, hash of the text), which name a row: rows that
repeat in full have the same spans. Words are told apart by 64-bit hashes.

Defined results: a null or empty text has no words, no spans and no items, and so has any text if the table of items is
empty; an item without text or words has no window; an item without an id hits words but isn't listed; items that share an id are one;
equal windows of several items name all of them; rows that repeat, null ids and ids that repeat are kept row by row; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, written
from .fmindex import SampledIndex
from .words import U, Numbers, gaps, text_bytes, words_of

WINDOW, PIECE, BLOCK_WORDS, SHARD_BYTES = 10, 4_096, 500_000, 4_000_000
#: Words are letters, digits and everything past ASCII.
GAP = gaps("".join(map(chr, (*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))))
GAP[65:91] = False  # lower-cased first
SPANS = "array<struct<first: int, last: int, start: int, end: int>>"


def item_pieces(items: DataFrame, window: int) -> DataFrame:
    """(item, piece, words): hashes of the words of every piece of every item that has words."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = text_bytes(batch.column("text"))
            h, starts, _ = words_of(data, at, GAP, lower=True)
            cuts = np.searchsorted(starts, at)
            names, numbers, pieces = [], [], []
            for name, lo, hi in zip(batch.column("item").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                for k, first in enumerate(range(lo, max(lo + 1, hi - window + 1), PIECE) if hi > lo else ()):
                    names.append(name)
                    numbers.append(k)
                    pieces.append(h[first : min(hi, first + PIECE + window - 1)].view(np.int64))
            return pa.RecordBatch.from_pydict({"item": pa.array(names, pa.string()), "piece": pa.array(numbers, pa.int32()), "words": pa.array(pieces, pa.list_(pa.int64()))})

        return step

    return map_text(items.select(F.col("item_id").cast("string").alias("item"), "text"), make, "item string, piece int, words array<long>")


class Phrases:
    """The distinct windows of one block as rows of symbols 1 .. n, their lengths, and the items that have each."""

    def __init__(self, pieces: list[tuple[str | None, np.ndarray]], window: int):
        words = np.concatenate([p for _, p in pieces]).view(U) if pieces else np.empty(0, U)
        vocabulary, symbols = np.unique(words, return_inverse=True)
        self.vocabulary, self.alphabet = vocabulary, len(vocabulary) + 1
        names = sorted({n for n, _ in pieces if n is not None})
        number = {n: i for i, n in enumerate(names)} | {None: -1}
        self.items = np.array(names, object)
        rows, owner, start = [np.zeros((0, window), np.int32)], [np.empty(0, np.int64)], 0
        for name, piece in pieces:
            mine = (symbols[start : start + len(piece)] + 1).astype(np.int32)
            start += len(piece)
            mine = mine if len(mine) >= window else np.pad(mine, (0, window - len(mine)))
            found = np.lib.stride_tricks.sliding_window_view(mine, window)
            rows.append(found)
            owner.append(np.full(len(found), number[name]))
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        self.windows, place = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.empty(0, np.int64))
        self.lengths = (self.windows > 0).sum(1)
        pairs = np.unique(np.stack([place.ravel(), owner], 1)[owner >= 0], axis=0) if len(rows) else np.empty((0, 2), np.int64)
        self.of, self.from_ = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))

    def items_of(self, windows: np.ndarray) -> list[str]:
        return self.items[np.unique(np.concatenate([self.of[self.from_[w] : self.from_[w + 1]] for w in windows]))].tolist()


def stretches(symbols: np.ndarray, owner: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of symbols above 0 of one owner, ``shortest`` long at least, a 0 after each; and the places of all in ``symbols``."""
    known = symbols > 0
    new = known.copy()
    new[1:] &= ~known[:-1] | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    ordinal = np.cumsum(new)[known] - 1
    size = np.bincount(ordinal, minlength=len(starts))
    long_enough = size >= shortest
    kept = np.flatnonzero(known)[long_enough[ordinal]]
    run = (np.cumsum(long_enough) - 1)[ordinal[long_enough[ordinal]]]
    text, place = np.zeros(len(kept) + int(long_enough.sum()), np.int64), np.full(len(kept) + int(long_enough.sum()), -1, np.int64)
    at = np.arange(len(kept)) + run
    text[at], place[at] = symbols[kept], kept
    return text, place


def occurrences(symbols: np.ndarray, owner: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """The places and the windows of all occurrences in one shard, by its index."""
    none = np.empty(0, np.int64)
    if not len(phrases.windows):
        return none, none
    text, place = stretches(symbols, owner, int(phrases.lengths.min()))
    if not len(text):
        return none, none
    index = SampledIndex(text, phrases.alphabet)
    low, high = index.search(phrases.windows, phrases.lengths)
    found = np.flatnonzero(low < high)
    many = (high - low)[found]
    first = np.cumsum(many) - many
    rows = np.arange(int(many.sum())) - np.repeat(first, many) + np.repeat(low[found], many)
    return place[index.locate(rows)], np.repeat(found, many)


def one_pass(rows: DataFrame, phrases: Phrases, keep_text: bool) -> DataFrame:
    """(doc_id, th, text) -> doc_id, th, n_words, spans, items of one block (and text)."""

    def make():
        number = Numbers(phrases.vocabulary)

        def shard(texts: pa.Array) -> tuple[list, list, list]:
            data, at = text_bytes(texts)
            h, starts, ends = words_of(data, at, GAP, lower=True)
            cuts = np.searchsorted(starts, at)
            sizes = np.diff(cuts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            where, which = occurrences(number(h) + 1, owner, phrases)
            spans, items = [[] for _ in sizes], [[] for _ in sizes]
            if len(where):
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, where, 1)
                np.add.at(edge, where + phrases.lengths[which], -1)
                hit = np.cumsum(edge)[:-1] > 0
                new = hit.copy()
                new[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
                over = hit.copy()
                over[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
                first, last = np.flatnonzero(new), np.flatnonzero(over)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                zero = points[at[owner[first]]]
                for doc, *span in zip(owner[first].tolist(), (first - cuts[owner[first]]).tolist(), (last + 1 - cuts[owner[first]]).tolist(), (points[starts[first]] - zero).tolist(), (points[ends[last]] - zero).tolist()):
                    spans[doc].append(dict(zip(("first", "last", "start", "end"), span)))
                pairs = np.unique(owner[where] * len(phrases.windows) + which)
                docs, windows = pairs // len(phrases.windows), pairs % len(phrases.windows)
                begins = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
                for doc, mine in zip(docs[begins].tolist(), np.split(windows, begins[1:])):
                    items[doc] = phrases.items_of(mine)
            return sizes.tolist(), spans, items

        kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "end")]))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = batch.column("text").dictionary_encode()
            code, found = coded.indices, shard(coded.dictionary)
            n_words, spans, items = (pa.array(x, t).take(code) for x, t in zip(found, (pa.int64(), kind, pa.list_(pa.string()))))
            columns = {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "n_words": n_words, "spans": spans, "items": items}
            return pa.RecordBatch.from_pydict(columns | ({"text": batch.column("text")} if keep_text else {}))

        return step

    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    return map_text(rows, make, f"doc_id long, th long, n_words long, spans {SPANS}, items array<string>" + ", text string" * keep_text, most=SHARD_BYTES)


def merged(found: DataFrame) -> DataFrame:
    """(doc_id, th, spans, items) with lists of several blocks -> spans that overlap or touch joined, items once and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lists in batch.column("spans").to_pylist():
                mine: list[dict] = []
                for s in sorted((s for x in lists for s in x), key=lambda s: s["first"]):
                    if mine and s["first"] <= mine[-1]["last"]:
                        if s["last"] > mine[-1]["last"]:
                            mine[-1] |= {"last": s["last"], "end": s["end"]}
                    else:
                        mine.append(s)
                out.append(mine)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "th": batch.column("th"), "spans": pa.array(out, pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "end")]))), "items": batch.column("items")})

    lists = found.groupBy("doc_id", "th").agg(F.collect_set("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return lists.mapInArrow(run, f"doc_id long, th long, spans {SPANS}, items array<string>")


def passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep_text: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans and items of every row (and text). A span: its first word and the one after its last, and the
    same in code points; ``items``: the ids, as strings, of items with a window in the text, in order."""
    pieces = written(item_pieces(items, window), "item-pieces")
    blocks = max(1, -(-(pieces.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "piece", "words"), F.lit(blocks)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    passes = []
    for block in range(blocks):  # a bounded number of words each
        mine = [(r["item"], np.array(r["words"], np.int64)) for r in pieces.where(F.col("block") == block).collect()]
        passes.append(one_pass(rows, Phrases(mine, window), keep_text and not block))
    if blocks == 1:
        return passes[0].drop("th")
    found = [written(p.where("size(spans) > 0") if i else p, "item-spans") for i, p in enumerate(passes)]
    several = found[0].where("size(spans) > 0").select("doc_id", "th", "spans", "items")
    for p in found[1:]:
        several = several.union(p.select("doc_id", "th", "spans", "items"))
    both = merged(several).select(F.col("doc_id").alias("id"), F.col("th").alias("hash"), F.col("spans").alias("s"), F.col("items").alias("i"))
    all_rows = found[0].join(both, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("hash")), "left")
    return all_rows.select("doc_id", "n_words", F.coalesce("s", "spans").alias("spans"), F.coalesce("i", "items").alias("items"), *["text"] * keep_text)


def digests(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    found = passages(docs, items, window)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text and spans of every row, the spans cut out of the text."""
    found = passages(docs, items, window, keep_text=True)
    # what stands in front of span i, and behind the last one
    part = "substring(text, IF(i = 0, 0, get(spans, i - 1).end) + 1, IF(i = size(spans), length(text), get(spans, i).start) - IF(i = 0, 0, get(spans, i - 1).end))"
    return found.select("doc_id", F.expr(f"array_join(transform(sequence(0, size(spans)), i -> {part}), '')").alias("text"), "spans")


OP11_SQL = r"""
WITH i AS (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + 9], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) x(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, k, s.size, array_to_string(w[k:k + s.size - 1], ' ') AS g FROM d, sizes s, unnest(range(1, len(w) - s.size + 2)) x(k)),
o AS (SELECT p.doc_id, p.k, p.size, win.item_id FROM p JOIN win ON p.g = win.g AND p.size = win.size),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM o, unnest(range(k, k + size)) x(j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM o WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
