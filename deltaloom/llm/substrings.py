"""Removal of repeated passages: words covered by a window of ``window`` words that also starts anywhere else.

Exact matching statistics come from FM-indexes over shards; anchors make sure that each stretch of text meets only the one
shard that can hold a match. Of the ``ANCHOR``-grams in a window the one with the smallest hash is its anchor; equal windows
have equal anchors. A document falls into segments, runs of windows with one anchor, about two for every 29 words.

1. Segments are rows of an anchor hash and a hash of their words. Anchors that occur once can't repeat: most rows end here.
2. Segments with the same words become one content with a multiplicity. Copies, however many, are counted before anything
   else happens to them.
3. Contents are fetched as words, once each, and dealt to shards by anchor. A shard builds an FM-index over its contents and
   streams them through it backwards: the matching statistics at each window's end, up to a window's length, tell whether the
   window occurs at least twice, where a suffix counts as often as its content occurs. An anchor with more than ``HOT``
   contents is dealt by the words of single windows instead; equal windows become one with a multiplicity before they are.
4. The repeated windows go back to the occurrences of their segments, and those to the documents.

Anchors, contents and windows are counted by aggregations that combine where rows are read; the few anchors and contents
that have a large share of all rows meet them by broadcast. Texts are shuffled once; both uses read the same exchange.
Anchors and contents are 64-bit hashes of the words, always used together; the symbols of a shard's index are its distinct
words, told apart by 64-bit hashes.

Defined results: a null or empty text has no words and the hash of the empty string; a document of fewer words than a window
loses none; rows that repeat in full repeat each other's windows; a null doc_id is kept as null; of equal smallest hashes in a
window the first is the anchor; a text of any length is cut into segments, and a task holds one whole text at least; an empty
table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_STEP, WORD_RE, map_text, meet, released, written
from .components import HUB, HUBS
from .fmindex import FmIndex
from .words import POWERS, U, by_text, grams, mixed, word_hashes

WINDOW, ANCHOR, HOT, SHARD = 35, 8, 4_096, 10_000


def segments(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, hash of the words, first window and number of windows of each segment of a document."""
    windows = len(h) - window + 1
    if windows <= 0:
        return np.empty(0, U), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    g = grams(h, anchor)
    width = window - anchor + 1
    place = np.lib.stride_tricks.sliding_window_view(g, width).argmin(1) + np.arange(windows)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    many = np.diff(np.append(first, windows))
    up, down = POWERS(len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed(h, 9) * up[: len(h)], dtype=U)])
        content = (sums[first + many + window - 1] - sums[first]) * down[first]
    return g[place[first]], mixed(content ^ mixed(many.astype(U), 10) ^ mixed((place[first] - first).astype(U), 11)), first, many


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and (did, th), which name a row: equal for rows that repeat in full, and only for those."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", did.alias("did"), F.xxhash64("text").alias("th"))


def segment_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [segments(h, window, anchor) for h in by_text(*word_hashes(batch.column("text")))]
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            seed, seg, at, many = (np.concatenate(x) for x in zip(*found))
            # a document that repeats itself has the same segment over and over: that is one row
            order = np.lexsort((at, seg, seed, row))
            row, seed, seg, at, many = row[order], seed[order], seg[order], at[order], many[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (seed[1:] != seed[:-1]) | (seg[1:] != seg[:-1])])) if len(row) else np.empty(0, np.int64)
            ends = np.append(new[1:], len(row))
            rest = [at[a + 1 : b] if b - a > 1 else None for a, b in zip(new.tolist(), ends.tolist())] if len(new) < len(row) else [None] * len(new)
            did, th = (batch.column(c).to_numpy()[row[new]] for c in ("did", "th"))
            return pa.RecordBatch.from_pydict({
                "seed": pa.array(seed[new].view(np.int64)), "seg": pa.array(seg[new].view(np.int64)), "did": pa.array(did), "th": pa.array(th),
                "at": pa.array(at[new], pa.int32()), "many": pa.array(many[new], pa.int32()), "rest": pa.array(rest, pa.list_(pa.int32())),
            })

        return step

    return map_text(rows.select("did", "th", "text"), make, "seed long, seg long, did long, th long, at int, many int, rest array<int>", most=SMALL_STEP)


def fetched(rows: DataFrame, window: int) -> DataFrame:
    """(text, wants) -> the words of every wanted content; of a hot anchor, window by window under the window's hash."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, wants in zip(batch.column("text").to_pylist(), batch.column("wants").to_pylist()):
                words = WORD_RE.findall(text)
                for w in wants:
                    if w["hot"]:
                        for b in range(w["many"]):
                            part = " ".join(words[w["at"] + b : w["at"] + b + window])
                            key = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "big", signed=True)
                            out.append((key, w["seed"], w["seg"], b, 1, w["n"], part))
                    else:
                        out.append((w["seed"], w["seed"], w["seg"], None, w["many"], w["n"], " ".join(words[w["at"] : w["at"] + w["many"] + window - 1])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["deal", "seed", "seg", "bit", "many", "n", "words"]) if out else None

        return step

    return map_text(rows, make, "deal long, seed long, seg long, bit int, many int, n long, words string")


def repeated_windows(contents: pa.Array, times: np.ndarray, window: int) -> np.ndarray:
    """For each distinct content, the windows (bits) that occur at least twice in all of them, each as often as ``times`` says."""
    hashes, sizes = word_hashes(contents)
    distinct, symbols = np.unique(hashes, return_inverse=True)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)  # a zero after each content
    text[np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols + 1
    del hashes, symbols
    index = FmIndex(text, len(distinct) + 1, int(sizes.max(initial=window)), np.repeat(np.minimum(times, 2), sizes + 1))
    masks, live, ends = np.zeros(len(sizes), np.int64), np.arange(len(sizes)), starts + sizes
    while len(live):
        # from an end backwards: all windows in the longest match repeat, and the window in front of them is next
        end = ends[live]
        length = index.matching_lengths(text, end, len(text))
        hit = length >= window
        first = (end - length - starts[live])[hit]
        masks[live[hit]] |= ((np.int64(1) << (length[hit] - window + 1)) - 1) << first
        ends[live] = np.where(hit, end - length - 1 + window, end - 1)
        live = live[ends[live] - starts[live] >= window]
    return masks


def masks(contents: DataFrame, window: int, shards: int) -> DataFrame:
    """(deal, seed, seg, n, words) -> (seed, seg, mask), in about ``shards`` shards."""

    def run(key, group):
        column = group["words"]
        coded = pa.concat_arrays(column.chunks).dictionary_encode()  # equal contents are one
        code = coded.indices.to_numpy()
        found = repeated_windows(coded.dictionary, np.bincount(code, group["n"].to_numpy()).astype(np.int64), window)
        released()
        return pa.table({"seed": group["seed"], "seg": group["seg"], "mask": pa.array(found[code], pa.int64())})

    contents = contents.select("seed", "seg", "n", "words", F.pmod(F.xxhash64("deal"), F.lit(shards)).alias("shard"))
    return contents.groupBy("shard").applyInArrow(run, "seed long, seg long, mask long")


def removed(rows: DataFrame, window: int, keep_text: bool = False) -> DataFrame:
    """(doc_id, text, marks) -> doc_id, n_words, n_removed, kept_sha256 (and kept, the text that is left)."""

    blank = pa.scalar(" ", pa.large_string())

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut = pc.ascii_split_whitespace(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
            words = cut.flatten()
            owner = np.repeat(np.arange(len(cut)), pc.list_value_length(cut).to_numpy())
            full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # the splitter gives an empty one for blanks at either end
            words, owner = words.filter(pa.array(full)), owner[full]
            sizes = np.bincount(owner, minlength=len(cut))
            first = np.cumsum(sizes) - sizes
            edge = np.zeros(len(owner) + 1, np.int32)
            for start, marks in zip(first.tolist(), batch.column("marks").to_pylist()):
                for m in marks or ():
                    bits = start + np.flatnonzero((m["mask"] >> np.arange(63)) & 1)
                    at = (np.array([m["at"], *(m["rest"] or ())])[:, None] + bits).ravel()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
            keep = np.cumsum(edge)[:-1] == 0
            left = np.bincount(owner[keep], minlength=len(cut))
            offsets = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int64())
            kept = pc.binary_join(pa.LargeListArray.from_arrays(offsets, words.filter(pa.array(keep))), blank)
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(sizes - left, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in kept], pa.string())}
            return pa.RecordBatch.from_pydict(columns | ({"kept": kept.cast(pa.string())} if keep_text else {}))

        return step

    return map_text(rows, make, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """Every row of ``docs`` without its repeated passages; windows are judged on the input. ``window`` is 62 + ``anchor`` at most."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs)
    times = F.when(F.col("rest").isNull(), 1).otherwise(1 + F.size("rest"))
    all_segments = written(segment_rows(rows, window, anchor).withColumn("times", times), "segments")
    total = all_segments.count()
    seeds = written(all_segments.groupBy("seed").agg(F.sum("times").alias("in_seed")).where("in_seed > 1"), "anchors")
    again = written(meet(all_segments, seeds, ["seed"], F.col("in_seed") > max(HUB, total // HUBS)).drop("in_seed"), "segments-again")
    contents = again.groupBy("seed", "seg").agg(F.sum("times").alias("n"), F.min(F.struct("did", "th", "at")).alias("one"), F.first("many").alias("many"))
    contents = written(contents.select("seed", "seg", "n", "many", "one.did", "one.th", "one.at"), "contents")
    # anchors of more than ``hot`` contents, one of ``hot`` contents at most
    crowded = contents.groupBy("seed").agg(F.count("*").alias("contents")).where(F.col("contents") > hot).select("seed", F.lit(True).alias("hot"))
    wanted = contents.join(F.broadcast(crowded), "seed", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    want = F.struct("seed", "seg", "at", "many", "n", "hot")
    wants = wanted.groupBy("did", "th").agg(F.collect_list(want).alias("wants"))  # of one document: bounded by its length
    texts = rows.repartition(parts, "did", "th")  # both uses share this exchange
    # rows that repeat in full share their name; one of them is enough here, and one is certain to be there
    words = fetched(texts.join(wants.hint("merge"), ["did", "th"]).select("doc_id", "text", "wants"), window)  # doc_id: the same columns, so the same exchange
    words = written(words, "contents-as-words")
    plain, single = words.where("bit IS NULL"), words.where("bit IS NOT NULL")
    found = masks(plain, window, max(1, plain.count() // SHARD))
    if windows := single.count():
        one = single.groupBy("deal").agg(F.first("words").alias("words"), F.sum("n").alias("n")).select("deal", F.col("deal").alias("seed"), F.lit(0).cast("long").alias("seg"), "n", "words")
        one = written(one, "windows")
        repeated = written(masks(one, window, max(1, one.count() // SHARD)).where("mask <> 0").select(F.col("seed").alias("deal")).join(one.select("deal", "n"), "deal"), "windows-again")
        back = meet(single.select("deal", "seed", "seg", "bit"), repeated, ["deal"], F.col("n") > max(HUB, windows // HUBS))
        found = found.union(back.select("seed", "seg", F.expr("shiftleft(1L, bit) AS mask")))
    found = found.where("mask <> 0").groupBy("seed", "seg").agg(F.bit_or("mask").alias("mask"))
    found = written(found.join(contents.select("seed", "seg", "n"), ["seed", "seg"]), "masks")
    marks = meet(again, found, ["seed", "seg"], F.col("n") > max(HUB, total // HUBS)).groupBy("did", "th", "at").agg(F.bit_or("mask").alias("mask"), F.first("rest").alias("rest"))
    marks = marks.groupBy("did", "th").agg(F.collect_list(F.struct("at", "mask", "rest")).alias("marks"))
    return removed(texts.join(marks.hint("merge"), ["did", "th"], "left").select("doc_id", "text", "marks"), window, keep_text)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, j, w[j] AS word, CASE WHEN j + 34 <= len(w) THEN md5(array_to_string(w[j:j + 34], ' ')) END AS win FROM d, unnest(range(1, len(w) + 1)) r(j)),
t AS (SELECT win FROM p WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
m AS (SELECT doc_id, j, word, max(CASE WHEN t.win IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN t ON p.win = t.win),
k AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (gone = 0), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
