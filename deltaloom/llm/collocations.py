"""Collocations: phrases of 2 to 4 words that occur more often together than apart, for each language.

1. Words are counted for each language. Those of ``least`` occurrences or more get a symbol: the ``NUMBERED`` most frequent
   ones their place in that order, others, if there are more, a hash. Where all have a place, other words only separate.
2. A shard is about ``SHARD_WORDS`` words of documents. Every position enters the next four words of its piece in a
   count trie. Serialised in order, a trie is its deepest paths with counts: a node's count is the sum of those below it.
3. Tries are cut at the same paths everywhere, and the parts of a range of prefixes meet in one task, which merges the
   sorted runs. Paths to cut at are quantiles of a sample of positions; they say how even the ranges are, not what comes out.
4. A walk over a merged part gives every node its count and those of its ancestors, the left parts. Nodes on either edge of a
   part may go on in the next one; their counts are summed, and what stands below them gets its ancestors' counts from there.
5. A suffix link goes from a node to that of its words without the first ones, the right parts: a join on paths.
   The longest phrase that counts against a candidate has one word more, since longer ones occur no more often.

A candidate's score is the lowest over its cuts, in whole numbers. Only phrases that reach their language's lowest listed score
get their words back, and every task keeps the first ``top`` of what it has before they meet.

Bounds: the driver holds NUMBERED words at most (16 bytes each) and the sample, 64 positions for each range. A range has
about ``RANGE_WORDS`` positions; what repeats is one path of a shard. Frequent right parts meet by broadcast, those with more
than 1 / ``SHARES`` of all words, so 4 * SHARES at most.

Defined results: a null text is empty, a null language is ``und``; empty texts and pieces have no words; rows that repeat count as often as
they are there; a null doc_id is like any other; ties go to the smallest phrase in the order of UTF-8 bytes; an empty table gives no rows; other columns are
ignored, whatever their names. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_STEP, map_text, meet, released, steps, written
from .words import U, Numbers, gaps, mixed, text_bytes, words_of

DEPTH, LEAST, TOP = 4, 30, 2_000
NUMBERED, SHARD_WORDS, RANGE_WORDS, SAMPLED, SHARES = 1 << 20, 1_000_000, 1_000_000, 200_000, 10_000
_BREAKS = gaps(".,;:!?\n\x0b\x0c\r")
_GAPS = _BREAKS | gaps(" \t")
PATH = ["s1", "s2", "s3", "s4"]
_CODEC = "zstd"


def cleaned(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def hashed_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Hashes of words with their language, the piece and the document of each, and where words are: (bytes, starts, ends)."""
    data, at = text_bytes(batch.column("text"))
    h, starts, ends = words_of(data, at, _GAPS, lower=True)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(np.searchsorted(starts, at)))
    coded = batch.column("lang").dictionary_encode()
    salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in coded.dictionary.to_pylist()], U)
    piece = np.cumsum(_BREAKS[data])[starts] + doc if len(starts) else np.empty(0, np.int64)
    return mixed(h ^ salts[coded.indices.to_numpy()[doc]]), piece, doc, (data, starts, ends)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, h, n) of all words."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            h, _, doc, (data, starts, ends) = hashed_words(batch)
            distinct, first, many = np.unique(h, return_index=True, return_counts=True)
            raw = data.tobytes()
            words = [raw[a:b].lower().decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            langs = batch.column("lang").take(pa.array(doc[first]))
            return pa.RecordBatch.from_pydict({"lang": langs, "word": pa.array(words, pa.string()), "h": pa.array(distinct.view(np.int64)), "n": pa.array(many, pa.int64())})

        return step

    found = map_text(docs, make, "lang string, word string, h long, n long", most=SMALL_STEP)
    return found.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n"))


class Symbols:
    """Symbols of hashes of words: places from 1 in the list, 0 for others if the list is complete, else their hash."""

    def __init__(self, hashes: np.ndarray, complete: bool):
        self.hashes, self.complete, self.number = hashes, complete, None

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.number is None:
            self.number = Numbers(self.hashes)
        place = self.number(h) + 1
        return place if self.complete else np.where(place > 0, place, (h >> U(2) | U(1 << 62)).view(np.int64))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"number": None}


def sorted_paths(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct paths in order and how often each occurs; ``counts``: how often each of ``columns`` does, 1 if not given."""
    if not len(columns[0]):
        return columns, np.empty(0, np.int64)
    bits = int(max(c.max() for c in columns)).bit_length()
    table = None
    if bits * DEPTH > 63:
        table, ranks = np.unique(np.concatenate(columns), return_inverse=True)
        columns, bits = np.split(ranks.ravel(), DEPTH), max(1, (len(table) - 1).bit_length())
    step = 1 if bits * DEPTH <= 63 else 2  # in one number, or in two
    packed = [np.zeros(len(columns[0]), np.int64) for _ in range(step)]
    for k, c in enumerate(columns):
        at = k * step // DEPTH
        packed[at] <<= bits
        packed[at] |= c
    if counts is None and step == 1:
        packed = [np.sort(packed[0])]
    else:
        order = np.argsort(packed[0], kind="stable") if step == 1 else np.lexsort(packed[::-1])
        packed, counts = [p[order] for p in packed], np.ones(len(order), np.int64) if counts is None else counts[order]
    new = np.ones(len(packed[0]), bool)
    new[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in packed])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(new))) if counts is None else np.add.reduceat(counts, first)
    mask, out = (1 << bits) - 1, []
    for k in range(DEPTH):
        at = k * step // DEPTH
        below = (at + 1) * DEPTH // step - 1 - k
        c = packed[at][first] >> (bits * below) & mask
        out.append(c if table is None else table[c])
    return out, counts


def cut_places(columns: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """For each of ``keys`` (rows of DEPTH symbols) the first of the sorted paths that isn't smaller."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(columns[0]), np.int64)
    for c, wanted in zip(columns, keys.T):
        bounds = []
        for strictly in (False, True):
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                mid = np.where(open_, (a + b) // 2, 0)
                right = open_ & ((c[mid] <= wanted) if strictly else (c[mid] < wanted))
                a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
            bounds.append(a)
        low, high = bounds
    return low


def serialised(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted paths and counts, byte by byte of all symbols, compressed."""
    wide = "<i8" if max(int(c.max()) for c in columns) >> 31 else "<i4"
    often = "<u1" if counts.max() < 256 else "<u4" if not int(counts.max()) >> 32 else "<i8"
    planes = [np.ascontiguousarray(x.astype(t)).view(np.uint8).reshape(len(x), -1).T.tobytes() for x, t in [*((c, wide) for c in columns), (counts, often)]]
    raw = b"".join(planes)
    return struct.pack("<IBBI", len(counts), int(wide[2]), int(often[2]), len(raw)) + pa.compress(raw, _CODEC, asbytes=True)


def read_back(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    n, wide, often, size = struct.unpack_from("<IBBI", blob)
    raw = np.frombuffer(pa.decompress(blob[10:], size, _CODEC, asbytes=True), np.uint8)
    out = []
    for k in range(DEPTH):
        out.append(np.ascontiguousarray(raw[k * n * wide : (k + 1) * n * wide].reshape(wide, n).T).view(f"<i{wide}").ravel())
    kind = {1: "<u1", 4: "<u4", 8: "<i8"}[often]
    return out, np.ascontiguousarray(raw[DEPTH * n * wide :].reshape(often, n).T).view(kind).ravel().astype(np.int64)


def paths(symbols: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
    """From every position with a symbol the next DEPTH symbols of its piece, zeros after the first word that has none."""
    n = len(symbols)
    out, inside = [symbols], symbols > 0
    for k in range(1, DEPTH):
        c, joined = np.zeros(n, symbols.dtype), np.zeros(n, bool)
        c[: max(0, n - k)], joined[: max(0, n - k)] = symbols[k:], piece[k:] == piece[: max(0, n - k)]
        inside = inside & joined & (c > 0)
        out.append(np.where(inside, c, 0))
    start = symbols > 0
    return [c[start] for c in out]


def tries(docs: DataFrame, symbols: Symbols, cuts: np.ndarray | None) -> DataFrame:
    """(part, trie): the parts of every shard's trie, cut at ``cuts``; without, the paths of all positions, uncounted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = pieces = 0

        def trie() -> pa.RecordBatch:
            columns, counts = sorted_paths(paths(*(np.concatenate(x) for x in zip(*held))))
            places = np.unique(np.concatenate([[0], cut_places(columns, cuts), [len(counts)]])).tolist()
            part = np.searchsorted(cut_places(columns, cuts), places[:-1], side="right")
            blobs = [serialised([c[a:b] for c in columns], counts[a:b]) for a, b in zip(places, places[1:])]
            return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "trie": pa.array(blobs, pa.binary())})

        for batch in batches:
            for step in steps(batch, most=SMALL_STEP):
                h, piece, _, _ = hashed_words(step)
                if not len(h):
                    continue
                found = symbols(h)
                now = found if found.max() >> 31 else found.astype(np.int32), (piece + pieces).astype(np.int32)  # pieces of one shard
                pieces = int(now[1][-1]) + 1
                if cuts is None:
                    found = paths(*now)
                    yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in zip(PATH, found)})
                    pieces = 0
                    continue
                held.append(now)
                size += len(h)
                if size >= SHARD_WORDS:
                    if any(s.any() for s, _ in held):
                        yield trie()
                    held, size, pieces = [], 0, 0
                    released()
        if any(s.any() for s, _ in held):
            yield trie()
        held = []
        released()

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in PATH) if cuts is None else "part int, trie binary")


def merged_nodes(parts: DataFrame, least: int) -> DataFrame:
    """(s1..s4, depth, f, l1..l3, edge): nodes of the merged tries with ``least`` occurrences, and all on an edge of a part.
    ``l``: the counts of ancestors by depth, null where an ancestor is on an edge."""

    def run(key, group):
        runs = [read_back(b) for b in group["trie"].to_pylist()]
        columns, counts = [np.concatenate([r[0][k] for r in runs]) for k in range(DEPTH)], np.concatenate([r[1] for r in runs])
        del runs
        columns, counts = sorted_paths(columns, counts)
        n, new, above, out = len(counts), np.zeros(len(counts), bool), [], []
        new[0] = True
        for depth in range(1, DEPTH + 1):
            c = columns[depth - 1]
            new[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(new)
            total = np.add.reduceat(counts, first)
            edge = np.zeros(len(first), bool)
            edge[[0, -1]] = True
            kept = np.flatnonzero((c[first] > 0) & ((total >= least) | edge))
            row = first[kept]
            rows = {s: x[row].astype(np.int64) if k < depth else np.zeros(len(row), np.int64) for k, (s, x) in enumerate(zip(PATH, columns))}
            rows |= {"depth": np.full(len(row), depth, np.int32), "f": total[kept]}
            table = {name: pa.array(x) for name, x in rows.items()}
            for k in range(1, DEPTH):
                if k < depth:
                    number, sums, on_edge = above[k - 1]
                    table[f"l{k}"] = pa.array(sums[number[row]], mask=on_edge[number[row]])
                else:
                    table[f"l{k}"] = pa.nulls(len(row), pa.int64())
            out.append(pa.table(table | {"edge": pa.array(edge[kept])}))
            above.append((np.cumsum(new) - 1, total, edge))
        if n > 100_000:
            released()
        return pa.concat_tables(out)

    schema = ", ".join([*(f"{c} long" for c in PATH), "depth int", "f long", *(f"l{k} long" for k in range(1, DEPTH)), "edge boolean"])
    return parts.groupBy("part").applyInArrow(run, schema)


def exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def shifted(k: int) -> list[Column]:
    """The path without its first k words."""
    return [F.col(PATH[i + k]) if i + k < DEPTH else F.lit(0).cast("long") for i in range(DEPTH)]


def phrases(docs: DataFrame, least: int = LEAST, numbered: int = NUMBERED, range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates (s1..s4, depth, a, k, l, r, score, longer), words (symbol, lang, word, n), and totals (lang, n).
    ``longer``: the count of the most frequent candidate with one word more around it, or null."""
    spark = docs.sparkSession
    docs = cleaned(docs)
    counts = written(word_counts(docs), "word-counts")
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("n")), "language-totals")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") >= least)
    listed = frequent.orderBy(F.desc("n"), "h").select("h").limit(numbered + 1).toPandas()["h"].to_numpy(np.int64)
    symbols = Symbols(listed[:numbered].view(U), len(listed) <= numbered)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"symbol": pa.array(symbols(b.column("h").to_numpy().view(U))), **{c: b.column(c) for c in ("lang", "word", "n")}})

    words = written(frequent.mapInArrow(named, "symbol long, lang string, word string, n long"), "frequent-words")
    ranges = max(1, -(-n_words // range_words), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // 50_000))
    sample = docs if n_words <= (wanted := max(SAMPLED, 64 * ranges)) else docs.sample(wanted / n_words, seed=7)
    seen = tries(sample, symbols, None).toPandas().to_numpy(np.int64).reshape(-1, DEPTH)
    seen = seen[np.lexsort(seen.T[::-1])]
    cuts = np.unique(seen[np.arange(1, ranges) * len(seen) // ranges], axis=0) if len(seen) else np.empty((0, DEPTH), np.int64)
    raw = written(merged_nodes(tries(docs, symbols, cuts).repartition(ranges, "part"), least), "trie-nodes")

    spine = raw.where("edge").groupBy(*PATH, "depth").agg(F.sum("f").alias("f"))
    lefts = [f"l{k}" for k in range(1, DEPTH)]
    nodes = raw.where("NOT edge").select(*PATH, "depth", "f", *lefts)
    nodes = nodes.union(spine.where(F.col("f") >= least).select(*PATH, "depth", "f", *[F.lit(None).cast("long")] * len(lefts)))
    for k in range(1, DEPTH):  # the nodes of one depth on edges are two for each part at most
        known = spine.where(F.col("depth") == k).select(*PATH[:k], F.col("f").alias("on_edge"))
        nodes = nodes.join(F.broadcast(known), PATH[:k], "left").withColumn(f"l{k}", F.when(F.col("depth") > k, F.coalesce(f"l{k}", "on_edge"))).drop("on_edge")
    nodes = written(nodes.select(*PATH, "depth", "f", *lefts), "phrases")

    # suffix links: cut k of a candidate leaves the node of its words after the first k
    links = [F.struct(F.lit(k).alias("k"), *(c.alias(f"t{i}") for i, c in enumerate(shifted(k))), F.col(f"l{k}").alias("l")) for k in range(1, DEPTH)]
    cut = nodes.where("depth > 1").select(*PATH, "depth", F.col("f").alias("a"), F.explode(F.slice(F.array(*links), 1, F.col("depth") - 1)).alias("c")).select(*PATH, "depth", "a", "c.*")
    keys = [f"t{i}" for i in range(DEPTH)]
    right = nodes.select(*(F.col(c).alias(t) for c, t in zip(PATH, keys)), F.col("f").alias("r"))
    cut = meet(cut, right, keys, F.col("r") > max(SHARES * least, n_words // SHARES))
    score = F.expr("CAST((CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS LONG)")
    best = cut.groupBy(*PATH).agg(F.first("depth").alias("depth"), F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    around = F.array(F.struct(*(F.when(F.col("depth") > i + 1, F.col(c)).otherwise(0).cast("long").alias(c) for i, c in enumerate(PATH))), F.struct(*(c.alias(p) for c, p in zip(shifted(1), PATH))))
    longer = nodes.where("depth > 2").select("f", F.explode(around).alias("p")).groupBy("p").agg(F.max("f").alias("longer")).select("p.*", "longer")
    return best.join(longer, PATH, "left").select(*PATH, "depth", "a", "b.k", "b.l", "b.r", "b.score", "longer"), words, totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, numbered: int = NUMBERED, range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language, without those that are hardly ever
    seen outside a longer one."""
    found, words, totals = phrases(docs, least, numbered, range_words)
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(SHARES * least, n_words // SHARES)
    kept = found.where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * 80)).drop("longer", "depth", "k")
    kept = written(meet(kept, words.select(F.col("symbol").alias("s1"), "lang", "n"), ["s1"], hot).drop("n"), "candidates")
    # the lowest score that a language lists; there are 1,000,001 scores
    down = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    scores = kept.groupBy("lang", "score").agg(F.count("*").alias("many")).withColumn("better", F.coalesce(F.sum("many").over(down), F.lit(0)))
    lowest = scores.where(F.col("better") < top).groupBy("lang").agg(F.min("score").alias("lowest"))
    listed = kept.join(lowest, "lang").where("score >= lowest").drop("lowest")
    spelled = listed.select("*", F.posexplode(F.array(*PATH)).alias("i", "symbol")).where("symbol > 0")
    spelled = meet(spelled, words.select("symbol", "word", "n"), ["symbol"], hot)
    words_of_phrase = F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"])
    spelled = spelled.groupBy("lang", *PATH, "a", "l", "r", "score").agg(F.array_join(words_of_phrase, " ").alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = spelled.select("lang", "phrase", "a", "l", "r", "score", place.alias("rank")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, w[i:i + s - 1] AS g FROM p, unnest(range(1, 5)) a(s), unnest(range(1, len(w) - s + 2)) b(i)),
f AS (SELECT lang, g, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(g) > 1 AND f >= 30),
k AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, (2000000 * c.f) // (x.f + y.f) AS score FROM c, unnest(range(1, len(c.g))) u(k)
      JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT lang, g[o:o + s - 1] AS g, max(f) AS longer FROM c, unnest(range(2, len(g))) a(s), unnest(range(1, len(g) - s + 2)) q(o) GROUP BY ALL),
t AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE longer IS NULL OR 100 * longer < 80 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t QUALIFY rank <= 2000)
SELECT r.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang)
"""
