"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Normalised vectors within cosine 0.95 are within Euclidean distance 0.317. A table hashes a vector by several Gaussian
projections, each shifted at random and cut into cells of width ``WIDTH``; two vectors at that distance share a cell of one
projection with probability 0.82, two unrelated ones with 0.37. The number of projections grows with the logarithm of the
number of vectors, so that a bucket holds about ``CROWD`` unrelated vectors however many there are, and the number of tables
follows, so that a pair exactly at the threshold shares one with probability 0.95 and nearer pairs almost surely.

1. Equal vectors become one class with a multiplicity.
2. Buckets hold narrow rows: the class and ``BITS`` signs of further random projections. Buckets are read as sorted streams;
   classes whose signs differ in at most ``NEAR`` places (4.5 deviations more than at the threshold) are candidates and are
   joined to one of them, so that a bucket gives one row for each class at most. In a bucket of more than ``MANY`` classes a
   class is compared with centres only, at twice the distance, which loses no candidate.
3. Components of candidates over all tables are the groups in which vectors are compared exactly, in double precision, by
   matrix products; vectors are shuffled once. A group of more than ``block`` vectors is dealt into blocks by hash, and
   pairs of blocks are compared in separate tasks; nothing is left out. Links are counted where they are found and never
   written as pairs: a task gives for each vector its number of links and one edge to the smallest vector connected to it.

Cost of a group of near copies: m vectors that are all similar have m * m / 2 links to count; a task of one pair of blocks
takes bounded memory, and each vector is sent m / block times.

Defined results: vectors that are null, empty, zero, or that hold nulls or non-finite numbers link with nothing, and so do
rows with a null vec_id, whose component_id is null and whose kept is false; vectors of different lengths don't link, those of
equal length do whatever that length; repeated rows link with each other like equal vectors of different ids; rows that share
a vec_id are vectors of their own; of equal cosines none is preferred; an empty table gives none. Vectors are told apart by
128-bit hashes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

COSINE, WIDTH, CROWD, BITS, NEAR, MANY, BLOCK = 0.95, 1.4, 64, 256, 48, 4_096, 32_768
#: Chances that a projection puts two vectors into one cell: at the threshold, and unrelated ones.
SAME, CHANCE, RECALL = 0.82, 0.366, 0.95


def plan(vectors: int) -> tuple[int, int]:
    """Projections in a table, and tables."""
    projections = max(8, math.ceil(math.log(max(vectors, 1) / CROWD, 1 / CHANCE))) if vectors > CROWD else 8
    return projections, math.ceil(math.log(1 - RECALL) / math.log(1 - SAME**projections))


def linkable(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def normalised(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def bucket_rows(classes: DataFrame, projections: int, tables: int, seed: int = 17) -> DataFrame:
    """(key, node, signs): one row for each table; keys hash the table, the length and the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch.column("v")).to_numpy()
            for size in np.unique(sizes).tolist():
                if size not in made:
                    rng = np.random.default_rng((seed, size))
                    mixers = rng.integers(1, 1 << 62, (tables, projections), dtype=np.int64) | 1
                    made[size] = (rng.normal(size=(size, tables * projections)), rng.random(tables * projections) * WIDTH, mixers, rng.integers(1, 1 << 62, tables, dtype=np.int64), rng.normal(size=(size, BITS)))
                into, shift, mixers, salts, signs = made[size]
                mine = np.flatnonzero(sizes == size)
                for at in np.split(mine, range(2_000, len(mine), 2_000)):
                    x = normalised(matrix(batch.column("v").take(pa.array(at))))
                    cells = np.floor((x @ into + shift) / WIDTH).astype(np.int64).reshape(len(x), tables, projections)
                    with np.errstate(over="ignore"):
                        keys = ((cells * mixers).sum(2) + salts) * np.int64(0x9E3779B97F4A7C15 - (1 << 64))
                    packed = np.packbits(x @ signs > 0, axis=1)
                    codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(x), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
                    row = pa.array(np.repeat(np.arange(len(x)), tables))
                    yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel()), "node": batch.column("node").take(pa.array(at)).take(row), "signs": codes.take(row)})

    return classes.select("node", "v").mapInArrow(run, "key long, node long, signs binary")


def rooted(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component, for edges (i, j)."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def candidates(buckets: DataFrame) -> DataFrame:
    """(src, dst): classes that share a bucket and most signs, joined in a star."""

    def small(key: np.ndarray, node: np.ndarray, signs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Roots of rows in buckets of at most 64 rows: all buckets at once, by the distance of rows."""
        last = np.cumsum(sizes).repeat(sizes)  # where each row's bucket ends
        i, j = [], []
        for d in range(1, int(sizes.max(initial=1))):
            at = np.flatnonzero(np.arange(len(key)) + d < last)
            at = at[bits_apart(signs[at], signs[at + d]) <= NEAR]
            i.append(at)
            j.append(at + d)
        return rooted(len(key), np.concatenate(i), np.concatenate(j)) if i else np.arange(len(key))

    def large(signs: np.ndarray) -> np.ndarray:
        """Roots of the rows of one bucket of at most MANY rows."""
        i, j, root = [], [], np.arange(len(signs))
        for lo in range(0, len(signs), 64):
            a, b = np.nonzero(bits_apart(signs[lo : lo + 64, None], signs[None, lo:]) <= NEAR)
            i.append(root[a + lo])
            j.append(root[b + lo])
            if sum(map(len, i)) > 1 << 18:
                root = rooted(len(signs), np.concatenate(i), np.concatenate(j))
                i, j = [root], [np.arange(len(signs))]
        return rooted(len(signs), np.concatenate(i), np.concatenate(j))

    class Crowd:
        """A bucket of any number of rows: what is near no centre becomes one; all centres within twice the distance are joined."""

        def __init__(self):
            self.node, self.signs = np.empty(0, np.int64), np.empty((0, BITS // 64), np.uint64)

        def add(self, node: np.ndarray, signs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for lo in range(0, len(node), 256):
                n, s = node[lo : lo + 256], signs[lo : lo + 256]
                apart = bits_apart(s[:, None], self.signs[None]) if len(self.node) else np.empty((len(n), 0), np.int64)
                lone = np.flatnonzero(~(apart <= NEAR).any(1))
                first = len(self.node)
                for r in lone.tolist():  # each may be near one that has just become a centre
                    if len(self.node) > first and (bits_apart(s[r], self.signs[first:]) <= NEAR).any():
                        continue
                    self.node, self.signs = np.append(self.node, n[r]), np.vstack([self.signs, s[r]])
                row, center = np.nonzero(bits_apart(s[:, None], self.signs[None]) <= 2 * NEAR)
                yield n[row], self.node[center]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_node, held_signs = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, BITS // 64), np.uint64)
        crowd: Crowd | None = None

        def edges(src: np.ndarray, dst: np.ndarray) -> Iterator[pa.RecordBatch]:
            use = src != dst
            if use.any():
                yield pa.RecordBatch.from_pydict({"src": pa.array(src[use]), "dst": pa.array(dst[use])})

        def whole(key: np.ndarray, node: np.ndarray, signs: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Complete buckets of at most MANY rows each."""
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            sizes = np.diff(np.append(first, len(key)))
            for kind in (sizes <= 64, sizes > 64):
                rows = np.repeat(kind & (sizes > 1), sizes)
                if not rows.any():
                    continue
                own = sizes[kind & (sizes > 1)]
                n, s = node[rows], signs[rows]
                if kind is not None and (own <= 64).all():
                    yield from edges(n, n[small(key[rows], n, s, own)])
                else:
                    at = np.cumsum(own) - own
                    for a, size in zip(at.tolist(), own.tolist()):
                        yield from edges(n[a : a + size], n[a : a + size][large(s[a : a + size])])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            signs = np.frombuffer(b"".join(batch.column("signs").to_pylist()), np.uint64).reshape(len(key), -1)
            if crowd is not None:
                more = int(np.searchsorted(key != held_key[0], True))
                for src, dst in crowd.add(node[:more], signs[:more]):
                    yield from edges(src, dst)
                key, node, signs = key[more:], node[more:], signs[more:]
                if not len(key):
                    continue
                crowd, held_key = None, np.empty(0, np.int64)
            key, node, signs = np.concatenate([held_key, key]), np.concatenate([held_node, node]), np.concatenate([held_signs, signs])
            # what a bucket of too many rows has so far goes to its crowd
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(first, len(key)))
            for a, size in zip(first[sizes > MANY].tolist(), sizes[sizes > MANY].tolist()):
                crowd = Crowd()
                for src, dst in crowd.add(node[a : a + size], signs[a : a + size]):
                    yield from edges(src, dst)
            if crowd is not None and sizes[-1] <= MANY:
                crowd = None
            done = np.repeat(sizes <= MANY, sizes)
            done[first[-1] :] = False
            yield from whole(key[done], node[done], signs[done])
            held_key, held_node, held_signs = key[first[-1] :], node[first[-1] :], signs[first[-1] :]
            if crowd is not None:
                held_key, held_node, held_signs = held_key[:1], held_node[:0], held_signs[:0]
        if crowd is None:
            yield from whole(held_key, held_node, held_signs)

    return buckets.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "src long, dst long").distinct()


def compared(rows: DataFrame, cosine: float) -> DataFrame:
    """(grp, a, b, node, many, side, v), sorted by (grp, a, b) -> (node, links, root) of vectors with links there."""

    def exact(node: np.ndarray, many: np.ndarray, side: np.ndarray, x: np.ndarray, within: bool) -> pa.RecordBatch:
        order = np.argsort(node, kind="stable")
        node, many, side, x = node[order], many[order], side[order], normalised(x[order])
        links, root, i, j = np.zeros(len(node), np.int64), np.arange(len(node)), [], []
        for start in range(0, len(node), 256):
            part = slice(start, min(len(node), start + 256))
            close = x[part] @ x[start:].T >= cosine
            close &= np.arange(start, len(node)) > np.arange(part.start, part.stop)[:, None]
            if not within:
                close &= side[part][:, None] != side[start:]
            links[part] += (close @ many[start:]).astype(np.int64)
            links[start:] += many[part] @ close
            p, q = np.nonzero(close)
            low, high = root[p + start], root[q + start]
            pairs = np.unique(np.minimum(low, high) * len(node) + np.maximum(low, high))
            i.append(pairs // len(node))
            j.append(pairs % len(node))
            if sum(map(len, i)) > 1 << 18 or start + 256 >= len(node):
                root = rooted(len(node), np.concatenate([*i, root]), np.concatenate([*j, np.arange(len(node))]))
                i, j = [], []
        used = np.flatnonzero(links)
        return pa.RecordBatch.from_pydict({"node": pa.array(node[used]), "links": pa.array(links[used]), "root": pa.array(node[root[used]])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> pa.RecordBatch:
            column = lambda name: np.concatenate([b.column(name).to_numpy() for b in held])
            x = np.concatenate([matrix(b.column("v")) for b in held])
            return exact(column("node"), column("many"), column("side"), x, last[1] == last[2])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("grp", "a", "b")]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                now = tuple(int(k[lo]) for k in keys)
                if held and now != last:
                    yield flush()
                    held = []
                last = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield flush()

    return rows.mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("fine", F.col("vec_id").isNotNull() & linkable(F.col("v")))
    rows = rows.withColumn("node", F.when(F.col("fine"), F.xxhash64("v"))).withColumn("twin", F.when(F.col("fine"), F.xxhash64(F.lit(1), "v")))
    classes = rows.where("fine").groupBy("node", "twin").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("v").alias("v"))
    classes = written(classes, "vector-classes")
    projections, tables = plan(classes.count())
    groups = components(candidates(bucket_rows(classes, projections, tables))).select("node", F.col("component").alias("grp"))
    members = classes.select("node", "many", "v").join(groups, "node")
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > block)
    sizes = sizes.select("grp", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "grp", "left")
    # groups of up to one block stay whole; only larger ones are dealt out in pairs of blocks
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("own", F.coalesce(own, F.lit(0))).select("*", other.alias("other"))
    placed = placed.select("grp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "many", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "v")
    found = compared(placed.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b"), cosine)
    found = written(found, "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    per_class = classes.select("node", "twin", "least", "many").join(links, "node", "left").join(linked, "node", "left").withColumn("of", F.coalesce("component", "node"))
    names = per_class.groupBy("of").agg(F.min("least").alias("component_id"))
    per_class = per_class.join(names, "of").select("node", "twin", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    known = rows.select("vec_id", "node", "twin").join(per_class, ["node", "twin"], "left")
    component = F.coalesce("component_id", "vec_id")
    return known.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0 AND isfinite(x))) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
n AS (SELECT x AS vec_id, count(*) AS n FROM b GROUP BY x),
r AS (SELECT x AS vec_id, x AS z FROM b UNION SELECT r.vec_id, b.y FROM r JOIN b ON b.x = r.z),
k AS (SELECT vec_id, min(z) AS component_id FROM r GROUP BY vec_id)
SELECT t.vec_id, coalesce(n.n, 0) AS n_links, coalesce(k.component_id, t.vec_id) AS component_id, t.vec_id = coalesce(k.component_id, t.vec_id) AS kept FROM embeddings t LEFT JOIN n USING (vec_id) LEFT JOIN k USING (vec_id)
"""
