"""N-gram Jaccard join: which documents are linked through sets of word shingles of similarity of at least ``percent``.

A size-aware heavy-light join. Two sets of sizes a and b are similar when they share c(a, b) elements, and then differ in at
most k(a, b). *Light* (small) sets enumerate all their subsets of that fixed size c; sets with a common subset are
candidates. *Heavy* (large) sets are put on inverted lists: the hash space is cut into more than k parts, so similar sets
agree in whole parts, and a list holds the sets with the same elements in one part; the smallest parts, as many as there are
to spare, need no list. Where a set has so many empty parts that agreement could be in those alone, its elements are lists. The boundary between light
and heavy is the size up to which enumeration is estimated to cost less, over the sizes that occur.

Lists are read in the order of their key and link every set to the smallest one of the list, so they are streams of
bounded memory and give one row for each entry, never pairs. The linked candidates form groups; in a group the overlaps are
counted exactly: one query scans the inverted lists of its elements against all sets of the group at once. A query is only
needed from sets that aren't joined to the most central set, which is asked first, so a group of near
copies of one text takes one scan. Equal sets are one class throughout: only a class's smallest document is compared.

A group of more than ``GROUP_BYTES`` of text is dealt in blocks. A task compares two blocks, all their sets with all: first
one block with every other, which joins most near copies of one text; then what is not in the largest class so found with all
blocks. Two sets of that class need no comparison and any other pair meets in a task, so the result is exact; components of
the links that were verified end it.

Hot keys: equal sets enter a list once in each task that reads them, however many rows have them; lists, hubs and classes of
many copies are read as streams, dealt in blocks, or met by broadcast where there can only be few of them.

Shingles are 64-bit hashes of the words, sets are told apart by 128 bits. Defined results: a null or empty text has no
shingle and links with nothing; with fewer words than a shingle has, the whole sequence is one shingle; rows are linked by
their texts only, so rows that share a doc_id may be in different components; rows that repeat are linked; a null doc_id links
with nothing and has a null component; a text of any length is one set, and a task holds one whole set at least; a similarity
of exactly the bound is a link; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_STEP, map_text, released, written
from .components import HUB, HUBS, components
from .words import U, by_text, mixed, shingles, word_hashes

WORDS, PERCENT = 4, 85
#: Text of a group that one task takes, and half of what one takes of a group that is dealt in blocks.
GROUP_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20
#: So many keys, of 8 bytes, may be broadcast so that texts that nobody asks for aren't shuffled; with more, all texts are.
FEW_KEYS = 1 << 20


class Sizes:
    """What the similarity bound says about sizes."""

    def __init__(self, percent: int):
        self.p = percent

    def least(self, n: int) -> int:
        return -(-self.p * n // 100)

    def most(self, n: int) -> int:
        return 100 * n // self.p

    def shared(self, a: int, b: int) -> int:
        return -(-self.p * (a + b) // (100 + self.p))

    def differ(self, n: int) -> int:
        """Most elements in which a set of size n and a larger similar one differ."""
        return (100 - self.p) * (n + self.most(n)) // (100 + self.p)

    def level(self, n: int) -> int:
        """Parts are 2 to this power; one in eight is spare, so that the smallest ones need no list."""
        level = 0
        while (1 << level) - ((1 << level) >> 3) < self.differ(n) + 1 + (level > 0):
            level += 1
        return level

    def subset_sizes(self, n: int, light: int) -> list[int]:
        return sorted({self.shared(n, m) for m in range(max(1, self.least(n)), self.most(n) + 1) if min(n, m) <= light and self.shared(n, m) <= n})

    def levels(self, n: int, light: int) -> list[int]:
        """Levels of all heavy sets up to size n that may be similar to one of size n."""
        return list(range(self.level(max(light + 1, self.least(n))), self.level(n) + 1)) if n > light else []

    def most_differing(self, n: int, level: int) -> int:
        parts = 1 << level
        return min(self.differ(n), parts - (parts >> 3) - 1 - (level > 0))

    def subset_cost(self, n: int) -> float:
        return sum(comb(n, c) for c in self.subset_sizes(n, n))

    def list_cost(self, n: int) -> float:
        return sum(1 << v for v in self.levels(n, 0)) * (1 + n / 4)  # small parts are shared by chance

    def largest_light(self) -> int:
        """The last size at which enumeration may cost less than lists: no boundary by cost is above it.

        Lists cost a power of the size, subsets grow faster than any; a factor of a thousand is never made up again.
        """
        n, last = 1, 0
        while n < 1_000 and self.subset_cost(n) < 1000 * self.list_cost(n):  # at 100 percent it never is
            last, n = n if self.subset_cost(n) <= self.list_cost(n) else last, n + 1
        return last

    def boundary(self, histogram: dict[int, int]) -> int:
        """The size up to which sets are light, by the cost of rows and of checks that come to nothing."""
        gain, best, at = 0.0, 0.0, 0
        for n in sorted(histogram):
            gain += histogram[n] * (self.list_cost(n) - self.subset_cost(n))
            if gain > best:
                best, at = gain, n
        return at


def keys_of(elements: np.ndarray, s: Sizes, light: int) -> np.ndarray:
    """The lists that a set (sorted 64-bit hashes) stands on."""
    n, out = len(elements), []
    if not n:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        for c in s.subset_sizes(n, light):
            weights = mixed(elements, 3)
            chosen = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
            out.append(mixed(weights.sum() - weights[chosen].sum(1, dtype=U), 1000 + c))
        for level in s.levels(n, light):
            weights = mixed(elements, 4)
            part = (elements >> U(64 - level)).astype(np.int64) if level else np.zeros(n, np.int64)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            held = np.diff(np.append(first, n))
            # similar sets agree in ``sure`` parts at least; the size of the sure-th smallest part is reached by one of those,
            # so smaller parts, which sets share by chance, need no list
            sure, empty = (1 << level) - s.most_differing(n, level), (1 << level) - len(first)
            least = 1 if empty >= sure else int(np.partition(held, sure - 1 - empty)[sure - 1 - empty])
            full = held >= least
            out.append(mixed(np.add.reduceat(weights, first)[full] + mixed(part[first].astype(U), 5)[full], 2000 + level))
            if empty >= sure:  # agreement may be in empty parts alone
                out.append(mixed(elements[: n - s.least(n) + 1], 3000 + level))
    return np.concatenate(out)


def root_of(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def linked(sets: list[np.ndarray], percent: int) -> list[int]:
    """The smallest index of each set's component, by exact overlaps."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    distinct, element, count = np.unique(flat, return_inverse=True, return_counts=True)
    owners, first = owner[order], np.concatenate([[0], np.cumsum(count)[:-1]])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    parent = list(range(m))
    central = np.add.reduceat(count[element], starts) / size if m else []

    def query(i: int) -> None:
        mine = element[starts[i] : starts[i] + size[i]]
        mine = mine[count[mine] > 1]
        n = count[mine]
        if not len(n):
            return
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        shared = np.bincount(owners[at], minlength=m)
        near = np.flatnonzero(100 * shared >= percent * (size + size[i] - shared))
        for j in near.tolist():
            a, b = root_of(parent, i), root_of(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)

    order = np.argsort(-np.asarray(central), kind="stable").tolist()
    for i in order:
        # what is joined to the most central set needs no query of its own: links to sets outside are found from there
        if i == order[0] or root_of(parent, i) != root_of(parent, order[0]):
            query(i)
    return [root_of(parent, i) for i in range(m)]


def set_hash(elements: np.ndarray, salt: int) -> int:
    with np.errstate(over="ignore"):
        return int(mixed(elements, salt).sum(dtype=U))


def element_sets(texts: pa.Array | pa.ChunkedArray, k: int) -> list[np.ndarray]:
    return [shingles(x, k) for x in by_text(*word_hashes(texts, lower=True))]


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, th, n, h1, h2, bytes): the size and a 128-bit hash of every document's set, and the size of its text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = element_sets(batch.column("text"), k)
            h1, h2 = (np.array([set_hash(x, salt) for x in found], U).view(np.int64) for salt in (1, 2))
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "th": batch.column("th"), "n": pa.array([len(x) for x in found], pa.int64()), "h1": pa.array(h1), "h2": pa.array(h2), "bytes": pc.binary_length(batch.column("text")).cast(pa.int64())})

        return step

    return map_text(docs, make, "doc_id long, th long, n long, h1 long, h2 long, bytes long", most=SMALL_STEP)


def list_entries(docs: DataFrame, k: int, percent: int, light: int) -> DataFrame:
    """(key, node) of every list that a set stands on; a node is a set's hash. A task enters equal sets once."""

    def make():
        s, entered = Sizes(percent), set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = element_sets(batch.column("text"), k)
            nodes = [set_hash(x, 1) for x in found]
            fresh = [i for i, node in enumerate(nodes) if len(found[i]) and node not in entered and not entered.add(node)]
            if not fresh:
                return None
            keys = [keys_of(found[i], s, light) for i in fresh]
            node = np.repeat(np.array([nodes[i] for i in fresh], U), [len(x) for x in keys])
            return pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys).view(np.int64)), "node": pa.array(node.view(np.int64))})

        return step

    return map_text(docs.where("doc_id IS NOT NULL"), make, "key long, node long", most=SMALL_STEP)


def stars(entries: DataFrame) -> DataFrame:
    """(src, dst): each set of a list and the smallest one of it; a stream over sorted lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = center = None
        for batch in batches:
            key, doc = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            if not len(key):
                continue
            first = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            centers = np.where(at >= 0, doc[at], center if center is not None else 0)
            use = centers != doc
            if use.any():
                yield pa.RecordBatch.from_pydict({"src": pa.array(doc[use]), "dst": pa.array(centers[use])})
            last_key, center = key[-1], centers[-1]

    return entries.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "src long, dst long").distinct()


def verified(members: DataFrame, k: int, percent: int) -> DataFrame:
    """(grp, i, j, node, text) -> (node, root): exact components of what shares a task (grp, i, j)."""

    def run(key, group):
        nodes, sets = group["node"].to_numpy().view(U), []
        for lo in range(0, group.num_rows, 256):
            sets += element_sets(group["text"].slice(lo, 256), k)
        # a set that is not the node's own would be of another text with the same hash; equal ones are one
        own = {int(nodes[i]): i for i, x in enumerate(sets) if len(x) and set_hash(x, 1) == int(nodes[i])}
        order = sorted(own)
        roots = linked([sets[own[n]] for n in order], percent) if order else []
        names = np.array(order, U).view(np.int64)
        if group.num_rows > 1_000:
            released()
        return pa.table({"node": pa.array(names, pa.int64()), "root": pa.array(names[roots] if order else names, pa.int64())})

    return members.groupBy("grp", "i", "j").applyInArrow(run, "node long, root long")


def in_blocks(texts: DataFrame, placed: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of groups that are dealt in blocks. ``texts``: node, text; ``placed``: node, grp, bytes, blocks."""

    def compared(tasks: DataFrame, name: str) -> DataFrame:
        return written(verified(tasks.join(texts.hint("merge"), "node").select("grp", "i", "j", "node", "text"), k, percent), name)

    def every(n, start: int = 0):
        return F.explode(F.sequence(F.lit(start), n - 1))

    texts = texts.distinct()  # rows that repeat a document are as many as they like; they are one here
    at = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    zero = F.lit(0)
    first = at.where("block > 0").select("node", "grp", zero.alias("i"), F.col("block").alias("j"))
    first = first.union(at.where("block = 0").select("node", "grp", zero.alias("i"), every(F.col("blocks"), 1).alias("j")))
    links = compared(first, "block-links")
    classes = components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    at = at.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    largest = at.groupBy("grp", "class").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("class", F.struct("n", "class")).alias("largest"))
    left = written(at.join(largest, "grp").where("class <> largest"), "block-rest")
    if left.isEmpty():
        return at.select("node", F.col("class").alias("root"))
    parts = left.groupBy("grp").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("parts")).withColumn("parts", F.greatest("parts", F.lit(1)))
    mine = left.join(parts, "grp").select("node", "grp", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("i"), every(F.col("blocks")).alias("j"))
    others = at.join(parts, "grp").select("node", "grp", every(F.col("parts")).alias("i"), F.col("block").alias("j"))
    links = links.union(compared(mine.union(others).distinct(), "block-links"))
    found = components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    return found.select("node", F.col("component").alias("root"))


def one_text_each(texts: DataFrame, sets: DataFrame, placed: DataFrame) -> DataFrame:
    """(grp, blocks, node, text): one text for each node of ``placed``, however many rows repeat its document.

    Texts are shuffled once, whatever the groups are, and only those of groups are kept; where there are few of those, others are
    left out before, by a hash of their document, and what is left meets its node exactly. Where rows meet
    their node, one is enough, which needs no further shuffle. A document that is repeated in more than ``1 / HUBS`` of
    all rows is one row from each task before it is shuffled.
    """
    name, total = ["doc_id", "th"], sets.count()
    if placed.count() <= FEW_KEYS:
        asked = F.broadcast(placed.select(F.xxhash64("rep", "rep_th").alias("_asked")).distinct())
        texts = texts.withColumn("_asked", F.xxhash64("doc_id", "th")).join(asked, "_asked", "left_semi").drop("_asked")
    hot = sets.groupBy(*name).count().where(F.col("count") > max(HUB, total // HUBS)).select(*name)
    hot = written(hot.join(placed.select(F.col("rep").alias("doc_id"), F.col("rep_th").alias("th")), name, "left_semi"), "repeated-rows")

    def met(rows: DataFrame) -> DataFrame:
        rows = rows.join(placed.withColumnsRenamed({"rep": "doc_id", "rep_th": "th"}).hint("merge"), name)
        # a document has one node, so the order that rows meet in is that of the groups and nothing is sorted again
        return rows.groupBy(*name).agg(*[F.any_value(c).alias(c) for c in ("grp", "blocks", "node", "text")]).drop(*name)

    if hot.isEmpty():
        return met(texts)
    few = F.broadcast(hot)
    return met(texts.join(few, name, "left_anti")).union(met(texts.join(few, name, "left_semi").groupBy(*name).agg(F.any_value("text").alias("text"))))


def linked_documents(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    sets = written(set_rows(texts, k), "shingle-sets")
    of = Sizes(percent)
    # as many rows at most as there are sizes up to the largest light one
    histogram = {r["n"]: r["count"] for r in sets.where(F.col("n").between(1, of.largest_light())).groupBy("n").count().collect()}
    light = of.boundary(histogram)
    candidates = components(stars(list_entries(texts.drop("th"), k, percent, light)))
    # a class of equal sets is a node; its smallest document stands for it, told from others of its id by its text
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "th", "bytes")).alias("one"), F.count("*").alias("many"))
    classes = written(classes.select("h1", "h2", "n", F.col("one.doc_id").alias("rep"), F.col("one.th").alias("rep_th"), F.col("one.bytes").alias("bytes"), "many"), "set-classes")
    wanted = classes.join(candidates, classes["h1"] == candidates["node"]).select("node", "rep", "rep_th", "bytes", F.col("component").alias("grp"))
    sums = wanted.groupBy("grp").agg(F.count("*").alias("count"), F.sum("bytes").alias("sum")).where("count > 1")
    blocks = F.when(F.col("sum") > GROUP_BYTES, F.ceil(F.col("sum") / BLOCK_BYTES).cast("int"))
    placed = written(wanted.join(sums.select("grp", blocks.alias("blocks")), "grp"), "placed-candidates")
    texts = written(one_text_each(texts, sets, placed), "group-texts")
    none = F.lit(0)
    found = verified(texts.where("blocks IS NULL").select("grp", none.alias("i"), none.alias("j"), "node", "text"), k, percent)
    large = placed.where("blocks IS NOT NULL")
    if not large.isEmpty():
        found = found.union(in_blocks(texts.where("blocks IS NOT NULL").select("node", "text"), large, k, percent))
    found = written(found, "verified-links")
    labelled = classes.join(found, classes["h1"] == found["node"], "left").withColumn("of", F.coalesce("root", "h1"))
    names = labelled.groupBy("of").agg(F.min("rep").alias("component"))
    labelled = labelled.join(names, "of").select("h1", "h2", "n", "many", "component")
    # classes of many copies, of which there are few, meet their rows by broadcast
    hot = F.col("many") > max(HUB, sets.count() // HUBS)
    rows = sets.join(F.broadcast(labelled.where(hot).select("h1", "h2", "n", F.col("component").alias("of_hot"))), ["h1", "h2", "n"], "left")
    cold = rows.where("of_hot IS NULL").drop("of_hot").join(labelled.where(~hot).select("h1", "h2", "n", "component"), ["h1", "h2", "n"], "left")
    rows = cold.select("doc_id", "n", "component").union(rows.where("of_hot IS NOT NULL").select("doc_id", "n", F.col("of_hot").alias("component")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without all but the smallest document of every group, and without repeated rows.

    A document is a doc_id with a text, either may be null: texts under one doc_id, or under none, are linked and kept each on
    its own. Of a group the smallest doc_id stays, null ids last; of rows that repeat a document, the smallest by the other
    columns. What has no shingle is in no group and stays. Documents are told apart by 64-bit hashes.
    """
    key = F.xxhash64("doc_id", "text")
    linked = linked_documents(docs.select(key.alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("_kept_key"), "component_id").distinct()
    ids = docs.select(key.alias("_kept_key"), F.col("doc_id").cast("long").alias("id")).distinct()
    smallest = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "_kept_key"))
    kept = linked.join(ids, "_kept_key").groupBy("component_id").agg(smallest.alias("kept")).select("kept._kept_key")
    keys = docs.select(key.alias("_kept_key")).groupBy("_kept_key").agg(F.count("*").alias("n")).join(kept.withColumn("stays", F.lit(True)), "_kept_key", "left")
    keys = written(keys.select("_kept_key", F.coalesce("stays", F.lit(False)).alias("stays"), "n"), "document-keys")
    stays, again = F.col("stays"), F.col("stays") & (F.col("n") > 1)
    many = keys.agg(F.count_if(stays).alias("stay"), F.count_if(~stays).alias("go"), F.count_if(again).alias("again")).first()
    rows = docs.select(F.struct("*").alias("row"), key.alias("_kept_key"))
    others = F.to_json(F.struct(*[F.col("row").getField(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0)))
    least = lambda rows: rows.groupBy("_kept_key").agg(F.min_by("row", others).alias("row")).select("row.*")
    if min(many["stay"], many["go"]) > FEW_KEYS or many["again"] > FEW_KEYS:
        # one shuffle of rows by their key: the aggregation that follows needs no other
        return least(rows.join(keys.where(stays).select("_kept_key").hint("merge"), "_kept_key", "left_semi"))
    # rows stay where they are but for those that repeat a document
    few = lambda which: F.broadcast(keys.where(which).select("_kept_key"))
    rows = rows.join(few(~stays), "_kept_key", "left_anti") if many["go"] <= many["stay"] else rows.join(few(stays), "_kept_key", "left_semi")
    if not many["again"]:
        return rows.select("row.*")
    return rows.join(few(again), "_kept_key", "left_anti").select("row.*").union(least(rows.join(few(again), "_kept_key", "left_semi")))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c.n >= 85 * (p.n + q.n - c.n)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS z FROM b UNION SELECT r.doc_id, b.y FROM r JOIN b ON b.x = r.z),
k AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
