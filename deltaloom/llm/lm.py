"""Language-model scores: a log-bilinear model trained in numpy with noise-contrastive estimation.

What is learned grows with the corpus. Every word of the training documents is counted. The ``embedded(N)`` most frequent of
them, in proportion to the cube root of the N training tokens, are symbols of their own; the words after them share symbols by
the logarithm of their count, those past the ``FREQUENT`` most frequent ones share one with unknown words, and the end of a
text is a symbol. So every counted word has an embedding, as a context and as an outcome. The model predicts a symbol from the
two before it: r = C1 * R[w-1] + C2 * R[w-2]. Symbols stand in groups by frequency, about as many as a group has symbols:
P(symbol) = P(group) * P(symbol in its group), where both are normalised over logits q * r + b by batched matrix products;
within a symbol that several words share, a word has its smoothed share. So the whole is normalised over words.

It is trained on the runs of three symbols of all training tokens. In a pass, a task begins with the parameters that all share
and takes every run of its documents once; the tasks' parameters are averaged by their numbers of runs, in blocks by a
shuffle. Corpora with fewer tokens than ``drawn(N)`` get several passes. Each run's group is told from groups drawn from their
unigram, its symbol from symbols drawn from the unigram of the group, for a batch at once. Counts and runs cover all documents.

Counts of the most frequent words are sent to the workers (``FREQUENT`` entries at most); all rarer words of a document are
joined with the counts by a shuffle. Words are told apart by 64-bit hashes of their bytes. Counting, joining and summing are
aggregations that spread over all words, so a hot source or word is pre-aggregated where it is read.

Defined results: a null text is empty and has the end token only; a null doc_id hashes as the empty string, so it is held
out; rows that repeat are counted and scored each; words of equal counts are ranked by their hashes; without training
documents every token is unknown: c = N = V = 0; a text of any length is scored as a whole, and a task holds one text at least;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_STEP, map_text, released, steps, written
from .words import U, word_hashes

FREQUENT, DIM = 150_000, 24
MOD = 10


def embedded(tokens: int) -> int:
    """How many words have a symbol of their own."""
    return max(64, round(2 * tokens ** (1 / 3)))


def drawn(tokens: int) -> int:
    """Of how many tokens the runs are learned from at least, all passes together."""
    return round(5_000 * tokens ** (1 / 3))


def passes(tokens: int) -> int:
    """How often all training documents are passed over."""
    return min(4, max(1, round(1.5 * drawn(tokens) / max(1, tokens))))


def remainder(doc_id, mod: int = MOD) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def training(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([remainder(d) != 0 for d in batch.column("doc_id").to_pylist()], bool)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents, words as hashes; the null word is the end of a text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            use = training(batch)
            hashes, _ = word_hashes(batch.column("text").filter(pa.array(use)), lower=True)
            words, n = np.unique(hashes, return_counts=True)
            words = pa.concat_arrays([pa.array(words.view(np.int64)), pa.array([None], pa.int64())])
            return pa.RecordBatch.from_pydict({"word": words, "n": pa.array(np.append(n, use.sum()))})

        return step

    return map_text(docs.select("doc_id", "text"), make, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Words sent to the workers, by hash: their counts, and the symbol of each; the last two entries are rare words and the end."""

    tokens: int
    distinct: int
    ends: int
    hashes: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    mass: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, ends: int) -> "Vocabulary":
        """``words`` by falling count; symbols: words of their own, shared ones by the logarithm of the count, rare, end."""
        own = min(embedded(tokens), len(words))
        bins = np.log2(np.maximum(counts[own:], 1)).astype(np.int64)
        used, place = np.unique(-bins, return_inverse=True)  # the most frequent first
        symbol = np.concatenate([np.arange(own), own + place, [own + len(used), own + len(used) + 1]]).astype(np.int64)
        inside = np.concatenate([counts + 0.1, [0.0, ends + 0.1 * (ends > 0)]])
        inside[-2] = tokens + 0.1 * (distinct + 1) - inside.sum()  # all rarer words and unknown ones
        if not ends:
            inside[-1] = 1e-9
        order = np.argsort(words)
        order = np.concatenate([order, [len(words), len(words) + 1]]).astype(np.int64)
        return cls(tokens, distinct, ends, words[order[:-2]], np.concatenate([counts, [0, ends]])[order], symbol[order], np.bincount(symbol, inside))

    @property
    def scale(self) -> float:
        return self.tokens + 0.1 * (self.distinct + 1)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each word; rare ones have the last but one."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, len(self.hashes))

    def tokens_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of all tokens, each text followed by its end; how many each text has; and the hashes of its words."""
        hashes, sizes = word_hashes(column, lower=True)
        ends = np.cumsum(sizes + 1) - 1
        entry = np.full(len(hashes) + len(sizes), len(self.hashes) + 1, np.int64)
        inside = np.ones(len(entry), bool)
        inside[ends] = False
        entry[inside] = self.places(hashes)
        return entry, sizes + 1, hashes

    def contexts(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols one and two places before each; what stands before a text counts as ends."""
        end = len(self.mass) - 1
        last, before = np.concatenate([[end], symbols[:-1]]), np.concatenate([[end, end], symbols[:-2]])[: len(symbols)]
        before[np.cumsum(sizes) - sizes] = end
        return last, before


class LogBilinear:
    """Parameters, noise-contrastive training and normalised scores. ``mass``: the unigram of the symbols, most frequent first."""

    def __init__(self, mass: np.ndarray, seed: int = 5):
        rng, n = np.random.default_rng(seed), len(mass)
        self.wide = math.ceil(math.sqrt(n))  # symbols of a group
        self.noise = np.maximum(mass, 1e-9) / np.maximum(mass, 1e-9).sum()
        self.group = np.arange(n) // self.wide
        self.group_noise = np.bincount(self.group, self.noise)
        normal = lambda *shape: rng.normal(0, 0.1, shape)
        self.p = {
            "R": normal(n, DIM), "C1": np.eye(DIM), "C2": 0.5 * np.eye(DIM),
            "G": normal(len(self.group_noise), DIM), "g": np.log(self.group_noise),
            "Q": normal(n, DIM), "b": np.log(self.noise / self.group_noise[self.group]),
        }

    def fit(self, runs: np.ndarray, counts: np.ndarray, batch: int = 4096, k: int = 6, rate: float = 0.01, decay: float = 0.5, passes: float = 1.5, seed: int = 6) -> "LogBilinear":
        """Tell a run's own group from ``k`` drawn groups, and its symbol from ``k`` drawn from the group, in about ``passes`` passes."""
        if not counts.sum():
            return self
        n, rng, p = len(self.noise), np.random.default_rng(seed), self.p
        steps = max(60, round(passes * counts.sum() / batch))
        total, ends = np.cumsum(counts), np.cumsum(self.noise)
        starts = np.concatenate([[0.0], np.cumsum(self.group_noise)])
        m, v = {x: np.zeros_like(y) for x, y in p.items()}, {x: np.zeros_like(y) for x, y in p.items()}
        for t in range(1, steps + 1):
            codes = runs[np.searchsorted(total, rng.random(batch) * total[-1], "right")]
            w2, w1, w = codes // (n * n), codes // n % n, codes % n
            a1, a2 = p["R"][w1], p["R"][w2]
            r = a1 @ p["C1"] + a2 @ p["C2"]
            own = self.group[w]
            groups = np.minimum(np.searchsorted(starts[1:], rng.random((batch, k)) * starts[-1], "right"), len(self.group_noise) - 1)
            spot = starts[own][:, None] + rng.random((batch, k)) * self.group_noise[own][:, None]
            symbols = np.clip(np.searchsorted(ends, spot, "right"), (own * self.wide)[:, None], np.minimum((own + 1) * self.wide, n)[:, None] - 1)
            d_r, g = np.zeros_like(r), {}
            for q, b, outs, noise in (("G", "g", np.column_stack([own, groups]), self.group_noise), ("Q", "b", np.column_stack([w, symbols]), self.noise / self.group_noise[self.group])):
                table = p[q][outs]
                d = 1 / (1 + np.exp(-(np.einsum("bd,bkd->bk", r, table) + p[b][outs] - np.log(k * noise[outs]))))
                d[:, 0] -= 1
                d /= batch
                d_r += np.einsum("bk,bkd->bd", d, table)
                g[b] = np.bincount(outs.ravel(), d.ravel(), len(p[b]))
                g[q] = np.zeros_like(p[q])
                np.add.at(g[q], outs.ravel(), (d[:, :, None] * r[:, None, :]).reshape(-1, DIM))
            g["C1"], g["C2"], g["R"] = a1.T @ d_r, a2.T @ d_r, np.zeros_like(p["R"])
            np.add.at(g["R"], w1, d_r @ p["C1"].T)
            np.add.at(g["R"], w2, d_r @ p["C2"].T)
            step = rate * min(1, 2 * (1 - (t - 1) / steps))
            for x, y in p.items():
                m[x] = 0.9 * m[x] + 0.1 * g[x]
                v[x] = 0.999 * v[x] + 0.001 * g[x] * g[x]
                if x in ("G", "Q", "R"):
                    y *= 1 - step * decay
                y -= step * (m[x] / (1 - 0.9**t)) / (np.sqrt(v[x] / (1 - 0.999**t)) + 1e-8)
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([y.ravel() for y in self.p.values()])

    def set_flat(self, values: np.ndarray) -> "LogBilinear":
        at = 0
        for x, y in self.p.items():
            self.p[x] = values[at : at + y.size].reshape(y.shape).astype(np.float64)
            at += y.size
        return self

    def ready(self) -> "LogBilinear":
        """Tables in single precision for ``log10``; a group's symbols side by side, without those the last group lacks."""
        p, f = self.p, np.float32
        self.from_last, self.from_before = (p["R"] @ p["C1"]).astype(f), (p["R"] @ p["C2"]).astype(f)
        self.to_group, self.group_bias = p["G"].T.astype(f).copy(), p["g"].astype(f)
        return self

    @staticmethod
    def _chosen(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = logits[np.arange(len(logits)), at]
        top = logits.max(1)
        logits -= top[:, None]
        np.exp(logits, out=logits)
        return own - top - np.log(logits.sum(1))

    def log10(self, before: np.ndarray, last: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """log10 P(symbol | before, last) of each, normalised over groups and over the symbols of the group."""
        out, group = np.empty(len(symbols)), self.group[symbols]
        order = np.argsort(group, kind="stable")
        for lo in range(0, len(order), 65_536):  # tokens of a group stand together
            at = order[lo : lo + 65_536]
            r = self.from_last[last[at]] + self.from_before[before[at]]
            found = self._chosen(r @ self.to_group + self.group_bias, group[at]).astype(np.float64)
            edges = np.flatnonzero(np.diff(group[at])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
                first = int(group[at[a]]) * self.wide
                stop = min(first + self.wide, len(self.noise))
                logits = r[a:b] @ self.p["Q"][first:stop].T.astype(np.float32) + self.p["b"][first:stop].astype(np.float32)
                found[a:b] += self._chosen(logits, symbols[at[a:b]] - first)
            out[at] = found
        return out / math.log(10)


def summed(rows: np.ndarray, keys: np.ndarray, many: int) -> np.ndarray:
    """Rows added up by key; ``keys`` in order."""
    out = np.zeros((many, *rows.shape[1:]), rows.dtype)
    if len(keys):
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        out[keys[first]] = np.add.reduceat(rows, first)
    return out


class Learner:
    """Noise-contrastive passes over all runs of a task, in single precision; a batch shares its drawn groups, and its drawn symbols in each group."""

    def __init__(self, model: LogBilinear, seed: int, done: int = 0, k: int = 16, rate: float = 0.01, decay: float = 0.5):
        self.model, self.rng, self.k, self.rate, self.decay = model, np.random.default_rng(seed), k, rate, decay
        self.p = {x: y.astype(np.float32) for x, y in model.p.items()}
        self.m, self.v = ({x: np.zeros_like(y) for x, y in self.p.items()} for _ in range(2))
        self.starts, self.ends = np.cumsum(model.group_noise), np.cumsum(model.noise)
        self.inside = np.log(model.noise / model.group_noise[model.group]).astype(np.float32)
        self.t, self.done, self.runs = 0, done, 0

    def take(self, runs: np.ndarray) -> None:
        """Every run once, in random order: small batches at first, larger ones when much was seen."""
        runs = self.rng.permutation(runs)
        batch = min(4_096, max(512, len(runs) // 200)) if not self.runs else 16_384
        for lo in range(0, len(runs), batch):
            self.step(runs[lo : lo + batch])
        self.runs += len(runs)

    def told(self, r, own, others, table, bias, noise):
        """d of the own outcome and of drawn ones: how far each is from being told as data or noise."""
        log_k = np.float32(math.log(self.k))
        told = lambda x: 1 / (1 + np.exp(-x))
        yes = told(np.einsum("bd,bd->b", r, table[own]) + bias[own] - noise[own] - log_k) - 1
        return yes, told(r @ table[others].T + bias[others] - noise[others] - log_k)

    def step(self, codes: np.ndarray) -> None:
        p, model, n = self.p, self.model, len(self.model.noise)
        w = codes % n
        order = np.argsort(w, kind="stable")
        codes, w = codes[order], w[order]
        w2, w1, own = codes // (n * n), codes // n % n, model.group[w]
        a1, a2 = p["R"][w1], p["R"][w2]
        r = a1 @ p["C1"] + a2 @ p["C2"]
        many, d_r, g = len(model.group_noise), np.zeros_like(r), {x: np.zeros_like(y) for x, y in p.items()}
        groups = np.minimum(np.searchsorted(self.starts, self.rng.random(self.k) * self.starts[-1], "right"), many - 1)
        spans = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist() + [len(own)]
        parts = [(0, len(own), own, groups, "G", "g", np.log(model.group_noise).astype(np.float32))]
        for a, b in zip(spans, spans[1:]):
            first = int(own[a]) * model.wide
            last = min(first + model.wide, n) - 1
            low = self.ends[first - 1] if first else 0.0
            symbols = np.clip(np.searchsorted(self.ends, low + self.rng.random(self.k) * (self.ends[last] - low), "right"), first, last)
            parts.append((a, b, w[a:b], symbols, "Q", "b", self.inside))
        for a, b, mine, others, q, bias, noise in parts:
            yes, no = self.told(r[a:b], mine, others, p[q], p[bias], noise)
            d_r[a:b] += yes[:, None] * p[q][mine] + no @ p[q][others]
            g[q] += summed(yes[:, None] * r[a:b], mine, len(p[q]))
            g[bias] += summed(yes, mine, len(p[bias]))
            np.add.at(g[q], others, no.T @ r[a:b])
            np.add.at(g[bias], others, no.sum(0))
        g["C1"], g["C2"] = a1.T @ d_r, a2.T @ d_r
        for c, at in (("C1", w1), ("C2", w2)):
            by = np.argsort(at, kind="stable")
            g["R"] += summed((d_r @ p[c].T)[by], at[by], n)
        self.t += 1
        step = np.float32(self.rate / math.sqrt(1 + self.t / 200 + self.done))
        for x, y in p.items():
            d = g[x] / np.float32(len(codes))
            self.m[x] += np.float32(0.1) * (d - self.m[x])
            self.v[x] += np.float32(0.001) * (d * d - self.v[x])
            if x in ("G", "Q", "R"):
                y *= 1 - step * np.float32(self.decay)
            y -= step * (self.m[x] / np.float32(1 - 0.9**self.t)) / (np.sqrt(self.v[x] / np.float32(1 - 0.999**self.t)) + np.float32(1e-8))

    def flat(self) -> np.ndarray:
        return np.concatenate([y.ravel() for y in self.p.values()])


#: Parameters of a row that goes to be averaged, and runs that a task holds at once.
BLOCK, HELD = 8_192, 1_000_000


def passed(docs: DataFrame, vocabulary: Vocabulary, model: LogBilinear, done: int) -> LogBilinear:
    """The model after every run of every training document was taken once: the tasks' parameters, averaged by their runs."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))  # FREQUENT words, embedded(N) symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, model = shared.value
        part, many = TaskContext.get().partitionId(), len(vocabulary.mass)
        learner, held, size = Learner(model, 1_000 * done + part, done), [], 0
        for batch in batches:
            for piece in steps(batch):
                entry, sizes, _ = vocabulary.tokens_of(piece.column("text").filter(pa.array(training(piece))))
                if not len(entry):
                    continue
                symbols = vocabulary.symbol[entry]
                last, before = vocabulary.contexts(symbols, sizes)
                held.append((before * many + last) * many + symbols)
                size += len(symbols)
                if size >= (HELD if learner.runs else HELD // 4):
                    learner.take(np.concatenate(held))
                    held, size = [], 0
        if size:
            learner.take(np.concatenate(held))
        values = learner.flat()
        for i in range(0, len(values) if learner.runs else 0, BLOCK):
            yield pa.RecordBatch.from_pydict({"block": pa.array([i // BLOCK], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([learner.runs], pa.int64()), "values": pa.array([values[i : i + BLOCK].tobytes()], pa.binary())})
        released()

    def average(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")  # so that sums are the same in any order of arrival
        total, n = 0.0, 0
        for size, values in zip(rows["n"].to_pylist(), rows["values"]):
            total, n = total + size * np.frombuffer(values.as_buffer(), np.float32).astype(np.float64), n + size
        return pa.table({"block": rows["block"].slice(0, 1), "n": pa.array([n], pa.int64()), "values": pa.array([(total / n).tobytes()], pa.binary())})

    found = docs.select("doc_id", "text").mapInArrow(run, "block int, part int, n long, values binary").groupBy("block").applyInArrow(average, "block int, n long, values binary").orderBy("block").toArrow()  # one model
    return model.set_flat(np.concatenate([np.frombuffer(x, np.float64) for x in found["values"].to_pylist()])) if found.num_rows else model


def learn(docs: DataFrame) -> tuple[Vocabulary, LogBilinear, DataFrame]:
    """The words, the model, and the counts of all words."""
    counts = written(word_counts(docs), "word-counts")
    total = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = counts.where("word IS NULL").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    frequent = counts.where("word IS NOT NULL AND c > 0").orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    vocabulary = Vocabulary.of(frequent["word"].to_numpy().view(U), frequent["c"].to_numpy(), int(total["n"]), int(total["v"]), int(ends))
    model = LogBilinear(vocabulary.mass)
    for done in range(passes(vocabulary.tokens)):
        model = passed(docs, vocabulary, model, done)
    return vocabulary, model.ready(), counts


def scored(docs: DataFrame, learned: tuple[Vocabulary, LogBilinear, DataFrame] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    vocabulary, model, counts = learned or learn(docs)
    scale, ends, rare = vocabulary.scale, vocabulary.ends, len(vocabulary.hashes)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))  # FREQUENT words, embedded(N) symbols

    def make():
        from pyspark import TaskContext

        vocabulary, model = shared.value
        base = np.log10((vocabulary.counts + 0.1) / scale)
        base[rare] = 0.0  # joined later
        share = base - np.log10(vocabulary.mass[vocabulary.symbol] / scale)
        share[-1] = 0.0
        uid = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal uid
            doc_ids = batch.column("doc_id")
            entry, sizes, hashes = vocabulary.tokens_of(batch.column("text"))
            symbols = vocabulary.symbol[entry]
            last, before = vocabulary.contexts(symbols, sizes)
            first = np.cumsum(sizes) - sizes
            tokens = model.log10(before, last, symbols) + share[entry]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            unknown = entry == rare
            n_rare = np.bincount(owner[unknown], minlength=len(sizes))
            # rare words of each text, once each
            words = np.full(len(entry), 0, U)
            words[entry != rare + 1] = hashes
            order = np.lexsort((words[unknown], owner[unknown]))
            w, o = words[unknown][order], owner[unknown][order]
            new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])])) if len(w) else np.empty(0, np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(o[new], minlength=len(sizes)))]), pa.int32())
            columns = {
                "doc_id": doc_ids, "uid": pa.array(np.arange(uid, uid + len(sizes))),
                "held_out": pa.array([remainder(d) == 0 for d in doc_ids.to_pylist()]),
                "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(sizes - n_rare - (0 if ends else 1), pa.int64()),
                "base": pa.array(np.add.reduceat(base[entry], first) if len(first) else np.empty(0)), "model": pa.array(np.add.reduceat(tokens, first) if len(first) else np.empty(0)),
                "rare": pa.ListArray.from_arrays(offsets, pa.array(w[new].view(np.int64))),
                "times": pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(new, len(w))), pa.int32())),
            }
            uid += len(sizes)
            return pa.RecordBatch.from_pydict(columns)

        return step

    schema = "doc_id long, uid long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<long>, times array<int>"
    partial = written(map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema, most=SMALL_STEP), "lm-partial")
    words = partial.where(F.size("rare") > 0).select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    # counts of the most frequent words never reach this join
    least = int(vocabulary.counts[:rare].min()) if rare == FREQUENT else 0
    rarely = counts.where(F.col("word").isNotNull() & (F.col("c") <= least) & (F.col("c") > 0))
    joined = words.join(rarely.hint("merge"), "word", "left").select("uid", "times", F.coalesce("c", F.lit(0)).alias("c"))
    sums = joined.groupBy("uid").agg(F.sum(F.col("times") * F.log10((F.col("c") + 0.1) / scale)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    rows = partial.drop("rare", "times").join(sums, "uid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
