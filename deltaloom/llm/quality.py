"""Quality of documents by a byte-level convolutional network in numpy.

Bytes are embedded; filters eight bytes wide step through the whole document four bytes at a time, so neighbouring chunks
overlap by half; responses are max-pooled over windows of 512 bytes that overlap by half; the means and the maxima of the
windows over the document are combined into one probability by a logistic unit. No part of a document is left out.

Training uses labelled rows only, from a bounded sample: at most ``SAMPLE_ROWS`` rows of those with crc32(doc_id as text)
mod 4 other than 2, the first by the hash of their id, of at most ``SAMPLE_CHARS`` characters each, so 90 million characters
reach the driver at most. Scores depend on the text alone. Scoring is a map over documents; memory is one step of texts.

Defined results: a null text scores as the empty text; a null doc_id counts as crc32 of the empty string, which is 0, so it
isn't held out, and it has no label; of several labels of an id the best counts, of several texts of an id the
smallest is trained on; with no labelled row nothing is known against a document and every score is 1; rows that repeat score
alike; equal scores need no order; a text of any length is scored as a whole; other columns are ignored in ``scored`` and unchanged in
``kept_documents``, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, released

SAMPLE_ROWS, SAMPLE_CHARS, THRESHOLD = 3_000, 30_000, 0.7
DIM, FILTERS, QUAD, WINDOW = 8, 24, 4, 64  # WINDOW: positions in half a pooling window


class ByteCnn:
    """Parameters and both directions of the network."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        half = (QUAD * DIM, FILTERS)
        self.p = {
            "embed": rng.normal(0, 0.5, (257, DIM)),
            "first": rng.normal(0, (2 * QUAD * DIM) ** -0.5, half),
            "second": rng.normal(0, (2 * QUAD * DIM) ** -0.5, half),
            "bias": np.zeros(FILTERS),
            "out": np.zeros(2 * FILTERS),
            "shift": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["embed"][256] = 0

    @staticmethod
    def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols by fours (256 pads), the first position and the number of positions of each document, its windows' starts."""
        quads = np.array([-(-len(t) // QUAD) + 1 for t in texts], np.int64)
        pad = b"".join(t + b"\0" * (int(q) * QUAD - len(t)) for t, q in zip(texts, quads))
        symbols = np.frombuffer(pad, np.uint8).astype(np.int16)
        ends = np.cumsum(quads)
        starts = ends - quads
        sizes = np.array([len(t) for t in texts], np.int64)
        fill = quads * QUAD - sizes
        at = np.repeat(starts * QUAD + sizes - np.concatenate([[0], np.cumsum(fill)[:-1]]), fill) + np.arange(int(fill.sum()))
        symbols[at] = 256
        return symbols.reshape(-1, QUAD), starts, quads - 1, ends

    def forward(self, texts: list[bytes], keep: bool = False):
        p = self.p
        symbols, starts, positions, _ = self.laid_out(texts)
        if keep:
            x = p["embed"][symbols].reshape(len(symbols), QUAD * DIM)
            response = x @ p["first"]
            response[:-1] += (x @ p["second"])[1:]
        else:  # by tables, in one order: a large product rounds by its number of rows, so a text's score would depend on its batch
            first, second = ([p["embed"] @ p[side][j * DIM : (j + 1) * DIM] for j in range(QUAD)] for side in ("first", "second"))
            response, ahead = first[0][symbols[:, 0]], symbols[1:]
            for j in range(1, QUAD):
                response += first[j][symbols[:, j]]
            for j in range(QUAD):
                response[:-1] += second[j][ahead[:, j]]
        response += p["bias"]
        # half windows of each document; the last position of a document is padding and belongs to none
        halves = np.maximum(1, -(-positions // WINDOW))
        owner = np.repeat(np.arange(len(texts)), halves)
        first = np.concatenate([[0], np.cumsum(halves)[:-1]])
        half_start = starts[owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
        response[starts + positions] = -np.inf
        pooled = np.maximum.reduceat(response, half_start, axis=0)
        full = pooled.copy()
        joined = owner[:-1] == owner[1:]
        full[:-1][joined] = np.maximum(pooled[:-1], pooled[1:])[joined]
        # a document of several half windows has one window less than halves; the last half stands in the one before
        counts = np.where(halves > 1, halves - 1, 1)
        last = first + halves - 1
        use = np.ones(len(owner), bool)
        use[last[halves > 1]] = False
        windows, window_owner = np.maximum(full[use], 0), owner[use]
        window_first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(windows, window_first, axis=0) / counts[:, None]
        most = np.maximum.reduceat(windows, window_first, axis=0)
        features = np.concatenate([mean, most], axis=1)
        if not keep:
            return (features * p["out"]).sum(axis=1) + p["shift"][0]
        return features @ p["out"] + p["shift"][0], (symbols, x, response, half_start, use, owner, windows, window_owner, counts, window_first, features, most, pooled, starts, positions)

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p = self.p
        logits, (symbols, x, response, half_start, use, owner, windows, window_owner, counts, window_first, features, most, pooled, starts, positions) = self.forward(texts, True)
        prob = 1 / (1 + np.exp(-logits))
        loss = float(-np.mean(labels * np.log(prob + 1e-7) + (1 - labels) * np.log(1 - prob + 1e-7)))
        d = ((prob - labels) / len(texts)).astype(np.float32)
        g = {"out": features.T @ d, "shift": np.array([d.sum()], np.float32)}
        d_mean, d_most = np.outer(d, p["out"][:FILTERS]), np.outer(d, p["out"][FILTERS:])
        d_window = d_mean[window_owner] / counts[window_owner, None]
        at_most = windows == most[window_owner]
        ties = np.add.reduceat(at_most.astype(np.float32), window_first, axis=0)
        d_window = (d_window + at_most * (d_most / ties)[window_owner]) * (windows > 0)
        # to the half window that holds the maximum, then to its position
        w, f = np.nonzero(d_window)
        h = np.flatnonzero(use)[w]
        after = np.minimum(h + 1, len(owner) - 1)
        h = np.where((owner[after] == owner[h]) & (pooled[after, f] > pooled[h, f]), after, h)
        value = d_window[w, f]
        # position of the maximum: search the half window of every (half, filter) in use
        pairs, back = np.unique(h * FILTERS + f, return_inverse=True)
        hh, ff = pairs // FILTERS, pairs % FILTERS
        span = np.minimum(half_start[hh][:, None] + np.arange(WINDOW), (starts + positions)[owner[hh]][:, None])
        place = half_start[hh] + np.argmax(response[span, ff[:, None]], axis=1)
        d_pair = np.bincount(back, value, len(pairs)).astype(np.float32)
        g["bias"] = np.bincount(ff, d_pair, FILTERS).astype(np.float32)
        spread = np.zeros((len(pairs), FILTERS), np.float32)
        spread[np.arange(len(pairs)), ff] = d_pair
        g["first"], g["second"] = x[place].T @ spread, x[place + 1].T @ spread
        g["embed"] = np.zeros_like(p["embed"])
        for side, shift in (("first", 0), ("second", 1)):
            d_x = (d_pair[:, None] * p[side].T[ff]).reshape(-1, DIM)
            s = symbols[place + shift].ravel()
            for j in range(DIM):
                g["embed"][:, j] += np.bincount(s, d_x[:, j], 257).astype(np.float32)
        g["embed"][256] = 0
        return loss, g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 11) -> "ByteCnn":
        rng = np.random.default_rng(seed)
        share = min(max(labels.mean(), 0.01), 0.99)
        self.p["shift"][0] = np.log(share / (1 - share))
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        steps = max(1, epochs * -(-len(texts) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                chosen = order[i : i + batch]
                _, g = self.gradients([texts[j] for j in chosen], labels[chosen])
                t += 1
                step = rate * min(1, 2 * (1 - (t - 1) / steps))
                for k, x in self.p.items():
                    grad = g[k] + (1e-4 * x if k == "out" else 0)
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    x -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, texts: list[bytes], most: int = 500_000) -> np.ndarray:
        out, start, held = [], 0, 0
        for i, t in enumerate([*texts, None]):
            if t is None or held and held + len(t) > most:
                if start < i:
                    out.append(1 / (1 + np.exp(-self.forward(texts[start:i]).astype(np.float64))))
                start, held = i, 0
            held += len(t or b"")
        return np.concatenate(out) if out else np.empty(0)


def bucket(doc_id, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ByteCnn | None:
    """Trained on the driver from at most ``rows`` texts; None if there is no labelled row."""
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    ids = ids.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(rows)
    texts = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    found = sorted((r["doc_id"], r["quality"], r["text"]) for r in texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text")).collect())  # ids: ``rows`` at most
    if not found:
        return None
    texts, marks = [t.encode() for _, _, t in found], np.array([q for _, q, _ in found], np.float32)
    del found
    net = ByteCnn().fit(texts, marks)
    released()
    return net


def scored(docs: DataFrame, model: ByteCnn | None, keep: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; with ``keep``, the columns of ``docs`` and the score in a column of that name."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.p if model else None)  # a few thousand numbers
    rows = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = (", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{keep}` double" if keep else "doc_id long, held_out boolean, score double, predicted int")

    def make():
        net = ByteCnn() if shared.value else None
        if net:
            net.p = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            score = net.scores(texts) if net else np.ones(len(texts))
            if keep:
                return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, keep])
            held = [bucket(d, 4) == 2 for d in batch.column("doc_id").to_pylist()]
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": pa.array(held), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

        return step

    return map_text(rows, make, schema)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, unchanged."""
    # by place, as workers take no names with dots
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)])
    return scored(plain, fit_quality(plain, labels), keep="score").where(F.col("score") >= THRESHOLD).drop("score").toDF(*docs.columns)
