"""Benchmark passages and collocations: against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaloom.llm import collocations, decontaminate
from deltaloom.llm.fmindex import SampledIndex, full_suffix_order
from deltaloom.llm.words import U, Numbers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string"
EXTRA = ("spans", "th", "items", "word", "block", "a.b", "row", "f", "s1", "depth")


def frame(spark, rows, schema=SCHEMA, extra=False):
    df = spark.createDataFrame(rows, schema).repartition(3)
    for name in EXTRA if extra else ():
        df = df.withColumn(name, F.lit(1))
    return df


# the index


@pytest.mark.parametrize("seed", range(20))
def test_index_counts_and_locates(seed):
    rng = np.random.default_rng(seed)
    size, n = int(rng.integers(2, 6)), int(rng.integers(1, 300))
    text = np.append(rng.integers(seed % 2, size, n), 0)
    index = SampledIndex(text, size, int(rng.integers(1, 7)))
    patterns, lengths = rng.integers(1, size, (40, 5)), rng.integers(1, 6, 40)
    for p, k, low, high in zip(patterns, lengths, *index.search(patterns, lengths)):
        expected = [i for i in range(len(text) - k + 1) if (text[i : i + k] == p[:k]).all()]
        assert sorted(index.locate(np.arange(low, high)).tolist()) == expected


def test_suffix_order_with_long_repeats():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.tile(np.append(rng.integers(1, 4, 90), 0), 6), [0, 0]])
    cut = [i + text[i:].tolist().index(0) for i in range(len(text))]
    assert full_suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: (text[i : cut[i]].tolist() + [0], cut[i]))


def test_numbers_of_hashes():
    rng = np.random.default_rng(2)
    known = np.unique(rng.integers(0, 1 << 63, 5_000).astype(U) & ~U(0xFF0))  # many share a slot
    rng.shuffle(known)
    asked = np.concatenate([known, known + U(1)])
    place = {int(h): i for i, h in enumerate(known)}
    assert Numbers(known)(asked).tolist() == [place.get(int(h), -1) for h in asked]
    assert Numbers(known[:0])(asked[:3]).tolist() == [-1, -1, -1]


# benchmark passages


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows_of(items, window):
    out = {}
    for name, item in items:
        w = item_words(item)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(tuple(w[k : k + window]), set()).update({str(name)} if name is not None else set())
    return out


def hits(text, windows, window):
    words, hit, found = item_words(text), set(), set()
    for i in range(len(words)):
        for n in range(1, min(window, len(words) - i) + 1):
            if (names := windows.get(tuple(words[i : i + n]))) is not None:
                hit.update(range(i, i + n))
                found |= names
    return words, hit, sorted(found)


def bench_fixture(rng):
    word = lambda: rng.choice(["Alpha", "beta", "gämma", "δ", "x1", "2", "the", "of"])
    line = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(word() for _ in range(n))
    items = [(k, line(rng.randint(1, 14))) for k in range(12)]
    items += [(3, items[5][1]), (100, items[5][1]), (None, line(5)), (7, None), (8, ""), (9, "?!"), (20, line(9_000)), (21, "zz")]
    texts = [line(rng.randint(0, 60)) for _ in range(25)]
    texts += [f"{line(4)} {items[k][1]}{rng.choice(['', ' ', '.'])}{line(3)}" for k in range(12)] + [items[18][1], items[18][1][400:9_000].upper(), None, "", "…", "zz", "zzz ZZ_zz"]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    return rows + rows[25:28] + [(None, texts[26], None), (None, None, None), (5, texts[27], "de")], items


@pytest.mark.parametrize("seed,window,block", [(0, 10, 500_000), (1, 4, 500_000), (2, 10, 900), (3, 3, 2_000)])
def test_passages_equal_brute_force(spark, seed, window, block):
    rng = random.Random(seed)
    rows, items = bench_fixture(rng)
    bench = frame(spark, items, "item_id long, text string", extra=True)
    got = decontaminate.passages(frame(spark, rows, extra=True), bench, window, True, block).collect()
    expected, windows = [], windows_of(items, window)
    for doc, text, _ in rows:
        words, hit, found = hits(text, windows, window)
        expected.append((doc, len(words), tuple(sorted(hit)), tuple(found)))
    seen = [(r["doc_id"], r["n_words"], tuple(i for s in r["spans"] for i in range(s["first"], s["last"])), tuple(r["items"])) for r in got]
    assert Counter(seen) == Counter(expected)
    assert any(e[2] for e in expected) and not all(e[2] for e in expected)
    for r in got:
        for s in r["spans"]:
            part = r["text"][s["start"] : s["end"]]
            assert item_words(part) == item_words(r["text"])[s["first"] : s["last"]] and item_words(part[:1]) and item_words(part[-1:])
        assert all(a["last"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_decontaminate_digests_and_cut_texts(spark):
    docs = frame(spark, [(1, "Keep this: one two three four five six seven eight nine ten ELEVEN, and this.", "en"), (2, "one two three", "en"), (3, None, None)])
    bench = frame(spark, [(2, "one two three four five six seven eight nine ten eleven"), (10, "three four, five six seven eight nine ten eleven and this now")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.digests(docs, bench).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (15, 13, 2, True)
    assert got[1]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest()
    assert (got[2]["n_hit"], got[3]["n_words"], got[3]["contaminated"], got[3]["items_sha256"]) == (0, 0, False, hashlib.sha256(b"").hexdigest())
    cut = {r["doc_id"]: r["text"] for r in decontaminate.without_passages(docs, bench).collect()}
    assert cut == {1: "Keep this: .", 2: "one two three", 3: ""}


def test_decontaminate_empty_tables(spark):
    docs, bench = frame(spark, [(1, "a b c", "en")]), frame(spark, [(1, "a b")], "item_id long, text string")
    assert decontaminate.digests(docs.limit(0), bench).count() == 0
    row = decontaminate.digests(docs, bench.limit(0)).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (3, 0, False)


# collocations


def best_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        mine = {p: a for (of, p), a in f.items() if of == lang and len(p) > 1 and a >= least}
        hidden = {p[i:j] for p, a in mine.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and p[i:j] in mine and 100 * a >= 80 * mine[p[i:j]]}
        ranked = []
        for p, a in mine.items():
            if p not in hidden:
                score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def prose(rng, n):
    parts = ["New York", "the", "of the", "Ünder", "a b c d e", "x", "ﬀ", "\u00a0", "in-line", "'s", "a", "b", "\x00", "new"]
    return "".join(rng.choice(parts) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(n))


def phrase_rows(seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["en", "en", "de", None, "und", ""])) for i in range(60)]
    return rows + [(1, None, "en"), (2, "", "en"), (None, prose(rng, 20), "fr"), (3, prose(rng, 6_000), "en"), (4, "Zu zu zu zu " * 40, "zz")] + rows[:5]


@pytest.mark.parametrize("seed,least,top,numbered,per_range", [(0, 3, 2_000, 1 << 20, 10**6), (1, 2, 7, 1 << 20, 300), (2, 3, 40, 6, 500), (3, 30, 2_000, 0, 2_000), (4, 2, 2_000, 3, 40)])
def test_collocations_equal_brute_force(spark, seed, least, top, numbered, per_range):
    rows = phrase_rows(seed)
    got = collocations.collocations(frame(spark, rows, extra=True), least, top, numbered, per_range)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == best_phrases(rows, least, top)


def test_collocations_of_few_or_no_words(spark):
    assert collocations.collocations(frame(spark, [(1, "a b", "en")]).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [(1, "a b", "en"), (2, None, None), (3, " . ", None)])).count() == 0


@pytest.mark.parametrize("most", [5, 40_000, 1 << 40])
def test_tries_in_order_cut_and_back(most):
    rng = np.random.default_rng(most)
    columns = [rng.integers(0, most, 3_000) // (1 + 2 * k) for k in range(4)]
    counts = rng.integers(1, 500, 3_000)
    whole = Counter()
    for p, n in zip(zip(*(c.tolist() for c in columns)), counts.tolist()):
        whole[p] += n
    got, sums = collocations.sorted_paths(columns, counts)
    paths = list(zip(*(c.tolist() for c in got)))
    assert paths == sorted(whole) and sums.tolist() == [whole[p] for p in paths]
    back, again = collocations.read_back(collocations.serialised(got, sums))
    assert [c.tolist() for c in back] == [c.tolist() for c in got] and again.tolist() == sums.tolist()
    keys = np.array([paths[0], paths[7], (paths[9][0], 0, 0, 0), (most, most, most, most)])
    assert collocations.cut_places(got, keys).tolist() == [sum(p < tuple(k) for p in paths) for k in keys.tolist()]
