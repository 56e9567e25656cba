"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. A sequence of tokens is what merging would give exactly when every
adjacent pair is *compatible*, that is when merging the text of the two tokens alone gives these two again; so the pairs
of a whole batch of words are checked at once against a table of known pairs, and only words with a failing pair are
merged exactly. Words are the pieces the vocabulary's own pattern cuts.

All of that is done for the distinct chunks (what stands between white space) of a step of texts, in arrays: Arrow cuts and
tells them apart, an Aho-Corasick automaton walks all distinct words for the longest matches, and failing words are merged
side by side, a round at a time. Chunks repeat, so a worker keeps recent ones with their ids.

Defined results: null and empty texts have no tokens and decode to the empty string; rows that repeat are encoded each;
other columns are ignored, whatever their names. A worker holds a bounded number of chunks and one step of texts, a whole
document at least; a document is never cut, and a word of any length is merged in time n log n. Pairs of equal rank are
merged leftmost first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import map_text, trimmed

#: Stands between the symbols of words; no word has it.
BETWEEN = 512
BLANK = pa.scalar(" ", pa.large_string())
#: Text in bytes that is encoded at once: its distinct chunks are met once. What a step needs is several times that.
STEP = 1_000_000
#: No merge.
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter of every byte: itself where it is printable, else the next letter from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Pairs:
    """Ranks of the pairs that merge: a hash table in arrays, asked for many pairs at once."""

    def __init__(self, first: np.ndarray, second: np.ndarray, rank: np.ndarray):
        size = 1 << max(4, int(4 * len(rank)).bit_length())
        self.mask, self.shift = size - 1, np.uint64(64 - (size.bit_length() - 1))
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys, left = (first << 32) | second, np.arange(len(rank))
        slots, self.probes = self.slot(keys), 0
        while len(left):
            self.probes += 1
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]  # of several for one slot, one is in
            won = self.keys[slots[left]] == keys[left]
            self.ranks[slots[left[won]]] = rank[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is none; negative ids merge with nothing."""
        keys = (first.astype(np.int64) << 32) | second
        keys[(first < 0) | (second < 0)] = -2
        slots = self.slot(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.ranks[slots], NONE).astype(np.int32)
        left = np.flatnonzero((there != keys) & (there >= 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            slots[left] = (slots[left] + 1) & self.mask
            there = self.keys[slots[left]]
            hit = there == keys[left]
            out[left[hit]] = self.ranks[slots[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Merger:
    """The merges of a vocabulary file of the ``tokenizers`` library: type BPE, byte-level letters, optional word end.

    A word is a row of symbols, one for each byte: the byte, or 256 more for the last one where words have ends.
    """

    #: Words up to this many symbols are merged together, a round for all of them at once; longer ones with a heap each.
    SHORT, ROWS = 48, 4_096

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.text: dict[int, str] = {}
        self.base = np.full(512, -1, np.int32)
        for byte, letter in enumerate(byte_letters()):
            for symbol, name in ((byte, letter), (256 + byte, letter + self.suffix)):
                if name in vocab and (self.suffix or symbol < 256):
                    self.base[symbol] = vocab[name]
                    self.text[vocab[name]] = chr(symbol)
        #: What may follow an id, with the rank of that merge; and what each rank makes.
        self.after: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        made, first, second = [], [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.after[x].setdefault(y, rank)
            made.append(z)
            first.append(x)
            second.append(y)
            if x in self.text and y in self.text:
                self.text.setdefault(z, self.text[x] + self.text[y])
        self.made = np.array(made, np.int32)
        self.ranks = Pairs(np.array(first, np.int64), np.array(second, np.int64), np.arange(len(made), dtype=np.int32))
        self.longest = ahocorasick.Automaton()
        for i, text in self.text.items():
            self.longest.add_word(text, i)
        self.longest.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.pairs: dict[int, bool] = {}

    def symbols(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, each word followed by BETWEEN, and the place of each BETWEEN. No word is empty or has a line end."""
        whole = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words.cast(pa.large_string())), pa.scalar("\n", pa.large_string()))[0]
        raw = np.append(np.frombuffer(whole.as_buffer(), np.uint8), np.uint8(10))
        ends = np.flatnonzero(raw == 10)
        codes = raw.astype(np.uint16)
        codes[ends] = BETWEEN
        if self.suffix:
            codes[ends - 1] += 256
        return codes, ends

    def merged_together(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of words of at most SHORT symbols: ids of all, and how many each has.

        In every round each word merges its pair of the lowest rank, leftmost first; words without such a pair leave.
        """
        order = np.argsort(sizes, kind="stable")
        done, owners, counts = [], [], []
        for lo in range(0, len(order), self.ROWS):
            word = order[lo : lo + self.ROWS]
            size, wide = sizes[word], int(sizes[word[-1]])
            column = np.arange(wide)
            inside = column < size[:, None]
            ids = np.where(inside, self.base[codes[np.minimum(starts[word][:, None] + column, len(codes) - 1)] & 511], -1)
            ranks = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
            while len(word):
                if ids.shape[1] > 1:
                    at = ranks.argmin(1)
                    least = ranks[np.arange(len(word)), at]
                    live = least != NONE
                else:
                    live = np.zeros(len(word), bool)
                if not live.all():
                    rest = ids[~live]
                    done.append(rest[rest >= 0])
                    owners.append(word[~live])
                    counts.append((rest >= 0).sum(1))
                    if not live.any():
                        break
                    word, ids, ranks, at, least = word[live], ids[live], ranks[live], at[live], least[live]
                n, wide, rows = len(word), ids.shape[1], np.arange(len(word))
                new = self.made[least]
                ids[rows, at] = new
                keep = np.ones((n, wide), bool)
                keep[rows, at + 1] = False
                ids = ids[keep].reshape(n, wide - 1)
                keep = np.ones((n, wide - 1), bool)
                keep[rows, at] = False
                ranks = ranks[keep].reshape(n, wide - 2)
                if wide > 2:
                    left, right = np.flatnonzero(at > 0), np.flatnonzero(at < wide - 2)
                    ranks[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], new[left])
                    ranks[right, at[right]] = self.ranks(new[right], ids[right, at[right] + 1])
        flat, owner, count = np.concatenate(done), np.concatenate(owners), np.concatenate(counts)
        first = np.cumsum(count) - count
        back = np.argsort(owner)
        return flat[runs(first[back], count[back])], count[back]

    def merged(self, symbols: list[int]) -> list[int]:
        """Exact merging of one word of any length."""
        ids = self.base[symbols].tolist()
        after, right, left = self.after, [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(rank, i, x, y) for i, (x, y) in enumerate(zip(ids, ids[1:])) if (rank := after[x].get(y)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = right[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (new := after[ids[i]].get(ids[k])) is not None:
                    heapq.heappush(heap, (new, i, ids[i], ids[k]))
            if (h := left[i]) >= 0 and (new := after[ids[h]].get(ids[i])) is not None:
                heapq.heappush(heap, (new, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For distinct keys ``first << 32 | second`` (second all ones for a lone token): does merging keep the two?"""
        known, keys, text = self.pairs, pairs.tolist(), self.text
        if new := [k for k in keys if k not in known]:
            both = [text[k >> 32] + text.get(k & 0xFFFFFFFF, "") for k in new]
            sizes = np.fromiter(map(len, both), np.int64, len(both))
            ids, counts = self.merged_all(np.frombuffer("".join(both).encode("utf-16-le"), np.uint16), np.cumsum(sizes) - sizes, sizes)
            first, key = np.cumsum(counts) - counts, np.array(new, np.int64)
            lone = (key & 0xFFFFFFFF) == 0xFFFFFFFF
            good = (counts == np.where(lone, 1, 2)) & (ids[first] == key >> 32) & (lone | (ids[first + counts - 1] == key & 0xFFFFFFFF))
            known.update(zip(new, good.tolist()))
        return np.fromiter(map(known.__getitem__, keys), bool, len(keys))

    def merged_all(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of words of any length: ids of all, and how many each has."""
        short, long = np.flatnonzero(sizes <= self.SHORT), np.flatnonzero(sizes > self.SHORT)
        parts, froms, counts, size = [np.empty(0, np.int32)], np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
        if len(short):
            ids, n = self.merged_together(codes, starts[short], sizes[short])
            parts.append(ids)
            froms[short], counts[short] = np.cumsum(n) - n, n
            size = len(ids)
        for i in long.tolist():
            ids = self.merged(codes[starts[i] : starts[i] + sizes[i]].tolist())
            parts.append(np.array(ids, np.int32))
            froms[i], counts[i] = size, len(ids)
            size += len(ids)
        return np.concatenate(parts)[runs(froms, counts)], counts

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and how many each has. Words are already normalised and cut."""
        if not len(words):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        codes, ends = self.symbols(words)
        # greedy longest match over all words at once; every symbol is a token itself, so that a word has no gap
        found = np.array(list(self.longest.iter_long(codes.tobytes().decode("utf-16-le"))), np.int64).reshape(-1, 2)
        last, flat = found[:, 0], found[:, 1]
        stops = np.searchsorted(last, ends)
        sizes = np.diff(stops, prepend=0)
        owner = np.repeat(np.arange(len(words)), sizes)
        # each token with its right neighbour in the word; a lone token with none
        inner = owner[:-1] == owner[1:]
        keys = [(flat[:-1][inner] << 32) | flat[1:][inner], (flat[sizes[owner] == 1] << 32) | 0xFFFFFFFF]
        owners = np.concatenate([owner[:-1][inner], owner[sizes[owner] == 1]])
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        failing = np.zeros(len(words), bool)
        failing[owners[~self.compatible(distinct)[where]]] = True
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        starts = np.concatenate([[0], ends[:-1] + 1])
        ids, froms, counts = flat.astype(np.int32), stops - sizes, sizes.copy()
        if failing.any():
            more, n = self.merged_all(codes, starts[failing], (ends - starts)[failing])
            froms[failing], counts[failing] = len(ids) + np.cumsum(n) - n, n
            ids = np.concatenate([ids, more])
        return ids[runs(froms, counts)], counts


def newer_characters() -> re.Pattern:
    """Finds characters past ASCII that were unassigned or of another kind in Unicode 3.2, or are outside the basic plane.

    What is a letter or a number and its lower case is settled for the others; for these it differs between the versions
    that this Python, its ``regex`` and the library have.
    """
    old, kind = unicodedata.ucd_3_2_0.category, lambda c: c[0] if c[0] in "LN" else c if c[0] in "CZ" else ""
    settled = [i for i in range(0x80, 0x10000) if (was := old(chr(i))) not in ("Cn", "Co", "Cs") and kind(was) == kind(unicodedata.category(chr(i)))]
    ranges, start = [], 0
    for i in range(1, len(settled) + 1):
        if i == len(settled) or settled[i] != settled[i - 1] + 1:
            ranges.append(f"\\u{settled[start]:04x}-\\u{settled[i - 1]:04x}")
            start = i
    return re.compile(f"[^\\x00-\\x7f{''.join(ranges)}]")


class WordEncoder:
    """Texts to ids for ``word_bpe_49k.json``: NFC, white space ends words, lower case by character, then its pattern.

    Chunks with characters that versions of Unicode disagree on go to the ``tokenizers`` library as they are.
    """

    PATTERN = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+")

    #: The same for lower-case ASCII without white space; a blank goes behind each match.
    ASCII = r"('s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+)"

    def __init__(self, path: str, most: int = 200_000):
        self.merger, self.most, self.path, self.library = Merger(path), most, path, None
        self.newer = newer_characters()
        special = self.merger.special
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        size = max(self.merger.names) + 1
        self.number = pa.array([str(i) for i in range(size)], pa.large_string())
        self.name = pa.array([self.merger.names.get(i, "") for i in range(size)], pa.large_string())
        self.forget()

    def forget(self) -> None:
        """Chunks met so far: as they are, their ids in decimal, their tokens as text, and how many tokens."""
        self.known = self.ids = self.tokens = pa.array([], pa.large_string())
        self.counts = np.empty(0, np.int64)

    def cut(self, lines: str) -> list[str]:
        """The words of all lines, with a line end behind each line."""
        text = unicodedata.normalize("NFC", lines)
        return self.PATTERN.findall(text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text))  # by character: no final sigma

    def marked(self, chunk: str) -> list[str]:
        """The same of a chunk that may hold strings of special tokens, which are words of their own wherever they stand."""
        special, out = self.merger.special, []
        for part in self.special.split(chunk) if self.special else [chunk]:
            out += [part] if part in special else self.cut(part)
        return [*out, "\n"]

    def ask(self, chunks: list[str]) -> None:
        """Learn chunks from the library."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        found = [self.library.encode(c, add_special_tokens=False).ids for c in chunks]
        self.keep(pa.array(chunks, pa.large_string()), [pa.array([" ".join(names[i].as_py() for i in ids) for ids in found], pa.large_string()) for names in (self.number, self.name)], np.array(list(map(len, found)), np.int64))

    def keep(self, chunks: pa.Array, both: list[pa.Array], counts: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, chunks])
        self.ids, self.tokens = pa.concat_arrays([self.ids, both[0]]), pa.concat_arrays([self.tokens, both[1]])
        self.counts = np.concatenate([self.counts, counts])

    def learn(self, chunks: pa.Array) -> None:
        """Encode distinct new chunks: cut them into words, encode the distinct words, and join what these give."""
        wide = pc.invert(pc.string_is_ascii(chunks))
        if newer := [c for c in chunks.filter(wide).to_pylist() if self.newer.search(c)]:
            self.ask(newer)
            chunks = chunks.filter(pc.invert(pc.is_in(chunks, pa.array(newer, pa.large_string()))))
        marked, ascii = pc.match_substring(chunks, "<|"), pc.string_is_ascii(chunks)
        odd = chunks.filter(marked)
        other = chunks.filter(pc.and_not(pc.invert(ascii), marked))
        chunks = chunks.filter(pc.and_not(ascii, marked))
        simple = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(chunks), self.ASCII, r"\1 "))
        rest = self.cut("\n".join([*other.to_pylist(), ""])) + [w for c in odd.to_pylist() for w in self.marked(c)]
        rest = pa.array(rest, pa.large_string())
        ends = pc.equal(rest, "\n").to_numpy(zero_copy_only=False)
        line = np.cumsum(ends) - ends  # the line of each word
        flat = pa.concat_arrays([simple.flatten().cast(pa.large_string()), rest])
        owner = np.concatenate([np.repeat(np.arange(len(simple)), pc.list_value_length(simple).to_numpy(zero_copy_only=False)), len(simple) + line])
        # what is blank is no word: the splitter gives one for the blank behind the last match
        full = np.concatenate([pc.not_equal(flat[: len(flat) - len(rest)], "").to_numpy(zero_copy_only=False), ~ends])
        owner, many = owner[full], len(chunks) + len(other) + len(odd)
        words = flat.filter(pa.array(full)).dictionary_encode()
        special = [(i, self.merger.special[w]) for i, w in enumerate(words.dictionary.to_pylist()) if w in self.merger.special] if len(odd) else []
        ids, counts = self.merger.encode_words(words.dictionary)
        if special:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, one in special:
                parts[i] = np.array([one], np.int32)
            ids, counts = np.concatenate(parts), np.array(list(map(len, parts)))
        at = words.indices.to_numpy()
        starts = np.cumsum(counts) - counts
        ids = pa.array(ids[runs(starts[at], counts[at])])  # of all chunks, one after the other
        counts = np.bincount(owner, counts[at], many).astype(np.int64) if len(owner) else np.zeros(many, np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
        both = [pc.binary_join(pa.LargeListArray.from_arrays(offsets, names.take(ids)), BLANK) for names in (self.number, self.name)]
        self.keep(pa.concat_arrays([chunks, other, odd]), both, counts)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Of each text: the number of ids, the ids in decimal and the decoded text, both joined by one blank."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = cut.flatten().dictionary_encode()
        if len(self.known) > self.most:
            self.forget()
        chunks = coded.dictionary
        at = pc.index_in(chunks, self.known)
        if at.null_count:
            self.learn(chunks.filter(pc.is_null(at)))
            at = pc.index_in(chunks, self.known)
        at = at.to_numpy()[coded.indices.to_numpy()]
        sizes = pc.list_value_length(cut).to_numpy().astype(np.int64)
        owner, counts = np.repeat(np.arange(len(cut)), sizes), self.counts[at]
        at, owner, counts = at[counts > 0], owner[counts > 0], counts[counts > 0]
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(cut)))]), pa.int64())
        at = pa.array(at)
        both = [pc.binary_join(pa.LargeListArray.from_arrays(offsets, found.take(at)), BLANK) for found in (self.ids, self.tokens)]
        return np.bincount(owner, counts, len(cut)).astype(np.int64), *both

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encoded(pa.array([text], pa.string()))[1][0].as_py().split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary has no decoder: tokens are joined by one blank; unknown ids are left out."""
        return " ".join(self.merger.names[i] for i in ids if i in self.merger.names)


def encoded(docs: DataFrame, path: str, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``keep_text`` also ids (array of int) and decoded."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_text

    def make():
        encoder = WordEncoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, ids, tokens = encoder.encoded(batch.column("text"))
            digests = [[hashlib.sha256(x.as_buffer()).hexdigest() for x in column] for column in (ids, tokens)]
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes), "ids_sha256": pa.array(digests[0], pa.string()), "decoded_sha256": pa.array(digests[1], pa.string())}
            if keep_text:
                columns |= {"ids": pa.array([list(map(int, x.split())) for x in ids.to_pylist()], pa.list_(pa.int32())), "decoded": tokens.cast(pa.string())}
            del sizes, ids, tokens
            trimmed()  # a step's arrays would stay with the worker, beside a heap that other work has filled
            return pa.RecordBatch.from_pydict(columns)

        return step

    return map_text(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), make, schema, most=STEP)
