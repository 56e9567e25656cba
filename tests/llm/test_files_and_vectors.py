"""Token files, media, vectors, components, the full-text index and the pipeline."""

from __future__ import annotations

import collections
import fractions
import hashlib
import io
import os
import random
import sys
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from deltaloom.llm import common, embeddings, fmindex, media, tokenfile
from deltaloom.llm.components import components
from deltaloom.llm.queries import tokenizer_file

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


# token files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


def test_ids_are_the_library(library):
    encoder = tokenfile.ByteEncoder(tokenizer_file("byte_bpe_50k.json"))
    assert encoder.fast is not None
    rng = random.Random(2)
    letters = "aAbé  \n\n\t\x1c\x85　​日本12's're<|endoftext|>²½한😀-_=&%"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["x  <|endoftext|> y", "", "a" * 50_000, " " * 1_000_000, "\x1c!" * 100_000, "a" * 1_999 + " " * 1_999 + "\n" * 1_999]
    for text, raw in zip(texts, encoder.texts(texts, 2)):
        assert np.frombuffer(raw, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("sizes", [[], [0], [1], [2047, 1, 0], [2047, 2], [270_000, 3], [64 * 2048], [64 * 2048 + 5], [900_000]])
def test_blocks_round_trip(sizes):
    rng = np.random.default_rng(len(sizes))
    ids = [np.minimum(rng.geometric(0.001, n), 50_256).astype(np.uint32) for n in sizes]
    model = tokenfile.Model(np.bincount(np.concatenate([*ids, [7, 50_256]]).astype(np.int64), minlength=50_257))
    assert int(model.freq.sum()) == 1 << tokenfile.SCALE
    data = tokenfile.pack(model, [None, *range(1, len(ids))][: len(ids)], ids)
    doc_ids, lengths, back = tokenfile.unpack(model, data)
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    assert doc_ids == [None, *range(1, len(ids))][: len(ids)] and lengths.tolist() == sizes and (back == flat).all()
    for i in range((-(-len(flat) // tokenfile.LANES) - 1) // tokenfile.EVERY):
        part = tokenfile.unpack(model, data, checkpoint=i)[2]
        assert (part == flat[(i + 1) * tokenfile.EVERY * tokenfile.LANES :]).all()
    with pytest.raises(ValueError, match="checksum"):
        tokenfile.unpack(model, data[:-9] + bytes([data[-9] ^ 1]) + data[-8:])


def test_token_files(spark, library):
    rows = [(i * 3, t) for i, t in enumerate(["Hello world", None, "", "a  b\n", "Hello world", "x" * 9000] * 5)] + [(None, "null id"), (3, "same id"), (3, "same id")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("part", F.lit("clash")).withColumn("ids", F.lit(0))
    folder = tokenfile.write_tokens(df, tokenizer_file("byte_bpe_50k.json"), file_tokens=300)
    out = tokenfile.read_tokens(spark, folder, with_ids=True).collect()
    want = sorted(((d is None, d or 0, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows))
    found = sorted(out, key=lambda r: r["start"])
    tie = lambda ids: int(np.array([xxhash.xxh64_intdigest(np.array(ids, "<u2").tobytes())], np.uint64).view(np.int64)[0])
    start = 0
    for r, (null, d, ids) in zip(found, sorted(want, key=lambda x: (x[0], x[1], tie(x[2])))):
        assert r["doc_id"] == (None if null else d) and r["ids"] == ids and r["start"] == start and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(out) == len(rows) and spark.read.parquet(f"{folder}/table").agg(F.sum("n")).first()[0] == start
    # files in the order of their names ascend by doc_id, nulls last
    model = tokenfile.Model(spark.read.parquet(f"{folder}/table").orderBy("id").toPandas()["n"].to_numpy())
    files = spark.read.parquet(f"{folder}/blocks").withColumn("file", F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1)).orderBy("file", "block").collect()
    assert len({f["file"] for f in files}) > 1
    order = [d for f in files for d in tokenfile.unpack(model, bytes(f["data"]))[0]]
    assert order == sorted((d for d, _ in rows), key=lambda d: (d is None, d or 0))
    other = tokenfile.Model(np.ones(50_257))
    with pytest.raises(ValueError, match="table"):
        tokenfile.unpack(other, bytes(files[0]["data"]))
    folder = tokenfile.write_tokens(spark.createDataFrame([], SCHEMA), tokenizer_file("byte_bpe_50k.json"))
    assert tokenfile.read_tokens(spark, folder).count() == 0


# media


def test_images_round_trip():
    rng = np.random.default_rng(1)
    for h, w, c in [(1, 1, 3), (5, 7, 3), (4, 8, 1), (9, 64, 3)]:
        image = rng.integers(0, 256, (h, w, c), dtype=np.uint8)
        assert (media.decode(media.encode_netpbm(image)) == image).all()
        assert (media.decode(media.encode_bmp(image)) == (image if c == 3 else np.repeat(image, 3, 2))).all()
        kind = "P3" if c == 3 else "P2"
        text = f"{kind} # note\n{w} # w\n {h}\n255\n" + "\n".join(map(str, image.ravel().tolist()))
        assert (media.decode(text.encode()) == image).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n0 1 0\n").ravel().tolist() == [0, 255, 0, 255, 0, 255]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).ravel().tolist() == [0, 255, 0, 255, 0, 255]
    assert media.decode(b"P5\n2 1\n65535\n" + bytes([1, 2, 255, 0])).ravel().tolist() == [1, 255]
    for bad in (b"", b"P6\n9 9\n255\nxx", b"BM" + bytes(60), b"P5\n1 1\n0\nx"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_exact():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (6, 10, 3), dtype=np.uint8)
    fine = np.repeat(np.repeat(image, 4, 0), 3, 1).astype(float)  # a grid that both sizes divide
    want = fine.reshape(8, 3, 6, 5, 3).mean((1, 3))
    assert np.allclose(media.area_resize(image, 8, 6), want)
    assert np.allclose(media.area_resize(image, 1, 1)[0, 0], image.mean((0, 1)))


def box_means(image, height, width):
    """Area means in exact fractions, box by box."""
    h, w, channels = image.shape
    cut = lambda j, n, cells: (fractions.Fraction(j * n, cells), fractions.Fraction((j + 1) * n, cells))
    parts = lambda a, b: [(i, min(b, i + 1) - max(a, i)) for i in range(int(a), -int(-b // 1))]
    out = np.empty((height, width, channels), object)
    for i in range(height):
        for j in range(width):
            rows, columns = parts(*cut(i, h, height)), parts(*cut(j, w, width))
            total = sum((wr * wc * image[r, c].astype(object) for r, wr in rows for c, wc in columns), np.zeros(channels, object))
            out[i, j] = total * fractions.Fraction(height * width, h * w)
    return out


def test_features_by_brute_force(spark):
    texts = ["", "x", "some text " * 40, "é" * 500, "".join(chr(33 + i * i % 90) for i in range(7000))]
    rows = media.text_media(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        image = np.frombuffer(raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw)), np.uint8).reshape(-1, 64, 3)
        tile = np.rint(box_means(image, 16, 16).astype(float)).astype(np.uint8)
        raw_tile = io.BytesIO()
        np.save(raw_tile, tile)
        brightness = (image.astype(np.int64) @ np.array([299, 587, 114]) // 1000).astype(np.uint8)[:, :, None]
        small = box_means(brightness, 8, 9)[:, :, 0].astype(float).round(6)
        bits = "".join("1" if small[i, j] < small[i, j + 1] else "0" for i in range(8) for j in range(8))
        assert r["feature"] == f"{int(bits, 2):016x}:{zlib.crc32(raw_tile.getvalue()):08x}"


@pytest.mark.parametrize("band", [1, 3, 4096])
def test_bands_change_nothing(band):
    image = np.random.default_rng(3).integers(0, 256, (11, 7, 3), dtype=np.uint8)
    assert np.allclose(media.area_resize(image, 4, 5, band), box_means(image, 4, 5).astype(float))


def test_text_media(spark):
    texts = [None, "", "x", "x", "é" * 500, "y" * 192, "z" * 100_000]
    rows = media.text_media(spark.createDataFrame(list(enumerate(texts)), SCHEMA), keep_media=True).collect()
    by_id = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), by_id[i]
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_bytes"] == len(r["media"])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and media.decode(bytes(r["media"])).tobytes() == payload
        assert np.load(io.BytesIO(bytes(r["tile"]))).shape == (16, 16, 3)
    assert by_id[2][1:] == by_id[3][1:] and {r["format"] for r in rows} <= {"bmp", "ppm"}
    images = spark.createDataFrame([(1, bytearray(by_id[4]["media"]), "a"), (2, bytearray(b"junk"), "b"), (3, None, None)], "id long, media binary, tile string")
    found = {r["id"]: r for r in media.media_columns(images).collect()}
    assert found[1]["width"] == 64 and found[2]["dhash"] is None and found[3]["tile"] is None


# vectors


def brute_links(vectors, cosine):
    good = [i for i, v in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(vectors), list(range(len(vectors)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = {i: np.array(vectors[i], float) for i in good}
    for i in good:
        for j in good:
            if j < i and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(vectors))]


@pytest.mark.parametrize(("block", "many", "kind"), [(2048, 4096, "float"), (8, 5, "float"), (2048, 20, "double"), (16, 100, "int")])
def test_vectors(spark, monkeypatch, block, many, kind):
    monkeypatch.setattr(embeddings, "MANY", many)
    rng = np.random.default_rng(block + many)
    vectors = [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [], [1.0] * 7, [2.0] * 7, [1.0] * 4, [1.0, 1.0, 1.0, 1.1], [3.0], [-3.0], [4.0]]
    for _ in range(30):
        base = rng.normal(size=8)
        vectors += [(base * s + rng.normal(size=8) * 0.02).tolist() for s in rng.uniform(0.5, 2, rng.integers(1, 5))]
    hub = rng.normal(size=8)
    vectors += [(hub + rng.normal(size=8) * 0.1).tolist() for _ in range(40)] + [vectors[14]] * 12
    vectors += [(np.concatenate([hub, hub[:4]]) + rng.normal(size=12) * 0.15).tolist() for _ in range(90)]  # another length
    if kind == "int":
        vectors = [v and [None if x is None else int(round(x * 100)) for x in v if x is None or np.isfinite(x)] for v in vectors]
    else:
        vectors = [v if v is None else [x if x is None else float(np.float32(x)) for x in v] for v in vectors]
    df = spark.createDataFrame(list(enumerate(vectors)), f"vec_id long, embedding array<{kind}>").repartition(4).withColumn("n_links", F.lit("clash")).withColumn("node", F.lit(1))
    rows = {r["vec_id"]: r for r in embeddings.near_duplicates(df, block=block).collect()}
    links, roots = brute_links(vectors, 0.95)
    assert len(rows) == len(vectors)
    got = [rows[i]["n_links"] for i in range(len(vectors))]
    assert all(g <= w for g, w in zip(got, links)) and sum(got) >= 0.95 * sum(links)
    assert all(rows[i]["kept"] == (rows[i]["component_id"] == i) for i in rows)
    assert np.mean([rows[i]["component_id"] == r for i, r in enumerate(roots)]) > 0.97


def test_vectors_without_ids(spark):
    one, other = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(None, one), (4, one), (4, one), (4, other), (9, other), (None, None), (2, None)]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == sorted([("None", 0, "None", False)] * 2 + [("4", 1, "4", True)] * 3 + [("9", 1, "4", False), ("2", 0, "2", True)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(empty).count() == 0


def test_vector_plan():
    assert embeddings.plan(0) == embeddings.plan(1000)
    for n in (10**4, 10**6, 10**9):
        projections, tables = embeddings.plan(n)
        assert n * embeddings.CHANCE**projections <= embeddings.CROWD and (1 - embeddings.SAME**projections) ** tables <= 0.05


# shared folder


def test_clean_deletes_intermediates(spark, monkeypatch):
    monkeypatch.setattr(common, "WRITTEN", [])
    out = common.written(spark.range(5), "some")
    assert out.count() == 5 and len(common.WRITTEN) == 1
    path = common.WRITTEN[0]
    common.clean(spark)
    assert not os.path.exists(path.removeprefix("file://")) and not common.WRITTEN


def test_no_folder_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


# components


@pytest.mark.parametrize("hub", [1000, 3])
def test_components(spark, monkeypatch, hub):
    module = sys.modules["deltaloom.llm.components"]
    monkeypatch.setattr(module, "HUB", hub)
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(700, 800)] + [(5, 5), (None, 3)]
    root: dict[int, int] = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


# full-text index


def test_weighted_intervals():
    """A sequence with a weight counts like as many copies of it."""
    rng = np.random.default_rng(8)
    parts = [np.append(rng.integers(1, 4, 12), 0) for _ in range(20)]
    times = rng.integers(1, 4, 20)
    once, copies = np.concatenate(parts), np.concatenate([p for p, n in zip(parts, times) for _ in range(n)])
    weighted = fmindex.FmIndex(once, 4, 9, np.repeat(times, 13))
    plain = fmindex.FmIndex(copies, 4, 9)
    firsts = np.cumsum(times * 13) - times * 13
    ends = np.concatenate([np.arange(1, 13) + 13 * i for i in range(20)])
    same = np.concatenate([np.arange(1, 13) + f for f in firsts])
    for least in (2, 3, 5):
        assert (weighted.matching_lengths(once, ends, 9, least) == plain.matching_lengths(copies, same, 9, least)).all()


@pytest.mark.parametrize(("alphabet", "n", "most"), [(3, 200, 5), (5, 500, 7), (50, 2000, 4), (2, 60, 9)])
def test_matching_statistics(alphabet, n, most):
    rng = np.random.default_rng(n)
    text = rng.integers(0, alphabet, n)
    counts = collections.Counter(tuple(text[i : i + k]) for k in range(1, most + 1) for i in range(n - k + 1) if (text[i : i + k] > 0).all())
    got = fmindex.FmIndex(text, alphabet, most).matching_lengths(text, np.arange(1, n + 1), most)
    for end, length in enumerate(got, start=1):
        want = 0
        while want < most and end - want - 1 >= 0 and counts[tuple(text[end - want - 1 : end])] >= 2:
            want += 1
        assert length == want


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL)
        if name != "tokens":
            assert after.schema.fieldNames() == ["doc_id", "text", "lang", "source", "n_chars"]
            assert [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
            after = spark.createDataFrame(after.collect(), docs.schema)
        docs = after
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] == seen[3] and seen[4] == seen[5] > 0
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(r["doc_id"] for r in docs.collect())
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
