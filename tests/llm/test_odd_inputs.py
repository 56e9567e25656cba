"""Shared ids, repeated rows, odd columns through every stage, and every code point through the word encoder."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deltaloom.llm import bpe, jaccard
from deltaloom.llm.queries import tokenizer_file

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ("a.b", "row", "_kept_key", "score", "th", "x y", "size", "spans")


def words(rng, n):
    return " ".join(rng.choice([f"v{i}" for i in range(300)]) for _ in range(n))


def test_every_code_point_is_the_library_s():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library, encoder, wrong = Tokenizer.from_file(path), bpe.WordEncoder(path), []
    points = [chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x33480 or 0xE0000 <= i < 0xE0200 or i % 4_096 < 16)]
    for start in range(0, len(points), 2_000):
        part = points[start : start + 2_000]
        for form in ("a{}b", "{}", "1{}2", "A{0}{0}'s"):
            text = " ".join(form.format(c) for c in part)
            if encoder.encode(text) != library.encode(text, add_special_tokens=False).ids:
                wrong += [(form, hex(ord(c))) for c in part if encoder.encode(form.format(c)) != library.encode(form.format(c), add_special_tokens=False).ids]
    assert wrong == []
    for text in ("a೜b <|endoftext|>Ᲊ", "\U0001f600 ok Ƛ", "x́೜", "́y Ᲊ́"):
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids




def test_jaccard_rows_that_share_an_id(spark):
    rng = random.Random(5)
    base = [words(rng, 30) for _ in range(400)]
    texts = base + [t + " tail" for t in base]
    docs = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")
    got = jaccard.linked_documents(docs)
    assert got.count() == 800 and {r[0] for r in got.select("component_id").distinct().collect()} == {7}
    # 400 pairs are as many groups; each of their 800 nodes has one text, not one for each row of the id
    keyed = docs.withColumn("th", F.xxhash64("text"))
    placed = keyed.select(F.col("doc_id").alias("rep"), F.col("th").alias("rep_th"), F.col("th").alias("node"), F.pmod("th", F.lit(400)).alias("grp"), F.lit(None).cast("int").alias("blocks"))
    assert jaccard.one_text_each(keyed, keyed, placed).count() == 800


@pytest.mark.parametrize("hub", [1_000, 100])
def test_jaccard_repeated_row_beside_a_near_copy(spark, hub, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB", hub)
    rng = random.Random(6)
    text = words(rng, 200)
    rows = [(3, text)] * 600 + [(9, text + " end"), (9, text + " end"), (4, words(rng, 50)), (None, text), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(map(tuple, jaccard.linked_documents(docs).select("doc_id", "component_id").collect()))
    assert got == Counter({(3, 3): 600, (9, 3): 2, (4, 4): 1, (None, None): 1, (2, 2): 1})
    keyed = docs.withColumn("th", F.xxhash64("text"))
    placed = keyed.where("doc_id IN (3, 9)").distinct().select(F.col("doc_id").alias("rep"), F.col("th").alias("rep_th"), F.col("th").alias("node"), F.lit(1).alias("grp"), F.lit(None).cast("int").alias("blocks"))
    assert sorted(r["text"] for r in jaccard.one_text_each(keyed, keyed, placed).collect()) == sorted([text, text + " end"])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_columns(spark, name, stage):
    rng = random.Random(8)
    prose = spark.read.parquet(f"{SMALL}/documents.parquet").limit(25).collect()
    rows = [tuple(r) for r in prose] + [(None, words(rng, 40), None, None, None), (10_001, None, None, "b", None), (10_002, "", "en", "b", 0), (10_003, words(rng, 30_000), "en", "b", None)]
    rows += rows[:3] + rows[:1]
    docs = spark.createDataFrame(rows, SCHEMA)
    for i, column in enumerate(ODD):
        docs = docs.withColumn(column, F.lit(i))
    after = stage(spark, docs, SMALL)
    if name == "tokens":
        assert after.count() == len(rows)
        return
    assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
    got = [r.asDict() for r in after.collect()]
    assert got and all(r[c] == i for r in got for i, c in enumerate(ODD))
    known = {(r[0], r[2], r[3]) for r in rows}
    assert all((r["doc_id"], r["lang"], r["source"]) in known for r in got)
    if name == "near_duplicates":  # repeated rows go, others here have nothing in common
        assert len({(r["doc_id"], r["text"]) for r in got}) == len(got)
    if name == "personal_data":
        assert len(got) == len(rows)
