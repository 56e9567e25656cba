"""What is written between steps, and what is read of it."""

from __future__ import annotations

from pathlib import Path

from deltaloom.operators import graph, overlay
from deltaloom.operators.program import program_facts


def test_one_value_is_read_without_the_others(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "kind string, n int")
    found = graph.settled(rows, "kind")
    for part in Path(graph.WRITTEN[-1].removeprefix("file://")).glob("kind=b/*.parquet"):
        part.write_bytes(b"no table")
    assert found.columns == ["kind", "n"] and [tuple(r) for r in found.where("kind = 'a'").collect()] == [("a", 1)]


def test_an_overlay_does_not_write_the_facts_again(spark):
    text = "import os\ndef f(a):\n" + "".join(f"    x{i} = a({i})\n" for i in range(50)) + "    return a\n"
    files = spark.createDataFrame([("a.py", text)], "path string, text string")
    facts = graph.settled(program_facts(files), "kind")
    before = len(graph.WRITTEN)
    found = overlay.laid_around(facts, facts, facts)
    written = sum(spark.read.parquet(p).count() for p in graph.WRITTEN[before:] if list(Path(p.removeprefix("file://")).glob("*.parquet")))
    assert found.count() == facts.count() and written < facts.count() / 2
