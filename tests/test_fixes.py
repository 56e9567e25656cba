"""Fix commits, their flags in order, and what ends the way."""

from __future__ import annotations

from deltaloom.operators import fixes

COMMITS = [
    ("main1", ["p1"], "2024-01-01T10:00:00+09:00", True), ("main2", ["p2"], "2024-01-01T02:00:00Z", True), ("side", ["p3"], "2023-01-01T00:00:00Z", False),
    ("merge", ["p1", "p2"], "2024-01-01T00:00:00Z", True), ("root", [], "2024-01-01T00:00:00Z", True),
]
LINKS = [("a", 0, "main2"), ("a", 1, "main1"), ("a", 2, "side"), ("a", 3, "lost"), ("b", 0, "side"), ("c", 0, "lost"), ("e", 0, "root"), ("f", 0, "merge"), ("g", 0, "main1"), ("h", 0, "main1"), ("i", 0, "main1")]
FILES = [("main1", "p1", "src/a.py", 3, None), ("main1", "p1", "web/a.js", 5, 1), ("main1", "p1", "README.md", 50, 1), ("side", "p3", "tests/test_a.py", 9, 9), ("merge", "p1", "a.py", 4, 4), ("main1", "g0", "a.py", 1, 1)]
LICENCES = [("p1", "MIT"), ("p3", None), ("g0", "Apache-2.0")]
GIVEN = [("g", "g0", True), ("h", "g0", False), ("i", "main1", True)]


def test_flags_and_commits(spark):
    make = spark.createDataFrame
    asked = make([(x, "MIT") for x in "abcdefghi"], "advisory string, licence string")
    tables = (
        make(LINKS, "advisory string, place int, sha string"), make(COMMITS, "sha string, parents array<string>, committed_at string, on_default boolean"),
        make(FILES, "sha string, base string, path string, added long, deleted long"), make(LICENCES, "sha string, detected string"), make(GIVEN, "advisory string, vulnerable string, is_ancestor boolean"),
    )
    found = fixes.resolved_fixes(asked, *tables)
    got = {r["advisory"]: (r["fix"], r["vulnerable"], r["flags"]) for r in found.collect()}
    mixed = "fix changes more non-Python code (6 lines) than Python source (3 lines); check the vulnerable code is Python"
    unknown, refused = "licence at vulnerable commit not recognised; check by hand", "given vulnerable commit {} is not an ancestor of the fix"
    assert got == {
        "a": ("main1", "p1", ["3 candidate fix commits (backports or multi-part fix)", mixed]),
        "b": ("side", "p3", ["no fix commit is on the default branch", "fix changes no Python source file", unknown]),
        "c": (None, None, ["no fix commit could be resolved"]), "d": (None, None, ["no fix commit linked by the advisory"]),
        "e": (None, None, ["fix commit has no parent (root commit)"]), "f": ("merge", "p1", ["fix commit is a merge; diff taken against its first parent"]),
        "g": ("main1", "g0", ["licence at vulnerable commit looks like Apache-2.0, not MIT as today"]),
        "h": (None, None, [refused.format("g0")]), "i": (None, None, [refused.format("main1")]),
    }
    tally = {r["flag"]: r["n"] for r in fixes.flag_tally(found).collect()}
    assert tally["licence at vulnerable commit not recognised"] == 1 and tally["fix changes more non-Python code"] == 1 and tally["3 candidate fix commits"] == 1
