"""From advisories to pairs of a vulnerable and a fixed commit: rules in stages, of which later ones read what earlier ones found.

An advisory links any number of commits and a commit may be linked by many. Of the linked ones that are known, the first by
time (offsets don't matter) on the default branch is the fix, or the first of all if none is there; its first parent is
the vulnerable commit, unless a review gives another one. What a person should look at is a list of flags, in the order of
the stages; an advisory whose stage has no way on keeps the flags up to there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_class

# Suffixes of code in other languages, and the families that licences of today are compared by.
OTHER_CODE = (".php", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".vue", ".rb", ".go", ".java", ".c", ".h", ".cc", ".cpp", ".rs", ".sh", ".pl")
FAMILIES = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC")


def utc(time: str) -> Column:
    """An ISO time with any offset as a timestamp; null if it isn't one."""
    return F.try_to_timestamp(F.col(time))


def chosen_fixes(links: DataFrame, commits: DataFrame) -> DataFrame:
    """(advisory, linked, known, fix, parents, on_default) from links (advisory, place, sha) and commits (sha, parents,
    committed_at, on_default). Ties of time go to the first link; a commit that is linked twice counts twice, as it is listed."""
    rows = links.join(commits, "sha", "left")
    known = F.col("parents").isNotNull()
    best = F.min(F.when(known, F.struct(F.when(F.col("on_default"), 0).otherwise(1).alias("off"), utc("committed_at").alias("at"), "place", "sha", "parents", "on_default")))
    out = rows.groupBy("advisory").agg(F.count("*").alias("linked"), F.count(F.when(known, 1)).alias("known"), best.alias("b"))
    return out.select("advisory", "linked", "known", F.col("b.sha").alias("fix"), "b.parents", "b.on_default")


def changed_code(files: DataFrame) -> DataFrame:
    """(sha, base, python_files, python_lines, other_lines) from files (sha, base, path, added, deleted); null counts are none."""
    lines = F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))
    source = path_class(F.col("path")) == "py-source"
    other = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1)).isin(*OTHER_CODE)
    return files.groupBy("sha", "base").agg(F.count(F.when(source, 1)).alias("python_files"), F.coalesce(F.sum(F.when(source, lines)), F.lit(0)).alias("python_lines"), F.coalesce(F.sum(F.when(other, lines)), F.lit(0)).alias("other_lines"))


def resolved_fixes(advisories: DataFrame, links: DataFrame, commits: DataFrame, files: DataFrame, licences: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(advisory, fix, vulnerable, python_files, licence, flags): one row for each of ``advisories`` (advisory, licence: today's).

    licences: sha, detected (null where the text isn't recognised); given: advisory, vulnerable, is_ancestor, the reviewed
    corrections. fix and vulnerable are null where a stage ends the way.
    """
    rows = advisories.select("advisory", F.col("licence").alias("today")).join(chosen_fixes(links, commits), "advisory", "left")
    if given is None:
        rows = rows.withColumn("given", F.lit(None).cast("string")).withColumn("is_ancestor", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(given.select("advisory", F.col("vulnerable").alias("given"), "is_ancestor"), "advisory", "left")
    linked, chosen = F.coalesce("linked", F.lit(0)), F.col("fix").isNotNull()
    refused = F.col("given").isNotNull() & ~(F.coalesce("is_ancestor", F.lit(False)) & (F.col("given") != F.col("fix")))
    rootless = F.col("given").isNull() & (F.size("parents") == 0)
    goes = chosen & ~refused & ~rootless
    rows = rows.withColumn("vulnerable", F.when(goes, F.coalesce("given", F.get("parents", F.lit(0))))).withColumn("goes", F.coalesce(goes, F.lit(False)))
    rows = rows.join(changed_code(files).select(F.col("sha").alias("fix"), F.col("base").alias("vulnerable"), "python_files", "python_lines", "other_lines"), ["fix", "vulnerable"], "left")
    rows = rows.join(licences.select(F.col("sha").alias("vulnerable"), "detected"), "vulnerable", "left")
    python, lines, others = (F.coalesce(c, F.lit(0)) for c in ("python_files", "python_lines", "other_lines"))
    family = F.when(F.col("today").isin(*FAMILIES), F.col("today"))
    said = lambda test, *text: F.when(test, F.concat(*[F.lit(t) if isinstance(t, str) else t.cast("string") for t in text]))
    flags = [
        said(linked == 0, "no fix commit linked by the advisory"),
        said((linked > 0) & ~chosen, "no fix commit could be resolved"),
        said(chosen & ~F.col("on_default"), "no fix commit is on the default branch"),
        said(chosen & (F.col("known") > 1), F.col("known"), " candidate fix commits (backports or multi-part fix)"),
        said(chosen & refused, "given vulnerable commit ", F.col("given"), " is not an ancestor of the fix"),
        said(chosen & rootless, "fix commit has no parent (root commit)"),
        said(F.col("goes") & F.col("given").isNull() & (F.size("parents") > 1), "fix commit is a merge; diff taken against its first parent"),
        said(F.col("goes") & (python == 0), "fix changes no Python source file"),
        said(F.col("goes") & (python > 0) & (others > lines), "fix changes more non-Python code (", others, " lines) than Python source (", lines, " lines); check the vulnerable code is Python"),
        said(F.col("goes") & F.col("detected").isNull(), "licence at vulnerable commit not recognised; check by hand"),
        said(F.col("goes") & (F.col("detected") != family), "licence at vulnerable commit looks like ", F.col("detected"), ", not ", F.col("today"), " as today"),
    ]
    out = rows.withColumn("flags", F.filter(F.array(*flags), lambda f: f.isNotNull()))
    kept = lambda c: F.when(F.col("goes"), c)
    return out.select("advisory", kept(F.col("fix")).alias("fix"), "vulnerable", kept(python).cast("long").alias("python_files"), kept(F.col("detected")).alias("licence"), "flags")


def flag_tally(fixes: DataFrame) -> DataFrame:
    """(flag, n): how often each flag stands, cut at the first sign that a detail follows."""
    cut = F.trim(F.regexp_extract("flag", r"^([^;:,(]*)", 1))
    return fixes.select(F.explode("flags").alias("flag")).groupBy(cut.alias("flag")).agg(F.count("*").alias("n"))
