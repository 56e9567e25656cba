"""Code as units: cut a file into definitions, imports, assignments and statements; slice, scrub, compare and merge files.

Each function works on one file and is mapped over files in Arrow batches by ``mapped``, where a file that cannot be parsed
gives null and does not end the job.
"""

from __future__ import annotations

import ast
import difflib
import io
import itertools
import random
import re
import textwrap
import tokenize
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import REVEALING

Key = tuple[str, str, int]
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
# Fixed value: words, numbers and signs of a text that doesn't parse.
WORDS_AND_SIGNS = r"[A-Za-z_]\w*|\d+(?:\.\d+)?|\S"


def mapped(rows: DataFrame, columns: list[str], f: Callable[..., str | None], name: str) -> DataFrame:
    """``rows`` with ``name``: the text that ``f`` gives for the columns, null for a file that can't be parsed."""
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema) + f", `{name}` string"

    def value(*row: pa.Scalar) -> str | None:
        try:
            return f(*[x.as_py() for x in row])
        except (SyntaxError, RecursionError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(map(value, *[batch.column(c) for c in columns]), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


def _start(node: ast.stmt) -> int:
    return min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])


def _named(node: ast.stmt) -> tuple[str, str]:
    """Kind of a unit, and its name or code."""
    match node:
        case ast.ClassDef(name=name):
            return "class", name
        case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name):
            return "def", name
        case ast.Assign(targets=[ast.Name(id=name), *_]) | ast.AnnAssign(target=ast.Name(id=name)):
            return "assign", name
    return "import" if isinstance(node, (ast.Import, ast.ImportFrom)) else "stmt", ast.unparse(node)


def _flat(body: list[ast.stmt], prefix: str = "") -> Iterator[tuple[str, str, int, int]]:
    """(kind, full name, first line, last line) in the order of the file; a class ends where its members start."""
    for node in body:
        kind, name = _named(node)
        members = node.body if kind == "class" else []
        end = max(node.lineno, _start(members[0]) - 1) if members else node.end_lineno
        yield kind, prefix + name, _start(node), end
        yield from _flat(members, f"{prefix}{name}.")


def units(text: str) -> list[tuple[Key, int, int, str]]:
    """(key, first line, last line, lines) of every unit, classes flattened to a head and their members; comments right above
    belong to a unit. A key is kind, name or code, and the number of equal ones before it."""
    lines, free, seen = text.splitlines(keepends=True), 1, Counter()  # free: first line of no unit yet
    out: list[tuple[Key, int, int, str]] = []
    for kind, name, start, end in _flat(ast.parse(text).body):
        above = itertools.takewhile(lambda line: line.lstrip().startswith("#"), reversed(lines[free - 1 : start - 1]))
        start -= sum(1 for _ in above)
        out.append(((kind, name, seen[kind, name]), start, end, "".join(lines[start - 1 : end])))
        seen[kind, name] += 1
        free = end + 1
    return out


class _Undocumented(ast.NodeTransformer):
    """Drops docstrings; a body left empty passes."""

    def generic_visit(self, node: ast.AST) -> ast.AST:
        super().generic_visit(node)
        if isinstance(node, (*_DEFS, ast.Module)) and ast.get_docstring(node, clean=False) is not None:
            node.body = node.body[1:] or ([] if isinstance(node, ast.Module) else [ast.Pass()])
        return node


def code_tokens(text: str) -> list[str]:
    """Tokens without comments, docstrings and layout, in one layout and one quoting style; words and signs if it doesn't parse."""
    text = textwrap.dedent(text)
    try:
        printed = ast.unparse(_Undocumented().visit(ast.parse(text)))
    except (SyntaxError, ValueError):
        return re.findall(WORDS_AND_SIGNS, re.sub(r"#[^\n]*", "", text))
    # Printed code has no comments; what is blank is layout, except inside an f-string.
    tokens = tokenize.generate_tokens(io.StringIO(printed).readline)
    return [t.string for t in tokens if t.string.strip() or t.string and t.type == tokenize.FSTRING_MIDDLE]


def sliced(text: str, names: set[str]) -> tuple[str, list[str]]:
    """The file cut down to the named definitions, the heads of their classes, and the imports and assignments that they
    use; and the names of the file that the rest still refers to."""
    found = units(text)
    keep = [u for u in found if u[0][0] == "def" and u[0][1] in names or u[0][0] == "class" and any(n == u[0][1] or n.startswith(u[0][1] + ".") for n in names)]
    keep += [u for u in found if u not in keep and any(u[0][1].startswith(n + ".") for n in names)]
    used = {t for u in keep for t in re.findall(r"[A-Za-z_]\w*", u[3])}
    for u in found:
        kind, name, _ = u[0]
        binds = [a.asname or a.name.split(".")[0] for n in ast.parse(textwrap.dedent(u[3])).body for a in getattr(n, "names", [])] if kind == "import" else [name]
        if kind in ("import", "assign") and "." not in name.split(" ")[0] and used & {*binds} and u not in keep:
            keep.append(u)
            used |= set(re.findall(r"[A-Za-z_]\w*", u[3]))
    kept = {u[0] for u in keep}
    dropped = sorted({u[0][1] for u in found if u[0][0] in ("def", "class", "assign") and u[0] not in kept and "." not in u[0][1] and u[0][1] in used})
    return "".join(u[3] for u in sorted(keep, key=lambda u: u[1])), dropped


def scrubbed(text: str) -> tuple[str, list[str]]:
    """The file without comments that reveal a weakness and without such paragraphs of docstrings; and what was removed."""
    revealing, removed, lines = re.compile(REVEALING), [], text.splitlines(keepends=True)
    edits: list[tuple[int, int, int, str]] = []  # line, from, to, replacement
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT and revealing.search(t.string):
                removed.append(t.string)
                edits.append((t.start[0], t.start[1], t.end[1], ""))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return text, []
    for line, a, b, new in edits:
        old = lines[line - 1]
        lines[line - 1] = "" if not old[:a].strip() else old[:a].rstrip() + new + old[b:]
    text = "".join(lines)
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, (*_DEFS, ast.Module)) and (doc := ast.get_docstring(node, clean=False)):
            left = [p for p in re.split(r"\n[ \t]*\n", doc) if not revealing.search(p)]
            if len(left) < len(re.split(r"\n[ \t]*\n", doc)):
                removed += [p.strip() for p in re.split(r"\n[ \t]*\n", doc) if revealing.search(p)]
                text = text.replace(doc, "\n\n".join(left) or "...", 1)
    return text, removed


def merged(base: str, changed: str, current: str) -> tuple[str | None, list[str]]:
    """The change from ``base`` to ``changed`` applied to ``current`` unit by unit; units that both changed in different
    ways are conflicts, and then there is no text."""
    b, c, now = ({u[0]: u for u in units(x)} for x in (base, changed, current))
    conflicts, lines = [], current.splitlines(keepends=True)
    replaced: dict[int, tuple[int, str]] = {}
    added: list[str] = []
    for key, unit in c.items():
        old, mine = b.get(key), now.get(key)
        if old and old[3] == unit[3]:
            continue
        if mine and mine[3] != unit[3] and (not old or mine[3] != old[3]):
            conflicts.append(":".join(map(str, key)))
        elif mine:
            replaced[mine[1]] = (mine[2], unit[3])
        elif old:
            conflicts.append(":".join(map(str, key)))
        else:
            added.append(unit[3] if unit[3].endswith("\n") else unit[3] + "\n")
    for key, old in b.items():
        if key not in c and (mine := now.get(key)):
            if mine[3] != old[3]:
                conflicts.append(":".join(map(str, key)))
            else:
                replaced[mine[1]] = (mine[2], "")
    if conflicts:
        return None, conflicts
    out, i = [], 1
    while i <= len(lines):
        if i in replaced:
            end, new = replaced[i]
            out.append(new)
            i = end + 1
        else:
            out.append(lines[i - 1])
            i += 1
    return "".join(out) + "".join(added), []


def unified_diff(path: str, before: str | None, after: str | None, context: int = 3) -> str:
    """The diff of one file; a missing side is an empty file."""
    a, b = (before or "").splitlines(keepends=True), (after or "").splitlines(keepends=True)
    names = (f"a/{path}" if before is not None else "/dev/null", f"b/{path}" if after is not None else "/dev/null")
    return "".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in difflib.unified_diff(a, b, *names, n=context))


# Turns of a trace, and where its injection may be.
TURNS, INJECTION = (5, 8), (2, 6)
# A turn's output as a share of the code it is about, lowest and highest.
OUTPUT_SHARE = (0.8, 1.5)


def trace_plan(event: str, prompts: list[str], plan_seed: int = 0) -> tuple[int, int, list[str]]:
    """Number of turns, the turn of the injection, and prompts without repetition, by the plan's seed and the event alone."""
    if len(prompts) < TURNS[1]:
        raise ValueError(f"{len(prompts)} prompts; a plan needs {TURNS[1]} at least")
    rng = random.Random(f"{plan_seed}:{event}")
    turns = rng.randint(*TURNS)
    injection = rng.randint(INJECTION[0], min(INJECTION[1], turns))
    return turns, injection, rng.sample(prompts, turns)
