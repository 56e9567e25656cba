"""Facts of Python source files as tables: symbols, imports, calls, assignments, guards; one file at a time.

Parsing needs Python, so files go through Arrow batches; everything after it is relational. A file that doesn't parse
gives one row of kind 'error'. A call's ``uses`` are the names of all its arguments; its ``detail``, for reading, and a guard's
are the first 120 characters of the code. Digests are of the code without comments, docstrings, layout and nested definitions.
"""

from __future__ import annotations

import ast
import builtins
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled

SCHEMA = "path string, kind string, symbol string, name string, target string, line int, end_line int, digest string, detail string, uses array<string>"
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_NOTED = {ast.Import, ast.ImportFrom, ast.Call, ast.Assign, ast.Assert, ast.If}


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (base := dotted(node.value)):
        return f"{base}.{node.attr}"
    return None


def own_body(node: ast.AST) -> list[ast.stmt]:
    body = list(getattr(node, "body", []))
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        body = body[1:]
    return body


#: Fields of a node that hold no nodes with code of their own.
_PLAIN = ("ctx", "op", "ops", "id", "attr", "type_comment", "lineno", "kind")
_FIELDS: dict[type, tuple[str, ...]] = {ast.Name: (), ast.Constant: ()}


def children(node: ast.AST) -> list[ast.AST]:
    """What ``ast.iter_child_nodes`` gives, without contexts and operators."""
    kind, out = type(node), []
    fields = _FIELDS.get(kind)
    if fields is None:
        fields = _FIELDS[kind] = tuple(f for f in kind._fields if f not in _PLAIN)
    for field in fields:
        value = getattr(node, field, None)
        if isinstance(value, ast.AST):
            out.append(value)
        elif isinstance(value, list):
            out += [v for v in value if isinstance(v, ast.AST)]
    return out


def own_nodes(node: ast.AST) -> tuple[list[ast.AST], list[ast.AST]]:
    """The nodes of a definition's code in order, not those of definitions inside it; and the definitions right under them."""
    todo, out, defs = [s for s in reversed(own_body(node)) if not isinstance(s, _DEFS)], [], []
    while todo:
        n = todo.pop()
        out.append(n)
        inside = children(n)
        defs += [c for c in inside if isinstance(c, _DEFS)]
        todo += [c for c in reversed(inside) if not isinstance(c, _DEFS)]
    return out, defs


def dumped(node: ast.AST | list) -> str:
    """``ast.dump(node)``, in a third of its time."""
    kind = type(node)
    if kind is ast.Name:
        return f"Name(id={node.id!r}, ctx={type(node.ctx).__name__}())"
    if kind is list:
        return f"[{', '.join(map(dumped, node))}]"
    if not isinstance(node, ast.AST):
        return repr(node)
    parts = []
    for field in kind._fields:
        value = getattr(node, field, None)
        if (value is not None and value != []) or (field == "value" and kind in (ast.Constant, ast.MatchSingleton)):
            parts.append(f"{field}={dumped(value)}")
    return f"{kind.__name__}({', '.join(parts)})"


def shown(node: ast.AST) -> str:
    """``ast.unparse(node)``; names, dotted names and calls of such are put together here."""
    return _plain_text(node) or ast.unparse(node)


def _plain_text(node: ast.AST) -> str | None:
    if type(node) is ast.Name:
        return node.id
    if type(node) is ast.Attribute:
        return (base := _plain_text(node.value)) and f"{base}.{node.attr}"
    if type(node) is not ast.Call:
        return None
    parts = [_plain_text(a) for a in node.args]
    parts += [k.arg and (value := _plain_text(k.value)) and f"{k.arg}={value}" for k in node.keywords]
    return (name := _plain_text(node.func)) and f"{name}({', '.join(parts)})" if all(parts) else None


def digest(node: ast.AST) -> str:
    parts = [dumped(s) for s in own_body(node) if not isinstance(s, _DEFS)]
    if hasattr(node, "args"):
        parts.insert(0, dumped(node.args))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


class _Blank(ast.NodeTransformer):
    def __init__(self, names: set[str]):
        self.names = names

    def visit_Name(self, node: ast.Name) -> ast.AST:
        return ast.copy_location(ast.Name("_", node.ctx), node) if node.id in self.names else node


def fingerprint(test: ast.expr, names: set[str]) -> str:
    """A guard's hash with local names blanked, so renaming a variable isn't a change."""
    blank = _Blank(names).visit(ast.parse(ast.unparse(test), mode="eval").body)
    return hashlib.sha256(ast.unparse(blank).encode()).hexdigest()[:12]


def rejects(body: list[ast.stmt]) -> bool:
    """Does a branch raise, or call something that ends the program or the request?"""
    for stmt in body:
        if isinstance(stmt, ast.Raise):
            return True
        if isinstance(stmt, ast.Expr) and isinstance(stmt.value, ast.Call) and (dotted(stmt.value.func) or "").split(".")[-1] in ("exit", "abort", "_exit"):
            return True
    return False


def argument_names(call: ast.Call) -> list[str]:
    """The variables that a call's arguments name, however long its text is."""
    todo, names = [*call.args, *(k.value for k in call.keywords)], set()
    while todo:
        n = todo.pop()
        if type(n) is ast.Name:
            names.add(n.id)
        else:
            todo += children(n)
    return sorted(names)


def extract(path: str, text: str) -> list[tuple]:
    """Rows of SCHEMA. Imports name the local alias and the full target, relative ones with leading dots."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, "error", None, None, None, getattr(e, "lineno", None), None, None, str(e)[:120], None)]
    rows: list[tuple] = []

    def visit(node: ast.AST, qualname: str) -> None:
        symbol = f"{path}::{qualname}" if qualname else path
        kind = "module" if not qualname else "class" if isinstance(node, ast.ClassDef) else "function"
        args = getattr(node, "args", None)
        names = {a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]} if args else set()
        rows.append((path, kind, symbol, qualname or None, None, getattr(node, "lineno", 1), getattr(node, "end_lineno", None), digest(node), ",".join(a.arg for a in args.args) if args else None, None))
        own, deep = own_nodes(node)
        names.update(n.id for n in own if type(n) is ast.Name and type(n.ctx) is ast.Store)
        for n in own:
            if type(n) not in _NOTED:
                continue
            where = (getattr(n, "lineno", None), getattr(n, "end_lineno", None), None)
            if isinstance(n, ast.Import):
                rows.extend((path, "import", symbol, a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], *where, None, None) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                base = "." * n.level + (n.module or "")
                rows.extend((path, "star-import" if a.name == "*" else "import", symbol, a.asname or a.name, base if a.name == "*" else f"{base}.{a.name}" if n.module else f"{base}{a.name}", *where, None, None) for a in n.names)
            elif isinstance(n, ast.Call):
                rows.append((path, "call", symbol, dotted(n.func), None, *where, shown(n)[:120], argument_names(n)))
            elif isinstance(n, ast.Assign):
                rows.extend((path, "assign", symbol, t.id, dotted(n.value.func) if isinstance(n.value, ast.Call) else dotted(n.value), *where, None, None) for t in n.targets if isinstance(t, ast.Name))
            elif isinstance(n, ast.Assert):
                rows.append((path, "guard", symbol, "assert", fingerprint(n.test, names), *where, ast.unparse(n.test)[:120], None))
            elif isinstance(n, ast.If) and (rejects(n.body) or rejects(n.orelse)):
                rows.append((path, "guard", symbol, "reject", fingerprint(n.test, names), *where, ast.unparse(n.test)[:120], None))
        for child in [*(c for c in children(node) if isinstance(c, _DEFS)), *deep]:
            visit(child, f"{qualname}.{child.name}" if qualname else child.name)

    visit(tree, "")
    return rows


def code_facts(files: DataFrame) -> DataFrame:
    """(path, text) -> facts, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string()] * 2 + [pa.list_(pa.string())]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [r for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) for r in extract(p, t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def resolved_calls(facts: DataFrame, known: tuple[str, ...] = tuple(dir(builtins))) -> DataFrame:
    """(path, symbol, name, line, target, resolution): what each call means, the nearest scope first.

    same-module (a definition of the file), import (the longest imported prefix of the dotted name), builtin, else unknown.
    A file's imports are one table here; ``linking`` has scopes, classes and other files. What is needed of ``facts`` is
    written first: they are read three times, and parsing is the most expensive step.
    """
    facts = settled(facts.where("kind IN ('call', 'function', 'class', 'import')").select("path", "kind", "symbol", "name", "target", "line"))
    calls = facts.where("kind = 'call'").select("path", "symbol", "name", "line", F.split("name", r"\.").alias("parts"))
    defs = facts.where("kind IN ('function', 'class') AND name IS NOT NULL").select("path", F.col("name"), F.col("symbol").alias("local"))
    imports = facts.where("kind = 'import'").groupBy("path", F.col("name").alias("head")).agg(F.max("target").alias("imported"))
    rows = calls.join(defs, ["path", "name"], "left").withColumn("head", F.col("parts")[0]).join(imports, ["path", "head"], "left")
    tail = F.array_join(F.concat(F.array("imported"), F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))), ".")
    builtin = (F.size("parts") == 1) & F.col("name").isin(*known)
    target = F.coalesce("local", F.when(F.col("imported").isNotNull(), tail), F.when(builtin, F.concat(F.lit("builtins."), "name")))
    how = F.when(F.col("local").isNotNull(), "same-module").when(F.col("imported").isNotNull(), "import").when(builtin, "builtin").otherwise("unknown")
    return rows.select("path", "symbol", "name", "line", target.alias("target"), how.alias("resolution"))


def longest_prefix(names: DataFrame, known: DataFrame, name: str, prefix: str, separator: str = ".") -> DataFrame:
    """(name, prefix): the longest known prefix of each name, by an equi-join on all its prefixes."""
    parts = F.split(name, f"\\Q{separator}\\E")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    rows = names.select(name, F.explode(every).alias(prefix)).join(known.select(prefix).distinct(), prefix)
    return rows.groupBy(name).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))


def first_match(rows: DataFrame, scopes: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """Looks ``key`` up in scopes (name, (key, value)) in order; adds value and scope of the first that has it."""
    out: list[Column] = []
    for i, (_, table) in enumerate(scopes):
        rows = rows.join(table.select(key, F.col(value).alias(f"_v{i}")), key, "left")
        out.append(F.col(f"_v{i}"))
    scope = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, (n, _) in zip(out, scopes)])
    return rows.withColumn(value, F.coalesce(*out)).withColumn("scope", scope).drop(*[f"_v{i}" for i in range(len(scopes))])


def call_roles(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds role and family to resolved calls: a catalogued sink before a sanitizer before a source; a call whose name is
    that of a validator is a sanitizer if nothing else is known of it. ``catalog``: target, role, family; small."""
    from ..functions.text import is_validator_name

    order = F.create_map(*[F.lit(x) for pair in (("sink", 0), ("sanitizer", 1), ("source", 2)) for x in pair])
    best = catalog.groupBy("target").agg(F.min_by(F.struct("role", "family"), order[F.col("role")]).alias("known"))
    name = F.element_at(F.split("name", r"\."), -1)
    rows = calls.join(best, "target", "left")
    validator = F.coalesce(is_validator_name(name), F.lit(False))
    return rows.select(*calls.columns, F.coalesce("known.role", F.when(validator, "sanitizer")).alias("role"), F.coalesce("known.family", F.when(validator, "validator")).alias("family"))


def drawn_edges(roles: DataFrame, facts: DataFrame) -> DataFrame:
    """(graph_id, src, dst, kind, via, resolution) from calls with roles.

    Every call is a call edge from its symbol; one to a sanitizer is a sanitize edge, too. Values flow where a variable is
    assigned from a call: from the callee to the next call of the same symbol that names the variable among its arguments.
    """
    to = F.coalesce("target", F.concat(F.lit("unknown::"), F.coalesce("name", F.lit("?"))))
    rows = roles.select("path", "symbol", "name", "line", "role", "resolution", to.alias("dst"))
    call = rows.select(F.lit("g").alias("graph_id"), F.col("symbol").alias("src"), "dst", F.lit("call").alias("kind"), F.array("symbol").alias("via"), "resolution")
    sanitize = rows.where("role = 'sanitizer'").select(F.lit("g").alias("graph_id"), F.col("symbol").alias("src"), "dst", F.lit("sanitize").alias("kind"), F.array("symbol").alias("via"), "resolution")
    made = facts.where("kind = 'assign' AND target IS NOT NULL").select("symbol", F.col("name").alias("variable"), F.col("target").alias("name"))
    source = rows.select("symbol", "name", F.col("dst").alias("from")).join(made, ["symbol", "name"]).select("symbol", "variable", "from").distinct()
    used = facts.where("kind = 'call'").select("symbol", F.col("name").alias("callee"), "line", F.explode("uses").alias("variable"))
    flow = source.join(used, ["symbol", "variable"]).join(rows.select("symbol", F.col("name").alias("callee"), "line", "dst", "resolution"), ["symbol", "callee", "line"])
    taint = flow.where("`from` <> dst").select(F.lit("g").alias("graph_id"), F.col("from").alias("src"), "dst", F.lit("taint").alias("kind"), F.array("symbol").alias("via"), "resolution")
    return call.union(sanitize).union(taint).distinct()


def event_checks(files: DataFrame, facts: DataFrame, warn: int = 24 * 1024, fail: int = 48 * 1024) -> DataFrame:
    """(event_id, name, status, detail): one row for each check of an event's files (event_id, path, text)."""
    size = files.groupBy("event_id").agg(F.sum(F.octet_length("text")).alias("n"))
    sized = size.select("event_id", F.lit("size").alias("name"), F.when(F.col("n") > fail, "fail").when(F.col("n") > warn, "warn").otherwise("ok").alias("status"), F.col("n").cast("string").alias("detail"))
    broken = facts.where("kind = 'error'").select("path").distinct()
    parsed = files.select("event_id", "path").join(broken.withColumn("bad", F.lit(True)), "path", "left").groupBy("event_id").agg(F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("path")))).alias("bad"))
    return sized.unionByName(parsed.select("event_id", F.lit("parse").alias("name"), F.when(F.size("bad") > 0, "fail").otherwise("ok").alias("status"), F.array_join("bad", ",").alias("detail")))
