"""Units and measurements of Python sources: functions, methods and lambdas with five metrics each."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNITS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_STRUCTURAL = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.ListComp,
               ast.SetComp, ast.DictComp, ast.GeneratorExp)
_STATEMENTS = (ast.Expr, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Return, ast.Raise, ast.Assert, ast.Delete, ast.Pass,
               ast.Break, ast.Continue, ast.Import, ast.ImportFrom)


class _Meter:
    """Reads one unit in the order of its text and leaves units inside it alone."""

    def __init__(self, lines: list[bytes]):
        self.lines = lines
        self.cognitive, self.decisions, self.statements, self.deepest, self.run = 0, 0, 0, 0, None

    def _is_elif(self, node: ast.AST) -> bool:
        return isinstance(node, ast.If) and self.lines[node.lineno - 1][node.col_offset:].startswith(b"elif")

    def _other(self, body: list, depth: int) -> None:
        """An else branch; an elif is one as well, and a decision, at the depth of its first if."""
        if not body:
            return
        self.cognitive, self.run = self.cognitive + 1, None
        if len(body) == 1 and self._is_elif(body[0]):
            self.decisions += 1
            self.read(body[0].test, depth)
            self.each(body[0].body, depth)
            self._other(body[0].orelse, depth)
        else:
            self.each(body, depth)

    def each(self, nodes: list, depth: int) -> None:
        for n in nodes:
            self.read(n, depth)

    def read(self, node: ast.AST, depth: int) -> None:
        if isinstance(node, _UNITS):
            if not isinstance(node, ast.Lambda):
                self.each(node.decorator_list, depth)
            return
        if isinstance(node, _STATEMENTS):
            self.statements, self.run = self.statements + 1, None
        if isinstance(node, ast.BoolOp):
            for _ in node.values[1:]:
                self.decisions += 1
                if self.run is not type(node.op):
                    self.cognitive, self.run = self.cognitive + 1, type(node.op)
        if isinstance(node, _STRUCTURAL):
            self.cognitive, self.decisions, self.run = self.cognitive + 1 + depth, self.decisions + 1, None
            depth += 1
            self.deepest = max(self.deepest, depth)
        if isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While)):
            for name in ("target", "iter", "test"):
                if hasattr(node, name):
                    self.read(getattr(node, name), depth)
            self.each(node.body, depth)
            self._other(node.orelse, depth)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            self.each([*node.body, *node.handlers], depth)
            self._other(node.orelse, depth)
            self.each(node.finalbody, depth)
        else:
            self.each(list(ast.iter_child_nodes(node)), depth)


def _parameters(a: ast.arguments) -> int:
    star = bool(a.kwonlyargs) and a.vararg is None
    return (len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg) + star + bool(a.posonlyargs))


def units(source: str) -> list[dict]:
    """Units in the order of their text; SyntaxError for a source that is none."""
    tree = ast.parse(source)
    lines = [x.encode() for x in source.split("\n")]
    out: list[dict] = []

    def visit(node: ast.AST, container: str | None, parent: int | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner, up = container, parent
            if isinstance(child, _UNITS):
                lam = isinstance(child, ast.Lambda)
                name = f"<lambda {child.lineno}>" if lam else child.name
                m = _Meter(lines)
                m.each([child.args], 0)
                m.each([child.body] if lam else child.body, 0)
                text = ast.dump(child)
                out.append({
                    "ordinal": len(out), "name": name, "container": container, "kind": "lambda" if lam else "function",
                    "start_line": child.lineno, "end_line": child.end_lineno, "parent_ordinal": parent, "cognitive": m.cognitive,
                    "cyclomatic": 1 + m.decisions, "logical_lines": m.statements, "max_nesting": m.deepest,
                    "parameter_count": _parameters(child.args), "fingerprint": hashlib.sha256(text.encode()).hexdigest()})
                inner, up = name, len(out) - 1
            elif isinstance(child, ast.ClassDef):
                inner = child.name
            visit(child, inner, up)

    visit(tree, None, None)
    return out


def imports(source: str) -> list[tuple[str, str | None, int]]:
    """(module, name or null, line) of every import; one row per imported name."""
    rows = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            rows += [(a.name, None, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            rows += [(module, None if a.name == "*" else a.name, node.lineno) for a in node.names]
    return sorted(rows, key=lambda r: r[2])


_SCHEMA = ("path string, ordinal int, name string, container string, kind string, start_line int, end_line int, parent_ordinal int, "
           "cognitive int, cyclomatic int, logical_lines int, max_nesting int, parameter_count int, fingerprint string")
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def measure(files: DataFrame) -> DataFrame:
    """Units of every Python file (path, text); files that do not parse give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if k == "string" else pa.int32() for k in (x.split()[1] for x in _SCHEMA.split(", "))]
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [{"path": path, **u} for u in units(text or "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(_NAMES, kinds)], _NAMES)

    return files.select("path", "text").mapInArrow(run, _SCHEMA)


def references(files: DataFrame) -> DataFrame:
    """Import references of every Python file: path, module, name, line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(path, *r) for r in imports(text or "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32()))],
                                             ["path", "module", "name", "line"])

    return files.select("path", "text").mapInArrow(run, "path string, module string, name string, line int")


def generated(text):
    """Whether one of the first five lines says that the source is generated."""
    head = F.array_join(F.slice(F.split(F.lower(text), "\n"), 1, 5), "\n")
    return head.rlike(r"(?m)^(?=.*generated)(?=.*do not edit).*$")


def line_count(text):
    """Line ends, and one more for a last line without."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return n + ((text != "") & ~F.endswith(text, F.lit("\n"))).cast("int")
