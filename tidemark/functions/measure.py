"""Units, imports and parse status of source files of every measured language."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import brace_units, python_units

EXTENSIONS = {"py": "python", "pyi": "python"} | brace_units.EXTENSIONS
UNITS = ("path string, language string, ordinal int, name string, container string, kind string, start_line int, end_line int, "
         "parent_ordinal int, cognitive int, cyclomatic int, logical_lines int, max_nesting int, parameter_count int, fingerprint string")
REFERENCES = "path string, language string, module string, name string, line int"
STATUS = "path string, language string, parse_status string, units int"


def language_of(path: str) -> str | None:
    name = path.rpartition("/")[2]
    return EXTENSIONS.get(name.rpartition(".")[2].lower()) if "." in name and not name.endswith(".blade.php") else None


def units_of(text: str, language: str) -> list[dict]:
    return python_units.units(text) if language == "python" else brace_units.units(text, language)


def imports_of(text: str, language: str) -> list[tuple[str, str | None, int]]:
    if language == "python":
        return python_units.imports(text)
    return [(target, None, line) for target, line in brace_units.imports(text, language)]


_UNREADABLE = (SyntaxError, ValueError, RecursionError)


def _mapped(files: DataFrame, schema: str, rows_of: Callable[[str, str], list[tuple]]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string() if x.split()[1] == "string" else pa.int32() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                language = language_of(path or "")
                if language is not None:
                    rows += [(path, language, *r) for r in rows_of(text or "", language)]
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return files.select("path", "text").mapInArrow(run, schema)


def measure(files: DataFrame) -> DataFrame:
    """Units of every file (path, text); files that cannot be read give none here, and a row in :func:`statuses`."""
    def rows(text: str, language: str) -> list[tuple]:
        try:
            return [tuple(u[c] for c in _COLUMNS) for u in units_of(text, language)]
        except _UNREADABLE:
            return []

    return _mapped(files, UNITS, rows)


_COLUMNS = [x.split()[0] for x in UNITS.split(", ")][2:]


def references(files: DataFrame) -> DataFrame:
    """Imports of every file, as they are written."""
    def rows(text: str, language: str) -> list[tuple]:
        try:
            return imports_of(text, language)
        except _UNREADABLE:
            return []

    return _mapped(files, REFERENCES, rows)


def statuses(files: DataFrame) -> DataFrame:
    """One row per file of a measured language: parsed or failed, and how many units it has."""
    def rows(text: str, language: str) -> list[tuple]:
        try:
            return [("parsed", len(units_of(text, language)))]
        except _UNREADABLE:
            return [("failed", 0)]

    return _mapped(files, STATUS, rows)
