"""Functions on repository paths: names, roles, globs, distances, nearest packages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Conventional entry files.
ENTRY_FILENAMES = (
    "Program.cs", "__init__.py", "__main__.py", "build.rs", "index.cjs", "index.js", "index.jsx", "index.mjs", "index.php",
    "index.ts", "index.tsx", "index.vue", "lib.rs", "main.c", "main.cpp", "main.go", "main.py", "main.rb", "main.rs", "mod.rs",
    "setup.py")
# Files that only wire a module together.
WIRING_FILENAMES = ("__init__.py", "index.cjs", "index.js", "index.mjs", "index.ts", "lib.rs", "mod.rs")
# Directories that no scan enters.
PRUNED = (".git", ".hg", ".svn", "target", "node_modules", "vendor")
# Path components that give a role, in the order in which they are asked for.
ROLE_COMPONENTS = {
    "fixture": ("fixture", "fixtures", "testdata", "__fixtures__"),
    "benchmark": ("bench", "benches", "benchmark", "benchmarks"),
    "example": ("example", "examples"),
    "generated": ("generated", "gen", "dist", "build", "coverage", "tmp"),
    "test": ("test", "tests", "spec", "specs"),
}
ROLE_NAMES = {
    "benchmark": r"bench", "generated": r"\.generated\.(rs|ts|js)$", "test": r"_test\.|\.test\.|\.spec\."}
# Extension to language.
LANGUAGES = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "go": "go", "java": "java",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "tsx": "tsx", "php": "php", "py": "python", "rb": "ruby", "rs": "rust", "vue": "vue"}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_entry(path: Column) -> Column:
    return basename(path).isin(*ENTRY_FILENAMES)


def is_wiring(path: Column) -> Column:
    return basename(path).isin(*WIRING_FILENAMES)


def pruned(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in PRUNED]))


def generic_role(path: Column) -> Column:
    """The role that a path's components or its name give; null if none does."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts, name = F.split(low, "/"), basename(low)
    out = None
    for role, names in ROLE_COMPONENTS.items():
        hit = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
        if role in ROLE_NAMES:
            hit = hit | name.rlike(ROLE_NAMES[role])
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out


def role(path: Column, explicit: Column, generated: Column) -> Column:
    """Explicit rule, then generated marker, then generic path rules, then primary."""
    return F.coalesce(explicit, F.when(generated, "generated"), generic_role(path), F.lit("primary"))


def language(path: Column) -> Column:
    ext = F.lower(F.element_at(F.split(basename(path), r"\."), -1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(F.contains(basename(path), F.lit(".")) & ~F.endswith(path, F.lit(".blade.php")), F.try_element_at(table, ext))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: * and ? stay inside a component, ** crosses them."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out.append("[\\s\\S]*")
            i += 2
            continue
        c = pattern[i]
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern).replace("$", "\\z"))


def clean(path: Column) -> Column:
    """Folds "." and ".." components; null if the path leaves the repository."""
    keep = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    folded = F.aggregate(
        keep, F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok")),
        lambda a, x: F.when(x != "..", F.struct(F.concat(a["p"], F.array(x)).alias("p"), a["ok"].alias("ok"))).otherwise(
            F.struct(F.slice(a["p"], 1, F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"),
                     (a["ok"] & (F.size(a["p"]) > 0)).alias("ok"))))
    return F.when(folded["ok"], F.array_join(folded["p"], "/"))


def strip_suffix(target: Column) -> Column:
    return F.regexp_replace(target, r"[?#][\s\S]*$", "")


def nearest_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path, package: the deepest package root above each file, by an equi-join on its ancestors."""
    from ..operators.ratings import ancestors

    up = files.select("path", F.explode(ancestors(F.col("path"))).alias("package"))
    roots = packages.select("package").distinct()
    depth = F.when(F.col("package") == ".", 0).otherwise(F.size(F.split("package", "/")))
    return up.join(roots, "package").groupBy("path").agg(F.max_by("package", depth).alias("package"))
