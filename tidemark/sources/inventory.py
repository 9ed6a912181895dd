"""Source trees as tables: files with language, role and package, and the packages their manifests declare."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

# Manifest file names; * stands for any stem.
MANIFESTS = {
    "Cargo.toml": "cargo", "package.json": "npm", "pyproject.toml": "python", "pom.xml": "maven", "build.gradle": "gradle",
    "build.gradle.kts": "gradle", "CMakeLists.txt": "cmake", "Gemfile": "bundler", "*.gemspec": "gemspec", "go.mod": "go",
    "composer.json": "composer", "*.csproj": "dotnet"}


class Ignore:
    """Rules of one ignore file, below its folder: the last rule that matches decides."""

    def __init__(self, folder: str, text: str):
        self.folder, self.rules = folder, []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            negated, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
            only_folders, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/")
            regex = "".join({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or (
                p.replace("[!", "[^") if p.startswith("[") and len(p) > 1 else re.escape(p))
                for p in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]+\]|.", line))
            try:
                self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + regex), negated, only_folders))
            except re.error:
                continue  # a pattern that is none excludes nothing

    def decides(self, path: str, folder: bool) -> bool | None:
        inside = os.path.relpath(path, self.folder) if self.folder else path
        out = None
        for regex, negated, only_folders in self.rules:
            if (folder or not only_folders) and regex.fullmatch(inside):
                out = not negated
        return out


def walk(root: str, excludes: tuple[str, ...] = ()) -> Iterator[tuple[str, str]]:
    """("file" or "checkout", path) below root in the order of names. Pruned folders stay out whatever the rules say;
    a folder that is a checkout of its own is named, not entered; links are not followed."""
    own = Ignore("", "\n".join(excludes))

    def below(rel: str, rules: list[Ignore]) -> Iterator[tuple[str, str]]:
        here = os.path.join(root, rel)
        if os.path.isfile(os.path.join(here, ".gitignore")):
            with open(os.path.join(here, ".gitignore"), errors="replace") as f:
                rules = [*rules, Ignore(rel, f.read())]
        for name in sorted(os.listdir(here)):
            path, full = (f"{rel}/{name}" if rel else name), os.path.join(here, name)
            folder = os.path.isdir(full)
            if os.path.islink(full) or (folder and name in paths.PRUNED) or own.decides(path, folder):
                continue
            verdict = next((v for r in reversed(rules) if (v := r.decides(path, folder)) is not None), False)
            if verdict:
                continue
            if folder and os.path.exists(os.path.join(full, ".git")):
                yield "checkout", path
            elif folder:
                yield from below(path, rules)
            else:
                yield "file", path

    yield from below("", [])


def manifest_kind(path: str) -> str | None:
    name = os.path.basename(path)
    return next((k for p, k in MANIFESTS.items() if fnmatch.fnmatchcase(name, p)), None)


def manifest_name(kind: str, text: str) -> tuple[str | None, list[str]]:
    """The package name that a manifest declares, and the source paths it names; nothing from one that cannot be read."""
    try:
        if kind == "cargo":
            t = tomllib.loads(text)
            return t.get("lib", {}).get("name") or t.get("package", {}).get("name"), []
        if kind == "python":
            t = tomllib.loads(text)
            return t.get("project", {}).get("name") or t.get("tool", {}).get("poetry", {}).get("name"), []
        if kind == "npm":
            t = json.loads(text)
            found: list[str] = []

            def collect(v):
                if isinstance(v, str):
                    found.append(v.removeprefix("./"))
                elif isinstance(v, dict):
                    for x in v.values():
                        collect(x)

            for key in ("main", "module", "browser", "types", "bin", "exports"):
                collect(t.get(key))
            return t.get("name"), sorted(set(found))
        if kind == "gemspec":
            m = re.search(r"""\.name\s*=\s*["']([^"']+)["']""", text)
            return (m[1] if m else None), []
    except (ValueError, AttributeError):
        pass
    return None, []


def tables(spark: SparkSession, root: str, excludes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """files (path, size_bytes, language, role, package) and packages (package, manifest_name, declared_paths)."""
    names = [p for kind, p in walk(root, excludes) if kind == "file"]
    packages = {".": (None, [])}
    for p in names:
        if kind := manifest_kind(p):
            with open(os.path.join(root, p), errors="replace") as f:
                name, declared = manifest_name(kind, f.read())
            folder = os.path.dirname(p) or "."
            old = packages.get(folder, (None, []))
            packages[folder] = (old[0] or name, sorted({*old[1], *declared}))
    packs = spark.createDataFrame([(k, *v) for k, v in sorted(packages.items())],
                                  "package string, manifest_name string, declared_paths array<string>")
    files = spark.createDataFrame([(p, os.path.getsize(os.path.join(root, p))) for p in names], "path string, size_bytes long")
    files = files.withColumn("language", paths.language(F.col("path"))).withColumn(
        "role", paths.role(F.col("path"), F.lit(None).cast("string"), F.lit(False)))
    return files.join(paths.nearest_package(files, packs), "path"), packs
