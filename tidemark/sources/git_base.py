"""The base side of a change: its ref, the files that differ, and what they held there. Git runs on the driver."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

#: Tried in this order where no base is named and the remote names none.
DEFAULTS = ("main", "master")


class GitError(RuntimeError):
    """A git command failed or answered in another format."""


class Change(NamedTuple):
    """base_path is the path before a rename; either side may not exist."""

    path: str
    base_path: str
    current_exists: bool
    base_exists: bool


def _git(root: str, *args: str) -> bytes:
    p = subprocess.run(["git", "-C", root, *args], capture_output=True)
    if p.returncode:
        raise GitError(p.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
    return p.stdout


def valid_ref(ref: str) -> str:
    """The ref, if it can be no option and no expression."""
    if not re.fullmatch(r"[\w][\w./@{}^~+-]*", ref) or ".." in ref:
        raise GitError(f"not a ref: {ref!r}")
    return ref


def default_base(root: str, named: str | None = None) -> str:
    """The named ref, else the head of origin, else main or master."""
    if named:
        return valid_ref(named)
    try:
        return _git(root, "symbolic-ref", "--quiet", "--short", "refs/remotes/origin/HEAD").decode().strip()
    except GitError:
        pass
    for ref in DEFAULTS:
        try:
            _git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}")
            return ref
        except GitError:
            continue
    raise GitError("no base: name one")


def merge_base(root: str, ref: str) -> str:
    return _git(root, "merge-base", valid_ref(ref), "HEAD").decode().strip()


def commits_ahead(root: str, base: str) -> set[str]:
    """Revisions that the change itself made."""
    return set(_git(root, "rev-list", f"{valid_ref(base)}..HEAD").decode().split())


def changes(root: str, base: str) -> list[Change]:
    """Files that differ between base and the worktree: committed, staged, not staged, renamed, deleted and untracked,
    sorted by path, each once."""
    found: dict[str, Change] = {}
    fields = iter(_git(root, "diff", "--name-status", "-z", "-M", valid_ref(base), "--").decode(errors="surrogateescape").split("\0"))
    for code in fields:
        if not code:
            continue
        old = path = next(fields, "")
        if code[0] in "RC":
            path = next(fields, "")
        if not path or code[0] not in "ACDMRT":
            raise GitError(f"name-status {code!r}")
        found.setdefault(path, Change(path, old, code[0] != "D", code[0] != "A"))
    for path in _git(root, "ls-files", "--others", "--exclude-standard", "-z").decode(errors="surrogateescape").split("\0"):
        if path:
            found.setdefault(path, Change(path, path, True, False))
    return sorted(found.values())


def tree(root: str, revision: str) -> list[tuple[str, str, int]]:
    """(path, object, size) of the files of a revision; links and nested repositories are left out."""
    out = []
    for entry in _git(root, "ls-tree", "-r", "-l", "-z", valid_ref(revision)).decode(errors="surrogateescape").split("\0"):
        if entry:
            head, path = entry.split("\t", 1)
            mode, kind, name, size = head.split()
            if kind == "blob" and mode != "120000":
                out.append((path, name, int(size)))
    return out


def objects(root: str, names: Iterable[str], pending: int = 64) -> Iterator[bytes | None]:
    """The contents of objects, in order, None for one that is missing. One batch process answers; so many names at a time are
    sent ahead, and one content is in memory."""
    with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
        names, waiting = iter(names), 0

        def send() -> bool:
            name = next(names, None)
            if name is None:
                return False
            p.stdin.write(f"{name}\n".encode(errors="surrogateescape"))
            p.stdin.flush()
            return True

        try:
            while waiting < pending and send():
                waiting += 1
            while waiting:
                head = p.stdout.readline().split()
                if not head:
                    raise GitError("cat-file ended early")
                if head[-1] == b"missing":
                    yield None
                else:
                    body = p.stdout.read(int(head[2]) + 1)
                    yield body[:-1]
                waiting += -1 + send()
        finally:
            p.stdin.close()


def base_files(spark: SparkSession, root: str, revision: str, paths: set[str] | None = None) -> DataFrame:
    """path, size_bytes and text of a revision's files (of the given paths only, if any are given)."""
    entries = [e for e in tree(root, revision) if paths is None or e[0] in paths]
    texts = objects(root, (e[1] for e in entries))
    rows = [(p, n, None if t is None else t.decode("utf-8", "replace")) for (p, _, n), t in zip(entries, texts)]
    return spark.createDataFrame(rows, "path string, size_bytes long, text string")


def change_table(spark: SparkSession, found: list[Change]) -> DataFrame:
    return spark.createDataFrame(found, "path string, base_path string, current_exists boolean, base_exists boolean")
