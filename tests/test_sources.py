"""Sources and source measurement on small inline trees."""

import subprocess

import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths, python_units
from tidemark.operators import graph, resolution
from tidemark.sources import baseline, git_history, inventory

SOURCE = '''def outer(items):
    def inner(value):
        try:
            if value > 1:
                return value
            elif value == 1:
                return 1
        except ValueError:
            return 0
        return [item for item in items if item]
    choose = lambda value: value if value else 0
    return inner(choose(1))
'''


def test_python_units():
    got = [(u["name"], u["container"], u["kind"], u["parent_ordinal"], u["start_line"], u["end_line"], u["cognitive"], u["cyclomatic"],
            u["logical_lines"], u["max_nesting"], u["parameter_count"]) for u in python_units.units(SOURCE)]
    assert got[0] == ("outer", None, "function", None, 1, 12, 0, 1, 2, 0, 1)
    assert got[1] == ("inner", "outer", "function", 0, 2, 10, 4, 5, 4, 1, 1)
    assert got[2][:6] == ("<lambda 11>", "outer", "lambda", 0, 11, 11)


def test_boolean_runs_and_nesting():
    u = python_units.units("def f(a, *, b):\n  if a and b and a or b:\n    for x in a:\n      while x: pass\n  else: pass\n")[0]
    assert (u["cognitive"], u["cyclomatic"], u["max_nesting"], u["parameter_count"]) == (1 + 2 + 2 + 3 + 1, 1 + 3 + 3, 3, 3)


def test_measure(spark):
    d = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    assert {(r.path, r.name) for r in python_units.measure(d).collect()} == {("a.py", "outer"), ("a.py", "inner"), ("a.py", "<lambda 11>")}
    assert d.select(python_units.line_count(F.col("text")).alias("n")).first().n == 12


def test_git_round_trip(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    for k, v in (("user.name", "A"), ("user.email", "a@x.org")):
        run("config", k, v)
    (tmp_path / "one.py").write_text("x = 1\ny = 2\nz = 3\n")
    (tmp_path / "bin").write_bytes(b"\0\1\2")
    run("add", "-A"), run("commit", "-qm", "first")
    run("mv", "one.py", "two.py"), run("commit", "-qam", "second")
    (tmp_path / "two.py").write_text("x = 1\ny = 2\nz = 4\n")
    run("commit", "-qam", "third")
    commits, changes = git_history.tables(spark, str(tmp_path), {"two.py", "bin"})
    assert commits.count() == 3
    rows = {(r.position, r.path, r.previous_path, r.added, r.deleted) for r in changes.collect()}
    assert rows == {(0, "two.py", None, 1, 1), (1, "two.py", "one.py", 0, 0), (2, "two.py", None, 3, 0), (2, "bin", None, None, None)}
    assert all("a@x.org" not in r.contributor for r in commits.collect())


def test_malformed_history_keeps_the_prefix():
    good = b"\x1e" + b"a" * 40 + b"\0A\0a@x\0" + b"5\0\n1\t2\tp\0"
    seen = []
    with pytest.raises(git_history.MalformedHistory):
        for c in git_history.parse([good, b"\x1eshort\0A\0a@x\0" + b"5\0"]):
            seen.append(c.changes)
    assert seen == [[("p", None, 1, 2)]]


def test_rename_conflict_is_a_gap():
    c = [git_history.Commit("r1", "x", 2, [("a", "old", 1, 1), ("b", "old", 1, 1)]), git_history.Commit("r2", "x", 1, [("old", None, 1, 1)])]
    rows, gaps = git_history.follow_renames(c, {"a", "b"})
    assert gaps == 1 and [r[1] for r in rows] == ["a", "b"]


def test_baseline(spark):
    text = f"{baseline.VERSION}\n{baseline.COLUMNS}\na\tcognitive\t1\t0\na\tnesting\t0\t2\n"
    d = spark.createDataFrame(baseline.parse(text) + [("b", "nesting", 0, 0)], baseline.SCHEMA)
    assert baseline.render(d) == text
    for bad in (text.replace("\n", "\r\n"), text.replace("v1", "v2"), text.replace("\t1\t0", "\t-1\t0"), text.replace("cognitive", "x"),
                text + "a\tnesting\t0\t2\n", text + "0\tnesting\t0\t2\n", text + "b\tnesting\n"):
        with pytest.raises(ValueError):
            baseline.parse(bad)


def test_inventory(spark, tmp_path):
    for p in ("src/a.py", "src/gen.log", "keep/x.log", "node_modules/z.js", "sub/.git/HEAD", "sub/b.py", "tests/t.py", "lib/pkg/m.ts"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x\n")
    (tmp_path / ".gitignore").write_text("*.log\n!keep/x.log\n!node_modules/\n")
    (tmp_path / "lib/package.json").write_text('{"name": "@a/lib", "main": "./pkg/m.ts"}')
    assert ("checkout", "sub") in list(inventory.walk(str(tmp_path)))
    files, packs = inventory.tables(spark, str(tmp_path), ("/src/",))
    rows = {r.path: (r.language, r.role, r.package) for r in files.collect()}
    assert set(rows) == {".gitignore", "keep/x.log", "tests/t.py", "lib/pkg/m.ts", "lib/package.json"}
    assert rows["tests/t.py"] == ("python", "test", ".") and rows["lib/pkg/m.ts"] == ("typescript", "primary", "lib")
    assert packs.where("package = 'lib'").first().declared_paths == ["pkg/m.ts"]


def test_resolution(spark):
    files = spark.createDataFrame([("a/x.ts",), ("a/y.js",), ("b/z.tsx",), ("b/z.ts",), ("p/__init__.py",), ("p/m.py",), ("p/n.py",)], "path string")
    refs = spark.createDataFrame([(1, "a", "./x.js?raw"), (2, "a", "../a/y.js"), (3, "a", "../b/z.js"), (4, "a", "../../out.js")],
                                 "ref_id long, directory string, target string")
    c = resolution.runtime_candidates(resolution.relative_candidates(refs))
    got = {r.ref_id: (r.outcome, r.path) for r in resolution.unique_match(refs, c, files).collect()}
    assert got == {1: ("resolved", "a/x.ts"), 2: ("resolved", "a/y.js"), 3: ("ambiguous", None), 4: ("unresolved", None)}
    py = spark.createDataFrame([(1, "p/m.py", ".n", None), (2, "p/m.py", "p", "n"), (3, "p/m.py", "os", "path"), (4, "p/m.py", ".gone", None)],
                               "ref_id long, path string, module string, name string")
    got = {r.ref_id: (r.outcome, r.file) for r in resolution.python_match(py, files).collect()}
    assert got == {1: ("resolved", "p/n.py"), 2: ("resolved", "p/n.py"), 3: ("external", None), 4: ("unresolved", None)}
    rules = spark.createDataFrame([("w", "@/", "", "src/*")], "package string, prefix string, suffix string, replacement string")
    alias = spark.createDataFrame([(9, "w", "@/k.ts")], "ref_id long, package string, target string")
    assert resolution.expand_aliases(alias, rules).first().candidate == "src/k.ts"


def test_globs():
    import re

    for pattern, text, want in (("src/*.rs", "src/a.rs", True), ("src/*.rs", "src/b/a.rs", False), ("src/**", "src/b/a.rs", True),
                                ("**/t?st/*", "a/b/test/x", True), ("a?c", "a/c", False)):
        assert bool(re.search(paths.glob_regex(pattern), text)) == want


def test_strong_components_against_reachability(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    n = 18
    a = rng.random((n, n)) < 0.09
    np.fill_diagonal(a, False)
    r = a | np.eye(n, dtype=bool)
    for k in range(n):
        r |= np.outer(r[:, k], r[k])
    both = r & r.T
    edges = spark.createDataFrame([(int(i), int(j), 1) for i, j in zip(*np.nonzero(a))], "src long, dst long, refs long")
    got = {x.node: x.component for x in graph.strong_components(edges).collect()}
    assert all(got[i] == int(np.flatnonzero(both[i])[0]) for i in got)
    members = graph.cycles(edges).select("component", F.explode("members").alias("node"))
    for w in graph.witnesses(edges, members).collect():
        assert all(a[x, y] for x, y in zip(w.path, [*w.path[1:], w.path[0]]))


def test_candidates_clean_each_reference_once(spark):
    refs = spark.createDataFrame([(1, "a", "./x.js?raw"), (2, "a", "../../x.js"), (3, "a", "y.mjs")], "ref_id long, directory string, target string")
    c = resolution.runtime_candidates(resolution.relative_candidates(refs))
    assert sorted(map(tuple, c.collect())) == [(1, "a/x.js", 0), (1, "a/x.ts", 1), (1, "a/x.tsx", 1), (3, "y.mjs", 0), (3, "y.mts", 1), (3, "y.ts", 1)]
    # A union reads the references twice; a filter on the candidate is pushed below and cleans the path again.
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Filter" not in plan
