"""The report of a small repository, its gate, and configuration files."""

import json
import subprocess

import pytest

from tidemark.plans import codebase
from tidemark.sources import baseline, config, datasource

DEEP = "def deep(a):\n" + "".join("    " * (i + 1) + f"if a > {i}:\n" for i in range(8)) + "    " * 9 + "return a\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    run("init", "-q"), run("config", "user.name", "A"), run("config", "user.email", "a@x.org")
    (root / "pkg").mkdir()
    (root / "pkg/__init__.py").write_text("")
    (root / "pkg/a.py").write_text("from . import b\n" + DEEP)
    (root / "pkg/b.py").write_text("from .a import deep\nimport os\nfrom .gone import x\n")
    (root / "pkg/alone.py").write_text("x = 1\n")
    for i in range(6):
        (root / "pkg/a.py").write_text((root / "pkg/a.py").read_text() + f"x{i} = {i}\n")
        run("add", "-A"), run("commit", "-qm", f"c{i}")
    return root


def test_report(spark, repo, tmp_path):
    t = codebase.analyze(spark, str(repo))
    assert [(r.name, r.rating, r.max_nesting) for r in t["findings"].collect()] == [("deep", 2, 8)]
    assert {(r.src, r.dst) for r in t["dependency_edges"].collect()} >= {("pkg/a.py", "pkg/b.py"), ("pkg/b.py", "pkg/a.py")}
    assert {(r.outcome, r.references) for r in t["dependency_coverage"].collect()} == {("resolved", 2), ("external", 1), ("unresolved", 1)}
    assert [r.members for r in t["architecture_findings"].collect()] == [["pkg/a.py", "pkg/b.py"]]
    assert [r.path for r in t["orphan_files"].collect()] == ["pkg/alone.py"]
    assert [(r.path, r.touches) for r in t["hotspots"].collect()] == [("pkg/a.py", 6)]
    assert t["verdict"].first().tier == "worn"
    codebase.write_report(t, str(tmp_path))
    assert json.loads((tmp_path / "report.json").read_text())["verdict"][0]["tier"] == "worn"


def test_gate(spark, repo, tmp_path):
    path = tmp_path / "gate.tsv"
    assert codebase.gate(spark, str(repo), str(path), update=True)[0] == 0
    assert codebase.gate(spark, str(repo), str(path))[0] == 0
    path.write_text(f"{baseline.VERSION}\n{baseline.COLUMNS}\n")
    assert codebase.gate(spark, str(repo), str(path))[0] == 3
    path.write_text("nothing\n")
    assert codebase.gate(spark, str(repo), str(path))[0] == 2


def test_data_source(spark, repo):
    datasource.register(spark)
    d = spark.read.format("git_changes").option("path", str(repo)).load()
    assert d.groupBy("path").count().where("path = 'pkg/a.py'").first()["count"] == 6
    newest = d.agg({"ts": "max"}).first()[0]
    assert d.where(f"ts >= {newest + 1}").count() == 0


def test_config():
    c = config.parse('history = "30d"\nexclude = ["x"]\n[thresholds]\nnesting = {watch = 2, high = 3}\n[source_roles]\ntest = ["t/**"]\n'
                     '[hotspots]\nminimum_touches = 2\n')
    assert c.health.limits["max_nesting"] == (2, 3) and c.history.window_days == 30 and c.history.hotspot_touches == 2
    assert c.roles == {"t/**": "test"} and c.excludes == ("x",)
    for bad in ("unknown = 1", "[thresholds]\nnesting = {watch = 3, high = 3}", 'history = "3w"', "[hotspots]\nminimum_touches = 0",
                '[source_roles]\ntest = ["a"]\nprimary = ["a"]', '[source_roles]\ntest = [" "]'):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_alias_rules(tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "base.json").write_text('{/* base */ "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*",], "one": ["lib/one.ts"]}},}')
    (tmp_path / "web/tsconfig.json").write_text('{"extends": "../base" // up\n}')
    rules = config.alias_rules(str(tmp_path), "web/tsconfig.json")
    assert rules == [("web", "@/", "", "src/*"), ("web", "one", "", "src/lib/one.ts"), ("web", "", "", "src/*")]
    (tmp_path / "base.json").write_text('{"extends": "./base.json"}')
    with pytest.raises(ValueError):
        config.alias_rules(str(tmp_path), "web/tsconfig.json")
