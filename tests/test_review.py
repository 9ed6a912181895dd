"""The base side of a change, its comparison, and histories that break."""

import subprocess

import pytest

from tidemark.plans import review
from tidemark.sources import baseline, git_base, git_history

DEEP = "def deep(a):\n" + "".join("    " * (i + 1) + f"if a > {i}:\n" for i in range(8)) + "    " * 9 + "return a\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main"), run("config", "user.name", "A"), run("config", "user.email", "a@x.org")
    (root / "old.py").write_text("import b\ndef keep(x):\n    return x\n" + "y = 1\n" * 20)
    (root / "b.py").write_text("def calm(a):\n    return a\ndef gone(q):\n    return q * 3\n")
    (root / "a.js").write_text("export const f = (x) => x;\n")
    (root / "dead.py").write_text(DEEP.replace("deep", "was"))
    run("add", "-A"), run("commit", "-qm", "base"), run("checkout", "-qb", "work")
    run("mv", "old.py", "new.py")
    (root / "b.py").write_text("import new\n" + DEEP.replace("deep", "calm"))
    run("add", "-A"), run("commit", "-qm", "ahead")
    (root / "a.js").write_text("import './c.js';\nexport const f = (x) => x;\n")
    (root / "c.js").write_text("export function fresh() { return 1; }\n")
    (root / "dead.py").unlink()
    return root


def test_base(repo):
    root = str(repo)
    base = git_base.merge_base(root, git_base.default_base(root))
    assert [tuple(c) for c in git_base.changes(root, base)] == [
        ("a.js", "a.js", True, True), ("b.py", "b.py", True, True), ("c.js", "c.js", True, False), ("dead.py", "dead.py", False, True),
        ("new.py", "old.py", True, True)]
    assert len(git_base.commits_ahead(root, base)) == 1 and git_base.commits_ahead(root, "HEAD") == set()
    names = [e[1] for e in git_base.tree(root, base)]
    texts = list(git_base.objects(root, [names[0], "0" * 40, *names] * 50, pending=3))
    assert len(texts) == 50 * (len(names) + 2) and texts[1] is None and texts[0] == texts[2] == b"export const f = (x) => x;\n"
    for bad in ("--all", "a..b", "x;y", ""):
        with pytest.raises(git_base.GitError):
            git_base.valid_ref(bad)
    assert git_base.default_base(root, "work") == "work"


def test_diff(spark, repo):
    t = review.analyze_diff(spark, str(repo))
    got = {(r.name_after, r["pass"], r.comparison, r.participation) for r in t["unit_comparisons"].collect()}
    assert got == {("keep", "declared", "unchanged", "verdict"), ("calm", "declared", "regressed", "verdict"), ("f", "declared", "unchanged", "verdict")}
    assert {(r.path, r.comparison, r.withheld) for r in t["one_sided_units"].collect()} == {
        ("b.py", "removed", False), ("c.js", "added", False), ("dead.py", "removed", False)}
    assert {(r.src, r.dst, r.kind) for r in t["relation_comparisons"].collect()} == {
        ("old.py", "b.py", "removed"), ("new.py", "b.py", "added"), ("b.py", "new.py", "added"), ("a.js", "c.js", "added")}
    assert [(r.size, r.kind) for r in t["cycle_comparisons"].collect()] == [(2, "added")]
    v = t["verdict"].first()
    assert (v.worse, v.better, v.tier) == (1, 1, "mixed") and t["change_revisions"].count() == 1


def test_history_that_breaks_keeps_what_came_before(spark, repo, tmp_path):
    raw = b"".join(git_history.log(str(repo)))
    commits, reason = git_history.kept(git_history.parse([raw + b"\x1enot a commit\0x"]))
    assert len(commits) == 2 and reason
    assert git_history.status(spark, commits, 0, reason).first().availability == "incomplete"
    assert git_history.load(spark, str(repo))[2].first().availability == "complete"
    assert git_history.load(spark, str(tmp_path))[2].first().availability == "unavailable"


def test_baseline_written_by_spark(spark, tmp_path):
    rows = spark.createDataFrame([("b/é", "cognitive", 1, 0), ("a", "nesting", 0, 2), ("a", "cognitive", 3, 1), ("z", "cognitive", 0, 0)], baseline.SCHEMA)
    baseline.write(rows.repartition(3), f"{tmp_path}/gate.tsv")
    text = (tmp_path / "gate.tsv").read_text()
    assert text == baseline.render(rows) and len(baseline.parse(text)) == 3
    assert [x.name for x in tmp_path.iterdir()] == ["gate.tsv"]


def test_commands_and_exit_codes(spark, repo, tmp_path, capsys):
    from tidemark.plans import terminal

    assert terminal.main(["report", str(repo)], spark) == 0
    text = capsys.readouterr().out
    assert "FINDINGS" in text and "b.py:2 calm" in text and "ARCHITECTURE" in text and "AREAS" in text
    assert terminal.main(["diff", str(repo), "--json", f"{tmp_path}/out"], spark) == 0
    assert capsys.readouterr().out.startswith("mixed: 1 worse, 1 better") and (tmp_path / "out/verdict").is_dir()
    line = f"{tmp_path}/gate.tsv"
    assert terminal.main(["gate", str(repo), "--baseline", line, "--update"], spark) == 0 and terminal.main(["gate", str(repo), "--baseline", line], spark) == 0
    (tmp_path / "gate.tsv").write_text(f"{baseline.VERSION}\n{baseline.COLUMNS}\n")
    assert terminal.main(["gate", str(repo), "--baseline", line], spark) == 3 and "regression b.py" in capsys.readouterr().out
    assert terminal.main(["gate", str(repo)], spark) == 2 and terminal.main(["no"], spark) == 2
    assert terminal.main(["diff", str(repo), "--base", "no-such-ref"], spark) == 1
