"""The report as text, and the exit codes of the commands."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cards import TIER_SENTENCES
from ..policy import RATINGS
from . import codebase, review

ROWS = 24


def _section(title: str, df: DataFrame | None, order: list, line: Callable, rows: int) -> list[str]:
    """A section's first rows; only they reach the driver."""
    if df is None:
        return []
    found = df.orderBy(*order).limit(rows + 1).collect()
    return [] if not found else ["", title, *(f"  {line(r)}" for r in found[:rows]), *(["  ..."] if len(found) > rows else [])]


def render(tables: dict[str, DataFrame], rows: int = ROWS) -> str:
    """Sections of the codebase report, of at most ``rows`` lines each; empty ones are left out."""
    head = tables["verdict"].first()
    get = tables.get
    out = [TIER_SENTENCES[head.tier_rank], f"{head.checked} units checked, {head.high} high, {head.watch} watch"] if head else [TIER_SENTENCES[0]]
    areas = tables["health"].where("scope <> '.' AND high + watch > 0")
    out += _section("AREAS", areas, [F.desc("high"), F.desc("watch"), "scope"], lambda r: f"{r.scope}: {r.high} high, {r.watch} watch", rows)
    out += _section("FINDINGS", tables["findings"], [F.desc("rating"), F.desc("signals_at_rating"), F.desc("cognitive"), "path", "start_line"],
                    lambda r: f"{RATINGS[r.rating]} {r.path}:{r.start_line} {r.name} (cognitive {r.cognitive}, cyclomatic {r.cyclomatic}, "
                              f"{r.logical_lines} statements, nesting {r.max_nesting}, {r.parameter_count} parameters)", rows)
    out += _section("ARCHITECTURE", get("architecture_findings"), [F.desc("size"), "component"], lambda r: f"cycle of {r.size}: {', '.join(map(str, r.members[:5]))}", rows)
    out += _section("HISTORY", get("hotspots"), [F.desc("touches"), "path"], lambda r: f"{r.path}: {r.touches} changes, {r.high} high, {r.watch} watch", rows)
    failed = tables["files"].where("parse_status = 'failed'").select(F.concat(F.lit("not readable: "), "path").alias("text"))
    warned = failed if get("history_status") is None else failed.union(tables["history_status"].where("availability <> 'complete'").select(
        F.concat_ws(": ", F.concat(F.lit("history "), "availability"), "reason")))
    out += _section("WARNINGS", warned, ["text"], lambda r: r.text, rows)
    return "\n".join(out) + "\n"


def render_diff(tables: dict[str, DataFrame], rows: int = ROWS) -> str:
    v = tables["verdict"].first()
    out = [f"{v.tier}: {v.worse} worse, {v.better} better, {v.changed} changed"]
    moved = tables["unit_comparisons"].where("participation = 'verdict' AND comparison <> 'unchanged'")
    out += _section("UNITS", moved, ["comparison", "path_after", "name_after"], lambda r: f"{r.comparison} {r.path_after} {r.name_after}", rows)
    out += _section("RELATIONS", tables["relation_comparisons"], ["kind", "src", "dst"], lambda r: f"{r.kind} {r.src} -> {r.dst}", rows)
    out += _section("CYCLES", tables["cycle_comparisons"], ["kind", "component"], lambda r: f"{r.kind} cycle of {r.size}", rows)
    return "\n".join(out) + "\n"


def main(args: list[str], spark: SparkSession | None = None) -> int:
    """0: done, no regression; 1: the analysis failed; 2: the call or the baseline is wrong; 3: a regression."""
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("command", choices=("report", "diff", "gate"))
    p.add_argument("root")
    p.add_argument("--base"), p.add_argument("--baseline"), p.add_argument("--update", action="store_true"), p.add_argument("--json")
    try:
        a = p.parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    if a.command == "gate" and not a.baseline:
        print("gate needs --baseline", file=sys.stderr)
        return 2
    try:
        spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
        if a.command == "gate":
            code, rows = codebase.gate(spark, a.root, a.baseline, a.update)
            if rows is not None:
                sys.stdout.write("".join(f"{r.outcome} {r.path} {r.signal}: high {r.high_b} -> {r.high_o}, watch {r.watch_b} -> {r.watch_o}\n"
                                         for r in rows.where("outcome <> 'unchanged'").orderBy("outcome", "path", "signal").toLocalIterator()))
            return code
        tables = codebase.analyze(spark, a.root) if a.command == "report" else review.analyze_diff(spark, a.root, a.base)
        if a.json:
            (codebase.write_report if a.command == "report" else review.write_tables)(tables, a.json)
        sys.stdout.write(render(tables) if a.command == "report" else render_diff(tables))
        return 0
    except Exception as e:  # the contract of the exit code
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
