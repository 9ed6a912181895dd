"""The whole report of one source tree: ingest on the driver, then one lazy table per kind of fact."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measure, paths, python_units
from ..operators import diff, graph, history, ratings, resolution
from ..policy import TIERS
from ..shared import written
from ..sources import baseline, config, git_history, inventory


def analyze(spark: SparkSession, root: str, settings: config.Config | None = None) -> dict[str, DataFrame]:
    """Tables of the report. Sources of every measured language are read; history is there if the root is a repository."""
    settings = settings or config.load(root)
    files, packages = inventory.tables(spark, root, settings.excludes)
    explicit = F.coalesce(*[F.when(paths.glob(F.col("path"), p), F.lit(r)) for p, r in settings.roles.items()], F.lit(None).cast("string"))
    top = "file:" + os.path.abspath(root).rstrip("/") + "/"
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(sorted(measure.EXTENSIONS)) + "}").load(root)
           .select(F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(top) + 1, 1 << 20).alias("path"),
                   F.decode("content", "utf-8").alias("text")))
    texts = written(raw.join(files.select("path"), "path", "left_semi"), "texts")
    marked = texts.select("path", python_units.generated(F.col("text")).alias("generated"), python_units.line_count(F.col("text")).alias("lines"))
    files = files.join(marked, "path", "left").withColumn(
        "role", paths.role(F.col("path"), explicit, F.coalesce("generated", F.lit(False)))).drop("generated")
    files = files.join(measure.statuses(texts).select("path", "parse_status"), "path", "left")
    files = written(files.withColumn("parse_status", F.coalesce("parse_status", F.lit("unsupported"))).withColumn(
        "trust", F.when(F.col("parse_status") == "failed", "advisory").otherwise("trusted")), "files")
    about = files.select("path", "package", "role", "trust")
    units = written(ratings.assess(measure.measure(texts).drop("language").join(about, "path"), settings.health), "units")
    refs = written(measure.references(texts).withColumn("ref_id", F.monotonically_increasing_id()), "refs")
    found = written(refs.join(resolution.language_match(refs, files, aliases(spark, root, settings.excludes)), "ref_id"), "found")
    edges = written(found.where("outcome = 'resolved' AND path <> file").groupBy(F.col("path").alias("src"), F.col("file").alias("dst"))
                    .agg(F.count(F.lit(1)).alias("refs")), "edges")
    out = {
        "files": files, "packages": packages, "findings": units.where("rating > 0 AND affects_verdict"),
        "health": ratings.scope_rollup(units), "dependency_edges": edges,
        "dependency_coverage": found.groupBy("outcome").agg(F.count(F.lit(1)).alias("references")),
        "architecture_findings": graph.cycles(edges), "package_edges": graph.package_edges(
            edges, about.select(F.col("path").alias("node"), "package")),
        "orphan_files": graph.orphans(files.where("parse_status = 'parsed' AND role = 'primary'").select("path"), edges,
                                      files.limit(0).select("path")),
        "size_findings": ratings.size_findings(files.where("lines IS NOT NULL").select("path", "lines"), settings.health),
        "gate": gate_rows(units)}
    cycles = out["architecture_findings"].count()
    out["verdict"] = ratings.scope_tiers(out["health"].where("scope = '.'"), cycles)
    if os.path.exists(os.path.join(root, ".git")):
        commits, changes, status = git_history.load(spark, root, {r.path for r in files.select("path").collect()})
        newest = commits.agg(F.max("ts").alias("newest"))
        changes = changes.join(commits.select("revision", "contributor", "ts"), "revision").crossJoin(F.broadcast(newest)).where(
            F.col("ts") >= F.col("newest") - settings.history.window_days * 86400)
        changes = written(changes.join(about, "path").withColumnRenamed("revision", "commit").drop("newest"), "changes")
        churn = history.churn(changes, "path", "role", "trust")
        rated = ratings.health_counts(units, "path")
        out |= {"file_history": churn, "package_history": history.churn(changes, "package", "role", "trust"),
                "contributor_concentration": history.ownership(changes, "package", "role", "trust"),
                "change_coupling": history.package_coupling(changes, settings.history),
                "file_change_coupling": history.file_coupling(changes, settings.history),
                "hotspots": history.hotspots(changes.groupBy("path").agg(F.count(F.lit(1)).alias("touches")), rated, settings.history),
                "history_coverage": history.coverage(changes), "history_status": status}
    return out


def aliases(spark: SparkSession, root: str, excludes: tuple[str, ...] = ()) -> DataFrame | None:
    """Alias rules of every script configuration of the tree; one that cannot be read gives none."""
    rules = []
    for kind, p in inventory.walk(root, excludes):
        if kind == "file" and os.path.basename(p) in ("tsconfig.json", "jsconfig.json"):
            try:
                rules += config.alias_rules(root, p)
            except ValueError:
                continue
    return spark.createDataFrame(rules, "package string, prefix string, suffix string, replacement string") if rules else None


def gate_rows(units: DataFrame) -> DataFrame:
    return ratings.gate_snapshot(units)


def gate(spark: SparkSession, root: str, path: str, update: bool = False) -> tuple[int, DataFrame | None]:
    """Exit code and comparison: 0 without a regression, 3 with one, 2 for a baseline that breaks its format."""
    observed = analyze(spark, root)["gate"]
    if update:
        baseline.write(observed, path)
        return 0, None
    try:
        before = baseline.read(spark, path)
    except ValueError:
        return 2, None
    compared = diff.gate(before, observed)
    return (3 if compared.where("outcome = 'regression'").take(1) else 0), compared


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as JSON lines in a folder of its own, and a head with the verdict."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    with open(os.path.join(folder, "report.json"), "w") as f:
        rows = [r.asDict() for r in tables["verdict"].collect()]
        json.dump({"schema_version": 4, "tiers": TIERS, "verdict": rows, "tables": sorted(tables)}, f, sort_keys=True)
