"""What a change does to a tree: both sides of the changed files, matched, rated and compared."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measure, paths
from ..operators import architecture, diff, graph, ratings, resolution
from ..policy import SIGNALS, HealthPolicy
from ..shared import written
from ..sources import git_base, inventory


def _side(spark: SparkSession, texts: DataFrame, every: DataFrame, health: HealthPolicy) -> tuple[DataFrame, DataFrame]:
    """Rated units of the texts and edges among every file of a side."""
    texts = written(texts, "texts")
    about = texts.select("path", paths.role(F.col("path"), F.lit(None).cast("string"), F.lit(False)).alias("role"))
    status = measure.statuses(texts).select("path", F.when(F.col("parse_status") == "failed", "advisory").otherwise("trusted").alias("trust"))
    units = written(ratings.assess(measure.measure(texts).join(about, "path").join(status, "path"), health), "units")
    refs = written(measure.references(texts).withColumn("ref_id", F.monotonically_increasing_id()), "refs")
    found = refs.join(resolution.language_match(refs, every), "ref_id").where("outcome = 'resolved' AND path <> file")
    return units, written(found.groupBy(F.col("path").alias("src"), F.col("file").alias("dst")).agg(F.count(F.lit(1)).alias("refs")), "edges")


def _keys(units: DataFrame) -> DataFrame:
    """Units with what they are matched by; a name made of a line is none, and anonymous units have their kind alone."""
    named = ~F.startswith("name", F.lit("<"))
    declared = F.when(named, F.concat_ws("\u0001", "kind", F.coalesce("container", F.lit("")), "name"))
    return units.select(F.concat_ws("\u0001", "path", F.col("ordinal").cast("string")).alias("uid"), "path", declared.alias("declared"),
                        F.lit(None).cast("string").alias("anchor"), "fingerprint", (~named).alias("anonymous"), "kind", "role", "rating", "name", *SIGNALS)


def analyze_diff(spark: SparkSession, root: str, base: str | None = None, health: HealthPolicy = HealthPolicy()) -> dict[str, DataFrame]:
    """Tables of a change against the merge base with ``base`` (by default the remote's head, main or master): changed
    files, matched units with their movement, one-sided units, relations and cycles that moved, and the tier of its debt."""
    revision = git_base.merge_base(root, git_base.default_base(root, base))
    changed = git_base.changes(root, revision)
    table = written(git_base.change_table(spark, changed), "changed")
    now_paths = [p for kind, p in inventory.walk(root, ()) if kind == "file"]
    now_files = spark.createDataFrame([(p,) for p in now_paths], "path string")
    rows = []
    for p in now_paths:
        if measure.language_of(p):
            with open(os.path.join(root, p), encoding="utf-8", errors="replace") as f:
                rows.append((p, f.read()))
    current = spark.createDataFrame(rows, "path string, text string")
    old = written(git_base.base_files(spark, root, revision), "base")
    after_all, after_edges = _side(spark, current, now_files, health)
    before_all, before_edges = _side(spark, old.select("path", "text"), old.select("path"), health)
    after = after_all.join(table.where("current_exists").select("path"), "path", "left_semi")
    # The base side of a renamed file goes by the name it has now.
    renamed = table.where("base_exists").select(F.col("base_path").alias("path"), F.col("path").alias("now"))
    before = before_all.join(renamed, "path").withColumn("path", F.col("now")).drop("now")
    b, a = written(_keys(before), "before"), written(_keys(after), "after")
    pairs = written(diff.match_units(*[x.select("uid", "path", "declared", "anchor", "fingerprint") for x in (b, a)]), "pairs")
    side = lambda d, name: d.select(F.col("uid").alias(f"{name}_uid"), *[F.col(c).alias(f"{c}_{name}") for c in ("path", "name", "role", "rating", *SIGNALS)])
    j = pairs.join(side(b, "before"), "before_uid").join(side(a, "after"), "after_uid")
    kind = diff.pair_kind(F.col("rating_before"), F.col("rating_after"), SIGNALS)
    j = j.withColumn("comparison", kind).withColumn("unpaired_anonymous", F.lit(False))
    moved = written(architecture.participation(j), "moved")
    one = lambda d, c: d.join(pairs.select(F.col(c).alias("uid")), "uid", "left_anti").select("uid", "path", "kind", "rating", "anonymous")
    single = diff.one_sided(one(b, "before_uid"), one(a, "after_uid"))
    roles = b.select("uid", "role").union(a.select("uid", "role")).groupBy("uid").agg(F.min("role").alias("role"))
    single = single.join(roles, "uid")
    verdict_role = F.col("role").isin("primary", "test", "example", "benchmark") & ~F.col("withheld") & (F.col("rating") > 0)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    v = moved.where("participation = 'verdict'")
    n1 = v.agg(count(F.col("comparison") == "regressed").alias("worse"), count(F.col("comparison") == "improved").alias("better"),
               count(F.col("comparison") == "metric_changed").alias("changed"))
    n2 = single.where(verdict_role).agg(count(F.col("comparison") == "added").alias("w"), count(F.col("comparison") == "removed").alias("b"))
    tally = n1.crossJoin(n2).select((F.col("worse") + F.col("w")).alias("worse"), (F.col("better") + F.col("b")).alias("better"), "changed")  # one row each
    cycles = [written(graph.cycles(e), "cycles") for e in (before_edges, after_edges)]
    return {"changed_files": table, "unit_comparisons": moved, "one_sided_units": single,
            "relation_comparisons": graph.relation_changes(before_edges, after_edges), "cycle_comparisons": diff.cycle_changes(*cycles),
            "verdict": tally.withColumn("tier", diff.debt_tier(tally)),
            "change_revisions": spark.createDataFrame([(r,) for r in sorted(git_base.commits_ahead(root, revision))], "revision string")}


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
