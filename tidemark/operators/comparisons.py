"""Facts of two snapshots or of incomplete evidence: reach, core, leakage and coupling that moved; dormancy; withheld facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_entry
from ..policy import GraphPolicy
from .graph import closure


def package_closures(edges: DataFrame, members: DataFrame, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """Per package of a stated number of files: the file that most of them depend on (itself counted; of several the
    smallest). members: node, package. Only edges inside the admitted packages are closed."""
    size = members.groupBy("package").agg(F.count(F.lit(1)).alias("files")).where(
        (F.col("files") >= policy.closure_min) & (F.col("files") <= policy.closure_max))
    m = members.join(size, "package")
    inside = (edges.join(m.select(F.col("node").alias("src"), "package"), "src")
              .join(m.select(F.col("node").alias("dst"), F.col("package").alias("other")), "dst").where("package = other"))
    reach = closure(inside.select("src", "dst")).where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    every = m.join(reach, "node", "left").select("package", "files", "node", (F.coalesce("n", F.lit(0)) + 1).alias("reach"))
    best = F.max(F.struct("reach", (-F.col("node")).alias("order")))
    return every.groupBy("package", "files").agg(best.alias("b")).select(
        "package", "files", (-F.col("b.order")).alias("node"), F.col("b.reach").alias("reach"))


def fraction_movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """subject, part, whole of both sides -> the direction of part / whole, by cross products."""
    b = before.select("subject", F.col("part").alias("part_b"), F.col("whole").alias("whole_b"))
    a = after.select("subject", F.col("part").alias("part_a"), F.col("whole").alias("whole_a"))
    left, right = F.col("part_a") * F.col("whole_b"), F.col("part_b") * F.col("whole_a")
    kind = (F.when(F.col("part_b").isNull(), "introduced").when(F.col("part_a").isNull(), "dissolved")
            .when(left > right, "worse").when(left < right, "better").otherwise("unchanged"))
    return b.join(a, "subject", "full_outer").select("subject", kind.alias("movement"), "part_b", "whole_b", "part_a", "whole_a")


def key_movement(before: DataFrame, after: DataFrame, *keys) -> DataFrame:
    """Symmetric difference of two sets of findings."""
    gone = before.select(*keys).distinct().join(after.select(*keys).distinct(), list(keys), "left_anti")
    new = after.select(*keys).distinct().join(before.select(*keys).distinct(), list(keys), "left_anti")
    return gone.withColumn("movement", F.lit("removed")).union(new.withColumn("movement", F.lit("introduced")))


def explanation_flips(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Coupled pairs (left, right) whose explanation by an edge (src, dst) came or went."""
    side = lambda e, name: e.select(F.least("src", "dst").alias("left"), F.greatest("src", "dst").alias("right"),
                                    F.lit(True).alias(name)).distinct()
    j = pairs.join(side(before, "b"), ["left", "right"], "left").join(side(after, "a"), ["left", "right"], "left")
    b, a = F.coalesce("b", F.lit(False)), F.coalesce("a", F.lit(False))
    return j.where(b != a).select("left", "right", F.when(b, "introduced").otherwise("dissolved").alias("movement"))


def dormant(files: DataFrame, imported: DataFrame, declared: DataFrame, touched: DataFrame, complete_history: bool = True) -> DataFrame:
    """Runtime scripts without module syntax that nothing imports, declares or touches; none without history.

    files: path, language, module_syntax; the others: path.
    """
    f = files.where(F.col("language").isin("javascript", "jsx") & ~F.col("module_syntax") & ~is_entry(F.col("path"))).select("path")
    if not complete_history:
        return f.limit(0)
    for other in (imported, declared, touched):
        f = f.join(other.select("path").distinct(), "path", "left_anti")
    return f


def incomplete_packages(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Packages whose graph is not complete: an untrusted primary file, or an internal reference without one answer."""
    bad = files.where("role = 'primary' AND trust <> 'trusted'").select("package")
    lost = outcomes.where("outcome IN ('unresolved', 'ambiguous')").select("package")
    return bad.union(lost).distinct()


def withheld(facts: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Facts per package split into stated and withheld."""
    j = facts.join(incomplete.withColumn("gap", F.lit(True)), "package", "left")
    gap = F.col("gap").isNotNull()
    return j.groupBy("package").agg(F.sum((~gap).cast("long")).alias("stated"), F.sum(gap.cast("long")).alias("withheld"))


def screen(rows: DataFrame, order: list, top: int) -> DataFrame:
    """The first ``top`` rows, the first of each direction before all others. rows: direction and the order's columns."""
    per = Window.partitionBy("direction").orderBy(*order)
    # Only the first rows of each direction can be shown, so no more of them reach the last sort.
    head = rows.withColumn("nth", F.row_number().over(per)).where(F.col("nth") <= top)
    lead = (F.col("nth") > 1).cast("int")
    return head.withColumn("lead", lead).orderBy("lead", *order).limit(top).withColumn(
        "place", F.row_number().over(Window.orderBy("lead", *order)).cast("long"))


def suppressed(facts: DataFrame, current: DataFrame, base: DataFrame) -> DataFrame:
    """By kind, comparisons (kind, package) that are withheld as a side's graph is not complete: in all, for the current
    side, for the base side (both may hold)."""
    mark = lambda d, n: d.select("package").distinct().withColumn(n, F.lit(True))
    j = facts.join(mark(current, "c"), "package", "left").join(mark(base, "b"), "package", "left")
    c, b = F.col("c").isNotNull(), F.col("b").isNotNull()
    n = lambda x: F.sum(x.cast("long"))
    return j.groupBy("kind").agg(n(c | b).alias("total"), n(c).alias("current"), n(b).alias("base"))
