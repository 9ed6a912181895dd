"""Eligibility of files and edges, the graphs that edges may enter, and what is stated of them only with whole evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import VERDICT_ROLES, GraphPolicy
from .graph import cycles


def health_eligible(role: Column, parse_status: Column) -> Column:
    """Counts towards health: a verdict role, and a source that was parsed exactly. Trust asks more and is another question."""
    return role.isin(*VERDICT_ROLES) & (parse_status == "parsed")


def edge_role(role: Column, test_scope: Column) -> Column:
    """The role of one reference: in test scope a primary file's reference counts as a test's."""
    return F.when(F.coalesce(test_scope, F.lit(False)) & (role == "primary"), "test").otherwise(role)


def edge_eligibility(edges: DataFrame) -> DataFrame:
    """edges (relation, role, trust) with affects_verdict and enters_graph."""
    affects = (F.col("relation") == "uses") & F.col("role").isin(*VERDICT_ROLES) & (F.col("trust") == "trusted")
    return edges.withColumn("affects_verdict", affects).withColumn("enters_graph", affects & (F.col("role") == "primary"))


def cycle_graph(edges: DataFrame) -> DataFrame:
    """src, dst of edges that enter the graph, without pairs that one of the two files owns as a module, whichever way."""
    pair = lambda e: e.select("src", "dst", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"))
    owned = pair(edges.where("relation = 'ownership'")).select("low", "high").distinct()
    uses = pair(edge_eligibility(edges).where("enters_graph"))
    return uses.join(owned, ["low", "high"], "left_anti").select("src", "dst").distinct()


def connection_graph(edges: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst of uses and ownership between files (node, role, trust) that are primary and trusted."""
    ok = files.where("role = 'primary' AND trust = 'trusted'").select("node")
    e = edges.where("relation IN ('uses', 'ownership')").select("src", "dst").distinct()
    return e.join(ok.withColumnRenamed("node", "src"), "src", "left_semi").join(ok.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def file_cycles(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Cycles of files that lie in one package: component, size, package. Those across packages are the packages' cycles."""
    c = cycles(edges).select("component", "size", F.explode("members").alias("node")).join(files.select("node", "package"), "node")
    return (c.groupBy("component", "size").agg(F.min("package").alias("package"), F.max("package").alias("other"))
            .where("package = other").select("component", "size", "package"))


def reach_statements(reach: DataFrame, total: int, packages: bool, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """Reach rows (reach) that are worth stating: of packages where there are three and two of them are reached, of files
    where there are ``reach_total``."""
    if packages:
        return reach.where((F.lit(total) >= policy.package_total) & (F.col("reach") >= policy.package_reached))
    return reach.where(F.lit(total) >= policy.reach_total)


def exact_reach(files: DataFrame, reach: DataFrame, closures: DataFrame, incomplete: DataFrame) -> DataFrame:
    """node, reach of files (node, package) whose package is complete: the file's own row (node, reach), else its package
    closure's (node, reach, itself counted); nothing where that is zero."""
    r = reach.select("node", F.col("reach").alias("own"))
    c = closures.select("node", (F.col("reach") - 1).alias("inside"))
    return (files.join(incomplete.select("package").distinct(), "package", "left_anti").join(r, "node", "left").join(c, "node", "left")
            .select("node", F.coalesce("own", "inside").alias("reach")).where("reach > 0"))


def explanations(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """Pairs of packages (left < right) that an edge (from_package, to_package) or a manifest (package, needs) explains."""
    pairs = edges.select("from_package", "to_package").union(declared.select("package", "needs"))
    return pairs.where("from_package <> to_package").select(
        F.least("from_package", "to_package").alias("left"), F.greatest("from_package", "to_package").alias("right")).distinct()


def dormant_restated(rows: DataFrame, dormant: DataFrame, sizes: bool = False) -> DataFrame:
    """rows (path, role) with the role of dormant files overwritten; of size findings those of dormant files are dropped."""
    d = dormant.select("path").distinct()
    if sizes:
        return rows.join(d, "path", "left_anti")
    return rows.join(d.withColumn("__dormant", F.lit("dormant")), "path", "left").withColumn(
        "role", F.coalesce("__dormant", "role")).drop("__dormant")


def folded(rows: DataFrame, *keys: str) -> DataFrame:
    """External targets or diagnostics folded by their keys: how often, and the three first lines. Of each key no more than
    three lines are gathered."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("line"))
    first = rows.select(*keys, "line").distinct().withColumn("nth", nth).where("nth <= 3").groupBy(*keys).agg(
        F.sort_array(F.collect_list("line")).alias("locations"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("references")).join(first, list(keys))


def largest_unsupported(files: DataFrame) -> DataFrame:
    """The label that most bytes of unsupported files have; of several the first by name."""
    return (files.groupBy("label").agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
            .orderBy(F.desc("bytes"), "label").limit(1))


def recovery(facts: DataFrame, errors: DataFrame) -> DataFrame:
    """Facts (path, uid, start, end) with in_doubt: an error span (path, start, end) overlaps; an empty span reaches one
    place to either side. A file with errors and without facts is in doubt as a whole (uid null)."""
    wide = errors.select("path", F.when(F.col("start") == F.col("end"), F.greatest(F.col("start") - 1, F.lit(0))).otherwise(F.col("start")).alias("s"),
                         F.when(F.col("start") == F.col("end"), F.col("end") + 1).otherwise(F.col("end")).alias("e"))
    hit = facts.join(wide, "path").where("start < e AND s < end").select("path", "uid").distinct().withColumn("in_doubt", F.lit(True))
    known = facts.select("path", "uid").join(hit, ["path", "uid"], "left").select("path", "uid", F.coalesce("in_doubt", F.lit(False)).alias("in_doubt"))
    empty = errors.select("path").distinct().join(facts.select("path").distinct(), "path", "left_anti").select(
        "path", F.lit(None).cast(facts.schema["uid"].dataType).alias("uid"), F.lit(True).alias("in_doubt"))
    return known.union(empty)


def first_line(text: Column) -> Column:
    """The first line with single blanks and no blank at its ends."""
    return F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), r"[ \t\r\f\x0b]+", " "))


def is_quoted(text: Column) -> Column:
    """One literal between equal quotes, without that quote inside."""
    return text.rlike(r"""^("[^"]*"|'[^']*'|`[^`]*`)\z""")


def core_anchors(before: DataFrame, after: DataFrame, before_graph: DataFrame, after_graph: DataFrame) -> DataFrame:
    """Files (node) by which two cores are compared: the smallest member of both; without one the smallest member of
    either that the other side's graph holds."""
    low = lambda d: d.agg(F.min("node").alias("node"))
    shared = low(before.select("node").intersect(after.select("node")))
    alone = low(before.join(after_graph, "node", "left_semi")).union(low(after.join(before_graph, "node", "left_semi")))
    none = shared.where("node IS NULL").select(F.lit(True).alias("apart"))
    return shared.where("node IS NOT NULL").union(alone.where("node IS NOT NULL").join(none, how="left_semi", on=F.lit(True))).distinct()


def core_comparison(anchors: DataFrame, before: DataFrame, after: DataFrame, n_before: int, n_after: int, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """anchor, sizes of the components (node, component) that hold it on both sides, and the direction of their shares;
    only where one of the two is large enough to state and something changed."""
    def side(c: DataFrame, name: str) -> DataFrame:
        at = c.join(anchors, "node").select(F.col("node").alias("anchor"), "component")
        size = c.groupBy("component").agg(F.count(F.lit(1)).alias(f"{name}_size"), F.bit_xor(F.xxhash64("node")).alias(f"{name}_set"))
        return at.join(size, "component").drop("component")

    j = side(before, "before").join(side(after, "after"), "anchor")
    large = lambda c, n: (F.col(c) >= policy.core_files) & (F.col(c) * 100 >= n * policy.core_percent)
    b, a = F.col("before_size") * n_after, F.col("after_size") * n_before
    changed = (F.col("before_size") != F.col("after_size")) | F.lit(n_before != n_after) | (F.col("before_set") != F.col("after_set"))
    return j.where((large("before_size", n_before) | large("after_size", n_after)) & changed).select(
        "anchor", "before_size", "after_size", F.when(a > b, "worse").when(a < b, "better").otherwise("changed").alias("direction"))


def leakage_stated(rows: DataFrame, files: DataFrame, incomplete: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leakage rows (left, right, kind, distance, shared) whose files' packages are both complete, in their order (rank),
    and how many were withheld by kind. files: path, package."""
    bad = files.join(incomplete.select("package").distinct(), "package", "left_semi").select("path").distinct()
    near = rows.join(bad.select(F.col("path").alias("left"), F.lit(True).alias("gap_left")), "left", "left").join(
        bad.select(F.col("path").alias("right"), F.lit(True).alias("gap_right")), "right", "left")
    gap = F.col("gap_left").isNotNull() | F.col("gap_right").isNotNull()
    order = Window.partitionBy("kind").orderBy(F.desc("distance"), F.desc("shared"), "left", "right")
    stated = near.where(~gap).drop("gap_left", "gap_right").withColumn("rank", F.row_number().over(order).cast("long"))
    return stated, near.where(gap).groupBy("kind").agg(F.count(F.lit(1)).alias("withheld"))


def participation(rows: DataFrame) -> DataFrame:
    """Compared units (role_before, role_after, unpaired_anonymous) with their part: verdict only if every known role is a
    verdict role, context where a unit without a name found no partner."""
    ok = lambda c: F.col(c).isNull() | F.col(c).isin(*VERDICT_ROLES)
    return rows.withColumn("participation", F.when(F.col("unpaired_anonymous"), "context").when(
        ok("role_before") & ok("role_after"), "verdict").otherwise("context"))


def sufficiency(coverage: DataFrame) -> DataFrame:
    """From the coverage of a history (complete, eligible_commits, mapped, rename_gaps): what it suffices for."""
    enough = F.col("complete") & (F.col("eligible_commits") > 0) & (F.col("mapped") > 0)
    return coverage.select("*", enough.alias("findings"), (enough & (F.col("rename_gaps") == 0)).alias("comparisons"),
                           F.col("complete").alias("amplification"))
