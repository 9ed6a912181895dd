"""Change history: churn, ownership, co-change, amplification, hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import VERDICT_ROLES, HistoryPolicy
from ..shared import written

ROLE_ORDER = ("primary", "test", "example", "benchmark", "fixture", "generated", "vendored", "dormant")


def window(changes: DataFrame, now: Column, days: int) -> DataFrame:
    """The trailing window, its first second included."""
    return changes.where(F.col("ts") >= now - F.make_interval(days=F.lit(days)))


def churn(changes: DataFrame, *keys) -> DataFrame:
    """Lines added and deleted, changes without counts, distinct commits."""
    unknown = F.col("added").isNull() | F.col("deleted").isNull()
    return changes.groupBy(*keys).agg(
        F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"),
        F.sum(unknown.cast("long")).alias("uncounted"), F.countDistinct("commit").alias("commits"))


def ownership(changes: DataFrame, *keys) -> DataFrame:
    """Contributors, commits of the top contributor and all commits, each commit once per group."""
    per = (changes.select(*keys, "commit", "contributor").distinct()
           .groupBy(*keys, "contributor").agg(F.count(F.lit(1)).alias("n")))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("contributors"), F.max("n").alias("top_commits"),
                                  F.sum("n").alias("commits"))


def concentration(owned: DataFrame, policy: HistoryPolicy = HistoryPolicy()) -> DataFrame:
    return owned.where((F.col("commits") >= policy.concentration_total)
                       & (F.col("top_commits") * 100 >= F.col("commits") * policy.concentration_percent))


def _pairs(members: DataFrame, name: str, keep: Column | None = None) -> DataFrame:
    """Unordered pairs of members (commit, name) that share commits, with touches of either side."""
    a = members.select("commit", F.col(name).alias("left"))
    b = members.select("commit", F.col(name).alias("right"))
    shared = a.join(b, "commit").where("left < right")
    if keep is not None:
        shared = shared.where(keep)
    shared = shared.groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared"))
    touch = members.groupBy(name).agg(F.count(F.lit(1)).alias("touches"))
    return (shared.join(touch.select(F.col(name).alias("left"), F.col("touches").alias("touch_left")), "left")
            .join(touch.select(F.col(name).alias("right"), F.col("touches").alias("touch_right")), "right")
            .withColumn("union", F.col("touch_left") + F.col("touch_right") - F.col("shared")))


def contains(outer: Column, inner: Column) -> Column:
    """Whether a package holds another; the root holds every one."""
    return (outer == ".") | (inner == outer) | F.startswith(inner, F.concat(outer, F.lit("/")))


def package_coupling(changes: DataFrame, policy: HistoryPolicy = HistoryPolicy()) -> DataFrame:
    """Packages that change together; a package never pairs with one inside it."""
    members = changes.select("commit", "package").distinct()
    apart = ~contains(F.col("left"), F.col("right")) & ~contains(F.col("right"), F.col("left"))
    return _pairs(members, "package", apart).where(F.col("shared") >= policy.package_shared)


def unexplained(pairs: DataFrame, explained: DataFrame, policy: HistoryPolicy = HistoryPolicy()) -> DataFrame:
    """Coupled packages with no dependency either way (explained: src, dst)."""
    known = explained.select(F.least("src", "dst").alias("left"), F.greatest("src", "dst").alias("right")).distinct()
    return pairs.where((F.col("shared") >= policy.finding_shared)
                       & (F.col("shared") * 100 >= F.col("union") * policy.finding_percent)).join(
        known, ["left", "right"], "left_anti")


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def distance(a: Column, b: Column) -> Column:
    """Steps between two directories through their nearest common one."""
    x = F.when(a == ".", F.array().cast("array<string>")).otherwise(F.split(a, "/"))
    y = F.when(b == ".", F.array().cast("array<string>")).otherwise(F.split(b, "/"))
    # Length of the common prefix: the first place where they differ.
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))),
                       F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                       lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")),
                       lambda s: s["n"])
    return (F.size(x) + F.size(y) - 2 * same).cast("long")


def file_coupling(changes: DataFrame, policy: HistoryPolicy = HistoryPolicy()) -> DataFrame:
    """Files of different directories that change together. Bulk commits are left out with their touches, which also
    bounds what one commit can add to the pairs."""
    graph = changes.where((F.col("role") == "primary") & (F.col("trust") == "trusted"))
    # Ranked by commit, files that occur again share a rank: rows that are dealt by commit need no other shuffle. The list ends
    # one file beyond the bound, so a bulk commit is never gathered.
    nth = F.dense_rank().over(Window.partitionBy("commit").orderBy("path"))
    lists = (graph.select("commit", "path").withColumn("nth", nth).where(F.col("nth") <= policy.bulk_files + 1).groupBy("commit")
             .agg(F.sort_array(F.collect_set("path")).alias("files")).where(F.size("files") <= policy.bulk_files).select("files"))
    lists = written(lists, "commits")
    touch = lists.select(F.explode("files").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("touches"))
    two = F.flatten(F.transform("files", lambda x, i: F.transform(F.slice("files", i + 2, F.size("files")), lambda y: F.struct(x.alias("left"), y.alias("right")))))
    shared = (lists.where("size(files) > 1").select(F.explode(two).alias("p")).select("p.left", "p.right")
              .where(directory(F.col("left")) != directory(F.col("right"))).groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared")))
    p = (shared.where(F.col("shared") >= policy.file_shared)
         .join(touch.select(F.col("path").alias("left"), F.col("touches").alias("touch_left")), "left")
         .join(touch.select(F.col("path").alias("right"), F.col("touches").alias("touch_right")), "right")
         .withColumn("union", F.col("touch_left") + F.col("touch_right") - F.col("shared")))
    return (p.where((F.col("shared") >= policy.file_shared)
                    & (F.col("shared") * 1000 >= F.col("union") * policy.file_permille))
            .withColumn("distance", distance(directory(F.col("left")), directory(F.col("right")))))


def amplification(changes: DataFrame, policy: HistoryPolicy = HistoryPolicy()) -> DataFrame:
    """Per directory (and all above it) the nearest-rank median of the files its commits change, capped."""
    from .ratings import ancestors

    members = changes.where(F.col("role").isin(*VERDICT_ROLES) & (F.col("trust") == "trusted")).select("commit", "path").distinct()
    size = members.groupBy("commit").agg(F.least(F.count(F.lit(1)), F.lit(policy.amplification_cap)).alias("files"))
    dirs = members.select("commit", F.explode(ancestors(directory(F.col("path")))).alias("directory")).distinct()
    return (dirs.join(size, "commit").groupBy("directory")
            .agg(F.count(F.lit(1)).alias("commits"), F.expr("CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY files) AS BIGINT)").alias("median"))
            .where((F.col("commits") >= policy.amplification_commits) & (F.col("median") >= policy.amplification_median)))


def hotspots(touches: DataFrame, rated: DataFrame, policy: HistoryPolicy = HistoryPolicy()) -> DataFrame:
    """Files with assessed units that change often. touches: path, touches; rated: path and health counts."""
    return touches.where(F.col("touches") >= policy.hotspot_touches).join(rated, "path")


def coverage(changes: DataFrame) -> DataFrame:
    """One row of counters over the stream."""
    eligible = F.col("role").isin(*VERDICT_ROLES) & (F.col("trust") == "trusted")
    return changes.agg(
        F.countDistinct("commit").alias("commits"), F.countDistinct(F.when(eligible, F.col("commit"))).alias("eligible_commits"),
        F.count(F.lit(1)).alias("changes"), F.sum(eligible.cast("long")).alias("mapped"), F.sum((~eligible).cast("long")).alias("context"),
        F.sum(F.col("added").isNotNull().cast("long")).alias("textual"), F.sum(F.col("added").isNull().cast("long")).alias("uncounted"))


def concentration_movement(before: DataFrame, after: DataFrame, *keys) -> DataFrame:
    """Findings that were introduced or dissolved."""
    b, a = before.select(*keys, F.lit(1).alias("b")), after.select(*keys, F.lit(1).alias("a"))
    return b.join(a, list(keys), "full_outer").where("a IS NULL OR b IS NULL").select(
        *keys, F.when(F.col("b").isNull(), "introduced").otherwise("dissolved").alias("movement"))


def base_side(changes: DataFrame) -> DataFrame:
    """The changes of the base: without the commits that the change under review made itself."""
    return changes.where(~F.coalesce("made_by_change", F.lit(False)))


def filled_churn(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Churn of every file (path, role, trust), zero where nothing changed it."""
    c = churn(changes, "path", "role", "trust")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return files.select("path", "role", "trust").join(c, ["path", "role", "trust"], "left").select(
        "path", "role", "trust", *[zero(n) for n in ("added", "deleted", "uncounted", "commits")])


def stream_counters(changes: DataFrame, start: Column, policy: HistoryPolicy = HistoryPolicy()) -> DataFrame:
    """One row over the stream (commit, ts, path, role, trust, previous_path): commits in the window and before it, newest and
    oldest time, renames, bulk commits, and pairs that were declined (none: pairs are spilled, not limited)."""
    inside = F.col("ts") >= start
    per = changes.groupBy("commit").agg(F.max("ts").alias("ts"), F.countDistinct(F.when(
        (F.col("role") == "primary") & (F.col("trust") == "trusted"), F.col("path"))).alias("files"),
        F.sum(F.col("previous_path").isNotNull().cast("long")).alias("renames"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return per.agg(n(inside).alias("streamed"), n(~inside).alias("excluded"), F.max(F.when(inside, F.col("ts"))).alias("newest"),
                   F.min(F.when(inside, F.col("ts"))).alias("oldest"), F.coalesce(F.sum(F.when(inside, F.col("renames"))), F.lit(0)).alias("renames"),
                   n(inside & (F.col("files") > policy.bulk_files)).alias("bulk"), F.lit(0).cast("long").alias("declined_pairs"))


def pair_evidence(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (left, right) with the least role and trust that either package showed in a commit that both changed: the
    strongest evidence there is of each side. Roles rank as in ROLE_ORDER, trusted before advisory."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), F.col("role")).cast("int") * 2 + (F.col("trust") != "trusted").cast("int")
    best = changes.groupBy("commit", "package").agg(F.min(rank).alias("rank"))
    side = lambda n: best.select("commit", F.col("package").alias(n), F.col("rank").alias(f"rank_{n}"))
    both = side("left").join(side("right"), "commit").where("left < right").groupBy("left", "right").agg(
        F.min("rank_left").alias("l"), F.min("rank_right").alias("r"))
    name = lambda c: F.concat_ws("/", F.get(F.array(*[F.lit(r) for r in ROLE_ORDER]), F.floor(F.col(c) / 2).cast("int") - 1),
                                 F.when(F.col(c) % 2 == 0, "trusted").otherwise("advisory"))
    return pairs.join(both, ["left", "right"]).select(*[F.col(f"`{c}`") for c in pairs.columns], name("l").alias("evidence_left"), name("r").alias("evidence_right"))
