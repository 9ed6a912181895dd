"""Two snapshots: unit matching by ordered unique-key passes, ratings that moved, cycles, and the ratchet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import SIGNALS
from ..shared import written


def match_pass(before: DataFrame, after: DataFrame, *keys) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of units whose key occurs once on each side, and what is left of either side.

    Both sides have uid (unique) and the key columns; a null key never matches. Keys are counted before they are
    joined, so a key that occurs very often makes one row.
    """
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    one = lambda d, name: (d.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias(name))
                           .where("n = 1").drop("n"))
    pairs = written(one(before, "before_uid").join(one(after, "after_uid"), list(keys)).select("before_uid", "after_uid"), "pairs")
    rest_b = before.join(pairs.select(F.col("before_uid").alias("uid")), "uid", "left_anti")
    rest_a = after.join(pairs.select(F.col("after_uid").alias("uid")), "uid", "left_anti")
    return pairs, rest_b, rest_a


def contests(before: DataFrame, after: DataFrame, *keys) -> DataFrame:
    """Keys on both sides of which one side has several units: one ambiguous row each."""
    n = lambda d, name: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return n(before.where(known), "n_before").join(n(after.where(known), "n_after"), list(keys)).where("n_before > 1 OR n_after > 1")


def match_units(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs (before_uid, after_uid, pass): declared identity, anchor and fingerprint inside a file, then declared
    identity and fingerprint across files. Units of contested declared names take no further part; those of a contested
    anchor wait for the fingerprint if every one of them has one.

    Columns: uid, path, declared, anchor, fingerprint.
    """
    found = None
    for name, keys in (("declared", ("path", "declared")), ("anchor", ("path", "anchor")), ("fingerprint", ("path", "fingerprint")),
                       ("moved_declared", ("declared",)), ("moved_fingerprint", ("fingerprint",))):
        pairs, before, after = match_pass(before, after, *keys)
        if name in ("declared", "anchor"):
            torn = contests(before, after, *keys)
            if name == "anchor":
                bare = before.union(after).where("fingerprint IS NULL").select(*keys).distinct()
                torn = torn.join(bare, list(keys), "left_semi")
            torn = written(torn.select(*keys), "torn")
            before = before.join(torn, list(keys), "left_anti")
            after = after.join(torn, list(keys), "left_anti")
        before, after = written(before, "before"), written(after, "after")
        pairs = pairs.withColumn("pass", F.lit(name))
        found = pairs if found is None else found.union(pairs)
    return found


def one_sided(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Rows of either side with ``withheld``: of the anonymous units of one kind and rating in one file, as many of each
    side as the smaller side has may be the same units rewritten and are withheld. Columns: uid, path, kind, rating, anonymous."""
    keys = ["path", "kind", "rating"]
    n = lambda d, name: d.where("anonymous").groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = n(removed, "n_removed").join(n(added, "n_added"), keys).select(*keys, F.least("n_removed", "n_added").alias("budget"))
    every = removed.withColumn("comparison", F.lit("removed")).unionByName(added.withColumn("comparison", F.lit("added")))
    nth = F.row_number().over(Window.partitionBy("comparison", "anonymous", *keys).orderBy("uid"))
    j = every.withColumn("nth", nth).join(both, keys, "left")
    return j.select("uid", *keys, "comparison", (F.col("anonymous") & (F.col("nth") <= F.coalesce("budget", F.lit(0)))).alias("withheld"))


def pair_kind(rating_before: Column, rating_after: Column, signals: tuple[str, ...] = SIGNALS) -> Column:
    """How a matched unit moved; its signals are the columns <signal>_before and <signal>_after."""
    up = F.greatest(*[F.col(f"{s}_after") > F.col(f"{s}_before") for s in signals])
    down = F.greatest(*[F.col(f"{s}_after") < F.col(f"{s}_before") for s in signals])
    return (F.when(rating_after > rating_before, "regressed").when(rating_after < rating_before, "improved")
            .when(~up & ~down, "unchanged").when(rating_before == 0, "metric_changed")
            .when(up & ~down, "regressed").when(down & ~up, "improved").otherwise("metric_changed"))


def direction(kind: Column, rating: Column) -> Column:
    return (F.when(kind == "regressed", "worse").when(kind == "improved", "better")
            .when((kind == "added") & (rating > 0), "worse").when((kind == "removed") & (rating > 0), "better").otherwise("changed"))


def debt_tier(counts: DataFrame) -> Column:
    """The tier of a change from its counts of worse, better and changed rows."""
    return (F.when((F.col("worse") > 0) & (F.col("better") > 0), "mixed").when(F.col("worse") > 0, "worse")
            .when(F.col("better") > 0, "better").when(F.col("changed") > 0, "changed").otherwise("no_debt_change"))


def gate(baseline: DataFrame, observed: DataFrame) -> DataFrame:
    """Per path and signal: a regression if either counter rose, an improvement if one fell. Both: path, signal, high, watch."""
    b = baseline.select("path", "signal", F.col("high").alias("high_b"), F.col("watch").alias("watch_b"))
    o = observed.select("path", "signal", F.col("high").alias("high_o"), F.col("watch").alias("watch_o"))
    j = b.join(o, ["path", "signal"], "full_outer").select(
        "path", "signal", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("high_b", "watch_b", "high_o", "watch_o")])
    worse = (F.col("high_o") > F.col("high_b")) | (F.col("watch_o") > F.col("watch_b"))
    better = (F.col("high_o") < F.col("high_b")) | (F.col("watch_o") < F.col("watch_b"))
    return j.withColumn("outcome", F.when(worse, "regression").when(better, "improvement").otherwise("unchanged"))


def gate_moves(compared: DataFrame) -> DataFrame:
    """Hints that a row moved: counts that left one path and came up at one other, unique for a signal on both sides."""
    gone = compared.where("high_o = 0 AND watch_o = 0 AND (high_b > 0 OR watch_b > 0)").groupBy(
        "signal", F.col("high_b").alias("high"), F.col("watch_b").alias("watch")).agg(
            F.count(F.lit(1)).alias("n"), F.min("path").alias("from_path")).where("n = 1").drop("n")
    came = compared.where("high_b = 0 AND watch_b = 0 AND (high_o > 0 OR watch_o > 0)").groupBy(
        "signal", F.col("high_o").alias("high"), F.col("watch_o").alias("watch")).agg(
            F.count(F.lit(1)).alias("n"), F.min("path").alias("to_path")).where("n = 1").drop("n")
    return gone.join(came, ["signal", "high", "watch"])


def cycle_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cycles (component, members) that share no member with one of the other side. Members are joined, not the lists."""
    b = before.select("component", F.explode("members").alias("node"))
    a = after.select("component", F.explode("members").alias("node"))
    gone = before.join(b.join(a.select("node"), "node", "left_semi").select("component").distinct(), "component", "left_anti")
    new = after.join(a.join(b.select("node"), "node", "left_semi").select("component").distinct(), "component", "left_anti")
    return gone.select("component", "size", F.lit("removed").alias("kind")).union(new.select("component", "size", F.lit("added").alias("kind")))
