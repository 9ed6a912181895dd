"""Co-change held against the dependency graph: change leakage and link classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_wiring
from ..policy import LeakagePolicy
from ..shared import written
from .graph import components


def leakage(pairs: DataFrame, imports: DataFrame, connections: DataFrame, files: DataFrame,
            policy: LeakagePolicy = LeakagePolicy()) -> DataFrame:
    """Findings for co-changing pairs (left, right, shared, union, distance).

    A pair with one import either way leaks through the imported file (unless that only wires a module); with both it
    is a cycle; with none it is hidden if the files are proven apart: their components differ and a walk over at most
    ``walk`` files ends in the smaller one. connections: src, dst over admitted files.
    """
    bar = F.greatest(F.lit(policy.bar_floor), F.lit(policy.bar) - F.greatest(F.col("distance") - policy.distance, F.lit(0)) * policy.bar_step)
    p = pairs.where((F.col("distance") >= policy.distance) & (F.col("shared") >= policy.shared)
                    & (F.col("shared") * 1000 >= F.col("union") * bar))
    e = imports.select("src", "dst").distinct()
    p = (p.join(e.select(F.col("src").alias("left"), F.col("dst").alias("right"), F.lit(True).alias("forward")), ["left", "right"], "left")
         .join(e.select(F.col("src").alias("right"), F.col("dst").alias("left"), F.lit(True).alias("backward")), ["left", "right"], "left"))
    c = written(components(connections, files.select(F.col("path").alias("node"))), "components")
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    c = c.join(size, "component")
    p = (p.join(c.select(F.col("node").alias("left"), F.col("component").alias("cl"), F.col("n").alias("nl")), "left")
         .join(c.select(F.col("node").alias("right"), F.col("component").alias("cr"), F.col("n").alias("nr")), "right"))
    f, b = F.coalesce("forward", F.lit(False)), F.coalesce("backward", F.lit(False))
    interface = F.when(f & ~b, F.col("right")).when(b & ~f, F.col("left"))
    kind = (F.when(f & b, None).when(f | b, F.when(~is_wiring(interface), "leaky_interface"))
            .when((F.col("cl") != F.col("cr")) & (F.least("nl", "nr") <= policy.walk), "hidden_coupling"))
    return p.select("left", "right", "shared", "union", "distance", kind.alias("kind"), interface.alias("interface")).where("kind IS NOT NULL")


def link_class(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """left, right, link, steps, first_hop of each pair of nodes: direct, indirect (by the shortest path either way, forward
    unless backward is shorter, named by its first hop, of several paths the smallest) or none. A search from the pairs'
    ends that goes on until nothing new is found, whatever the length of the path."""
    e = written(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    ends = pairs.select(F.col("left").alias("from")).union(pairs.select("right")).distinct()
    frontier = written(ends.join(e, ends["from"] == e.src).select("from", F.col("dst").alias("at"), F.col("dst").alias("hop")), "walk")
    found, n = frontier.withColumn("steps", F.lit(1).cast("long")), 1
    while frontier.take(1):
        n += 1
        new = (frontier.join(e, frontier.at == e.src).where(F.col("dst") != F.col("from")).groupBy("from", F.col("dst").alias("at"))
               .agg(F.min("hop").alias("hop")).join(found, ["from", "at"], "left_anti"))
        frontier = written(new, "walk")
        found = written(found.union(frontier.withColumn("steps", F.lit(n).cast("long"))), "found")
    side = lambda a, b, name: found.select(F.col("from").alias(a), F.col("at").alias(b), F.struct("steps", "hop").alias(name))
    j = pairs.join(side("left", "right", "there"), ["left", "right"], "left").join(side("right", "left", "back"), ["left", "right"], "left")
    best = F.when(F.col("there").isNull() | (F.col("back.steps") < F.col("there.steps")), F.col("back")).otherwise(F.col("there"))
    j = j.withColumn("best", best)
    return j.select("left", "right", F.when(F.col("best.steps") == 1, "direct").when(F.col("best.steps") > 1, "indirect").otherwise("none").alias("link"),
                    F.coalesce("best.steps", F.lit(0)).alias("steps"), F.when(F.col("best.steps") > 1, F.col("best.hop")).alias("first_hop"))
