"""Dependency graphs: degrees, components, cycles, reach. Iterations write each round to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..policy import GraphPolicy
from ..shared import written


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Distinct neighbours either way without loops; nodes without edges (from ``every``) have 0."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(
        e.select("dst", F.lit(0), F.lit(1)))
    d = ends.groupBy("node").agg(F.sum("in").alias("fan_in"), F.sum("out").alias("fan_out"))
    every = nodes(edges) if every is None else every
    return every.join(d, "node", "left").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"),
                                                F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def instability(degree: DataFrame) -> DataFrame:
    """fan_out / (fan_in + fan_out) as numerator and denominator, null where a node stands alone."""
    total = F.col("fan_in") + F.col("fan_out")
    return degree.select("node", F.when(total > 0, F.col("fan_out")).alias("numerator"), F.when(total > 0, total).alias("denominator"))


def stable_violations(edges: DataFrame, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """Edges from a more stable node to a less stable one, compared by cross products."""
    d = degrees(edges).withColumn("total", F.col("fan_in") + F.col("fan_out"))
    s = d.select(F.col("node").alias("src"), F.col("fan_out").alias("out_s"), F.col("total").alias("tot_s"))
    t = d.select(F.col("node").alias("dst"), F.col("fan_out").alias("out_t"), F.col("total").alias("tot_t"))
    return (edges.where(F.col("refs") >= policy.stable_references).join(s, "src").join(t, "dst")
            .where("tot_s > 0 AND tot_t > 0 AND out_t * tot_s > out_s * tot_t").select("src", "dst", "refs"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not its component's smallest node, the root, by alternating
    large-star and small-star rounds.

    Null ends and loops are ignored. Rounds grow with the logarithm of the longest path. Every join is an
    equi-join of two shuffled sides, so a hub with very many edges is split by adaptive skew handling; minima are
    combined before the shuffle. Only a count and a checksum reach the driver.
    """
    e = (edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e = written(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        e = written(small, "small")
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(edges: DataFrame, every: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable in either direction; nodes without edges are their own."""
    roots = star_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return every.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def closure(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """All (src, dst) with a path of at least one edge. A frontier of new pairs is joined with the edges each round."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    reached = frontier = e
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    rounds = 1
    while limit is None or rounds < limit:
        new = (frontier.join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
               .join(reached, ["src", "dst"], "left_anti"))
        frontier = written(new, "frontier")
        if not frontier.take(1):
            break
        reached = written(reached.union(frontier), "reached")
        rounds += 1
    return reached


#: A table of a graph of more nodes is never broadcast: numbers compress so well that Spark takes large tables for small ones, and
#: each of the rounds would send them through the driver.
BROADCAST_NODES = 100_000


def _sized(large: bool) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.hint("merge") if large else d


def _trimmed(e: DataFrame, far: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (written) without those that no cycle can hold: again and again, edges from nodes that nothing leads to and to
    nodes that lead nowhere are left out."""
    n = e.count()
    while n:
        e = written(e.join(far(e.select(F.col("dst").alias("src")).distinct()), "src", "left_semi")
                    .join(far(e.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst"), "trimmed")
        n, before = e.count(), n
        if n == before:
            break
    return e


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) by colouring: nodes that no cycle can hold are components of their own; among the others the largest
    label is spread forwards; from each root the nodes of its colour that reach it are its component; what is left goes round
    again. No transitive closure is built."""
    alone = lambda d: d.select("node", F.col("node").alias("color"))
    every = written(nodes(edges), "nodes")
    far = _sized(every.count() > BROADCAST_NODES)
    e = _trimmed(written(edges.select("src", "dst").where("src <> dst").distinct(), "edges"), far)
    left = written(nodes(e), "left")
    done = written(alone(every.join(far(left), "node", "left_anti")), "alone")
    while left.take(1):
        color = written(left.select("node", F.col("node").alias("color")), "color")
        while True:
            top = e.join(far(color), e.src == color.node).groupBy("dst").agg(F.max("color").alias("top"))
            new = written(color.join(far(top), color.node == top.dst, "left").select(
                "node", F.greatest("color", "top").alias("color"), F.col("color").alias("old")), "color")
            color = new.select("node", "color")
            if not new.where("color <> old").take(1):
                break
        back = e.join(far(color.select(F.col("node").alias("src"), F.col("color").alias("cs"))), "src").join(
            far(color.select(F.col("node").alias("dst"), F.col("color").alias("cd"))), "dst").where("cs = cd")
        back = written(back.select("src", "dst", F.col("cs").alias("color")), "back")
        found = frontier = written(color.where("node = color"), "roots")
        while True:
            new = (back.join(far(frontier.select(F.col("node").alias("dst"), "color")), ["dst", "color"])
                   .select(F.col("src").alias("node"), "color").distinct().join(far(found), "node", "left_anti"))
            frontier = written(new, "frontier")
            if not frontier.take(1):
                break
            found = written(found.union(frontier), "found")
        left = written(left.join(far(found), "node", "left_anti"), "left")
        e = _trimmed(written(e.join(far(left.select(F.col("node").alias("src"))), "src", "left_semi")
                             .join(far(left.select(F.col("node").alias("dst"))), "dst", "left_semi").select("src", "dst"), "edges"), far)
        rest = written(nodes(e), "left")
        done = done.union(found).union(alone(left.join(far(rest), "node", "left_anti")))
        left = rest
    low = done.groupBy("color").agg(F.min("node").alias("component"))
    return done.join(far(low), "color").select("node", "component")


def cycles(edges: DataFrame) -> DataFrame:
    """Strong components of two nodes and more: component, members (sorted), size."""
    return (strong_components(edges).groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"))
            .withColumn("size", F.size("members").cast("long")).where("size > 1"))


def witnesses(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The shortest closed path of each component (of several the smallest as a list): component, path.

    members: node, component of cycles only. A component is one group, as large as the cycle itself.
    """
    inside = (edges.join(members.select(F.col("node").alias("src"), "component"), "src")
              .join(members.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst")
              .where("component = other").select("component", "src", "dst").distinct())

    def shortest(key, rows):
        import pyarrow as pa

        src, dst = rows.column("src").to_pylist(), rows.column("dst").to_pylist()
        out: dict = {}
        for a, b in sorted(zip(src, dst)):
            out.setdefault(a, []).append(b)
        best = None
        for start in sorted(out):
            layer, seen, back = [[start]], {start}, None
            while layer and back is None and (best is None or len(layer[0]) <= len(best)):
                grown = []
                for path in layer:
                    for b in out.get(path[-1], ()):
                        if b == start and back is None:
                            back = path
                        elif b not in seen:
                            seen.add(b)
                            grown.append([*path, b])
                layer = grown
            if back is not None and (best is None or (len(back), back) < (len(best), best)):
                best = back
        return pa.table({"component": [key[0].as_py()], "path": [best]},
                        schema=pa.schema([("component", pa.int64()), ("path", pa.list_(pa.int64()))]))

    return inside.groupBy("component").applyInArrow(shortest, "component long, path array<long>")


def reach_in(edges: DataFrame) -> DataFrame:
    """How many nodes depend on a node, directly or through others, itself included."""
    c = closure(edges).where("src <> dst").groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    return nodes(edges).join(c, F.col("node") == F.col("dst"), "left").select(
        "node", (F.coalesce("n", F.lit(0)) + 1).alias("reach"))


def file_reach(edges: DataFrame, cyclic: DataFrame, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """Exact reach (itself excluded) of cycle members and high-degree nodes, at most ``reach_candidates`` of them by
    fan-in: a reverse search from these sources only."""
    d = degrees(edges)
    picked = d.where((F.col("fan_in") >= policy.reach_degree) | (F.col("fan_out") >= policy.reach_degree)).select("node").union(
        cyclic.select("node")).distinct()
    some = (d.join(picked, "node").orderBy(F.desc("fan_in"), "node").limit(policy.reach_candidates).select("node"))
    back = written(edges.where("src <> dst").select(F.col("dst").alias("at"), F.col("src").alias("next")).distinct(), "back")
    found = frontier = written(some.select("node", F.col("node").alias("at")), "reach")
    while True:
        new = frontier.join(back, "at").select("node", F.col("next").alias("at")).distinct().join(found, ["node", "at"], "left_anti")
        frontier = written(new, "frontier")
        if not frontier.take(1):
            break
        found = written(found.union(frontier), "reach")
    return found.groupBy("node").agg((F.count(F.lit(1)) - 1).alias("reach"))


def core(members: DataFrame, total: int, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """The largest cycle (of several that with the smallest member list) if it is large enough to state."""
    return (members.orderBy(F.desc("size"), "members").limit(1).withColumn("total", F.lit(total).cast("long"))
            .where((F.col("size") >= policy.core_files) & (F.col("size") * 100 >= F.col("total") * policy.core_percent)))


def orphans(files: DataFrame, edges: DataFrame, declared: DataFrame) -> DataFrame:
    """Files (path) that nothing uses and that no manifest or convention declares as entries."""
    from ..functions.paths import is_entry

    return (files.where(~is_entry(F.col("path"))).join(edges.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")
            .join(declared, "path", "left_anti"))


def deduplicated(references: DataFrame, *keys) -> DataFrame:
    """References folded to edges: their number and the first three locations."""
    return references.where("src <> dst").groupBy("src", "dst", *keys).agg(
        F.count(F.lit(1)).alias("references"), F.slice(F.sort_array(F.collect_set("line")), 1, 3).alias("locations"))


def package_edges(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """Edges between packages: file pairs and references. packages: node, package."""
    s = packages.select(F.col("node").alias("src"), F.col("package").alias("from_package"))
    t = packages.select(F.col("node").alias("dst"), F.col("package").alias("to_package"))
    return (edges.join(s, "src").join(t, "dst").where("from_package <> to_package")
            .groupBy("from_package", "to_package").agg(F.count(F.lit(1)).alias("file_pairs"), F.sum("refs").alias("references")))


def relation_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges of one side only or with other counts."""
    b, a = before.withColumnRenamed("refs", "before_refs"), after.withColumnRenamed("refs", "after_refs")
    j = b.join(a, ["src", "dst"], "full_outer")
    kind = F.when(F.col("before_refs").isNull(), "added").when(F.col("after_refs").isNull(), "removed").otherwise("changed")
    return j.where("NOT before_refs <=> after_refs").select("src", "dst", kind.alias("kind"), "before_refs", "after_refs")


def test_demotion(files: DataFrame, declarations: DataFrame) -> DataFrame:
    """Primary files that are declared, and only from test scope or from files that qualify themselves: least fixpoint.

    files: path, role; declarations: owner, path, test BOOLEAN.
    """
    primary = files.where("role = 'primary'").select("path")
    declared = written(declarations.join(primary, "path", "left_semi").select("owner", "path", "test"), "declared")
    found = written(primary.limit(0), "found")
    while True:
        open_ = declared.where("NOT test").join(found.select(F.col("path").alias("owner")), "owner", "left_anti")
        new = declared.select("path").distinct().join(open_, "path", "left_anti").join(found, "path", "left_anti")
        new = written(new, "demoted")
        if not new.take(1):
            return found
        found = written(found.union(new), "found")
