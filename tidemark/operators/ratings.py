"""Threshold ratings, health aggregation over the scope hierarchy, tiers and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import SIGNALS, TIERS, VERDICT_ROLES, HealthPolicy, VerdictPolicy


def rating(value: Column, limits: tuple[int, int]) -> Column:
    watch, high = limits
    return F.when(value >= high, 2).when(value >= watch, 1).otherwise(0)


def assess(units: DataFrame, policy: HealthPolicy = HealthPolicy()) -> DataFrame:
    """Each unit's rating, and how many signals stand at it and above healthy."""
    r = {s: rating(F.col(s), policy.limits[s]) for s in SIGNALS}
    out = units.withColumn("rating", F.greatest(*r.values()).cast("long"))
    at = sum((x == F.col("rating")).cast("long") for x in r.values())
    out = out.withColumn("signals_at_rating", at)
    out = out.withColumn("triggered", sum((x > 0).cast("long") for x in r.values()))
    return out.withColumn("affects_verdict", F.col("role").isin(*VERDICT_ROLES) & (F.col("trust") == "trusted"))


def finding_rank(assessed: DataFrame, top: int) -> DataFrame:
    """The first ``top`` findings of the total order. The sort ends at ``top`` rows before they are numbered. hot (BOOLEAN) and
    activity (changes of the file in the window) count where the findings have them."""
    for name, none in (("hot", F.lit(False)), ("activity", F.lit(0))):
        if name not in assessed.columns:
            assessed = assessed.withColumn(name, none)
    role_class = F.when(F.col("role") == "primary", 0).when(F.col("role").isin(*VERDICT_ROLES), 1).otherwise(2)
    order = [F.desc("rating"), F.asc("role_class"), F.desc("hot"), F.desc("signals_at_rating"), F.desc("triggered"), F.desc("cognitive"),
             F.desc("cyclomatic"), F.desc("logical_lines"), F.desc("activity"), F.asc("path"), F.asc("start_line"), F.asc("ordinal"),
             F.desc("max_nesting"), F.desc("parameter_count"), F.asc("trust")]
    first = assessed.where("rating > 0").withColumn("role_class", role_class.cast("long")).orderBy(*order).limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def health_counts(assessed: DataFrame, *keys) -> DataFrame:
    one = lambda k: F.sum((F.col("rating") == k).cast("long"))
    return assessed.groupBy(*keys).agg(one(0).alias("healthy"), one(1).alias("watch"), one(2).alias("high"))


def ancestors(path: Column) -> Column:
    """The path and every scope above it, "." first."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit(".")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def scope_rollup(assessed: DataFrame) -> DataFrame:
    """Health of every scope. Files are counted first, so only one row per file is sent up the hierarchy."""
    files = health_counts(assessed.where("affects_verdict"), "path")
    return (files.select(F.explode(ancestors(F.col("path"))).alias("scope"), "healthy", "watch", "high")
            .groupBy("scope").agg(*[F.sum(c).alias(c) for c in ("healthy", "watch", "high")]))


def tier(checked: Column, watch: Column, high: Column, cycles: Column, policy: VerdictPolicy = VerdictPolicy()) -> Column:
    """Tier number: the density's tier, raised by floors for cycles and for sheer volume."""
    permille = F.expr("CAST(0 AS BIGINT)") if checked is None else F.floor(high * 1000 / F.greatest(checked, F.lit(1)))
    mapped = (F.when(checked == 0, 0).when((high == 0) & (watch == 0), 1).when(high == 0, 2)
              .when((checked < policy.small_units) & (high < policy.small_highs), 3)
              .when(permille <= policy.worn_permille, 3).when(permille <= policy.fights_permille, 4).otherwise(5))
    structure = F.when(cycles >= policy.fights_cycles, 4).when(cycles >= policy.worn_cycles, 3).otherwise(0)
    volume = F.when(high >= policy.lost_highs, 5).when(high >= policy.fights_highs, 4).otherwise(0)
    return F.greatest(mapped, structure, volume)


def scope_tiers(rollup: DataFrame, cycles: Column | int = 0, policy: VerdictPolicy = VerdictPolicy()) -> DataFrame:
    checked = F.col("healthy") + F.col("watch") + F.col("high")
    n = tier(checked, F.col("watch"), F.col("high"), F.lit(cycles) if isinstance(cycles, int) else cycles, policy)
    return rollup.select("scope", checked.alias("checked"), "watch", "high", n.cast("long").alias("tier_rank"),
                         F.element_at(F.array(*[F.lit(t) for t in TIERS]), n.cast("int") + 1).alias("tier"))


def size_findings(files: DataFrame, policy: HealthPolicy = HealthPolicy()) -> DataFrame:
    """path, lines -> files at watch or high; healthy rows are dropped."""
    r = rating(F.col("lines"), policy.file_lines)
    return files.withColumn("rating", r.cast("long")).where("rating > 0")


def container_sizes(units: DataFrame, *keys, policy: HealthPolicy = HealthPolicy()) -> DataFrame:
    """Statements of each container (keys) at watch or high."""
    s = units.groupBy(*keys).agg(F.sum("logical_lines").alias("statements"))
    return s.withColumn("rating", rating(F.col("statements"), policy.container_statements).cast("long")).where("rating > 0")


def coverage(units: DataFrame, *keys) -> DataFrame:
    """Units, verdict units and context units by trust."""
    verdict = F.col("role").isin(*VERDICT_ROLES)
    n = lambda c: F.sum(c.cast("long"))
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("selected"), n(verdict & (F.col("trust") == "trusted")).alias("clean"),
        n(verdict & (F.col("trust") == "advisory")).alias("recovered"), n(~verdict).alias("context"))


def gate_snapshot(assessed: DataFrame) -> DataFrame:
    """Per path and signal the number of high and watch findings; rows without any are left out."""
    limits = HealthPolicy().limits
    kinds = F.array(*[F.struct(F.lit("nesting" if s == "max_nesting" else "parameters" if s == "parameter_count" else s).alias("signal"),
                               rating(F.col(s), limits[s]).alias("r")) for s in SIGNALS])
    x = assessed.where("affects_verdict").select("path", F.explode(kinds).alias("x")).select("path", "x.signal", "x.r")
    return (x.where("r > 0").groupBy("path", "signal")
            .agg(F.sum((F.col("r") == 2).cast("long")).alias("high"), F.sum((F.col("r") == 1).cast("long")).alias("watch")))


#: Classes of selected files in the order in which they are asked.
COVERAGE = ("unsupported", "failed", "context", "recovered", "clean")


def file_coverage(files: DataFrame, *keys) -> DataFrame:
    """Files, lines and bytes (role, trust, parse_status, lines, bytes) of each class: not supported, not parsed, outside the
    verdict's roles, recovered, clean; and of all."""
    verdict = F.col("role").isin(*VERDICT_ROLES)
    kind = (F.when(F.col("parse_status") == "unsupported", "unsupported").when(F.col("parse_status") == "failed", "failed")
            .when(~verdict, "context").when(F.col("parse_status") == "recovered", "recovered").otherwise("clean"))
    f = files.withColumn("class", kind)
    total = lambda c, k: F.coalesce(F.sum(F.when(F.col("class") == k, c)), F.lit(0)).cast("long")
    what = {"files": F.lit(1), "lines": F.coalesce("lines", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))}
    return f.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(f"selected_{n}") for n, c in what.items()],
                                *[total(c, k).alias(f"{k}_{n}") for k in COVERAGE for n, c in what.items()])


def whole_gate_snapshot(assessed: DataFrame, **findings: DataFrame) -> DataFrame:
    """The gate's rows of units and of other findings: by signal (file_size, container_size, file_cycle, package_cycle,
    stable_dependency) a table of path and rating; cycles and dependencies go by the path of their witness."""
    out = gate_snapshot(assessed)
    for signal, rows in findings.items():
        out = out.union(rows.where("rating > 0").groupBy("path").agg(
            F.sum((F.col("rating") == 2).cast("long")).alias("high"), F.sum((F.col("rating") == 1).cast("long")).alias("watch"))
            .select("path", F.lit(signal).alias("signal"), "high", "watch"))
    return out
