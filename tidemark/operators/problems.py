"""Problem cards: every file joins at most one card, detectors claim in a fixed order, cards are ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..policy import ProblemPolicy

#: Class order of the patterns; file detectors claim in the order of DETECTORS.
PATTERNS = ("tangle", "god_file", "hub", "hot_mess", "shotgun_pair", "bus_risk", "unstable_dependency", "measured",
            "leaky_interface", "hidden_coupling")
DETECTORS = ("god_file", "hub", "hot_mess", "measured", "leaky_interface")


def file_cards(facts: DataFrame, policy: ProblemPolicy = ProblemPolicy()) -> DataFrame:
    """path, pattern, rating: the first detector that a file satisfies.

    facts: path, high, watch, findings, sizes, fan_in, fan_out, median_in, median_out, reach (null: not stated), hot,
    followers. All of a file's facts stand in one row, so claiming is a CASE and not a second pass.
    """
    out = lambda degree, median: (F.col(degree) >= policy.hub_degree) & (
        (F.col(median) == 0) | (F.col(degree) >= F.col(median) * policy.hub_factor))
    concentrated = (F.col("high") >= policy.god_highs) | ((F.col("high") >= 1) & (F.col("high") + F.col("watch") >= policy.god_debt))
    god = concentrated & ((F.col("sizes") > 0) | (F.col("fan_out") >= policy.god_fan_out))
    stands = out("fan_in", "median_in") | out("fan_out", "median_out") | F.coalesce(F.col("reach") >= policy.hub_degree, F.lit(False))
    corroborated = F.col("hot") | (F.col("followers") > 0)
    hub = stands & ((F.col("high") + F.col("watch") == 0) | corroborated)
    pattern = (F.when(god, "god_file").when(hub, "hub").when((F.col("high") > 0) & F.col("hot"), "hot_mess")
               .when((F.col("findings") > 0) | (F.col("sizes") > 0), "measured").when(F.col("followers") > 0, "leaky_interface"))
    claimed = F.when(F.col("high") > 0, 2).when((F.col("watch") > 0) | (F.col("sizes") > 0) | (F.col("followers") > 0), 1).otherwise(0)
    cards = facts.withColumn("pattern", pattern).where("pattern IS NOT NULL")
    return cards.withColumn("rating", F.when(F.col("pattern").isin("god_file", "hot_mess"), 2).otherwise(claimed).cast("long"))


def rank(cards: DataFrame, top: int) -> DataFrame:
    """The first cards of the total order: rating, high claims, hot, claims, pattern class, path."""
    klass = F.array_position(F.array(*[F.lit(p) for p in PATTERNS]), F.col("pattern"))
    order = [F.desc("rating"), F.desc("high"), F.desc("hot"), F.desc(F.col("high") + F.col("watch")), F.asc("klass"), F.asc("path")]
    first = cards.withColumn("klass", klass).orderBy(*order).limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def degree_medians(degree: DataFrame) -> DataFrame:
    """package, median_in, median_out over all files of the package (package, fan_in, fan_out), nearest rank."""
    median = "CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY {}) AS BIGINT)"
    return degree.groupBy("package").agg(F.expr(median.format("fan_in")).alias("median_in"), F.expr(median.format("fan_out")).alias("median_out"))
