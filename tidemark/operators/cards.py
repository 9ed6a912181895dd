"""Cards of findings that no single file owns, their evidence and visibility, and what a verdict states of a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ratings import ancestors

# The sentences of the tiers, in the order of the tiers, and of the other facts.
TIER_SENTENCES = ("Nothing was checked.", "Clean. Ship it.", "Solid, with rough edges.", "Worn in the usual places.",
                  "This code fights back.", "The code is winning.")
SHARE_SENTENCE = "%d of the repository's %d high live here."
PACKAGES_SENTENCE = "A change in one package can reach %d of %d packages."
FILES_SENTENCE = "A change here can reach %d of %d files in this package."
QUALIFIER_SENTENCE = "Not all source was checked."
#: Slots of a screen, and the numbers of cards it may be spent on.
SCREEN_BUDGET = 24
LADDER = (6, 8, 12, 24)
OFFENDERS = 3


def tangles(cycles: DataFrame, reach: DataFrame, hot: DataFrame) -> DataFrame:
    """One card per cycle (component, size, rating, members in order): anchored on its members, with their number, the
    reach (node, reach) of the first member that has one, and the most touches (node, touches) of its hot members."""
    m = cycles.select("component", F.posexplode("members").alias("place", "node"))
    facts = (m.join(reach.select("node", "reach"), "node", "left").join(hot.select("node", "touches"), "node", "left")
             .groupBy("component").agg(F.min(F.when(F.col("reach").isNotNull(), F.struct("place", "reach"))).alias("first"),
                                       F.max("touches").alias("hot"), F.min("node").alias("anchor")))
    return cycles.select("component", "size", "rating").join(facts, "component").select(
        F.lit("tangle").alias("pattern"), F.col("anchor").cast("string").alias("anchor"), "rating", F.col("size").alias("members"),
        F.col("first.reach").alias("reach"), "hot")


def plain_cards(findings: DataFrame, pattern: str, *anchor: str) -> DataFrame:
    """One card per finding, anchored on a package or a pair of packages."""
    name = F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in anchor])
    none = F.lit(None).cast("long")
    return findings.select(F.lit(pattern).alias("pattern"), name.alias("anchor"), "rating", none.alias("members"), none.alias("reach"), none.alias("hot"))


def hidden_cards(leaks: DataFrame, claimed: DataFrame) -> DataFrame:
    """Cards of hidden couplings (left, right, kind, rating) whose first file no card of a file has claimed (path)."""
    return (leaks.where("kind = 'hidden_coupling'").join(claimed.select(F.col("path").alias("left")).distinct(), "left", "left_anti")
            .select(F.lit("hidden_coupling").alias("pattern"), "left", "right", "rating"))


#: The order in which a card states its evidence.
EVIDENCE = ("top", "pattern", "leakage", "size", "hot", "rest")


def evidence(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """path, rating, visibility, evidence of every file with claims (path, source, id, rank, rating, affects). source is
    finding, size or leakage; findings are stated best rank first. facts: path, text of the pattern, touches (null: not hot)."""
    nth = F.row_number().over(Window.partitionBy("path", "source").orderBy("rank", "id"))
    part = (F.when((F.col("source") == "finding") & (F.col("nth") == 1), 0).when(F.col("source") == "leakage", 2)
            .when(F.col("source") == "size", 3).otherwise(5))
    c = claims.withColumn("nth", nth).select("path", "rating", "source", "affects", part.alias("part"), "nth",
                                             F.concat_ws(":", "source", F.col("id").cast("string")).alias("line"))
    lines = c.select("path", "part", "nth", "line").union(
        facts.select("path", F.lit(1), F.lit(0), "text")).union(
        facts.where("touches IS NOT NULL").select("path", F.lit(4), F.lit(0), F.concat(F.lit("hot:"), F.col("touches").cast("string"))))
    listed = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "nth", "line"))).alias("x"))
    shown = F.max((F.col("affects") | (F.col("source") == "leakage")).cast("int")) == 1
    head = c.groupBy("path").agg(F.max("rating").alias("rating"), F.when(shown, "default").otherwise("detail").alias("visibility"))
    return head.join(listed, "path").select("path", "rating", "visibility", F.transform("x", lambda v: v["line"]).alias("evidence"))


def claim_partition(findings: DataFrame, claims: DataFrame) -> DataFrame:
    """By source: findings (source, id), how many of them one card claims, several claim, none claims; all but the first
    of these must be 0."""
    n = claims.groupBy("source", "id").agg(F.count(F.lit(1)).alias("n"))
    count = lambda c: F.sum(c.cast("long"))
    n_ = F.coalesce("n", F.lit(0))
    return findings.join(n, ["source", "id"], "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("findings"), count(n_ == 1).alias("once"), count(n_ > 1).alias("twice"), count(n_ == 0).alias("missing"))


def scope_problems(cards: DataFrame, every: bool = False) -> DataFrame:
    """scope, path, rank, place: ranked cards of files (path, rank, visibility) in each scope above them. Cards of
    visibility detail are shown in the file's own scope only, unless every card is asked for."""
    up = cards.withColumn("scope", F.explode(ancestors(F.col("path"))))
    shown = up if every else up.where("visibility = 'default' OR scope = path")
    return shown.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy("rank")).cast("long")).select("scope", "path", "rank", "place")


def offenders(cards: DataFrame, limit: int = OFFENDERS) -> DataFrame:
    """The first cards (path, rank, visibility, affects, hot) of each scope that affect its verdict, with the reason. No
    scope's cards are sorted beyond the first ones of each file's parent: a window group holds them in rank order."""
    first = scope_problems(cards.where("affects")).where(F.col("place") <= limit)
    return first.join(cards.select("path", "hot"), "path").select(
        "scope", "path", "place", F.when(F.col("hot"), "hot_and_complex").otherwise("top_ranked_problem").alias("reason"))


def ladder(cards: Column) -> tuple[Column, Column]:
    """How many cards a screen shows of so many, and how many lines of evidence each may have: the first rung that holds
    them all, else the last; a card's head takes one slot."""
    rung = F.lit(LADDER[-1])
    for n in reversed(LADDER):
        rung = F.when(cards <= n, n).otherwise(rung)
    return F.least(cards, rung), F.floor(F.lit(SCREEN_BUDGET) / rung).cast("long") - 1


def scope_amplification(scopes: DataFrame, amplification: DataFrame) -> DataFrame:
    """scopes (scope, kind) with the median of the directory they are: the root for the repository, their own for packages
    and directories, none for files."""
    a = amplification.select(F.col("directory").alias("scope"), "median")
    return scopes.where("kind <> 'file'").join(a, "scope", "left").select("scope", "kind", "median").union(
        scopes.where("kind = 'file'").select("scope", "kind", F.lit(None).cast("long")))


def verdict_facts(scopes: DataFrame, unsupported: DataFrame) -> DataFrame:
    """Of each scope (scope, high, selected, analyzed, selected_bytes, unsupported_bytes): its share of the repository's
    high units (not at the root, nor where the scope is all of it) and the qualifier where not all source was analysed.
    unsupported: label (the largest unsupported language, at most one row)."""
    root = scopes.where("scope = '.'").select(F.col("high").alias("root_high"), F.col("selected").alias("root_selected"))
    s = scopes.crossJoin(F.broadcast(root)).join(F.broadcast(unsupported.select(F.col("label").alias("language"))), how="left", on=F.lit(True))  # one row each
    share = (F.col("scope") != ".") & (F.col("selected") != F.col("root_selected")) & (F.col("root_high") > 0)
    open_ = F.col("analyzed") < F.col("selected")
    permille = F.when(F.col("selected_bytes") > 0, F.expr("unsupported_bytes * 1000 div selected_bytes")).otherwise(0)
    return s.select("scope", F.when(share, F.format_string(SHARE_SENTENCE, "high", "root_high")).alias("share"),
                    F.when(open_, F.lit(QUALIFIER_SENTENCE)).alias("qualifier"), F.when(open_, permille).alias("unsupported_permille"),
                    F.when(open_, F.col("language")).alias("language"))


def tier_sentence(tier_rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in TIER_SENTENCES]), tier_rank.cast("int"))


def gate_document(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The gate's result as JSON lines (value): a head with the totals of outcomes (outcome, n), then the rows in order."""
    head = counts.select(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("totals"))
    cols = [c for c in rows.columns]
    lines = rows.select(F.lit(1).alias("part"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(("path", "signal"))], F.to_json(F.struct(*cols)).alias("value"))
    top = head.select(F.lit(0).alias("part"), F.lit("").alias("k0"), F.lit("").alias("k1"), F.to_json(F.struct(F.lit(1).alias("version"), "totals")).alias("value"))
    return top.union(lines).orderBy("part", "k0", "k1").select("value")
