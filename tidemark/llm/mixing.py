"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

A source's target is its share by weight of all words, never above ``max_repeat`` times its own size; what is above
is shared again by weight among the others until none is above. Every document first gets the whole copies that its
share of its source's target is certain to hold. Shares are unequal: document i is to be taken level * weight_i times on
average, ``max_repeat`` times at most, where the level of a source makes the words add up to its target (documents that
reach the limit are set to it and the level is found anew, until none is above). The weight is an SQL expression over the
columns of the documents and ``size``; by default the root of the size, so that a text of four times the words comes twice
as often. The whole part of that number is certain. The rest of the target is a sample without repeats: document i has
the remaining fraction as its inclusion chance p_i, a uniform u_i from a hash of its id, source and text, and the Pareto
rank q_i = (u_i / (1 - u_i)) / (p_i / (1 - p_i)). Documents are taken by rising q until the words taken are as near to the
target as whole documents allow.

The cut is found without ordering a source in one task: q / (1 + q) is cut into 256 bins three times over (each time
inside the bin where the target falls), partial sums combine before the shuffle, and only the rows of the last bin
(about one in 16 million) are ordered.

Cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; repeated rows
are documents of their own with equal ranks; an empty table gives an empty result; a source of only empty documents
has target 0; a null or negative weight is 0, and a document without weight is never taken (a source whose weighted
documents at ``max_repeat`` times hold less than its target stays below it); other columns are ignored by :func:`mixture`
and carried by :func:`take`, whatever their names.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

NO_SOURCE = "\x00"


@dataclass(frozen=True)
class MixPolicy:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    max_repeat: float = 3.0
    seed: int = 17
    weight: str = "sqrt(size)"
    #: Sources up to this number are broadcast (about 100 bytes each); above it they are joined by a shuffle.
    broadcast_sources: int = 100_000
    bins: int = 256
    rounds: int = 3


def targets(sizes: DataFrame, policy: MixPolicy = MixPolicy()) -> DataFrame:
    """(source_key, is_null, source_size, target), one row per source.

    The repeated sharing ends where min(cap, level * weight) adds up to all words. Sources fill up in the order of
    cap / weight; the level after k of them is what the rest's weights share of what is left. The window has one row
    per source, not per document.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in policy.weights]),
                     (F.pmod(F.row_number().over(Window.orderBy("is_null", "source_key")) - 1,
                             F.lit(len(policy.weights))) + 1).cast("int"))
    s = (sizes.groupBy("source_key", "is_null").agg(F.sum("size").alias("source_size"))
         .withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(policy.max_repeat)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "is_null", "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = (s.withColumn("level", (F.sum("source_size").over(Window.partitionBy()).cast("double")
                                - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                      / F.sum("weight").over(rest))
         .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight")))
    # The level that holds is that of the first source which is not full.
    level = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "is_null", "source_key",
                                                  "level"))).over(Window.partitionBy())
    return s.withColumn("at", level["level"]).select(
        "source_key", "is_null", "source_size",
        F.when(F.col("full") | F.col("at").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


#: Weights are kept as whole multiples of 1 / this, so that their sums do not depend on the order of rows.
_UNIT = 1 << 20


def sizes_of(docs: DataFrame, policy: MixPolicy = MixPolicy()) -> DataFrame:
    """(doc_id, key, source_key, is_null, size, w): narrow rows; size is the number of words, w the weight in units."""
    sized = docs.withColumn("size", F.size(C.words(C.whole("text"))).cast("long"))
    w = F.round(F.greatest(F.lit(0.0), F.coalesce(F.expr(policy.weight).cast("double"), F.lit(0.0))) * _UNIT).cast("long")
    return sized.select(
        "doc_id", C.row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("key"),
        F.coalesce("source", F.lit(NO_SOURCE)).alias("source_key"), F.col("source").isNull().alias("is_null"),
        "size", F.when(F.col("size") > 0, w).otherwise(F.lit(0)).cast("long").alias("w"))


def _near(df: DataFrame, small: DataFrame, rows: int, policy: MixPolicy) -> DataFrame:
    """df with the rows of its source in small: broadcast if small is within the bound, else joined by a shuffle."""
    on = ["source_key", "is_null"]
    return df.join(F.broadcast(small) if rows <= policy.broadcast_sources else small, on, "left")


def levels(sizes: DataFrame, per: DataFrame, rows: int, policy: MixPolicy = MixPolicy()) -> DataFrame:
    """per with two columns more: documents of weight ``least`` or above are taken ``max_repeat`` times, the others
    level * w times on average. Rounds of sums, one row per source each, until no document joins the former."""
    on, most, top = ["source_key", "is_null"], policy.max_repeat, (1 << 63) - 1
    every = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    at = per.withColumn("least", F.when(every, F.lit(0)).otherwise(F.lit(top)).cast("long"))
    exact = "decimal(38,0)"
    for turn in itertools.count():
        d = _near(sizes, at.select(*on, "least"), rows, policy)
        sums = d.groupBy(*on).agg(
            F.sum(F.when(F.col("w") >= F.col("least"), F.col("size")).otherwise(0)).alias("full"),
            F.sum(F.when(F.col("w") < F.col("least"), F.col("size").cast(exact) * F.col("w")).otherwise(0).cast(exact)).alias("heavy"))
        level = F.when(F.col("heavy") > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("full") * most) / F.col("heavy").cast("double"))
        new = at.select(*per.columns, F.col("least").alias("before")).join(sums, on, "left").withColumn("level", level)
        new = new.withColumn("least", F.when(F.col("level") * float(top) > most, F.least(
            "before", F.ceil(most / F.col("level")).cast("long"))).otherwise(F.col("before")))
        at = C.materialize(new, f"level{turn}")
        if not at.where("least <> before").limit(1).count():
            return at.select(*per.columns, "least", F.coalesce("level", F.lit(0.0)).alias("level"))


def mixture(docs: DataFrame, policy: MixPolicy = MixPolicy()) -> DataFrame:
    """(doc_id, key, size, source_size, target, chance, copies, taken) of every row; chance is the mean number of copies."""
    on = ["source_key", "is_null"]
    sizes = C.materialize(sizes_of(docs, policy), "sizes")
    per = C.materialize(targets(sizes, policy), "targets")
    n_sources = per.count()
    per = levels(sizes, per, n_sources, policy)
    # Whole copies are certain; what the fraction adds is sampled.
    mean = F.when(F.col("size") == 0, 0.0).when(F.col("w") >= F.col("least"), policy.max_repeat).otherwise(
        F.least(F.lit(policy.max_repeat), F.col("w") * F.col("level")))
    d = _near(sizes, per, n_sources, policy).withColumn("chance", mean)
    d = d.withColumn("certain", F.floor(F.col("chance") + 1e-12).cast("long"))
    d = d.withColumn("part", F.greatest(F.lit(0.0), F.least(F.lit(1.0 - 1e-9), F.col("chance") - F.col("certain"))))
    sure = d.groupBy(*on).agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    per = C.materialize(per.join(sure, on, "left").withColumn("rest", F.greatest(
        F.lit(0.0), F.col("target") - F.coalesce("sure", F.lit(0)))), "rests")
    d = _near(d, per.select(*on, "rest"), n_sources, policy)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(policy.seed), "key"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    odds = F.col("part") / (1 - F.col("part"))
    q = (u / (1 - u)) / odds
    # q / (1 + q) keeps the order of q and lies in (0, 1), so it can be cut into bins.
    d = d.withColumn("z", F.when(F.col("part") > 0, q / (1 + q)).otherwise(F.lit(2.0)))
    # Written once: each later step plans a scan of narrow rows, not all the joins before it anew (the driver holds those plans).
    d = C.materialize(d.select("doc_id", "key", "source_key", "is_null", "size", "source_size", "target", "chance", "certain", "rest", "z"), "ranked")
    width = 1.0
    cut = per.select(*on, "rest", F.lit(0.0).alias("low"), F.lit(0.0).alias("spent"))
    for r in range(policy.rounds):
        width /= policy.bins
        here = _near(d.select(*on, "size", "z"), cut, n_sources, policy)
        here = here.where((F.col("z") >= F.col("low")) & (F.col("z") < F.col("low") + width * policy.bins) & (F.col("z") < 1.5))
        bins = (here.withColumn("bin", F.least(F.floor((F.col("z") - F.col("low")) / width), F.lit(policy.bins - 1)))
                .groupBy(*on, "bin").agg(F.sum("size").alias("words")))
        sums = bins.withColumn("upto", F.sum("words").over(Window.partitionBy(*on).orderBy("bin")))
        inside = (sums.join(cut, on).where((F.col("spent") + F.col("upto") - F.col("words") <= F.col("rest")))
                  .groupBy(*on).agg(F.max(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
                  .select(*on, F.col("x.bin").alias("bin"), F.col("x.before").alias("before")))
        cut = C.materialize(cut.join(inside, on, "left").select(
            *on, "rest", (F.col("low") + F.coalesce("bin", F.lit(0)) * width).alias("low"),
            (F.col("spent") + F.coalesce("before", F.lit(0))).alias("spent")), f"cut{r}")
    d = _near(d, cut.drop("rest"), n_sources, policy)
    edge = (F.col("z") >= F.col("low")) & (F.col("z") < F.col("low") + width) & (F.col("size") > 0)
    last = d.where(edge).select(*on, "doc_id", "key", "size", "z", "rest", "spent")
    w = Window.partitionBy(*on).orderBy("z", "key", "size")
    # Taken while half of the document still fits: what is taken then differs by half a document at most.
    last = (last.withColumn("upto", F.col("spent") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*on, "key").agg(F.sum((F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long")).alias("edge"),
                                     F.count(F.lit(1)).alias("same")))
    # Equal rows have one key: of them the first ones are taken.
    d = C.sized_join(d.withColumn("is_edge", edge), C.materialize(last, "edge"), [*on, "key"], "left")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    many = d.where(F.col("same") > 1)
    one = d.where(F.coalesce(F.col("same"), F.lit(1)) <= 1)
    marked = (one.withColumn("extra", F.when(F.col("is_edge"), F.coalesce("edge", F.lit(0))))
              .unionByName(many.withColumn("extra", F.when(nth <= F.col("edge"), 1).otherwise(0).cast("long"))))
    copies = F.col("certain") + F.coalesce("extra", ((F.col("z") < F.col("low")) & (F.col("size") > 0)).cast("long"))
    return marked.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0)).select(
        "doc_id", "key", "size", "source_size", "target", "chance", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, policy: MixPolicy = MixPolicy()) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, all columns unchanged."""
    copies = mixture(docs, policy).groupBy("key").agg(
        F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows")).where("all > 0")
    key, every, rows, times, i = C.free(docs, "__key", "__all", "__rows", "__n", "__i")
    copies = C.materialize(copies.select(F.col("key").alias(key), F.col("all").alias(every), F.col("rows").alias(rows)), "taken")
    # By a sort on both sides whatever their size, as without the table.
    keyed = docs.withColumn(key, C.row_key(F.col("doc_id"), F.col("source"), F.col("text"))).join(copies.hint("merge"), key)
    # Equal rows share their copies; the first of them takes what does not divide.
    if copies.where(F.col(rows) > 1).take(1):
        nth = F.row_number().over(Window.partitionBy(key).orderBy(key))
        keyed = keyed.withColumn(times, F.floor((F.col(every) + F.col(rows) - nth) / F.col(rows)))
    else:
        keyed = keyed.withColumn(times, F.col(every))
    return keyed.where(F.col(times) > 0).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(C.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "chance")


QUERIES = {"op6_pareto_mix": op6_pareto_mix}
SQL: dict[str, str] = {}
