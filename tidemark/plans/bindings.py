"""Adapters from star-schema and event tables to the canonical relations, with the same relations as SQL.

Units are order lines, files are suppliers below region and nation, a commit is an order (files: parts below brands)
or a user's day (files: event types and keys), and nations that buy from each other make a dependency graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppkey, package (region/nation), path."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    package = F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey")
    return j.select(F.col("s_suppkey").alias("suppkey"), package.alias("package"),
                    F.concat(package, F.lit("/s"), "s_suppkey").alias("path"))


SUPPLIERS = """suppliers AS (SELECT s_suppkey AS suppkey, 'r' || n_regionkey || '/n' || n_nationkey AS package,
  'r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey AS path
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit per order line."""
    li = table(spark, sf_dir, "lineitem")
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    u = li.select(
        F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("ordinal"), line.cast("long").alias("start_line"),
        F.when(F.col("l_returnflag") == "A", "primary").when(F.col("l_returnflag") == "N", "test").otherwise("vendored").alias("role"),
        F.when(F.col("l_linestatus") == "F", "trusted").otherwise("advisory").alias("trust"),
        F.col("l_quantity").cast("long").alias("cognitive"), (F.col("l_partkey") % 30).cast("long").alias("cyclomatic"),
        F.floor(F.col("l_extendedprice") / 1000).cast("long").alias("logical_lines"),
        F.col("l_linenumber").cast("long").alias("max_nesting"), F.round(F.col("l_tax") * 100).cast("long").alias("parameter_count"))
    return u.join(suppliers(spark, sf_dir), "suppkey").drop("suppkey")


UNITS = SUPPLIERS + """, units AS (SELECT path, package, l_partkey AS ordinal, (l_orderkey * 8 + l_linenumber)::BIGINT AS start_line,
  CASE l_returnflag WHEN 'A' THEN 'primary' WHEN 'N' THEN 'test' ELSE 'vendored' END AS role,
  CASE l_linestatus WHEN 'F' THEN 'trusted' ELSE 'advisory' END AS trust,
  l_quantity::BIGINT AS cognitive, (l_partkey % 30)::BIGINT AS cyclomatic, floor(l_extendedprice / 1000)::BIGINT AS logical_lines,
  l_linenumber::BIGINT AS max_nesting, round(l_tax * 100)::BIGINT AS parameter_count
  FROM lineitem JOIN suppliers ON l_suppkey = suppkey)"""


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit stream of the events: commit, contributor, ts, path, package."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(F.concat_ws("@", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("commit"),
                    F.col("user_id").cast("string").alias("contributor"), "ts",
                    F.concat(F.col("event_type"), F.lit("/k"), k).alias("path"), F.col("event_type").alias("package"))


EVENTS = """changes AS (SELECT user_id || '@' || ts::DATE AS commit, user_id::VARCHAR AS contributor, ts,
  event_type || '/k' || json_extract_string(props, '$.k') AS path, event_type AS package FROM events)"""


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit stream of the orders: commit, contributor, ts, path, package, role, trust, added, deleted."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    binary = F.col("l_returnflag") == "R"
    # The orders come last: what groups by commit finds the rows dealt by it.
    of_part = dealt(li.join(p, li.l_partkey == p.p_partkey), li, "l_orderkey")
    return (of_part.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("commit"), F.col("o_orderpriority").alias("contributor"), F.col("o_custkey").alias("author"),
        F.col("o_orderdate").alias("ts"),
        F.concat(F.regexp_replace("p_brand", "#", "/"), F.lit("/p"), F.col("p_partkey")).alias("path"),
        F.col("p_brand").alias("package"),
        F.when(F.col("p_type").isin("STANDARD", "MEDIUM", "PROMO"), "primary").when(F.col("p_type") == "LARGE", "test")
        .when(F.col("p_type") == "SMALL", "benchmark").otherwise("vendored").alias("role"),
        F.when(F.col("p_size") % 5 == 0, "advisory").otherwise("trusted").alias("trust"),
        F.when(~binary, F.col("l_quantity").cast("long")).alias("added"),
        F.when(~binary, F.col("l_linenumber").cast("long")).alias("deleted")))


ORDERS = """changes AS (SELECT o_orderkey AS commit, o_orderpriority AS contributor, o_custkey AS author, o_orderdate AS ts,
  replace(p_brand, '#', '/') || '/p' || p_partkey AS path, p_brand AS package,
  CASE WHEN p_type IN ('STANDARD', 'MEDIUM', 'PROMO') THEN 'primary' WHEN p_type = 'LARGE' THEN 'test'
       WHEN p_type = 'SMALL' THEN 'benchmark' ELSE 'vendored' END AS role,
  CASE WHEN p_size % 5 = 0 THEN 'advisory' ELSE 'trusted' END AS trust,
  CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT END AS added,
  CASE WHEN l_returnflag <> 'R' THEN l_linenumber::BIGINT END AS deleted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

#: A nation depends on another if it has this percentage of the mean number of lines from it.
EDGE_PERCENT = 156


def nation_edges(spark: SparkSession, sf_dir: str, percent: int = EDGE_PERCENT, until: str | None = None,
                 since: str | None = None) -> DataFrame:
    """Dependency edges between nations: src, dst, refs (no loops)."""
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    if until:
        o = o.where(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz"))
    if since:
        o = o.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
    pairs = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
             .join(s, li.l_suppkey == s.s_suppkey).where("c_nationkey <> s_nationkey")
             .groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
             .agg(F.count(F.lit(1)).alias("refs")))
    mean = pairs.agg(F.sum("refs").alias("all_refs"), F.count(F.lit(1)).alias("all_pairs"))
    return pairs.crossJoin(F.broadcast(mean)).where(  # one row
        F.col("refs") * F.col("all_pairs") * 100 >= F.col("all_refs") * percent).select("src", "dst", "refs")


def nation_edges_sql(percent: int = EDGE_PERCENT, name: str = "edges", where: str = "true") -> str:
    return f"""{name}_p AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS refs
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey AND {where} GROUP BY 1, 2),
{name} AS (SELECT src, dst, refs FROM {name}_p WHERE refs * (SELECT count(*) FROM {name}_p) * 100 >= (SELECT sum(refs) FROM {name}_p) * {percent})"""
