"""Queries of coverage, counters, evidence and suppression, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparisons, history, ratings
from . import bindings as B
from .queries import _CUT, _ORDER, _PAIRS, ASSESSED, assessed, query

_CLASSES = ", ".join(f"coalesce(sum(CASE WHEN class = '{k}' THEN {c} END), 0)::BIGINT AS {k}_{n}" for k in ratings.COVERAGE
                     for n, c in (("files", "1"), ("lines", "lines"), ("bytes", "n_chars")))


@query(f"""WITH f AS (SELECT source, n_chars, len(text) - len(replace(text, chr(10), '')) AS lines, CASE WHEN lang = 'fr' THEN 'unsupported' WHEN doc_id % 9 = 0 THEN 'failed'
  WHEN doc_id % 4 = 0 THEN 'recovered' ELSE 'parsed' END AS st, CASE WHEN doc_id % 5 = 0 THEN 'vendored' WHEN doc_id % 2 = 0 THEN 'test' ELSE 'primary' END AS role FROM documents),
c AS (SELECT *, CASE WHEN st IN ('unsupported', 'failed') THEN st WHEN role = 'vendored' THEN 'context' WHEN st = 'recovered' THEN st ELSE 'clean' END AS class FROM f)
SELECT source, count(*) AS selected_files, sum(lines)::BIGINT AS selected_lines, sum(n_chars)::BIGINT AS selected_bytes, {_CLASSES} FROM c GROUP BY source""")
def file_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = B.table(spark, sf, "documents")
    status = (F.when(F.col("lang") == "fr", "unsupported").when(F.col("doc_id") % 9 == 0, "failed").when(F.col("doc_id") % 4 == 0, "recovered").otherwise("parsed"))
    role = F.when(F.col("doc_id") % 5 == 0, "vendored").when(F.col("doc_id") % 2 == 0, "test").otherwise("primary")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return ratings.file_coverage(d.select("source", role.alias("role"), status.alias("parse_status"), lines.cast("long").alias("lines"), F.col("n_chars").alias("bytes")), "source")


_SIGNALS = {"cognitive": "cognitive", "cyclomatic": "cyclomatic", "logical_lines": "logical_lines", "max_nesting": "nesting", "parameter_count": "parameters"}


@query(f"""WITH {ASSESSED}, x AS (SELECT path, unnest([{', '.join(f"{{'s': '{n}', 'r': r_{s}}}" for s, n in _SIGNALS.items())}]) AS x FROM assessed WHERE affects_verdict),
z AS (SELECT path, 'file_size' AS s, CASE WHEN sum(logical_lines) >= 800 THEN 2 WHEN sum(logical_lines) >= 400 THEN 1 ELSE 0 END AS r FROM assessed GROUP BY path),
k AS (SELECT path, 'container_size' AS s, CASE WHEN sum(logical_lines) >= 600 THEN 2 WHEN sum(logical_lines) >= 300 THEN 1 ELSE 0 END AS r FROM assessed GROUP BY path, ordinal),
d AS (SELECT path, 'stable_dependency' AS s, 1 AS r FROM assessed WHERE cognitive = 50),
a AS (SELECT path, x.s AS s, x.r AS r FROM x UNION ALL SELECT * FROM z UNION ALL SELECT * FROM k UNION ALL SELECT * FROM d)
SELECT path, s AS signal, count(*) FILTER (r = 2) AS high, count(*) FILTER (r = 1) AS watch FROM a WHERE r > 0 GROUP BY ALL""")
def gate_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    a = assessed(spark, sf)
    lines = a.groupBy("path").agg(F.sum("logical_lines").alias("lines"))
    return ratings.whole_gate_snapshot(a, file_size=ratings.size_findings(lines), container_size=ratings.container_sizes(a, "path", "ordinal"),
                                       stable_dependency=a.where("cognitive = 50").select("path", F.lit(1).alias("rating")))


_HOT = _ORDER.replace("role_class,", "role_class, hot DESC,").replace("logical_lines DESC,", "logical_lines DESC, activity DESC,")


@query(f"""WITH {ASSESSED}, act AS (SELECT path, count(*) AS activity FROM assessed GROUP BY path), c AS (SELECT a.*, activity, activity % 3 = 0 AS hot,
  CASE WHEN role = 'primary' THEN 0 WHEN role = 'test' THEN 1 ELSE 2 END AS role_class FROM assessed a JOIN act USING (path) WHERE rating > 0)
SELECT path, start_line, hot, row_number() OVER (ORDER BY {_HOT}) AS rank FROM c QUALIFY rank <= 50""")
def hot_finding_rank(spark: SparkSession, sf: str) -> DataFrame:
    a = assessed(spark, sf)
    act = a.groupBy("path").agg(F.count(F.lit(1)).alias("activity"))
    a = a.join(act, "path").withColumn("hot", F.col("activity") % 3 == 0)
    return ratings.finding_rank(a, 50).select("path", "start_line", "hot", "rank")


@query(f"""WITH {B.ORDERS}, c AS (SELECT path, role, trust, coalesce(sum(added), 0)::BIGINT AS added, coalesce(sum(deleted), 0)::BIGINT AS deleted,
  sum((added IS NULL OR deleted IS NULL)::BIGINT)::BIGINT AS uncounted, count(DISTINCT commit) AS commits FROM changes WHERE ts < TIMESTAMP '1992-06-01' OR author % 50 = 1 GROUP BY ALL)
SELECT DISTINCT path, role, trust, coalesce(c.added, 0) AS added, coalesce(c.deleted, 0) AS deleted, coalesce(c.uncounted, 0) AS uncounted, coalesce(c.commits, 0) AS commits
FROM (SELECT DISTINCT path, role, trust FROM changes) LEFT JOIN c USING (path, role, trust)""")
def filled_churn(spark: SparkSession, sf: str) -> DataFrame:
    c = B.order_changes(spark, sf)
    some = c.where((F.col("ts") < F.lit("1992-06-01").cast("timestamp_ntz")) | (F.col("author") % 50 == 1))
    return history.filled_churn(some, c.select("path", "role", "trust").distinct())


@query(f"""WITH {B.ORDERS}, p AS (SELECT commit, max(ts) AS ts, count(DISTINCT CASE WHEN role = 'primary' AND trust = 'trusted' THEN path END) AS files,
  count(CASE WHEN added IS NULL THEN 1 END) AS renames FROM changes GROUP BY commit), w AS (SELECT *, ts >= TIMESTAMP '{_CUT}' AS ok FROM p)
SELECT count(*) FILTER (ok) AS streamed, count(*) FILTER (NOT ok) AS excluded, max(ts) FILTER (ok) AS newest, min(ts) FILTER (ok) AS oldest,
  sum(renames) FILTER (ok)::BIGINT AS renames, count(*) FILTER (ok AND files > 4) AS bulk, 0::BIGINT AS declined_pairs FROM w""")
def history_counters(spark: SparkSession, sf: str) -> DataFrame:
    from dataclasses import replace

    from ..policy import HistoryPolicy
    c = B.order_changes(spark, sf).withColumn("previous_path", F.when(F.col("added").isNull(), F.col("path")))
    return history.stream_counters(c, F.lit(_CUT).cast("timestamp_ntz"), replace(HistoryPolicy(), bulk_files=4))


_RANK = "list_position(['primary', 'test', 'example', 'benchmark', 'fixture', 'generated', 'vendored', 'dormant'], role) * 2 + (trust <> 'trusted')::INT"


@query(f"""WITH {B.ORDERS}, {_PAIRS}, b AS (SELECT commit, package, min({_RANK}) AS rank FROM changes GROUP BY ALL),
e AS (SELECT x.package AS "left", y.package AS "right", min(x.rank) AS l, min(y.rank) AS r FROM b x JOIN b y ON x.commit = y.commit AND x.package < y.package GROUP BY 1, 2),
n AS (SELECT ['primary', 'test', 'example', 'benchmark', 'fixture', 'generated', 'vendored', 'dormant'] AS names)
SELECT "left", "right", shared, names[l // 2] || CASE WHEN l % 2 = 0 THEN '/trusted' ELSE '/advisory' END AS evidence_left,
  names[r // 2] || CASE WHEN r % 2 = 0 THEN '/trusted' ELSE '/advisory' END AS evidence_right FROM pairs JOIN e USING ("left", "right"), n""")
def pair_evidence(spark: SparkSession, sf: str) -> DataFrame:
    c = B.order_changes(spark, sf)
    return history.pair_evidence(c, history.package_coupling(c).select("left", "right", "shared"))


@query("""WITH f AS (SELECT CASE p_size % 3 WHEN 0 THEN 'reach' WHEN 1 THEN 'core' ELSE 'leakage' END AS kind, p_brand AS package FROM part),
c AS (SELECT DISTINCT p_brand AS package FROM part WHERE p_size = 7 AND p_type = 'SMALL'), b AS (SELECT DISTINCT p_brand AS package FROM part WHERE p_size = 11 AND p_type = 'LARGE')
SELECT kind, count(*) FILTER (package IN (SELECT package FROM c) OR package IN (SELECT package FROM b)) AS total, count(*) FILTER (package IN (SELECT package FROM c)) AS current,
  count(*) FILTER (package IN (SELECT package FROM b)) AS base FROM f GROUP BY kind""")
def suppressed_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "reach").when(F.col("p_size") % 3 == 1, "core").otherwise("leakage")
    package = F.col("p_brand").alias("package")
    return comparisons.suppressed(p.select(kind.alias("kind"), package), p.where("p_size = 7 AND p_type = 'SMALL'").select(package), p.where("p_size = 11 AND p_type = 'LARGE'").select(package))
