"""Registered queries over the bound tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import comparisons, diff, graph, history, leakage, problems, ratings, resolution
from ..policy import GraphPolicy, HealthPolicy, HistoryPolicy, LeakagePolicy, ProblemPolicy
from . import bindings as B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rate(c: str, w: int, h: int) -> str:
    return f"CASE WHEN {c} >= {h} THEN 2 WHEN {c} >= {w} THEN 1 ELSE 0 END"


_LIMITS = HealthPolicy().limits
_R = {s: _rate(s, *_LIMITS[s]) for s in _LIMITS}
ASSESSED = B.UNITS + f""", rated AS (SELECT *, {', '.join(f'{x} AS r_{s}' for s, x in _R.items())} FROM units),
assessed0 AS (SELECT *, greatest({', '.join(f'r_{s}' for s in _R)})::BIGINT AS rating FROM rated),
assessed AS (SELECT *, ({' + '.join(f'(r_{s} = rating)::BIGINT' for s in _R)})::BIGINT AS signals_at_rating,
  ({' + '.join(f'(r_{s} > 0)::BIGINT' for s in _R)})::BIGINT AS triggered,
  role IN ('primary', 'test', 'example', 'benchmark') AND trust = 'trusted' AS affects_verdict FROM assessed0)"""
_SCOPES = """files AS (SELECT path, sum((rating = 0)::BIGINT) AS healthy, sum((rating = 1)::BIGINT) AS watch, sum((rating = 2)::BIGINT) AS high
  FROM assessed WHERE affects_verdict GROUP BY path),
scopes AS (SELECT scope, sum(healthy)::BIGINT AS healthy, sum(watch)::BIGINT AS watch, sum(high)::BIGINT AS high FROM
  (SELECT unnest(list_concat(['.'], list_transform(range(1, len(string_split(path, '/')) + 1),
     lambda i: array_to_string(string_split(path, '/')[1:i], '/')))) AS scope, healthy, watch, high FROM files) GROUP BY scope)"""


def assessed(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.assess(B.units(spark, sf))


@query(f"WITH {ASSESSED} SELECT path, start_line, ordinal, rating, signals_at_rating, triggered, affects_verdict FROM assessed")
def unit_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return assessed(spark, sf).select("path", "start_line", "ordinal", "rating", "signals_at_rating", "triggered", "affects_verdict")


_ORDER = """rating DESC, role_class, signals_at_rating DESC, triggered DESC, cognitive DESC, cyclomatic DESC, logical_lines DESC,
  path, start_line, ordinal, max_nesting DESC, parameter_count DESC, trust"""


@query(f"""WITH {ASSESSED}, c AS (SELECT *, CASE WHEN role = 'primary' THEN 0 WHEN role = 'test' THEN 1 ELSE 2 END AS role_class
  FROM assessed WHERE rating > 0)
SELECT path, start_line, rating, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM c QUALIFY rank <= 50""")
def finding_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.finding_rank(assessed(spark, sf), 50).select("path", "start_line", "rating", "rank")


@query(f"WITH {ASSESSED}, {_SCOPES} SELECT scope, healthy, watch, high FROM scopes")
def health_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.scope_rollup(assessed(spark, sf))


_TIER = """greatest(CASE WHEN checked = 0 THEN 0 WHEN high = 0 AND watch = 0 THEN 1 WHEN high = 0 THEN 2
  WHEN checked < 200 AND high < 10 THEN 3 WHEN high * 1000 // greatest(checked, 1) <= 10 THEN 3
  WHEN high * 1000 // greatest(checked, 1) <= 50 THEN 4 ELSE 5 END, 0,
  CASE WHEN high >= 1000 THEN 5 WHEN high >= 100 THEN 4 ELSE 0 END)"""


@query(f"""WITH {ASSESSED}, {_SCOPES}, t AS (SELECT scope, healthy + watch + high AS checked, watch, high FROM scopes)
SELECT scope, checked, watch, high, {_TIER}::BIGINT AS tier_rank,
  ['empty', 'clean', 'solid', 'worn', 'fights_back', 'lost'][{_TIER} + 1] AS tier FROM t""")
def scope_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.scope_tiers(ratings.scope_rollup(assessed(spark, sf)))


@query(f"WITH {ASSESSED}, s AS (SELECT path, ordinal, sum(logical_lines)::BIGINT AS statements FROM units GROUP BY 1, 2) "
       f"SELECT path, ordinal, statements, ({_rate('statements', 300, 600)})::BIGINT AS rating FROM s WHERE statements >= 300")
def container_size_findings(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.container_sizes(B.units(spark, sf), "path", "ordinal")


@query(r"WITH d AS (SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + (text <> '' AND NOT text LIKE '%' || chr(10))::INT)::BIGINT AS lines "
       rf"FROM documents) SELECT doc_id, lines, ({_rate('lines', 10, 40)})::BIGINT AS rating FROM d WHERE lines >= 10")
def file_size_findings(spark: SparkSession, sf: str) -> DataFrame:
    d = B.table(spark, sf, "documents")
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
             + ((F.col("text") != "") & ~F.endswith("text", F.lit("\n"))).cast("int"))
    return ratings.size_findings(d.select("doc_id", lines.cast("long").alias("lines")), HealthPolicy(file_lines=(10, 40)))


@query(f"WITH {B.UNITS} SELECT package, count(*) AS selected, sum((role IN ('primary', 'test') AND trust = 'trusted')::BIGINT)::BIGINT AS clean, "
       "sum((role IN ('primary', 'test') AND trust = 'advisory')::BIGINT)::BIGINT AS recovered, sum((role = 'vendored')::BIGINT)::BIGINT AS context "
       "FROM units GROUP BY package")
def unit_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.coverage(B.units(spark, sf), "package")


_CHURN = ("coalesce(sum(added), 0)::BIGINT AS added, coalesce(sum(deleted), 0)::BIGINT AS deleted, "
          "sum((added IS NULL OR deleted IS NULL)::BIGINT)::BIGINT AS uncounted, count(DISTINCT commit) AS commits")


@query(f"WITH {B.ORDERS} SELECT path, role, trust, {_CHURN} FROM changes GROUP BY ALL")
def file_churn(spark: SparkSession, sf: str) -> DataFrame:
    return history.churn(B.order_changes(spark, sf), "path", "role", "trust")


@query(f"WITH {B.ORDERS} SELECT package, role, trust, {_CHURN} FROM changes GROUP BY ALL")
def package_churn(spark: SparkSession, sf: str) -> DataFrame:
    return history.churn(B.order_changes(spark, sf), "package", "role", "trust")


@query(f"""WITH {B.EVENTS}, t AS (SELECT path, count(DISTINCT commit) AS touches FROM changes GROUP BY path HAVING touches >= 5),
rated AS (SELECT event_type || '/k' || json_extract_string(props, '$.k') AS path, CASE WHEN value >= 25 THEN 2 WHEN value >= 15 THEN 1 ELSE 0 END AS r FROM events),
h AS (SELECT path, sum((r = 0)::BIGINT)::BIGINT AS healthy, sum((r = 1)::BIGINT)::BIGINT AS watch, sum((r = 2)::BIGINT)::BIGINT AS high FROM rated GROUP BY path)
SELECT path, touches, healthy, watch, high FROM t JOIN h USING (path)""")
def hotspots(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: churn held against rated units."""
    c = B.event_changes(spark, sf)
    touches = c.groupBy("path").agg(F.countDistinct("commit").alias("touches"))
    e = B.table(spark, sf, "events")
    rated = e.select(F.concat(F.col("event_type"), F.lit("/k"), F.get_json_object("props", "$.k")).alias("path"),
                     ratings.rating(F.col("value"), (15, 25)).alias("rating"))
    return history.hotspots(touches, ratings.health_counts(rated, "path"))


_PAIRS = """m AS (SELECT DISTINCT commit, package FROM changes), touch AS (SELECT package, count(*) AS n FROM m GROUP BY package),
p AS (SELECT a.package AS "left", b.package AS "right", count(*) AS shared FROM m a JOIN m b ON a.commit = b.commit AND a.package < b.package GROUP BY 1, 2),
pairs AS (SELECT "left", "right", shared, x.n AS touch_left, y.n AS touch_right, x.n + y.n - shared AS "union"
  FROM p JOIN touch x ON x.package = "left" JOIN touch y ON y.package = "right" WHERE shared >= 2)"""


@query(f"WITH {B.EVENTS}, {_PAIRS} SELECT * FROM pairs")
def package_change_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return history.package_coupling(B.event_changes(spark, sf)).select("left", "right", "shared", "touch_left", "touch_right", "union")


@query(f"""WITH {B.EVENTS}, {_PAIRS} SELECT "left", "right", shared, "union" FROM pairs WHERE shared >= 3 AND shared * 100 >= "union" * 20
  AND NOT ("left" = 'click' AND "right" = 'view') AND NOT ("left" = 'error' AND "right" = 'signup')""")
def unexplained_coupling(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([("view", "click"), ("error", "signup")], "src string, dst string")
    return history.unexplained(history.package_coupling(B.event_changes(spark, sf)), known).select("left", "right", "shared", "union")


_FILE_PAIRS = """g AS (SELECT DISTINCT commit, path FROM changes WHERE role = 'primary' AND trust = 'trusted'),
small AS (SELECT commit FROM g GROUP BY commit HAVING count(*) <= 8), m AS (SELECT commit, path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dir FROM g JOIN small USING (commit)),
touch AS (SELECT path, count(*) AS n FROM m GROUP BY path),
p AS (SELECT a.path AS "left", b.path AS "right", count(*) AS shared FROM m a JOIN m b ON a.commit = b.commit AND a.path < b.path AND a.dir <> b.dir GROUP BY 1, 2),
pairs AS (SELECT "left", "right", shared, x.n + y.n - shared AS "union",
  (CASE WHEN split_part("left", '/', 1) = split_part("right", '/', 1) THEN 2 ELSE 4 END)::BIGINT AS distance
  FROM p JOIN touch x ON x.path = "left" JOIN touch y ON y.path = "right" WHERE shared >= 2)"""
_LOOSE = replace(HistoryPolicy(), bulk_files=8, file_shared=2, file_permille=0)


@query(f"WITH {B.ORDERS}, {_FILE_PAIRS} SELECT * FROM pairs")
def file_change_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return history.file_coupling(B.order_changes(spark, sf), _LOOSE).select("left", "right", "shared", "union", "distance")


@query(f"""WITH {B.ORDERS}, o AS (SELECT package, role, contributor, count(DISTINCT commit) AS n FROM changes GROUP BY ALL)
SELECT package, role, count(*) AS contributors, max(n) AS top_commits, sum(n)::BIGINT AS commits FROM o GROUP BY ALL""")
def ownership(spark: SparkSession, sf: str) -> DataFrame:
    return history.ownership(B.order_changes(spark, sf), "package", "role")


@query(f"""WITH {B.ORDERS}, o AS (SELECT author, contributor, count(DISTINCT commit) AS n FROM changes GROUP BY ALL),
s AS (SELECT author, count(*) AS contributors, max(n) AS top_commits, sum(n)::BIGINT AS commits FROM o GROUP BY author)
SELECT * FROM s WHERE commits >= 10 AND top_commits * 100 >= commits * 50""")
def knowledge_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return history.concentration(history.ownership(B.order_changes(spark, sf), "author"),
                                 replace(HistoryPolicy(), concentration_percent=50))


_CUT = "1998-01-01"


@query(f"""WITH {B.ORDERS}, o AS (SELECT ts < TIMESTAMP '{_CUT}' AS early, author, contributor, count(DISTINCT commit) AS n FROM changes GROUP BY ALL),
s AS (SELECT early, author FROM o GROUP BY ALL HAVING sum(n) >= 5 AND max(n) * 100 >= sum(n) * 50)
SELECT author, CASE WHEN bool_or(early) THEN 'dissolved' ELSE 'introduced' END AS movement FROM s GROUP BY author HAVING count(*) = 1""")
def concentration_comparison(spark: SparkSession, sf: str) -> DataFrame:
    c, p = B.order_changes(spark, sf), replace(HistoryPolicy(), concentration_total=5, concentration_percent=50)
    cut = F.lit(_CUT).cast("timestamp_ntz")
    side = lambda d: history.concentration(history.ownership(d, "author"), p)
    return history.concentration_movement(side(c.where(F.col("ts") < cut)), side(c.where(F.col("ts") >= cut)), "author")


@query(f"""WITH {B.ORDERS}, m AS (SELECT DISTINCT commit, path FROM changes WHERE role IN ('primary', 'test', 'benchmark') AND trust = 'trusted'),
s AS (SELECT commit, least(count(*), 1000) AS files FROM m GROUP BY commit),
d AS (SELECT DISTINCT commit, unnest(['.', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS directory FROM m)
SELECT directory, count(*) AS commits, quantile_disc(files, 0.5)::BIGINT AS median FROM d JOIN s USING (commit) GROUP BY directory
HAVING count(*) >= 10 AND median >= 2""")
def change_amplification(spark: SparkSession, sf: str) -> DataFrame:
    return history.amplification(B.order_changes(spark, sf), replace(HistoryPolicy(), amplification_median=2))


@query(f"""WITH {B.ORDERS}, e AS (SELECT *, role IN ('primary', 'test', 'benchmark') AND trust = 'trusted' AS ok FROM changes)
SELECT count(DISTINCT commit) AS commits, count(DISTINCT CASE WHEN ok THEN commit END) AS eligible_commits, count(*) AS changes,
  sum(ok::BIGINT)::BIGINT AS mapped, sum((NOT ok)::BIGINT)::BIGINT AS context, count(added) AS textual, (count(*) - count(added))::BIGINT AS uncounted FROM e""")
def history_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return history.coverage(B.order_changes(spark, sf))


@query(f"""WITH {B.EVENTS}, n AS (SELECT max(ts) AS top FROM changes)
SELECT package, count(*) AS changes, count(DISTINCT commit) AS commits FROM changes, n WHERE ts >= top - INTERVAL 7 DAY GROUP BY package""")
def history_window(spark: SparkSession, sf: str) -> DataFrame:
    c = B.event_changes(spark, sf)
    c = c.crossJoin(F.broadcast(c.agg(F.max("ts").alias("top"))))  # one row
    return history.window(c, F.col("top"), 7).groupBy("package").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("commit").alias("commits"))


_E = B.nation_edges_sql()
_DEG = """n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
deg AS (SELECT node, (SELECT count(*) FROM edges WHERE dst = node)::BIGINT AS fan_in, (SELECT count(*) FROM edges WHERE src = node)::BIGINT AS fan_out FROM n)"""


@query(f"WITH {_E}, {_DEG} SELECT * FROM deg")
def dependency_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(B.nation_edges(spark, sf))


@query(f"""WITH {_E}, {_DEG} SELECT node, CASE WHEN fan_in + fan_out > 0 THEN fan_out END AS numerator,
  CASE WHEN fan_in + fan_out > 0 THEN fan_in + fan_out END AS denominator FROM deg""")
def instability(spark: SparkSession, sf: str) -> DataFrame:
    return graph.instability(graph.degrees(B.nation_edges(spark, sf)))


@query(f"""WITH {_E}, {_DEG} SELECT src, dst, refs FROM edges JOIN deg s ON s.node = src JOIN deg t ON t.node = dst
WHERE refs >= 2 AND t.fan_out * (s.fan_in + s.fan_out) > s.fan_out * (t.fan_in + t.fan_out)""")
def stable_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return graph.stable_violations(B.nation_edges(spark, sf))


_CLOSURE = "RECURSIVE reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"


def _with_closure(edges: str) -> str:
    return "WITH RECURSIVE " + edges + ", " + _CLOSURE.removeprefix("RECURSIVE ")


_SCC = """n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
scc AS (SELECT node, least(node, coalesce((SELECT min(a.dst) FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src = node), node))::BIGINT AS component FROM n)"""


@query(f"{_with_closure(_E)}, {_SCC} SELECT * FROM scc")
def strongly_connected(spark: SparkSession, sf: str) -> DataFrame:
    return graph.strong_components(B.nation_edges(spark, sf))


@query(f"{_with_closure(_E)}, {_SCC} SELECT component, count(*) AS size, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM scc GROUP BY component HAVING count(*) > 1")
def package_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cycles(B.nation_edges(spark, sf)).select(
        "component", "size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(f"""{_with_closure(_E)}, {_SCC}, inside AS (SELECT s.component, src, dst FROM edges JOIN scc s ON s.node = src JOIN scc t ON t.node = dst WHERE s.component = t.component AND src <> dst),
walk(component, node, path, len) AS (SELECT component, dst, [src], 1 FROM inside WHERE dst > src UNION ALL SELECT w.component, i.dst, list_append(path, w.node), len + 1
  FROM walk w JOIN inside i ON i.src = w.node AND i.component = w.component WHERE i.dst > path[1] AND NOT list_contains(path, i.dst) AND i.dst <> w.node AND len < 5),
closed AS (SELECT w.component, list_append(path, node) AS path FROM walk w JOIN inside i ON i.src = w.node AND i.dst = path[1]),
best AS (SELECT component, path, row_number() OVER (PARTITION BY component ORDER BY len(path), path) AS n FROM closed)
SELECT component, array_to_string(path, ',') AS path FROM best WHERE n = 1""")
def cycle_witnesses(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.written(B.nation_edges(spark, sf), "nations")
    m = graph.cycles(e).select("component", F.explode("members").alias("node"))
    return graph.witnesses(e, m).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ","))


@query(f"""{_with_closure(_E)}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
SELECT node, 1 + (SELECT count(*) FROM reach WHERE dst = node AND src <> node) AS reach FROM n""")
def package_reach(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reach_in(graph.written(B.nation_edges(spark, sf), "nations"))


@query(f"""{_with_closure(_E)}, {_DEG}, {_SCC.replace('n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),', '')},
cyc AS (SELECT node FROM scc WHERE component IN (SELECT component FROM scc GROUP BY component HAVING count(*) > 1)),
c AS (SELECT node FROM deg WHERE fan_in >= 8 OR fan_out >= 8 OR node IN (SELECT node FROM cyc) ORDER BY fan_in DESC, node LIMIT 64)
SELECT node, (SELECT count(*) FROM reach WHERE dst = node AND src <> node) AS reach FROM c""")
def file_reach(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.written(B.nation_edges(spark, sf), "nations")
    return graph.file_reach(e, graph.cycles(e).select(F.explode("members").alias("node")))


@query(f"""{_with_closure(_E)}, {_SCC}, c AS (SELECT component, count(*) AS size FROM scc GROUP BY component HAVING count(*) > 1)
SELECT component, size, (SELECT count(*) FROM n) AS total FROM c WHERE size >= 5 AND size * 100 >= (SELECT count(*) FROM n) * 2 ORDER BY size DESC, component LIMIT 1""")
def core_component(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.written(B.nation_edges(spark, sf), "nations")
    return graph.core(graph.cycles(e), graph.nodes(e).count()).select("component", "size", "total")


_SPARSE = f"""edges AS (SELECT DISTINCT c_custkey % 97 * 1000 + c_nationkey AS src, c_custkey % 89 * 1000 + c_nationkey AS dst FROM customer)"""


def _sparse(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "customer")
    return c.select((F.col("c_custkey") % 97 * 1000 + F.col("c_nationkey")).cast("long").alias("src"),
                    (F.col("c_custkey") % 89 * 1000 + F.col("c_nationkey")).cast("long").alias("dst")).distinct()


@query(f"""WITH RECURSIVE {_SPARSE}, both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reach(node, other) AS (SELECT src, src FROM both_ UNION SELECT r.node, b.dst FROM reach r JOIN both_ b ON r.other = b.src)
SELECT node, min(other)::BIGINT AS component FROM reach GROUP BY node""")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    e = _sparse(spark, sf)
    return graph.components(e, graph.nodes(e))


_LEAK = LeakagePolicy(shared=2, bar=0, bar_floor=0)


@query(f"""WITH RECURSIVE {B.ORDERS}, {_FILE_PAIRS}, files AS (SELECT DISTINCT path FROM changes WHERE role = 'primary' AND trust = 'trusted'),
imports AS (SELECT a.path AS src, b.path AS dst FROM (SELECT path, split_part(path, '/p', 2)::BIGINT AS k FROM files) a
  JOIN (SELECT path, split_part(path, '/p', 2)::BIGINT AS k FROM files) b ON b.k = a.k + 1 WHERE a.k % 3 > 0),
both_ AS (SELECT src, dst FROM imports UNION SELECT dst, src FROM imports),
reach(node, other) AS (SELECT path, path FROM files UNION SELECT r.node, b.dst FROM reach r JOIN both_ b ON r.other = b.src),
comp AS (SELECT node, min(other) AS c FROM reach GROUP BY node), size AS (SELECT c, count(*) AS n FROM comp GROUP BY c),
k AS (SELECT p.*, f.src IS NOT NULL AS fw, b.src IS NOT NULL AS bw, x.c AS cl, y.c AS cr, sx.n AS nl, sy.n AS nr FROM pairs p
  LEFT JOIN imports f ON f.src = "left" AND f.dst = "right" LEFT JOIN imports b ON b.src = "right" AND b.dst = "left"
  JOIN comp x ON x.node = "left" JOIN comp y ON y.node = "right" JOIN size sx ON sx.c = x.c JOIN size sy ON sy.c = y.c WHERE distance >= 2)
SELECT "left", "right", shared, CASE WHEN fw OR bw THEN 'leaky_interface' ELSE 'hidden_coupling' END AS kind,
  CASE WHEN fw THEN "right" WHEN bw THEN "left" END AS interface FROM k
WHERE NOT (fw AND bw) AND (fw OR bw OR (cl <> cr AND least(nl, nr) <= 4096))""")
def change_leakage(spark: SparkSession, sf: str) -> DataFrame:
    c = B.order_changes(spark, sf)
    files = graph.written(c.where("role = 'primary' AND trust = 'trusted'").select("path").distinct(), "files")
    k = files.withColumn("k", F.substring_index("path", "/p", -1).cast("long"))
    imports = k.where("k % 3 > 0").select(F.col("path").alias("src"), (F.col("k") + 1).alias("k")).join(
        k.select(F.col("path").alias("dst"), "k"), "k").select("src", "dst")
    imports = graph.written(imports, "imports")
    return leakage.leakage(history.file_coupling(c, _LOOSE), imports, imports, files, _LEAK).select("left", "right", "shared", "kind", "interface")


_LINKS = """w(src, dst, d) AS (SELECT src, dst, 1::BIGINT FROM edges UNION SELECT w.src, e.dst, d + 1 FROM w JOIN edges e ON w.dst = e.src WHERE d < {most}),
far AS (SELECT src, dst, min(d) AS d FROM w WHERE src <> dst GROUP BY 1, 2),
both_ AS (SELECT "left", "right", f.d AS there, b.d AS back FROM pairs LEFT JOIN far f ON f.src = "left" AND f.dst = "right" LEFT JOIN far b ON b.src = "right" AND b.dst = "left"),
way AS (SELECT *, there IS NULL OR coalesce(back < there, false) AS turned FROM both_),
best AS (SELECT *, CASE WHEN turned THEN back ELSE there END AS steps, CASE WHEN turned THEN "right" ELSE "left" END AS a, CASE WHEN turned THEN "left" ELSE "right" END AS b FROM way)
SELECT "left", "right", CASE WHEN steps = 1 THEN 'direct' WHEN steps > 1 THEN 'indirect' ELSE 'none' END AS link, coalesce(steps, 0) AS steps,
  CASE WHEN steps > 1 THEN (SELECT min(e.dst) FROM edges e JOIN far f ON f.src = e.dst AND f.dst = best.b WHERE e.src = best.a AND f.d = best.steps - 1) END AS first_hop FROM best"""


@query(f"""WITH RECURSIVE {B.nation_edges_sql(200)}, pairs AS (SELECT a.n_nationkey::BIGINT AS "left", b.n_nationkey::BIGINT AS "right" FROM nation a JOIN nation b
  ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey), {_LINKS.format(most=25)}""")
def link_classes(spark: SparkSession, sf: str) -> DataFrame:
    n = B.table(spark, sf, "nation")
    a = n.select(F.col("n_nationkey").cast("long").alias("left"), "n_regionkey")
    b = n.select(F.col("n_nationkey").cast("long").alias("right"), "n_regionkey")
    return leakage.link_class(a.join(b, "n_regionkey").where("left < right").select("left", "right"), B.nation_edges(spark, sf, 200))


@query(f"""WITH RECURSIVE n AS (SELECT n_nationkey::BIGINT AS k, (n_nationkey * 7 % 25)::BIGINT AS other FROM nation),
edges AS (SELECT k AS src, k + 1 AS dst FROM n WHERE k < 24 UNION SELECT k, k - 6 FROM n WHERE k % 12 = 11),
pairs AS (SELECT least(k, other) AS "left", greatest(k, other) AS "right" FROM n WHERE k <> other GROUP BY ALL), {_LINKS.format(most=25)}""")
def long_links(spark: SparkSession, sf: str) -> DataFrame:
    """Link classes over a chain of nations with a few ways back: paths of up to two dozen edges."""
    n = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), (F.col("n_nationkey") * 7 % 25).cast("long").alias("other"))
    edges = n.where("k < 24").select(F.col("k").alias("src"), (F.col("k") + 1).alias("dst")).union(n.where("k % 12 = 11").select("k", F.col("k") - 6))
    pairs = n.where("k <> other").select(F.least("k", "other").alias("left"), F.greatest("k", "other").alias("right")).distinct()
    return leakage.link_class(pairs, edges)


@query("""WITH f AS (SELECT p_partkey, 'lib/' || p_brand || '/' || CASE WHEN p_partkey % 40 = 0 THEN 'index.js' ELSE 'p' || p_partkey || '.js' END AS path FROM part),
used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01')
SELECT DISTINCT path FROM f WHERE p_partkey NOT IN (SELECT l_partkey FROM used) AND p_partkey % 40 <> 0 AND p_partkey % 50 <> 1""")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 40 == 0, "index.js").otherwise(F.concat(F.lit("p"), "p_partkey", F.lit(".js")))
    f = p.select("p_partkey", F.concat(F.lit("lib/"), "p_brand", F.lit("/"), name).alias("path"))
    li = B.table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz"))
    edges = li.select(F.col("l_partkey").alias("p_partkey")).distinct().join(f, "p_partkey").select(F.lit("main").alias("src"), F.col("path").alias("dst"))
    return graph.orphans(f.select("path").distinct(), edges, f.where("p_partkey % 50 = 1").select("path"))


@query("""SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, l_returnflag AS relation, count(*) AS references,
  list_sort(list_distinct(list(l_orderkey)))[1] AS first_location FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3""")
def dependency_edges(spark: SparkSession, sf: str) -> DataFrame:
    li, o, c, s = (B.table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    r = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
         .select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"),
                 F.col("l_returnflag").alias("relation"), F.col("l_orderkey").alias("line")))
    return graph.deduplicated(r, "relation").select("src", "dst", "relation", "references", F.get("locations", F.lit(0)).alias("first_location"))


@query(f"""WITH {_E} SELECT s.n_regionkey::BIGINT AS from_package, t.n_regionkey::BIGINT AS to_package, count(*) AS file_pairs, sum(refs)::BIGINT AS references
FROM edges JOIN nation s ON src = s.n_nationkey JOIN nation t ON dst = t.n_nationkey WHERE s.n_regionkey <> t.n_regionkey GROUP BY 1, 2""")
def package_edges(spark: SparkSession, sf: str) -> DataFrame:
    n = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("package"))
    return graph.package_edges(B.nation_edges(spark, sf), n)


@query("""SELECT CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'context' WHEN p_size % 5 = 0 THEN 'context' WHEN l_returnflag = 'R' THEN 'ownership'
  WHEN l_tax < 0.02 THEN 'unresolved' WHEN l_tax < 0.03 THEN 'ambiguous' WHEN l_tax < 0.04 THEN 'asset' WHEN l_linestatus = 'O' THEN 'external' ELSE 'internal' END AS bucket,
  count(*) AS references FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def dependency_coverage(spark: SparkSession, sf: str) -> DataFrame:
    li, p = B.table(spark, sf, "lineitem"), B.table(spark, sf, "part")
    x = li.join(p, li.l_partkey == p.p_partkey)
    bucket = (F.when(F.col("p_type").isin("SMALL", "ECONOMY") | (F.col("p_size") % 5 == 0), "context")  # role and trust come first
              .when(F.col("l_returnflag") == "R", "ownership").when(F.col("l_tax") < 0.02, "unresolved").when(F.col("l_tax") < 0.03, "ambiguous")
              .when(F.col("l_tax") < 0.04, "asset").when(F.col("l_linestatus") == "O", "external").otherwise("internal"))
    return x.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("references"))


_HALVES = (f"{B.nation_edges_sql(120, 'eb', f'o_orderdate < TIMESTAMP {chr(39)}{_CUT}{chr(39)}')}, "
           f"{B.nation_edges_sql(120, 'ea', f'o_orderdate >= TIMESTAMP {chr(39)}{_CUT}{chr(39)}')}")


@query(f"""WITH {_HALVES} SELECT coalesce(b.src, a.src) AS src, coalesce(b.dst, a.dst) AS dst,
  CASE WHEN b.refs IS NULL THEN 'added' WHEN a.refs IS NULL THEN 'removed' ELSE 'changed' END AS kind, b.refs AS before_refs, a.refs AS after_refs
FROM eb b FULL JOIN ea a ON a.src = b.src AND a.dst = b.dst WHERE a.refs IS DISTINCT FROM b.refs""")
def relation_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return graph.relation_changes(B.nation_edges(spark, sf, 120, until=_CUT), B.nation_edges(spark, sf, 120, since=_CUT))


def _cycle_sql(reach: str, edges: str, name: str) -> str:
    return f"""{name}n AS (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges}), {name}s AS (SELECT node, least(node, coalesce(
  (SELECT min(a.dst) FROM {reach} a JOIN {reach} b ON a.src = b.dst AND a.dst = b.src WHERE a.src = node), node))::BIGINT AS component FROM {name}n),
{name}c AS (SELECT * FROM {name}s WHERE component IN (SELECT component FROM {name}s GROUP BY component HAVING count(*) > 1))"""


@query(f"""WITH RECURSIVE eb AS (SELECT p_partkey AS src, p_partkey // 8 * 8 + (p_partkey * 5 + p_size) % 8 AS dst FROM part),
ea AS (SELECT p_partkey AS src, p_partkey // 8 * 8 + (p_partkey * 5 + p_size // 3) % 8 AS dst FROM part),
rb(src, dst) AS (SELECT src, dst FROM eb UNION SELECT r.src, e.dst FROM rb r JOIN eb e ON r.dst = e.src),
ra(src, dst) AS (SELECT src, dst FROM ea UNION SELECT r.src, e.dst FROM ra r JOIN ea e ON r.dst = e.src),
{_cycle_sql("rb", "eb", "x")}, {_cycle_sql("ra", "ea", "y")}
SELECT component, count(*) AS size, 'removed' AS kind FROM xc GROUP BY component HAVING bool_and(node NOT IN (SELECT node FROM yc))
UNION ALL SELECT component, count(*), 'added' FROM yc GROUP BY component HAVING bool_and(node NOT IN (SELECT node FROM xc))""")
def cycle_comparison(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    k = F.col("p_partkey")
    side = lambda size: graph.written(graph.cycles(p.select(
        k.alias("src"), (F.floor(k / 8) * 8 + (k * 5 + size) % 8).cast("long").alias("dst"))), "cycles")
    return diff.cycle_changes(side(F.col("p_size")), side(F.floor(F.col("p_size") / 3)))


_SIG = {"cognitive": "cognitive", "cyclomatic": "cyclomatic", "logical_lines": "logical_lines", "max_nesting": "nesting", "parameter_count": "parameters"}
_SNAP = ", ".join(f"('{n}', r_{s})" for s, n in _SIG.items())
_GATE = f"""sig AS (SELECT path, start_line % 2 AS side, unnest([{', '.join(f"{{'s': '{n}', 'r': r_{s}}}" for s, n in _SIG.items())}]) AS x FROM assessed WHERE affects_verdict),
snap AS (SELECT path, side, x.s AS signal, sum((x.r = 2)::BIGINT)::BIGINT AS high, sum((x.r = 1)::BIGINT)::BIGINT AS watch FROM sig WHERE x.r > 0 GROUP BY ALL),
gate AS (SELECT coalesce(b.path, o.path) AS path, coalesce(b.signal, o.signal) AS signal, coalesce(b.high, 0) AS high_b, coalesce(b.watch, 0) AS watch_b,
  coalesce(o.high, 0) AS high_o, coalesce(o.watch, 0) AS watch_o FROM (SELECT * FROM snap WHERE side = 0) b FULL JOIN (SELECT * FROM snap WHERE side = 1) o
  ON b.path = o.path AND b.signal = o.signal)"""


def _gate(spark: SparkSession, sf: str) -> DataFrame:
    a = assessed(spark, sf)
    return diff.gate(ratings.gate_snapshot(a.where("start_line % 2 = 0")), ratings.gate_snapshot(a.where("start_line % 2 = 1")))


@query(f"""WITH {ASSESSED}, {_GATE} SELECT *, CASE WHEN high_o > high_b OR watch_o > watch_b THEN 'regression'
  WHEN high_o < high_b OR watch_o < watch_b THEN 'improvement' ELSE 'unchanged' END AS outcome FROM gate""")
def gate_compare(spark: SparkSession, sf: str) -> DataFrame:
    return _gate(spark, sf)


@query(f"""WITH {ASSESSED}, {_GATE}, gone AS (SELECT signal, high_b AS high, watch_b AS watch, min(path) AS from_path FROM gate
  WHERE high_o = 0 AND watch_o = 0 AND (high_b > 0 OR watch_b > 0) GROUP BY 1, 2, 3 HAVING count(*) = 1),
came AS (SELECT signal, high_o AS high, watch_o AS watch, min(path) AS to_path FROM gate WHERE high_b = 0 AND watch_b = 0 AND (high_o > 0 OR watch_o > 0)
  GROUP BY 1, 2, 3 HAVING count(*) = 1) SELECT * FROM gone JOIN came USING (signal, high, watch)""")
def gate_moves(spark: SparkSession, sf: str) -> DataFrame:
    return diff.gate_moves(_gate(spark, sf))


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = B.table(spark, sf, "documents").select(
        F.col("doc_id").alias("uid"), F.col("source").alias("path"), F.concat_ws("-", "lang", "n_chars").alias("declared"),
        F.when(F.col("lang") == "en", F.sha2(F.lower("text"), 256)).alias("anchor"), F.sha2("text", 256).alias("fingerprint"))
    return d.where("uid % 2 = 0"), d.where("uid % 2 = 1")


def _match_sql() -> str:
    out = ["""u0 AS (SELECT doc_id AS uid, source AS path, concat_ws('-', lang, n_chars::VARCHAR) AS declared,
  CASE WHEN lang = 'en' THEN lower(text) END AS anchor, text AS fingerprint FROM documents)""",
           "b0 AS (SELECT * FROM u0 WHERE uid % 2 = 0), a0 AS (SELECT * FROM u0 WHERE uid % 2 = 1)"]
    passes = (("declared", "path, declared"), ("anchor", "path, anchor"), ("fingerprint", "path, fingerprint"), ("moved_declared", "declared"),
              ("moved_fingerprint", "fingerprint"))
    for k, (name, keys) in enumerate(passes, 1):
        known = " AND ".join(f"{c} IS NOT NULL" for c in keys.split(", "))
        one = lambda side, known=known, keys=keys: f"(SELECT {keys}, min(uid) AS uid FROM {side} WHERE {known} GROUP BY ALL HAVING count(*) = 1)"
        n = lambda side, c, known=known, keys=keys: f"(SELECT {keys}, count(*) AS {c}, count(*) - count(fingerprint) AS {c}0 FROM {side} WHERE {known} GROUP BY {keys})"
        out.append(f"p{k} AS (SELECT x.uid AS before_uid, y.uid AS after_uid, '{name}' AS pass FROM {one(f'b{k - 1}')} x JOIN {one(f'a{k - 1}')} y USING ({keys}))")
        for s, c in (("b", "before_uid"), ("a", "after_uid")):
            out.append(f"{s}r{k} AS (SELECT * FROM {s}{k - 1} WHERE uid NOT IN (SELECT {c} FROM p{k}))")
        if name in ("declared", "anchor"):
            wait = " AND x0 + y0 > 0" if name == "anchor" else ""
            out.append(f"t{k} AS (SELECT {keys} FROM {n(f'br{k}', 'x')} JOIN {n(f'ar{k}', 'y')} USING ({keys}) WHERE (x > 1 OR y > 1){wait})")
            out += [f"{s}{k} AS (SELECT * FROM {s}r{k} ANTI JOIN t{k} USING ({keys}))" for s in "ba"]
        else:
            out += [f"{s}{k} AS (SELECT * FROM {s}r{k})" for s in "ba"]
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, 6))


@query(_match_sql())
def unit_matching(spark: SparkSession, sf: str) -> DataFrame:
    return diff.match_units(*_sides(spark, sf))


_SIDES = """u AS (SELECT doc_id AS uid, source AS path, text AS fp FROM documents)"""


@query(f"""WITH {_SIDES}, b AS (SELECT fp, min(uid) AS before_uid FROM u WHERE uid % 2 = 0 GROUP BY fp HAVING count(*) = 1),
a AS (SELECT fp, min(uid) AS after_uid FROM u WHERE uid % 2 = 1 GROUP BY fp HAVING count(*) = 1) SELECT before_uid, after_uid FROM b JOIN a USING (fp)""")
def moved_units(spark: SparkSession, sf: str) -> DataFrame:
    return diff.match_pass(*_sides(spark, sf), "fingerprint")[0]


@query(f"""WITH {_SIDES}, g AS (SELECT fp, count(*) FILTER (uid % 2 = 0) AS n_before, count(*) FILTER (uid % 2 = 1) AS n_after FROM u GROUP BY fp)
SELECT sha256(fp) AS fingerprint, n_before, n_after FROM g WHERE n_before > 0 AND n_after > 0 AND (n_before > 1 OR n_after > 1)""")
def ambiguous_units(spark: SparkSession, sf: str) -> DataFrame:
    return diff.contests(*_sides(spark, sf), "fingerprint")


_ONE = """t AS (SELECT l_orderkey * 100000 + l_partkey * 8 + l_linenumber AS uid, 's' || l_suppkey AS path, l_returnflag AS kind, (l_linenumber % 3)::BIGINT AS rating,
  l_quantity >= 25 AS anonymous, l_shipdate < TIMESTAMP '1998-01-01' AS early FROM lineitem),
u AS (SELECT uid, any_value(path) AS path, any_value(kind) AS kind, any_value(rating) AS rating, any_value(anonymous) AS anonymous, any_value(early) AS early FROM t GROUP BY uid HAVING count(*) = 1)"""


@query(f"""WITH {_ONE}, n AS (SELECT path, kind, rating, least(count(*) FILTER (early), count(*) FILTER (NOT early)) AS budget FROM u WHERE anonymous GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY early, anonymous, path, kind, rating ORDER BY uid) AS nth FROM u)
SELECT uid, path, kind, rating, CASE WHEN early THEN 'removed' ELSE 'added' END AS comparison, anonymous AND nth <= coalesce(budget, 0) AS withheld
FROM r LEFT JOIN n USING (path, kind, rating)""")
def one_sided_units(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    u = li.select((F.col("l_orderkey") * 100000 + F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("uid"), F.concat(F.lit("s"), "l_suppkey").alias("path"),
                  F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") % 3).cast("long").alias("rating"), (F.col("l_quantity") >= 25).alias("anonymous"),
                  (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("early"))
    one = u.groupBy("uid").agg(*[F.first(c).alias(c) for c in ("path", "kind", "rating", "anonymous", "early")], F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return diff.one_sided(one.where("early").drop("early"), one.where("NOT early").drop("early"))


@query(f"""WITH {ASSESSED}, x AS (SELECT path, max(r_cognitive) AS rb, min(r_cognitive) AS ra, sum((rating = 2)::BIGINT)::BIGINT AS worse, sum((rating = 0)::BIGINT)::BIGINT AS better,
  sum((rating = 1)::BIGINT)::BIGINT AS changed FROM assessed GROUP BY path)
SELECT path, worse, better, changed, CASE WHEN worse > 0 AND better > 0 THEN 'mixed' WHEN worse > 0 THEN 'worse' WHEN better > 0 THEN 'better'
  WHEN changed > 0 THEN 'changed' ELSE 'no_debt_change' END AS tier FROM x""")
def debt_movement(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda k: F.sum((F.col("rating") == k).cast("long"))
    c = assessed(spark, sf).groupBy("path").agg(n(2).alias("worse"), n(0).alias("better"), n(1).alias("changed"))
    return c.withColumn("tier", diff.debt_tier(c))


_PAIRED = """p AS (SELECT b.l_orderkey AS k, b.l_linenumber AS n, b.l_quantity::BIGINT AS cb, a.l_quantity::BIGINT AS ca, (b.l_partkey % 30)::BIGINT AS yb, (a.l_partkey % 30)::BIGINT AS ya
  FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1) b JOIN (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1) a
  ON a.l_orderkey = b.l_orderkey + 1 AND a.l_linenumber = b.l_linenumber)"""


@query(f"""WITH {_PAIRED}, r AS (SELECT *, greatest({_rate('cb', 15, 25)}, {_rate('yb', 11, 21)}) AS rb, greatest({_rate('ca', 15, 25)}, {_rate('ya', 11, 21)}) AS ra,
  ca > cb OR ya > yb AS up, ca < cb OR ya < yb AS down FROM p)
SELECT k, n, CASE WHEN ra > rb THEN 'regressed' WHEN ra < rb THEN 'improved' WHEN NOT up AND NOT down THEN 'unchanged' WHEN rb = 0 THEN 'metric_changed'
  WHEN up AND NOT down THEN 'regressed' WHEN down AND NOT up THEN 'improved' ELSE 'metric_changed' END AS kind FROM r""")
def rating_movement(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    one = (li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c"), F.first("l_quantity").cast("long").alias("cognitive"),
                                                        (F.first("l_partkey") % 30).cast("long").alias("cyclomatic")).where("c = 1"))
    s = ("cognitive", "cyclomatic")
    b = one.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), *[F.col(c).alias(f"{c}_before") for c in s])
    a = one.select((F.col("l_orderkey") - 1).alias("k"), F.col("l_linenumber").alias("n"), *[F.col(c).alias(f"{c}_after") for c in s])
    r = lambda side: F.greatest(*[ratings.rating(F.col(f"{c}_{side}"), _LIMITS[c]) for c in s])
    return b.join(a, ["k", "n"]).select("k", "n", diff.pair_kind(r("before"), r("after"), s).alias("kind"))


@query(r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1) AS path FROM pages), q AS (SELECT path, lower(path) AS low, string_split(lower(path), '/') AS c FROM p)
SELECT path, CASE WHEN list_has_any(c, ['fixture', 'fixtures', 'testdata', '__fixtures__']) THEN 'fixture'
  WHEN list_has_any(c, ['bench', 'benches', 'benchmark', 'benchmarks']) OR contains(c[-1], 'bench') THEN 'benchmark'
  WHEN list_has_any(c, ['example', 'examples']) THEN 'example' WHEN list_has_any(c, ['generated', 'gen', 'dist', 'build', 'coverage', 'tmp']) OR regexp_matches(c[-1], '\.generated\.(rs|ts|js)$') THEN 'generated'
  WHEN list_has_any(c, ['test', 'tests', 'spec', 'specs']) OR regexp_matches(c[-1], '_test\.|\.test\.|\.spec\.') THEN 'test' ELSE 'primary' END AS role FROM q""")
def role_by_path(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^?#]*)", 1).alias("path")).distinct()
    return p.select("path", F.coalesce(paths.generic_role(F.col("path")), F.lit("primary")).alias("role"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)
SELECT page_id, regexp_matches(path, '^[^/]*\.example\.com/[^/]*/[^/]*$') AS one_level, regexp_matches(path, '^.*/en/.*$') AS english,
  regexp_matches(path, '^[^/]*/[^/][^/]/[0-9]*$') AND regexp_matches(path, '^[^/]*/[^/][^/]/[^/]*$') AS short FROM p""")
def glob_match(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"))
    c = F.col("path")
    return p.select("page_id", paths.glob(c, "*.example.com/*/*").alias("one_level"), paths.glob(c, "**/en/**").alias("english"),
                    (paths.glob(c, "*/??/*") & c.rlike(r"^[^/]*/[^/][^/]/[0-9]*\z")).alias("short"))


@query(f"""WITH {B.SUPPLIERS}, s AS (SELECT suppkey, string_split(path, '/') AS c FROM suppliers)
SELECT a.suppkey AS a, b.suppkey AS b, (CASE WHEN a.c[1] <> b.c[1] THEN 4 WHEN a.c[2] <> b.c[2] THEN 2 ELSE 0 END)::BIGINT AS distance
FROM s a JOIN s b ON b.suppkey = a.suppkey + 1""")
def directory_distance(spark: SparkSession, sf: str) -> DataFrame:
    s = B.suppliers(spark, sf)
    a = s.select(F.col("suppkey").alias("a"), F.col("path").alias("pa"), (F.col("suppkey") + 1).alias("b"))
    j = a.join(s.select(F.col("suppkey").alias("b"), F.col("path").alias("pb")), "b")
    return j.select("a", "b", history.distance(history.directory(F.col("pa")), history.directory(F.col("pb"))).alias("distance"))


@query(f"""WITH {B.SUPPLIERS}, roots AS (SELECT 'r' || r_regionkey AS package FROM region UNION SELECT '.' UNION SELECT 'r' || n_regionkey || '/n' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0)
SELECT path, CASE WHEN package IN (SELECT * FROM roots) THEN package ELSE split_part(path, '/', 1) END AS package FROM suppliers""")
def nearest_package(spark: SparkSession, sf: str) -> DataFrame:
    r, n = B.table(spark, sf, "region"), B.table(spark, sf, "nation")
    roots = (r.select(F.concat(F.lit("r"), "r_regionkey").alias("package")).union(spark.createDataFrame([(".",)], "package string"))
             .union(n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey"))))
    return paths.nearest_package(B.suppliers(spark, sf), roots)


_FACTS = f"""h AS (SELECT path, any_value(package) AS package, sum((rating = 1 AND affects_verdict)::BIGINT)::BIGINT AS watch, sum((rating = 2 AND affects_verdict)::BIGINT)::BIGINT AS high,
  sum((rating > 0)::BIGINT)::BIGINT AS findings, (sum(logical_lines) >= 600)::BIGINT AS sizes, count(DISTINCT ordinal) AS fan_out, count(DISTINCT start_line % 50) AS fan_in, count(*) AS touches
  FROM assessed GROUP BY path),
m AS (SELECT package, quantile_disc(fan_in, 0.5) AS median_in, quantile_disc(fan_out, 0.5) AS median_out FROM h GROUP BY package),
f AS (SELECT h.*, median_in, median_out, touches >= 610 AS hot, 0 AS followers FROM h JOIN m USING (package)),
cards AS (SELECT *, CASE WHEN (high >= 3 OR (high >= 1 AND high + watch >= 6)) AND sizes > 0 AND touches % 3 = 0 THEN 'god_file'
  WHEN ((fan_in >= 8 AND (median_in = 0 OR fan_in >= 4 * median_in)) OR (fan_out >= 8 AND (median_out = 0 OR fan_out >= 4 * median_out))) AND (high + watch = 0 OR hot) THEN 'hub'
  WHEN high > 0 AND hot THEN 'hot_mess' WHEN findings > 0 OR (sizes > 0 AND touches % 3 = 0) THEN 'measured' END AS pattern FROM f)"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("affects_verdict")
    n = lambda c: F.sum(c.cast("long"))
    h = assessed(spark, sf).groupBy("path").agg(
        F.first("package").alias("package"), n(v & (F.col("rating") == 1)).alias("watch"), n(v & (F.col("rating") == 2)).alias("high"),
        n(F.col("rating") > 0).alias("findings"), (F.sum("logical_lines") >= 600).alias("large"), F.countDistinct("ordinal").alias("fan_out"),
        F.countDistinct(F.col("start_line") % 50).alias("fan_in"), F.count(F.lit(1)).alias("touches"))
    h = h.withColumn("sizes", (F.col("large") & (F.col("touches") % 3 == 0)).cast("long"))
    h = h.withColumn("hot", F.col("touches") >= 610).withColumn("followers", F.lit(0)).withColumn("reach", F.lit(None).cast("long"))
    h = graph.written(h, "facts")  # read by the join and by the medians
    return h.join(problems.degree_medians(h), "package")


@query(f"""WITH {ASSESSED}, {_FACTS} SELECT path, pattern, CASE WHEN pattern IN ('god_file', 'hot_mess') OR high > 0 THEN 2 WHEN watch > 0 OR (sizes > 0 AND touches % 3 = 0) THEN 1 ELSE 0 END::BIGINT AS rating
FROM cards WHERE pattern IS NOT NULL""")
def problem_cards(spark: SparkSession, sf: str) -> DataFrame:
    return problems.file_cards(_facts(spark, sf), ProblemPolicy(god_fan_out=1 << 40)).select("path", "pattern", "rating")


@query(f"""WITH {ASSESSED}, {_FACTS}, c AS (SELECT *, CASE WHEN pattern IN ('god_file', 'hot_mess') OR high > 0 THEN 2 WHEN watch > 0 OR (sizes > 0 AND touches % 3 = 0) THEN 1 ELSE 0 END AS rating,
  CASE pattern WHEN 'god_file' THEN 2 WHEN 'hub' THEN 3 WHEN 'hot_mess' THEN 4 ELSE 8 END AS klass FROM cards WHERE pattern IS NOT NULL)
SELECT path, pattern, row_number() OVER (ORDER BY rating DESC, high DESC, hot DESC, high + watch DESC, klass, path) AS rank FROM c QUALIFY rank <= 20""")
def problem_rank(spark: SparkSession, sf: str) -> DataFrame:
    return problems.rank(problems.file_cards(_facts(spark, sf), ProblemPolicy(god_fan_out=1 << 40)), 20).select("path", "pattern", "rank")


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS k, p_type IN ('STANDARD', 'MEDIUM', 'PROMO') AS prim FROM part),
d AS (SELECT DISTINCT p_partkey // 3 AS owner, p_partkey AS k, p_size % 3 > 0 AS test FROM part WHERE p_size % 7 > 0),
s1 AS (SELECT k FROM f WHERE prim AND k IN (SELECT k FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = f.k AND NOT test)),
s2 AS (SELECT k FROM f WHERE prim AND k IN (SELECT k FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = f.k AND NOT test AND owner NOT IN (SELECT k FROM s1))),
s3 AS (SELECT k FROM f WHERE prim AND k IN (SELECT k FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = f.k AND NOT test AND owner NOT IN (SELECT k FROM s2))),
s4 AS (SELECT k FROM f WHERE prim AND k IN (SELECT k FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = f.k AND NOT test AND owner NOT IN (SELECT k FROM s3))),
s5 AS (SELECT k FROM f WHERE prim AND k IN (SELECT k FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = f.k AND NOT test AND owner NOT IN (SELECT k FROM s4))),
s6 AS (SELECT k FROM f WHERE prim AND k IN (SELECT k FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = f.k AND NOT test AND owner NOT IN (SELECT k FROM s5))),
s7 AS (SELECT k FROM f WHERE prim AND k IN (SELECT k FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = f.k AND NOT test AND owner NOT IN (SELECT k FROM s6))),
s8 AS (SELECT k FROM f WHERE prim AND k IN (SELECT k FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = f.k AND NOT test AND owner NOT IN (SELECT k FROM s7))),
s9 AS (SELECT k FROM f WHERE prim AND k IN (SELECT k FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = f.k AND NOT test AND owner NOT IN (SELECT k FROM s8))),
s10 AS (SELECT k FROM f WHERE prim AND k IN (SELECT k FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = f.k AND NOT test AND owner NOT IN (SELECT k FROM s9)))
SELECT k AS path FROM s10""")
def test_demotion(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    files = p.select(F.col("p_partkey").alias("path"), F.when(F.col("p_type").isin("STANDARD", "MEDIUM", "PROMO"), "primary").otherwise("test").alias("role"))
    decl = p.where("p_size % 7 > 0").select(F.floor(F.col("p_partkey") / 3).alias("owner"), F.col("p_partkey").alias("path"), (F.col("p_size") % 3 > 0).alias("test"))
    return graph.test_demotion(files, decl.distinct())


_MEMBERS = "members AS (SELECT DISTINCT node, node % 1000 AS package FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges))"
_CLOSE = replace(GraphPolicy(), closure_min=4)


@query(f"""WITH RECURSIVE {_SPARSE}, {_MEMBERS}, size AS (SELECT package, count(*) AS files FROM members GROUP BY package HAVING count(*) >= 4 AND count(*) <= 4096),
e2 AS (SELECT src, dst FROM edges WHERE src % 1000 = dst % 1000 AND src % 1000 IN (SELECT package FROM size)),
reach(src, dst) AS (SELECT src, dst FROM e2 UNION SELECT r.src, e.dst FROM reach r JOIN e2 e ON r.dst = e.src),
n AS (SELECT m.package, files, m.node, 1 + (SELECT count(*) FROM reach WHERE dst = m.node AND src <> m.node) AS reach FROM members m JOIN size USING (package))
SELECT package, files, node, reach FROM n QUALIFY row_number() OVER (PARTITION BY package ORDER BY reach DESC, node) = 1""")
def package_closures(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.written(_sparse(spark, sf), "sparse")
    m = graph.nodes(e).withColumn("package", F.col("node") % 1000)
    return comparisons.package_closures(e, m, _CLOSE)


_TOP = "o AS (SELECT ts < TIMESTAMP '1998-01-01' AS early, package, contributor, count(DISTINCT commit) AS n FROM changes GROUP BY ALL), t AS (SELECT early, package, max(n) AS part, sum(n)::BIGINT AS whole FROM o GROUP BY ALL)"


@query(f"""WITH {B.ORDERS}, {_TOP}, b AS (SELECT * FROM t WHERE early), a AS (SELECT * FROM t WHERE NOT early)
SELECT coalesce(b.package, a.package) AS subject, CASE WHEN b.part IS NULL THEN 'introduced' WHEN a.part IS NULL THEN 'dissolved'
  WHEN a.part * b.whole > b.part * a.whole THEN 'worse' WHEN a.part * b.whole < b.part * a.whole THEN 'better' ELSE 'unchanged' END AS movement,
  b.part AS part_b, b.whole AS whole_b, a.part AS part_a, a.whole AS whole_a FROM b FULL JOIN a ON a.package = b.package""")
def share_movement(spark: SparkSession, sf: str) -> DataFrame:
    c, cut = B.order_changes(spark, sf), F.lit(_CUT).cast("timestamp_ntz")
    side = lambda d: history.ownership(d, "package").select(
        F.col("package").alias("subject"), F.col("top_commits").alias("part"), F.col("commits").alias("whole"))
    return comparisons.fraction_movement(side(c.where(F.col("ts") < cut)), side(c.where(F.col("ts") >= cut)))


@query(f"""WITH {_HALVES}, b AS (SELECT DISTINCT src, dst FROM eb), a AS (SELECT DISTINCT src, dst FROM ea)
SELECT src, dst, 'removed' AS movement FROM (FROM b EXCEPT FROM a) UNION ALL SELECT src, dst, 'introduced' FROM (FROM a EXCEPT FROM b)""")
def edge_movement(spark: SparkSession, sf: str) -> DataFrame:
    return comparisons.key_movement(B.nation_edges(spark, sf, 120, until=_CUT), B.nation_edges(spark, sf, 120, since=_CUT), "src", "dst")


@query(f"""WITH {_HALVES}, p AS (SELECT a.n_nationkey::BIGINT AS "left", b.n_nationkey::BIGINT AS "right" FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey),
x AS (SELECT "left", "right", EXISTS (SELECT 1 FROM eb WHERE least(src, dst) = "left" AND greatest(src, dst) = "right") AS b,
  EXISTS (SELECT 1 FROM ea WHERE least(src, dst) = "left" AND greatest(src, dst) = "right") AS a FROM p)
SELECT "left", "right", CASE WHEN b THEN 'introduced' ELSE 'dissolved' END AS movement FROM x WHERE a <> b""")
def evolution_comparison(spark: SparkSession, sf: str) -> DataFrame:
    n = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    pairs = n.select(F.col("k").alias("left")).join(n.select(F.col("k").alias("right")), F.col("left") < F.col("right"))
    return comparisons.explanation_flips(pairs, B.nation_edges(spark, sf, 120, until=_CUT), B.nation_edges(spark, sf, 120, since=_CUT))


@query("""WITH f AS (SELECT p_partkey AS k, 'web/' || p_brand || '/' || CASE WHEN p_partkey % 40 = 0 THEN 'index.js' ELSE 'p' || p_partkey || CASE WHEN p_size % 4 = 0 THEN '.ts' ELSE '.js' END END AS path,
  p_size % 3 = 0 AS module FROM part)
SELECT DISTINCT path FROM f WHERE path LIKE '%.js' AND NOT module AND path NOT LIKE '%/index.js' AND k % 5 <> 0 AND k % 7 <> 0
  AND path NOT IN (SELECT path FROM f JOIN lineitem ON l_partkey = k WHERE l_shipdate >= TIMESTAMP '2001-06-01')""")
def dormant_files(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 40 == 0, "index.js").otherwise(
        F.concat(F.lit("p"), "p_partkey", F.when(F.col("p_size") % 4 == 0, ".ts").otherwise(".js")))
    f = p.select(F.col("p_partkey").alias("k"), F.concat(F.lit("web/"), "p_brand", F.lit("/"), name).alias("path"), (F.col("p_size") % 3 == 0).alias("module_syntax"))
    f = f.withColumn("language", paths.language(F.col("path")))
    li = B.table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz"))
    touched = f.join(li, f.k == li.l_partkey, "left_semi")
    return comparisons.dormant(f, f.where("k % 5 = 0"), f.where("k % 7 = 0"), touched).distinct()


_EVID = """files AS (SELECT p_brand AS package, p_partkey AS k, CASE WHEN p_type = 'LARGE' THEN 'test' ELSE 'primary' END AS role, CASE WHEN p_size = 50 AND p_partkey % 3 = 0 THEN 'advisory' ELSE 'trusted' END AS trust FROM part),
gaps AS (SELECT package FROM files WHERE role = 'primary' AND trust <> 'trusted' UNION SELECT package FROM files WHERE k % 97 = 0)"""


@query(f"WITH {_EVID} SELECT package FROM gaps")
def incomplete_packages(spark: SparkSession, sf: str) -> DataFrame:
    return comparisons.incomplete_packages(*_evidence(spark, sf))


@query(f"""WITH {_EVID} SELECT package, sum((package NOT IN (SELECT package FROM gaps))::BIGINT)::BIGINT AS stated,
  sum((package IN (SELECT package FROM gaps))::BIGINT)::BIGINT AS withheld FROM files GROUP BY package""")
def withheld_facts(spark: SparkSession, sf: str) -> DataFrame:
    files, outcomes = _evidence(spark, sf)
    return comparisons.withheld(files, comparisons.incomplete_packages(files, outcomes))


def _evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = B.table(spark, sf, "part")
    files = p.select(F.col("p_brand").alias("package"), F.col("p_partkey").alias("k"), F.when(F.col("p_type") == "LARGE", "test").otherwise("primary").alias("role"),
                     F.when((F.col("p_size") == 50) & (F.col("p_partkey") % 3 == 0), "advisory").otherwise("trusted").alias("trust"))
    return files, files.select("package", F.when(F.col("k") % 97 == 0, "unresolved").otherwise("resolved").alias("outcome"))


@query(f"""WITH {ASSESSED}, d AS (SELECT CASE rating WHEN 2 THEN 'worse' WHEN 1 THEN 'better' ELSE 'changed' END AS direction, path, start_line, ordinal, cognitive, cyclomatic FROM assessed),
r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY cognitive DESC, cyclomatic DESC, path, start_line, ordinal) AS nth FROM d)
SELECT direction, path, start_line, row_number() OVER (ORDER BY (nth > 1)::INT, cognitive DESC, cyclomatic DESC, path, start_line, ordinal) AS place FROM r QUALIFY place <= 6""")
def diff_screen(spark: SparkSession, sf: str) -> DataFrame:
    d = assessed(spark, sf).withColumn("direction", F.when(F.col("rating") == 2, "worse").when(F.col("rating") == 1, "better").otherwise("changed"))
    order = [F.desc("cognitive"), F.desc("cyclomatic"), F.asc("path"), F.asc("start_line"), F.asc("ordinal")]
    return comparisons.screen(d, order, 6).select("direction", "path", "start_line", "place")


@query(f"""WITH {ASSESSED}, sig AS (SELECT path, unnest([{', '.join(f"{{'s': '{n}', 'r': r_{s}}}" for s, n in _SIG.items())}]) AS x FROM assessed WHERE affects_verdict)
SELECT path, x.s AS signal, sum((x.r = 2)::BIGINT)::BIGINT AS high, sum((x.r = 1)::BIGINT)::BIGINT AS watch FROM sig WHERE x.r > 0 GROUP BY ALL""")
def gate_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.gate_snapshot(assessed(spark, sf))


_REFS = """files AS (SELECT DISTINCT 'lib/b' || p_size % 5 || '/p' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '.js' END AS path FROM part),
refs AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS ref_id, '../b' || l_linenumber % 5 || '/p' || l_partkey || '.js' || CASE WHEN l_tax > 0.05 THEN '?raw' ELSE '' END AS target FROM lineitem)"""


@query(f"""WITH {_REFS}, c AS (SELECT ref_id, 'lib/' || regexp_replace(substr(target, 4), '[?].*$', '') AS c FROM refs),
o AS (SELECT ref_id, c AS candidate, 0 AS pr FROM c UNION SELECT ref_id, regexp_replace(c, 'js$', 'ts'), 1 FROM c UNION SELECT ref_id, regexp_replace(c, 'js$', 'tsx'), 1 FROM c),
h AS (SELECT ref_id, pr, count(DISTINCT candidate) AS n, min(candidate) AS path FROM o JOIN files ON path = candidate GROUP BY 1, 2),
m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY pr) = 1), ids AS (SELECT DISTINCT ref_id FROM refs)
SELECT ref_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome, CASE WHEN n = 1 THEN path END AS path FROM ids LEFT JOIN m USING (ref_id)""")
def reference_resolution(spark: SparkSession, sf: str) -> DataFrame:
    p, li = B.table(spark, sf, "part"), B.table(spark, sf, "lineitem")
    k = F.col("p_partkey") % 4
    files = p.select(F.concat(F.lit("lib/b"), (F.col("p_size") % 5).cast("string"), F.lit("/p"), "p_partkey",
                              F.when(k == 0, ".ts").when(k == 1, ".tsx").otherwise(".js")).alias("path")).distinct()
    refs = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("ref_id"), F.lit("lib/x").alias("directory"), F.concat(
        F.lit("../b"), (F.col("l_linenumber") % 5).cast("string"), F.lit("/p"), "l_partkey", F.lit(".js"), F.when(F.col("l_tax") > 0.05, "?raw").otherwise("")).alias("target"))
    c = resolution.runtime_candidates(resolution.relative_candidates(refs))
    return resolution.unique_match(refs.select("ref_id").distinct(), c, files)


@query("""WITH packs AS (SELECT 'pkg' || (p_partkey * 2 // 3) AS manifest_name, p_brand AS package FROM part),
refs AS (SELECT l_orderkey * 8 + l_linenumber AS ref_id, CASE WHEN l_tax > 0.06 THEN 'npm' ELSE 'pkg' END || (l_partkey * 2 // 3) AS first FROM lineitem), ids AS (SELECT DISTINCT ref_id, first FROM refs),
n AS (SELECT manifest_name AS first, count(DISTINCT package) AS n, min(package) AS package FROM packs GROUP BY 1)
SELECT ref_id, CASE WHEN n IS NULL THEN 'external' WHEN n > 1 THEN 'ambiguous' ELSE 'package' END AS outcome, CASE WHEN n = 1 THEN package END AS package FROM ids LEFT JOIN n USING (first)""")
def manifest_resolution(spark: SparkSession, sf: str) -> DataFrame:
    p, li = B.table(spark, sf, "part"), B.table(spark, sf, "lineitem")
    packs = p.select(F.concat(F.lit("pkg"), F.expr("p_partkey * 2 div 3")).alias("manifest_name"), F.col("p_brand").alias("package"))
    refs = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("ref_id"),
                     F.concat(F.when(F.col("l_tax") > 0.06, "npm").otherwise("pkg"), F.expr("CAST(l_partkey * 2 div 3 AS STRING)"),
                              F.lit("/sub")).alias("target")).distinct()
    return resolution.manifest_match(refs, packs)


@query("SELECT event_type, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS changes, count(DISTINCT event_id) AS commits FROM events GROUP BY ALL")
def event_hotspots_stream(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.hotspots import daily_changes

    return daily_changes(spark, f"{sf}/events.parquet")


from . import architecture, cards, more  # noqa: E402, F401  (they add their queries)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
