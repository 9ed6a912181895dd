"""Queries of cards and verdict facts, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards as K
from ..operators import graph, history, ratings
from ..policy import HistoryPolicy
from . import bindings as B
from .queries import _E, _GATE, _PAIRS, _SCC, _SCOPES, _TIER, ASSESSED, _gate, _with_closure, assessed, query

_NONE = "NULL::BIGINT AS members, NULL::BIGINT AS reach, NULL::BIGINT AS hot"


@query(f"""{_with_closure(_E)}, {_SCC}, c AS (SELECT component, count(*) AS size FROM scc GROUP BY component HAVING count(*) > 1),
deg AS (SELECT node, (SELECT count(*) FROM edges WHERE dst = node) AS fan_in, (SELECT count(*) FROM edges WHERE src = node) AS fan_out FROM n),
r AS (SELECT node, (SELECT count(*) FROM reach WHERE dst = node AND src <> node) AS reach FROM n WHERE node % 2 = 1),
h AS (SELECT c_nationkey::BIGINT AS node, count(*) AS touches FROM customer GROUP BY 1),
top AS (SELECT avg(touches) AS a FROM h)
SELECT 'tangle' AS pattern, component::VARCHAR AS anchor, 2::BIGINT AS rating, size AS members,
  (SELECT r.reach FROM scc s JOIN r USING (node) WHERE s.component = c.component ORDER BY node LIMIT 1) AS reach,
  (SELECT max(touches) FROM scc s JOIN h USING (node), top WHERE s.component = c.component AND touches >= a) AS hot FROM c
UNION ALL SELECT 'unstable_dependency', src || '|' || dst, 1, {_NONE} FROM edges JOIN deg s ON s.node = src JOIN deg t ON t.node = dst
  WHERE refs >= 2 AND t.fan_out * (s.fan_in + s.fan_out) > s.fan_out * (t.fan_in + t.fan_out)""")
def graph_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Tangles and unstable dependencies of the nations' graph."""
    e = graph.written(B.nation_edges(spark, sf), "nations")
    reach = graph.reach_in(e).where("node % 2 = 1").select("node", (F.col("reach") - 1).alias("reach"))
    h = B.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("node")).agg(F.count(F.lit(1)).alias("touches"))
    hot = h.crossJoin(F.broadcast(h.agg(F.avg("touches").alias("a")))).where("touches >= a")  # one row
    c = graph.cycles(e).withColumn("rating", F.lit(2).cast("long"))
    unstable = graph.stable_violations(e).withColumn("rating", F.lit(1).cast("long"))
    return K.tangles(c, reach, hot).union(K.plain_cards(unstable, "unstable_dependency", "src", "dst"))


@query(f"""WITH {B.ORDERS}, {_PAIRS}, o AS (SELECT package, contributor, count(DISTINCT commit) AS n FROM changes GROUP BY ALL),
s AS (SELECT package, max(n) AS top, sum(n) AS total FROM o GROUP BY package)
SELECT 'shotgun_pair' AS pattern, "left" || '|' || "right" AS anchor, 1::BIGINT AS rating, {_NONE} FROM pairs WHERE shared >= 3 AND shared * 100 >= "union" * 1
  AND NOT ("left" = 'Brand#11' AND "right" = 'Brand#12')
UNION ALL SELECT 'bus_risk', package, 1, {_NONE} FROM s WHERE total >= 10 AND top * 100 >= total * 20""")
def history_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Shotgun pairs and bus risks of the orders' history."""
    c, p = B.order_changes(spark, sf), replace(HistoryPolicy(), finding_percent=1, concentration_percent=20)
    known = spark.createDataFrame([("Brand#12", "Brand#11")], "src string, dst string")
    one = F.lit(1).cast("long")
    pairs = history.unexplained(history.package_coupling(c, p), known, p).withColumn("rating", one)
    risk = history.concentration(history.ownership(c, "package"), p).withColumn("rating", one)
    return K.plain_cards(pairs, "shotgun_pair", "left", "right").union(K.plain_cards(risk, "bus_risk", "package"))


#: Files are suppliers; their findings are their rated units by (start line, ordinal), one leakage row per pair of neighbours.
_CLAIMS = f"""fnd AS (SELECT path, 'finding' AS source, start_line * 100000 + ordinal AS id, row_number() OVER (PARTITION BY path ORDER BY rating DESC, start_line, ordinal) AS rank, rating,
  affects_verdict AS affects FROM assessed WHERE rating = 2 AND cognitive >= 48 QUALIFY count(*) OVER (PARTITION BY path, start_line * 100000 + ordinal) = 1),
sz AS (SELECT path, 'size' AS source, 1::BIGINT AS id, 1 AS rank, 1 AS rating, false AS affects FROM assessed GROUP BY path HAVING sum(logical_lines) >= 600),
lk AS (SELECT path, 'leakage' AS source, suppkey + 1 AS id, 1 AS rank, 1 AS rating, false AS affects FROM suppliers WHERE suppkey % 3 = 0),
claims AS (SELECT * FROM fnd UNION ALL SELECT * FROM sz UNION ALL SELECT * FROM lk)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    a = assessed(spark, sf)
    f = a.where("rating = 2 AND cognitive >= 48").select("path", (F.col("start_line") * 100000 + F.col("ordinal")).alias("id"), "rating", "affects_verdict", "start_line", "ordinal")
    f = f.groupBy("path", "id").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("rating", "affects_verdict", "start_line", "ordinal")]).where("n = 1")
    w = F.row_number().over(K.Window.partitionBy("path").orderBy(F.desc("rating"), "start_line", "ordinal")).cast("long")
    f = f.select("path", F.lit("finding").alias("source"), "id", w.alias("rank"), "rating", F.col("affects_verdict").alias("affects"))
    one, no = F.lit(1).cast("long"), F.lit(False)
    z = a.groupBy("path").agg(F.sum("logical_lines").alias("n")).where("n >= 600").select("path", F.lit("size"), one, one, one, no)
    k = B.suppliers(spark, sf).where("suppkey % 3 = 0").select("path", F.lit("leakage"), (F.col("suppkey") + 1).cast("long"), one, one, no)
    return f.union(z).union(k)


@query(f"""WITH {ASSESSED}, {_CLAIMS}, h AS (SELECT path, count(*) AS touches FROM assessed GROUP BY path),
c AS (SELECT *, row_number() OVER (PARTITION BY path, source ORDER BY rank, id) AS nth FROM claims),
l AS (SELECT path, CASE WHEN source = 'finding' AND nth = 1 THEN 0 WHEN source = 'leakage' THEN 2 WHEN source = 'size' THEN 3 ELSE 5 END AS part, nth, source || ':' || id AS line FROM c
  UNION ALL SELECT path, 1, 0, 'units:' || touches FROM h WHERE path IN (SELECT path FROM claims) UNION ALL SELECT path, 4, 0, 'hot:' || touches FROM h WHERE touches % 2 = 0 AND path IN (SELECT path FROM claims))
SELECT path, max(rating)::BIGINT AS rating, CASE WHEN bool_or(affects OR source = 'leakage') THEN 'default' ELSE 'detail' END AS visibility,
  (SELECT string_agg(line, ' ' ORDER BY part, nth) FROM l WHERE l.path = c.path) AS evidence FROM c GROUP BY path""")
def card_evidence(spark: SparkSession, sf: str) -> DataFrame:
    claims = _claims(spark, sf)
    h = assessed(spark, sf).groupBy("path").agg(F.count(F.lit(1)).alias("touches")).join(claims.select("path").distinct(), "path", "left_semi")
    facts = h.select("path", F.concat(F.lit("units:"), F.col("touches").cast("string")).alias("text"), F.when(F.col("touches") % 2 == 0, F.col("touches")).alias("touches"))
    return K.evidence(claims, facts).withColumn("evidence", F.array_join("evidence", " "))


@query(f"""WITH {ASSESSED}, {_CLAIMS} SELECT source, count(*) AS findings, count(*) AS once, 0::BIGINT AS twice, 0::BIGINT AS missing FROM claims GROUP BY source""")
def claim_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Every finding is claimed once: claims read back from the assembled cards."""
    claims = _claims(spark, sf).withColumn("source", F.when(F.col("source") == "size", "size").otherwise(F.col("source")))
    shown = K.evidence(claims, claims.limit(0).select("path", F.lit("").alias("text"), F.lit(None).cast("long").alias("touches")))
    back = shown.select("path", F.explode("evidence").alias("line")).select(
        F.substring_index("line", ":", 1).alias("source"), F.concat_ws("/", "path", F.substring_index("line", ":", -1)).alias("id"))
    return K.claim_partition(claims.select("source", F.concat_ws("/", "path", F.col("id").cast("string")).alias("id")), back)


@query(f"""WITH {B.ORDERS}, p AS (SELECT DISTINCT path, package FROM changes), leaks AS (SELECT a.path AS "left", b.path AS "right",
  CASE WHEN split_part(a.path, '/p', 2)::BIGINT % 2 = 0 THEN 'hidden_coupling' ELSE 'leaky_interface' END AS kind FROM p a JOIN p b ON split_part(b.path, '/p', 2)::BIGINT = split_part(a.path, '/p', 2)::BIGINT + 1),
claimed AS (SELECT path FROM p WHERE package IN ('Brand#11', 'Brand#23', 'Brand#42'))
SELECT 'hidden_coupling' AS pattern, "left", "right", 1::BIGINT AS rating FROM leaks WHERE kind = 'hidden_coupling' AND "left" NOT IN (SELECT path FROM claimed)""")
def hidden_cards(spark: SparkSession, sf: str) -> DataFrame:
    p = B.order_changes(spark, sf).select("path", "package").distinct().withColumn("k", F.substring_index("path", "/p", -1).cast("long"))
    leaks = p.select(F.col("path").alias("left"), (F.col("k") + 1).alias("k"), F.when(F.col("k") % 2 == 0, "hidden_coupling").otherwise("leaky_interface").alias("kind"),
                     F.lit(1).cast("long").alias("rating")).join(p.select(F.col("path").alias("right"), "k"), "k")
    return K.hidden_cards(leaks, p.where(F.col("package").isin("Brand#11", "Brand#23", "Brand#42")))


_RANKED = """fc AS (SELECT path, row_number() OVER (ORDER BY count(*) FILTER (rating = 2) DESC, path) AS rank,
  CASE WHEN count(*) % 4 = 0 THEN 'detail' ELSE 'default' END AS visibility, count(*) % 3 > 0 AS affects, count(*) % 5 = 0 AS hot FROM assessed GROUP BY path),
up AS (SELECT *, unnest(list_concat(['.'], list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/')))) AS scope FROM fc)"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    c = assessed(spark, sf).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("rating") == 2).cast("long")).alias("high"))
    return c.select("path", F.row_number().over(K.Window.orderBy(F.desc("high"), "path")).cast("long").alias("rank"),
                    F.when(F.col("n") % 4 == 0, "detail").otherwise("default").alias("visibility"), (F.col("n") % 3 > 0).alias("affects"), (F.col("n") % 5 == 0).alias("hot"))


@query(f"""WITH {ASSESSED}, {_RANKED} SELECT scope, path, rank, row_number() OVER (PARTITION BY scope ORDER BY rank) AS place FROM up WHERE visibility = 'default' OR scope = path""")
def scope_problems(spark: SparkSession, sf: str) -> DataFrame:
    return K.scope_problems(_ranked(spark, sf))


@query(f"""WITH {ASSESSED}, {_RANKED}, x AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY rank) AS place FROM up WHERE affects AND (visibility = 'default' OR scope = path))
SELECT scope, path, place, CASE WHEN hot THEN 'hot_and_complex' ELSE 'top_ranked_problem' END AS reason FROM x WHERE place <= 3""")
def worst_offenders(spark: SparkSession, sf: str) -> DataFrame:
    return K.offenders(_ranked(spark, sf))


@query(f"""WITH {ASSESSED}, {_RANKED}, n AS (SELECT scope, count(*) AS cards FROM up GROUP BY scope),
r AS (SELECT *, CASE WHEN cards <= 6 THEN 6 WHEN cards <= 8 THEN 8 WHEN cards <= 12 THEN 12 ELSE 24 END AS rung FROM n)
SELECT scope, cards, least(cards, rung)::BIGINT AS shown, (24 // rung - 1)::BIGINT AS evidence FROM r""")
def screen_ladder(spark: SparkSession, sf: str) -> DataFrame:
    n = K.scope_problems(_ranked(spark, sf), every=True).groupBy("scope").agg(F.count(F.lit(1)).alias("cards"))
    shown, lines = K.ladder(F.col("cards"))
    return n.select("scope", "cards", shown.cast("long").alias("shown"), lines.alias("evidence"))


@query(f"""WITH {ASSESSED}, {_SCOPES}, u AS (SELECT path, sum(logical_lines)::BIGINT AS bytes, count(*) % 3 = 0 AS missing FROM assessed GROUP BY path),
up AS (SELECT *, unnest(list_concat(['.'], list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/')))) AS scope FROM u),
s AS (SELECT scope, count(*) AS selected, count(*) FILTER (NOT missing) AS analyzed, sum(bytes)::BIGINT AS all_bytes, coalesce(sum(bytes) FILTER (missing), 0)::BIGINT AS lost FROM up GROUP BY scope),
j AS (SELECT s.*, coalesce(high, 0) AS high FROM s LEFT JOIN scopes USING (scope)), r AS (SELECT high AS rh, selected AS rs FROM j WHERE scope = '.'),
t AS (SELECT scope, {_TIER} AS tr FROM (SELECT scope, healthy + watch + high AS checked, watch, high FROM scopes))
SELECT scope, CASE WHEN scope <> '.' AND selected <> rs AND rh > 0 THEN high || ' of the repository''s ' || rh || ' high live here.' END AS share,
  CASE WHEN analyzed < selected THEN 'Not all source was checked.' END AS qualifier, CASE WHEN analyzed < selected THEN CASE WHEN all_bytes > 0 THEN lost * 1000 // all_bytes ELSE 0 END END AS unsupported_permille,
  CASE WHEN analyzed < selected THEN 'Zig' END AS language,
  ['Nothing was checked.', 'Clean. Ship it.', 'Solid, with rough edges.', 'Worn in the usual places.', 'This code fights back.', 'The code is winning.'][tr + 1] AS sentence
FROM j LEFT JOIN t USING (scope), r""")
def verdict_facts(spark: SparkSession, sf: str) -> DataFrame:
    a = assessed(spark, sf)
    u = a.groupBy("path").agg(F.sum("logical_lines").alias("bytes"), (F.count(F.lit(1)) % 3 == 0).alias("missing"))
    m = F.col("missing").cast("long")
    s = u.withColumn("scope", F.explode(ratings.ancestors(F.col("path")))).groupBy("scope").agg(
        F.count(F.lit(1)).alias("selected"), F.sum(1 - m).alias("analyzed"), F.sum("bytes").alias("selected_bytes"), F.sum(m * F.col("bytes")).alias("unsupported_bytes"))
    health = ratings.scope_rollup(a)
    s = s.join(health.select("scope", "high"), "scope", "left").withColumn("high", F.coalesce("high", F.lit(0)))
    tiers = ratings.scope_tiers(health).select("scope", K.tier_sentence(F.col("tier_rank")).alias("sentence"))
    label = spark.createDataFrame([("Zig",)], "label string")
    return K.verdict_facts(graph.written(s, "scopes"), label).join(tiers, "scope", "left")


@query(f"""WITH {ASSESSED}, {_GATE}, o AS (SELECT path, signal, high_b, watch_b, high_o, watch_o, CASE WHEN high_o > high_b OR watch_o > watch_b THEN 'regression'
  WHEN high_o < high_b OR watch_o < watch_b THEN 'improvement' ELSE 'unchanged' END AS outcome FROM gate)
SELECT '{{"path":"' || path || '","signal":"' || signal || '","high_b":' || high_b || ',"watch_b":' || watch_b || ',"high_o":' || high_o || ',"watch_o":' || watch_o || ',"outcome":"' || outcome || '"}}' AS value
FROM o UNION ALL SELECT '{{"version":1,"totals":{{' || (SELECT string_agg('"' || outcome || '":' || n, ',' ORDER BY outcome) FROM (SELECT outcome, count(*) AS n FROM o GROUP BY 1)) || '}}}}'""")
def gate_document(spark: SparkSession, sf: str) -> DataFrame:
    g = _gate(spark, sf).select("path", "signal", "high_b", "watch_b", "high_o", "watch_o", "outcome")
    return K.gate_document(g, g.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))
