"""Queries of edge eligibility, cycle and connection graphs, gates, problem cards and verdict facts, with their SQL.

Files are parts below brands (packages). Neighbouring lines of an order whose quantities lie within one of each other make
a reference from part to part, so the graph of files is sparse and has cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import architecture as A
from ..operators import cards, graph, history
from ..policy import GraphPolicy
from . import bindings as B
from .queries import _CUT, _FILE_PAIRS, _LEAK, _LOOSE, _PAIRS, ASSESSED, assessed, query

_ROLE = """CASE WHEN p_type IN ('STANDARD', 'MEDIUM', 'PROMO') THEN 'primary' WHEN p_type = 'LARGE' THEN 'test'
  WHEN p_type = 'SMALL' THEN 'benchmark' ELSE 'vendored' END"""
FILES = f"""files AS (SELECT p_partkey AS node, p_brand AS package, {_ROLE} AS role,
  CASE WHEN p_size % 5 = 0 THEN 'advisory' ELSE 'trusted' END AS trust FROM part)"""
EDGES = FILES + """, refs AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, CASE a.l_returnflag WHEN 'R' THEN 'ownership' ELSE 'uses' END AS relation,
  a.l_linestatus = 'O' AND a.l_tax < 0.04 AS test_scope, a.l_orderkey AS line, a.l_shipdate AS ts FROM lineitem a JOIN lineitem b
  ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE abs(a.l_quantity - b.l_quantity) <= 1 AND a.l_partkey <> b.l_partkey),
edges AS (SELECT src, dst, relation, CASE WHEN test_scope AND role = 'primary' THEN 'test' ELSE role END AS role, trust, count(*) AS refs
  FROM refs JOIN files ON node = src GROUP BY ALL),
judged AS (SELECT *, relation = 'uses' AND role IN ('primary', 'test', 'example', 'benchmark') AND trust = 'trusted' AS affects_verdict FROM edges),
owned AS (SELECT DISTINCT least(src, dst) AS low, greatest(src, dst) AS high FROM edges WHERE relation = 'ownership'),
graph AS (SELECT DISTINCT src, dst FROM judged WHERE affects_verdict AND role = 'primary'
  AND NOT EXISTS (SELECT 1 FROM owned WHERE low = least(src, dst) AND high = greatest(src, dst)))"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    role = (F.when(F.col("p_type").isin("STANDARD", "MEDIUM", "PROMO"), "primary").when(F.col("p_type") == "LARGE", "test")
            .when(F.col("p_type") == "SMALL", "benchmark").otherwise("vendored"))
    return B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("node"), F.col("p_brand").alias("package"), role.alias("role"),
        F.when(F.col("p_size") % 5 == 0, "advisory").otherwise("trusted").alias("trust"))


def references(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"), F.col("l_quantity").alias("q"),
                  F.when(F.col("l_returnflag") == "R", "ownership").otherwise("uses").alias("relation"),
                  ((F.col("l_linestatus") == "O") & (F.col("l_tax") < 0.04)).alias("test_scope"), F.col("l_shipdate").alias("ts"))
    b = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"), "l_quantity")
    return (a.join(b, ["l_orderkey", "l_linenumber"]).where("abs(q - l_quantity) <= 1 AND src <> dst")
            .select("src", "dst", "relation", "test_scope", F.col("l_orderkey").alias("line"), "ts"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, relation, role, trust, refs."""
    f = files(spark, sf).select(F.col("node").alias("src"), "role", "trust")
    return references(spark, sf).join(f, "src").withColumn("role", A.edge_role(F.col("role"), F.col("test_scope"))).groupBy(
        "src", "dst", "relation", "role", "trust").agg(F.count(F.lit(1)).alias("refs"))


@query(f"WITH {EDGES} SELECT *, affects_verdict AND role = 'primary' AS enters_graph FROM judged")
def edge_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return A.edge_eligibility(edges(spark, sf))


@query(f"WITH {EDGES} SELECT * FROM graph")
def cycle_graph(spark: SparkSession, sf: str) -> DataFrame:
    return A.cycle_graph(edges(spark, sf))


@query(f"""WITH {EDGES}, ok AS (SELECT node FROM files WHERE role = 'primary' AND trust = 'trusted')
SELECT DISTINCT src, dst FROM edges WHERE relation IN ('uses', 'ownership') AND src IN (SELECT node FROM ok) AND dst IN (SELECT node FROM ok)""")
def connection_graph(spark: SparkSession, sf: str) -> DataFrame:
    return A.connection_graph(edges(spark, sf), files(spark, sf))


#: Pairs inside packages of eight brands each, so that cycles within a package occur.
_NEAR = """groups AS (SELECT node, CASE WHEN package < 'Brand#30' THEN 'low' ELSE 'high' END AS package FROM files),
inner_ AS (SELECT e.src, e.dst FROM (SELECT DISTINCT src, dst FROM edges) e JOIN groups a ON a.node = src JOIN groups b ON b.node = dst WHERE a.package = b.package)"""
_REACH = """reach(src, dst) AS (SELECT src, dst FROM {0} UNION SELECT r.src, e.dst FROM reach r JOIN {0} e ON r.dst = e.src),
scc AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)"""


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("node", F.when(F.col("package") < "Brand#30", "low").otherwise("high").alias("package"))


@query(f"""WITH RECURSIVE {EDGES}, {_NEAR}, {_REACH.format('(SELECT DISTINCT src, dst FROM edges)')}
SELECT component, count(*) AS size, min(package) AS package FROM scc JOIN groups USING (node) GROUP BY component HAVING count(*) > 1 AND min(package) = max(package)
UNION ALL SELECT component, count(*), 'inner' FROM (SELECT a.src AS node, min(a.dst) AS component FROM
  (SELECT * FROM reach_in) a JOIN reach_in b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) GROUP BY component HAVING count(*) > 1""".replace(
    "scc AS (", "reach_in(src, dst) AS (SELECT src, dst FROM inner_ UNION SELECT r.src, e.dst FROM reach_in r JOIN inner_ e ON r.dst = e.src), scc AS (", 1))
def file_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of files that stay in one package, over all edges; and those of the edges inside packages ('inner')."""
    e, g = graph.written(edges(spark, sf).select("src", "dst").distinct(), "edges"), _groups(spark, sf)
    s, t = g.select(F.col("node").alias("src"), "package"), g.select(F.col("node").alias("dst"), F.col("package").alias("other"))
    inner = e.join(s, "src").join(t, "dst").where("package = other").select("src", "dst")
    return A.file_cycles(e, g).union(A.file_cycles(inner, g).withColumn("package", F.lit("inner")))


@query("""WITH f AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 4 = 0 THEN 'recovered' WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'parsed' END AS parse_status,
  CASE lang WHEN 'en' THEN 'primary' WHEN 'de' THEN 'test' ELSE 'vendored' END AS role FROM documents)
SELECT source, sum((role IN ('primary', 'test') AND parse_status = 'parsed')::BIGINT)::BIGINT AS eligible, count(*) AS files FROM f GROUP BY source""")
def health_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    d = B.table(spark, sf, "documents")
    status = F.when(F.col("doc_id") % 4 == 0, "recovered").when(F.col("doc_id") % 9 == 0, "failed").otherwise("parsed")
    role = F.when(F.col("lang") == "en", "primary").when(F.col("lang") == "de", "test").otherwise("vendored")
    return d.groupBy("source").agg(F.sum(F.coalesce(A.health_eligible(role, status), F.lit(False)).cast("long")).alias("eligible"),
                                   F.count(F.lit(1)).alias("files"))


_P_EDGES = f"""{EDGES}, pe AS (SELECT DISTINCT s.package AS a, t.package AS b FROM judged JOIN files s ON s.node = src JOIN files t ON t.node = dst
  WHERE affects_verdict AND refs >= 2 AND s.package <> t.package)"""


@query(f"""WITH {_P_EDGES}, m AS (SELECT DISTINCT s.p_brand AS package, t.p_brand AS needs FROM part s JOIN part t ON t.p_partkey = s.p_partkey + 1
  WHERE s.p_size = t.p_size), u AS (SELECT * FROM pe UNION SELECT package, needs FROM m)
SELECT DISTINCT least(a, b) AS "left", greatest(a, b) AS "right" FROM u WHERE a <> b""")
def explanation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    f, p = files(spark, sf).select("node", "package"), B.table(spark, sf, "part")
    e = (A.edge_eligibility(edges(spark, sf)).where("affects_verdict AND refs >= 2").join(f.select(F.col("node").alias("src"), F.col("package").alias("from_package")), "src")
         .join(f.select(F.col("node").alias("dst"), F.col("package").alias("to_package")), "dst"))
    m = p.select((F.col("p_partkey") + 1).alias("p_partkey"), "p_size", F.col("p_brand").alias("package")).join(
        p.select("p_partkey", "p_size", F.col("p_brand").alias("needs")), ["p_partkey", "p_size"])
    return A.explanations(e, m)


@query(f"""WITH RECURSIVE g AS (SELECT n_nationkey::BIGINT AS node, n_regionkey::BIGINT AS package FROM nation), {B.nation_edges_sql()},
reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
own AS (SELECT node, (SELECT count(*) FROM reach WHERE dst = node AND src <> node)::BIGINT AS n FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)),
gone AS (SELECT DISTINCT n_regionkey AS package FROM nation WHERE n_name IN ('NATION_7', 'CHINA', 'JAPAN') OR n_nationkey = 12)
SELECT node, coalesce(CASE WHEN node < 15 THEN n END, CASE WHEN node >= 20 THEN 3 END)::BIGINT AS reach FROM g LEFT JOIN own USING (node)
WHERE package NOT IN (SELECT package FROM gone) AND coalesce(CASE WHEN node < 15 THEN n END, CASE WHEN node >= 20 THEN 3 END) > 0""")
def exact_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Reach of single files: their own row where there is one, else the closure's, nothing in incomplete packages."""
    n = B.table(spark, sf, "nation")
    g = n.select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("package"))
    gone = n.where(F.col("n_name").isin("NATION_7", "CHINA", "JAPAN") | (F.col("n_nationkey") == 12)).select(F.col("n_regionkey").cast("long").alias("package"))
    own = graph.reach_in(graph.written(B.nation_edges(spark, sf), "nations")).where("node < 15").select("node", (F.col("reach") - 1).alias("reach"))
    closures = g.where("node >= 20").select("node", F.lit(4).cast("long").alias("reach"))
    return A.exact_reach(g, own, closures, gone)


@query(f"""WITH RECURSIVE {B.nation_edges_sql()}, reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
r AS (SELECT node, 1 + (SELECT count(*) FROM reach WHERE dst = node AND src <> node) AS reach FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges))
SELECT node, reach, 'package' AS kind FROM r WHERE (SELECT count(*) FROM r) >= 3 AND reach >= 2 UNION ALL SELECT node, reach, 'file' FROM r WHERE (SELECT count(*) FROM r) >= 20""")
def reach_statements(spark: SparkSession, sf: str) -> DataFrame:
    r = graph.written(graph.reach_in(graph.written(B.nation_edges(spark, sf), "nations")), "reach")
    n = r.count()
    return A.reach_statements(r, n, True).withColumn("kind", F.lit("package")).union(A.reach_statements(r, n, False).withColumn("kind", F.lit("file")))


@query(f"""WITH {B.ORDERS}, e AS (SELECT * FROM changes WHERE role IN ('primary', 'test', 'benchmark') AND trust = 'trusted'), {_PAIRS.replace('FROM changes', 'FROM e')} SELECT * FROM pairs""")
def eligible_change_coupling(spark: SparkSession, sf: str) -> DataFrame:
    c = B.order_changes(spark, sf).where("role IN ('primary', 'test', 'benchmark') AND trust = 'trusted'")
    return history.package_coupling(c).select("left", "right", "shared", "touch_left", "touch_right", "union")


_GAP = """bad AS (SELECT DISTINCT p_brand AS package FROM part WHERE p_size = 5 AND p_type = 'PROMO'),
f AS (SELECT DISTINCT path, package FROM changes)"""


def _leaks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = B.order_changes(spark, sf)
    rows = history.file_coupling(c, _LOOSE).where("distance >= 2").withColumn(
        "kind", F.when(F.col("shared") > 2, "leaky_interface").otherwise("hidden_coupling"))
    bad = B.table(spark, sf, "part").where("p_size = 5 AND p_type = 'PROMO'").select(F.col("p_brand").alias("package"))
    return rows, c.select("path", "package").distinct(), bad


_LEAKS = f"""{B.ORDERS}, {_FILE_PAIRS}, {_GAP}, k AS (SELECT *, CASE WHEN shared > 2 THEN 'leaky_interface' ELSE 'hidden_coupling' END AS kind,
  EXISTS (SELECT 1 FROM f JOIN bad USING (package) WHERE path IN ("left", "right")) AS gap FROM pairs WHERE distance >= 2)"""


@query(f"""WITH {_LEAKS} SELECT "left", "right", kind, shared, row_number() OVER (PARTITION BY kind ORDER BY distance DESC, shared DESC, "left", "right") AS rank FROM k WHERE NOT gap""")
def leakage_stated(spark: SparkSession, sf: str) -> DataFrame:
    return A.leakage_stated(*_leaks(spark, sf))[0].select("left", "right", "kind", "shared", "rank")


@query(f"WITH {_LEAKS} SELECT kind, count(*) AS withheld FROM k WHERE gap GROUP BY kind")
def leakage_withheld(spark: SparkSession, sf: str) -> DataFrame:
    return A.leakage_stated(*_leaks(spark, sf))[1]


_AMPLE = f"""m AS (SELECT DISTINCT commit, path FROM changes WHERE role IN ('primary', 'test', 'benchmark') AND trust = 'trusted'),
s AS (SELECT commit, least(count(*), 1000) AS files FROM m GROUP BY commit),
d AS (SELECT DISTINCT commit, unnest(['.', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS directory FROM m),
am AS (SELECT directory, quantile_disc(files, 0.5)::BIGINT AS median FROM d JOIN s USING (commit) GROUP BY directory HAVING count(*) >= 10 AND median >= 2)"""
_SCOPES_OF = """sc AS (SELECT DISTINCT '.' AS scope, 'repository' AS kind UNION SELECT DISTINCT replace(p_brand, '#', '/'), 'package' FROM part
  UNION SELECT 'Brand', 'directory' UNION SELECT replace(p_brand, '#', '/') || '/p' || p_partkey, 'file' FROM part)"""


@query(f"""WITH {B.ORDERS}, {_AMPLE}, {_SCOPES_OF} SELECT scope, kind, median FROM sc LEFT JOIN am ON kind <> 'file' AND directory = scope""")
def scope_amplification(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    brand = F.regexp_replace("p_brand", "#", "/")
    scopes = (p.select(brand.alias("scope"), F.lit("package").alias("kind")).distinct()
              .union(spark.createDataFrame([(".", "repository"), ("Brand", "directory")], "scope string, kind string"))
              .union(p.select(F.concat(brand, F.lit("/p"), "p_partkey"), F.lit("file"))))
    from dataclasses import replace

    from ..policy import HistoryPolicy
    return cards.scope_amplification(scopes, history.amplification(B.order_changes(spark, sf), replace(HistoryPolicy(), amplification_median=2)))


@query(f"""WITH {EDGES}, x AS (SELECT relation, dst % 40 AS target, line FROM refs), l AS (SELECT DISTINCT relation, target, line FROM x),
t AS (SELECT relation, target, string_agg(line::VARCHAR, ',' ORDER BY line) AS locations FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY relation, target ORDER BY line) <= 3) GROUP BY ALL)
SELECT relation, target, count(*) AS references, any_value(locations) AS locations FROM x JOIN t USING (relation, target) GROUP BY ALL""")
def external_targets(spark: SparkSession, sf: str) -> DataFrame:
    x = references(spark, sf).select("relation", (F.col("dst") % 40).alias("target"), "line")
    return A.folded(x, "relation", "target").withColumn("locations", F.array_join(F.transform("locations", lambda v: v.cast("string")), ","))


@query("""SELECT lang AS label, sum(n_chars)::BIGINT AS bytes, count(*) AS files FROM documents GROUP BY lang ORDER BY bytes DESC, label LIMIT 1""")
def largest_unsupported(spark: SparkSession, sf: str) -> DataFrame:
    return A.largest_unsupported(B.table(spark, sf, "documents").select(F.col("lang").alias("label"), F.col("n_chars").alias("size_bytes")))


@query(f"""WITH {B.ORDERS}, c AS (SELECT count(DISTINCT commit) FILTER (role IN ('primary', 'test', 'benchmark') AND trust = 'trusted' AND package = brand) AS eligible_commits,
  count(*) FILTER (role IN ('primary', 'test', 'benchmark') AND trust = 'trusted' AND package = brand AND added IS NOT NULL) AS mapped, brand,
  count(*) FILTER (package = brand AND added IS NULL) AS rename_gaps FROM changes, (SELECT DISTINCT p_brand AS brand FROM part) GROUP BY brand)
SELECT brand AS package, rename_gaps < 400 AS complete, eligible_commits, mapped, rename_gaps % 7 AS rename_gaps, rename_gaps < 400 AND eligible_commits > 0 AND mapped > 0 AS findings,
  rename_gaps < 400 AND eligible_commits > 0 AND mapped > 0 AND rename_gaps % 7 = 0 AS comparisons, rename_gaps < 400 AS amplification FROM c""")
def history_sufficiency(spark: SparkSession, sf: str) -> DataFrame:
    ok = "role IN ('primary', 'test', 'benchmark') AND trust = 'trusted'"
    c = B.order_changes(spark, sf).groupBy("package").agg(
        F.expr(f"count(DISTINCT CASE WHEN {ok} THEN commit END)").alias("eligible_commits"),
        F.expr(f"count(CASE WHEN {ok} AND added IS NOT NULL THEN 1 END)").alias("mapped"), F.expr("count(CASE WHEN added IS NULL THEN 1 END)").alias("gaps"))
    return A.sufficiency(c.select("package", (F.col("gaps") < 400).alias("complete"), "eligible_commits", "mapped", (F.col("gaps") % 7).alias("rename_gaps")))


@query(f"""WITH {B.ORDERS}, o AS (SELECT author, contributor, count(DISTINCT commit) AS n FROM changes WHERE ts < TIMESTAMP '{_CUT}' GROUP BY ALL)
SELECT author, count(*) AS contributors, max(n) AS top_commits, sum(n)::BIGINT AS commits FROM o GROUP BY author""")
def base_ownership(spark: SparkSession, sf: str) -> DataFrame:
    """Ownership on the base side: without the commits that the change itself made."""
    c = B.order_changes(spark, sf).withColumn("made_by_change", F.col("ts") >= F.lit(_CUT).cast("timestamp_ntz"))
    return history.ownership(history.base_side(c), "author")


@query("""WITH r AS (SELECT b.l_orderkey AS k, b.l_linenumber AS n, CASE b.l_returnflag WHEN 'A' THEN 'primary' WHEN 'R' THEN 'vendored' END AS role_before,
  CASE a.l_returnflag WHEN 'A' THEN 'primary' WHEN 'N' THEN 'test' ELSE 'generated' END AS role_after, coalesce(a.l_quantity, 0) > 45 AS unpaired_anonymous
  FROM lineitem b JOIN lineitem a ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1)
SELECT participation, count(*) AS units FROM (SELECT CASE WHEN unpaired_anonymous THEN 'context' WHEN (role_before IS NULL OR role_before = 'primary') AND role_after IN ('primary', 'test')
  THEN 'verdict' ELSE 'context' END AS participation FROM r) GROUP BY 1""")
def comparison_participation(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    b = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"),
                  F.when(F.col("l_returnflag") == "A", "primary").when(F.col("l_returnflag") == "R", "vendored").alias("role_before"))
    a = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "primary").when(F.col("l_returnflag") == "N", "test").otherwise("generated").alias("role_after"),
                  (F.col("l_quantity") > 45).alias("unpaired_anonymous"))
    return A.participation(b.join(a, ["l_orderkey", "l_linenumber"])).groupBy("participation").agg(F.count(F.lit(1)).alias("units"))


_SPLIT = f"""{EDGES}, eb AS (SELECT DISTINCT src, dst FROM refs WHERE ts < TIMESTAMP '{_CUT}'), ea AS (SELECT DISTINCT src, dst FROM refs WHERE ts >= TIMESTAMP '1996-01-01'),
rb(src, dst) AS (SELECT src, dst FROM eb UNION SELECT r.src, e.dst FROM rb r JOIN eb e ON r.dst = e.src),
ra(src, dst) AS (SELECT src, dst FROM ea UNION SELECT r.src, e.dst FROM ra r JOIN ea e ON r.dst = e.src),
sb AS (SELECT a.src AS node, min(a.dst) AS component FROM rb a JOIN rb b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
sa AS (SELECT a.src AS node, min(a.dst) AS component FROM ra a JOIN ra b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
nb AS (SELECT src AS node FROM eb UNION SELECT dst FROM eb), na AS (SELECT src AS node FROM ea UNION SELECT dst FROM ea),
cb AS (SELECT node FROM sb WHERE component = (SELECT component FROM sb GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)),
ca AS (SELECT node FROM sa WHERE component = (SELECT component FROM sa GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)),
sh AS (SELECT min(node) AS node FROM cb WHERE node IN (SELECT node FROM ca)),
anchors AS (SELECT node FROM sh WHERE node IS NOT NULL UNION SELECT min(node) FROM cb WHERE node IN (SELECT node FROM na) AND (SELECT node FROM sh) IS NULL
  UNION SELECT min(node) FROM ca WHERE node IN (SELECT node FROM nb) AND (SELECT node FROM sh) IS NULL)"""


@query(f"""WITH RECURSIVE {_SPLIT}, wb AS (SELECT node, coalesce(component, node) AS component FROM nb LEFT JOIN sb USING (node)),
wa AS (SELECT node, coalesce(component, node) AS component FROM na LEFT JOIN sa USING (node)),
j AS (SELECT node AS anchor, (SELECT count(*) FROM wb x WHERE x.component = b.component) AS before_size, (SELECT count(*) FROM wa x WHERE x.component = a.component) AS after_size,
  (SELECT list_sort(list(node)) FROM wb x WHERE x.component = b.component) AS mb, (SELECT list_sort(list(node)) FROM wa x WHERE x.component = a.component) AS ma,
  (SELECT count(*) FROM nb) AS tb, (SELECT count(*) FROM na) AS ta FROM anchors JOIN wb b USING (node) JOIN wa a USING (node))
SELECT anchor, before_size, after_size, CASE WHEN after_size * tb > before_size * ta THEN 'worse' WHEN after_size * tb < before_size * ta THEN 'better' ELSE 'changed' END AS direction
FROM j WHERE ((before_size >= 2 AND before_size * 100 >= tb * 0) OR after_size >= 2) AND (before_size <> after_size OR tb <> ta OR mb <> ma)""")
def core_comparison(spark: SparkSession, sf: str) -> DataFrame:
    r = references(spark, sf)
    cut = F.lit(_CUT).cast("timestamp_ntz")
    sides = [graph.written(r.where(w).select("src", "dst").distinct(), "side") for w in (F.col("ts") < cut, F.col("ts") >= F.lit("1996-01-01").cast("timestamp_ntz"))]
    comps = [graph.written(graph.strong_components(e), "components") for e in sides]
    nodes = [graph.nodes(e) for e in sides]

    def largest(c: DataFrame) -> DataFrame:
        top = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "component").limit(1)
        return c.join(top, "component").select("node")

    anchors = graph.written(A.core_anchors(largest(comps[0]), largest(comps[1]), *nodes), "anchors")
    return A.core_comparison(anchors, *comps, nodes[0].count(), nodes[1].count(), GraphPolicy(core_files=2, core_percent=0))


@query(r"""SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '[ \t\r\f\x0b]+', ' ', 'g')) AS head,
  regexp_full_match('"' || lang || '"', '"[^"]*"') AND NOT contains(text, '~') AS quoted FROM documents""")
def first_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", A.first_line(F.col("text")).alias("head"),
                    (A.is_quoted(F.concat(F.lit('"'), "lang", F.lit('"'))) & ~F.contains("text", F.lit("~"))).alias("quoted"))


@query(f"""WITH {ASSESSED}, d AS (SELECT DISTINCT path FROM assessed WHERE role = 'vendored' AND rating = 2 AND cognitive >= 49)
SELECT path, coalesce(CASE WHEN path IN (SELECT path FROM d) THEN 'dormant' END, role) AS role, count(*) AS units FROM assessed WHERE rating > 0 GROUP BY ALL
UNION ALL SELECT path, 'size', count(*) FROM assessed WHERE path NOT IN (SELECT path FROM d) GROUP BY ALL""")
def dormant_restated(spark: SparkSession, sf: str) -> DataFrame:
    a = assessed(spark, sf)
    d = a.where("role = 'vendored' AND rating = 2 AND cognitive >= 49").select("path")
    rows = A.dormant_restated(a.where("rating > 0").select("path", "role"), d).groupBy("path", "role").agg(F.count(F.lit(1)).alias("units"))
    sizes = A.dormant_restated(a.select("path"), d, sizes=True).groupBy("path").agg(F.count(F.lit(1)).alias("units"))
    return rows.union(sizes.select("path", F.lit("size"), "units"))


@query("""WITH facts AS (SELECT 's' || l_suppkey AS path, l_orderkey * 100 + l_partkey * 10 + l_linenumber AS uid, l_orderkey AS start, l_orderkey + l_quantity::BIGINT AS "end" FROM lineitem WHERE l_returnflag <> 'R' OR l_suppkey > 3),
errors AS (SELECT 's' || l_suppkey AS path, l_orderkey + 3 AS start, l_orderkey + 3 + (l_linenumber % 2) AS "end" FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07),
w AS (SELECT DISTINCT path, CASE WHEN start = "end" THEN start - 1 ELSE start END AS s, CASE WHEN start = "end" THEN "end" + 1 ELSE "end" END AS e FROM errors),
hit AS (SELECT DISTINCT f.path, uid FROM facts f JOIN w ON w.path = f.path AND f.start < e AND s < f."end")
SELECT path, count(*) AS facts, count(*) FILTER ((path, uid) IN (SELECT path, uid FROM hit)) AS in_doubt FROM facts GROUP BY path""")
def recovery_classification(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    path = F.concat(F.lit("s"), "l_suppkey").alias("path")
    facts = li.where("l_returnflag <> 'R' OR l_suppkey > 3").select(
        path, (F.col("l_orderkey") * 100 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("uid"), F.col("l_orderkey").alias("start"),
        (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"))
    errors = li.where("l_discount > 0.09 AND l_tax > 0.07").select(path, (F.col("l_orderkey") + 3).alias("start"), (F.col("l_orderkey") + 3 + F.col("l_linenumber") % 2).alias("end"))
    return A.recovery(facts, errors).groupBy("path").agg(F.count("uid").alias("facts"), F.sum((F.col("uid").isNotNull() & F.col("in_doubt")).cast("long")).alias("in_doubt"))
