"""Quality rules with cross-document line frequency (DataFrame functions only).

Every normalised line is hashed; the documents of one host (``source``) that hold it are counted; a line held by more
documents than the limits allow is boilerplate of that host and every occurrence is removed (:func:`keep_good` gives the
text without it); a document of which too little is left is rejected, as is one that fails the base rules (too few words,
too many words in repeated 8-word windows).

Limits: more than ``line_docs`` documents, whatever the host's size, or in a small host ``few_docs`` or more documents
that are more than ``line_percent`` of it. Twenty is what a quotation or a formula of one author may reach; a tenth of a
small host is a header or footer, and five documents keep a host of a few pages from losing what two of them share.
Documents of equal text count once, so that a copied document does not make boilerplate of its own lines: copies are for
the near-duplicate operators.

Cases: a null text is empty (no words, so it fails the base rules); a null source is a host of its own; every row of
repeated rows and copies gets the same verdict; an empty table gives an empty result; other columns are ignored by
:func:`features` and carried through by :func:`keep_good`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class QualityPolicy:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: A line is boilerplate in a host where more different documents than this hold it.
    line_docs: int = 20
    #: So is one that this many hold, or more, if they are more than this percentage of the host's.
    few_docs: int = 5
    line_percent: int = 10
    #: A document is depleted if boilerplate holds more than this percentage of its words, every occurrence counted.
    max_removed_percent: int = 70


#: Words inside 8-word windows that occur twice or more in the text. transform(array(x), y -> ...) binds y once.
REPEAT_WORDS = f"""
CASE WHEN size(ws) <= {WINDOW} THEN 0L ELSE
transform(array(transform(ws, w -> xxhash64(w))), wh ->
 transform(array(transform(sequence(1, size(wh) - {WINDOW - 1}), i -> xxhash64(slice(wh, i, {WINDOW})))), h ->
  CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
   transform(array(array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))), ph ->
    transform(array(sort_array(transform(
      filter(sequence(0, size(ph) - 1),
             k -> coalesce(ph[k].x = get(ph, k - 1).x, false) OR coalesce(ph[k].x = get(ph, k + 1).x, false)),
      k -> ph[k].i))), st ->
     aggregate(sequence(1, size(st) - 1), {WINDOW}L,
               (a, k) -> a + least({WINDOW}L, CAST(st[k] - st[k - 1] AS BIGINT))))[0])[0]
  END)[0])[0]
END"""


def _lines(text):
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != "")


def _normal(text):
    """Every line in lower case with single blanks, in order; the whole text is normalised at once."""
    flat = F.lower(F.translate(text, "\t\x0b\f\r", " " * 4))
    flat = F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat)
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


#: Of the normalised lines ns each once: its hash, and the words that all its occurrences hold. Lines that repeat are put
#: side by side first, so that the work does not grow with the square of their number.
LINES = """
transform(array(transform(ns, x -> struct(xxhash64(x) AS line, length(x) - length(translate(x, ' ', '')) + 1 AS words))), ls ->
 CASE WHEN size(array_distinct(ls)) = size(ls) THEN ls ELSE
  transform(array(array_sort(ls)), o ->
   transform(array(filter(sequence(0, size(o) - 1), i -> i = 0 OR o[i].line <> o[i - 1].line)), st ->
    transform(st, (s, j) -> struct(o[s].line AS line, o[s].words * (coalesce(get(st, j + 1), size(o)) - s) AS words)))[0])[0]
 END)[0]"""


def _without(text, gone):
    """The text without the lines whose normalised hash is in gone, wherever and however often they stand. The hashes are
    looked up in as many bins as the root of their number."""
    lines = F.arrays_zip(F.split(text, "\n").alias("raw"), _normal(text).alias("normal"))
    n = F.ceil(F.sqrt(F.size(gone))).cast("long")
    bins = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda b: F.filter(gone, lambda g: F.pmod(g, n) == b))
    known = lambda h, table: F.array_contains(F.get(table, F.pmod(h, n).cast("int")), h)
    left = F.transform(F.array(bins), lambda table: F.filter(lines, lambda x: ~known(F.xxhash64(x["normal"]), table)))[0]
    return F.array_join(F.transform(left, lambda x: x["raw"]), "\n")


def features(docs: DataFrame) -> DataFrame:
    """One narrow row per document, from one pass over the text: base counts, the key that names equal rows, and the
    distinct normalised lines as (hash, words)."""
    d = docs.select(
        "doc_id", F.coalesce(F.col("source"), F.lit("\x00")).alias("host"), C.whole("text").alias("text"),
        C.row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("key"),
        C.row_key(F.col("source"), F.col("text")).alias("copy"))
    d = d.withColumn("ws", C.words(F.col("text"))).withColumn("raw", _lines(F.col("text")))
    d = d.withColumn("ns", F.filter(_normal(F.col("text")), lambda x: x != ""))
    shown = lambda c: F.length(c).cast("long")
    return d.select(
        "doc_id", "host", "key", "copy",
        F.size("ws").cast("long").alias("n_words"),
        shown(F.translate("text", " " + C.ASCII_WS, "")).alias("word_chars"),
        (shown(F.col("text")) - shown(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.expr(REPEAT_WORDS).alias("n_repeat_words"),
        F.expr(LINES).alias("lines"))


def verdicts(docs: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """Base counts of every row, the words its host's frequent lines hold, and whether the document is kept."""
    base = C.materialize(features(docs), "quality")
    lines = base.select("host", "key", F.explode("lines").alias("l")).select("host", "key", "l.line", "l.words")
    copies = C.materialize(base.groupBy("host", "copy").agg(F.count(F.lit(1)).alias("n")), "copies")
    hosts = copies.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    different = C.once(base.select("host", "copy", "lines"), copies.where("n > 1").select("copy"), "copy")
    frequent = (different.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
                .where(F.col("docs") >= min(policy.few_docs, policy.line_docs + 1)).join(hosts, "host")
                .where((F.col("docs") > policy.line_docs) | (F.col("docs") >= policy.few_docs)
                       & (F.col("docs") * 100 > F.col("host_docs") * policy.line_percent))
                .select("host", "line"))
    # A set, so that equal rows (one key) count their lines once.
    removed = (lines.join(frequent, ["host", "line"])
               .groupBy("key").agg(F.collect_set(F.struct("line", "words")).alias("gone"))
               .select("key", F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("gone"),
                       F.col("gone.line").alias("gone_lines")))
    return (base.drop("lines", "copy").join(removed, "key", "left")
            .withColumn("n_removed_words", F.coalesce("gone", F.lit(0).cast("long")))
            .withColumn("base_failed", (F.col("n_words") < policy.min_words)
                        | (F.col("n_repeat_words") * 100 > F.col("n_words") * policy.max_repeat_percent))
            .withColumn("kept", ~F.col("base_failed")
                        & (F.col("n_removed_words") * 100 <= F.col("n_words") * policy.max_removed_percent)))


def keep_good(docs: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """The rows of docs that are kept, their text without the frequent lines of their host; other columns unchanged.
    Only keys of rejects and of rows that lose lines are joined; the text stays where it is as long as they are few
    enough to broadcast."""
    key, kept, gone = C.free(docs, "__key", "__kept", "__gone")
    found = (verdicts(docs, policy).where(~F.col("kept") | F.col("gone_lines").isNotNull())
             .groupBy(F.col("key").alias(key)).agg(F.first("kept").alias(kept), F.first("gone_lines").alias(gone)))
    found = C.materialize(found.withColumn(gone, F.when(F.col(kept), F.col(gone))), "found")
    weight = found.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.size(F.coalesce(gone, F.array())))), F.lit(0))).first()[0]
    keyed = docs.withColumn(key, C.row_key(F.col("doc_id"), F.col("source"), F.col("text")))
    keyed = C.sized_join(keyed, found, key, "left", weight).where(F.coalesce(kept, F.lit(True)))
    return keyed.withColumn("text", F.when(F.col(gone).isNull(), F.col("text"))
                            .otherwise(_without(F.col("text"), F.col(gone)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(C.documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_words")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text
           FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g
          FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
line AS (SELECT rid, host, text, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l
         FROM (SELECT rid, unnest(lines) AS l FROM w) JOIN d USING (rid)),
freq AS (SELECT host, l FROM (SELECT host, l, count(DISTINCT text) AS n FROM line GROUP BY host, l)
         JOIN (SELECT host, count(DISTINCT text) AS hn FROM d GROUP BY host) USING (host)
         WHERE n > 20 OR (n >= 5 AND n * 100 > hn * 10)),
gone AS (SELECT rid, sum(len(l) - len(replace(l, ' ', '')) + 1)::BIGINT AS n
         FROM line JOIN freq USING (host, l) GROUP BY rid),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_removed_words * 100 <= n_words * 70 AS kept, n_removed_words
FROM b
"""

QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL = {"op9_quality_rules": OP9_SQL}
