"""Personal data: fixed patterns, and terms that disclose the entities of their documents (DataFrame functions only).

Pattern matches are found with their places by splitting a text at the pattern: the lengths of the pieces and of the
matches add up to the offsets. The sanitisation then asks of every term of a document with a match how much of the
entity's information it gives away: with document counts over the whole corpus, PMI(term; entity) / IC(entity), which
is 1 where the term occurs only with the entity. Every pair counts, also one of a single document: a smoothing strong
enough to matter there would be a cut by another name. Terms at or above ``disclose`` are generalised, those at or
above ``remove`` are removed, at every place of the document outside the matches. Terms are runs of two or more
letters, digits and underscores, and every two neighbouring characters of a Han or kana run, which has no blanks.

Cases: a null text is empty (no spans); repeated rows get equal spans and count as one document of the corpus
statistics; a null doc_id is carried; an empty table gives an empty result; other columns are ignored by :func:`find`
and carried by :func:`redact`. Texts are of any length: work grows with the length of a text and with its matches to the
power 1.5 at most (running sums go by blocks of a square root's size).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone", "term")
# Forms of the patterns that find the same matches in one pass: a match starts where a run of its characters starts
# (or where the last match ended), and a card is a whole run of 12 to 19 digits.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{M}\p{N}_]{2,}"
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
#: A place before two such characters; the group holds them.
BIGRAM = rf"(?=({_CJK}{{2}}))"


@dataclass(frozen=True)
class Policy:
    disclose: float = 0.8
    remove: float = 0.999


def _quoted(regex: str) -> str:
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(values: str, op: str) -> str:
    """SQL for the running sums (op '+') or maxima ('greatest') of an array of ints. Blocks of a square root's size keep
    the copies that a growing array costs in bounds."""
    two = (lambda a, b: f"{a} + {b}") if op == "+" else (lambda a, b: f"{op}({a}, {b})")
    grow = lambda v: (f"aggregate({v}, CAST(array() AS array<int>), "  # noqa: E731
                      f"(o, x) -> array_append(o, {two('coalesce(get(o, size(o) - 1), 0)', 'x')}))")
    return f"""transform(array({values}), v -> CASE WHEN size(v) <= 64 THEN {grow('v')} ELSE
 transform(array(CAST(ceil(sqrt(size(v))) AS INT)), c ->
  transform(array(transform(sequence(0, CAST((size(v) - 1) div c AS INT)), k -> {grow('slice(v, k * c + 1, c)')})), parts ->
   transform(array({grow('transform(parts, p -> element_at(p, -1))')}), tops ->
    flatten(transform(parts, (p, k) -> CASE WHEN k = 0 THEN p ELSE transform(p, x -> {two('x', 'tops[k - 1]')}) END)))[0])[0])[0]
 END)[0]"""


#: A place: code points s to e, bytes b to f, and what stands there.
_PLACE = "array<struct<s:int,e:int,b:int,f:int,m:string>>"


def places(text: str, regex: str) -> str:
    """SQL for the matches of regex in the SQL string text with their places."""
    r = _quoted(regex)
    upto = lambda size: running(f"transform(ms, (m, i) -> {size}(ps[i]) + {size}(m))", "+")
    return f"""transform(array(regexp_extract_all({text}, {r}, 0)), ms ->
 CASE WHEN size(ms) = 0 THEN CAST(array() AS {_PLACE}) ELSE
  transform(array(split({text}, {r}, -1)), ps -> transform(array({upto('length')}), cs -> transform(array({upto('octet_length')}), bs ->
   transform(ms, (m, i) -> named_struct('s', cs[i] - length(m), 'e', cs[i], 'b', bs[i] - octet_length(m), 'f', bs[i], 'm', m)))[0])[0])[0]
 END)[0]"""


_DIGITS = "translate(x.m, ' ()-.+', '')"
_LUHN = ("aggregate(sequence(1, length({d})), 0, (t, i) -> t + CASE WHEN i % 2 = 1 THEN CAST(substr({d}, -i, 1) AS INT) "
         "ELSE CAST(substr('0246813579', CAST(substr({d}, -i, 1) AS INT) + 1, 1) AS INT) END) % 10 = 0").format(d=_DIGITS)
_KEEP = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), y -> length(ltrim('0', y)) <= 3 AND CAST(concat('0', ltrim('0', y)) AS BIGINT) <= 255)"
          .replace("ltrim('0', y)", "trim(LEADING '0' FROM y)"),
    "card": _LUHN,
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
_ENTITY = {"email": "lower(x.m)", "ip": "x.m", "card": _DIGITS, "phone": _DIGITS}


def _of_kind(kind: str, regex: str, needs: str | None) -> str:
    k = KINDS.index(kind)
    found = (f"transform(filter({places('text', regex)}, x -> {_KEEP[kind]}), "
             f"x -> struct(x.s AS s, {k} AS k, x.e AS e, x.b AS b, x.f AS f, xxhash64('{kind}', {_ENTITY[kind]}) AS entity))")
    none = "CAST(array() AS array<struct<s:int,k:int,e:int,b:int,f:int,entity:bigint>>)"
    return f"CASE WHEN contains(text, '{needs}') THEN {found} ELSE {none} END" if needs else found


def _rebuilt(spans: str, piece: str) -> str:
    """SQL for the text put together anew: for each span x, sorted, the SQL string piece, where p is the byte up to which
    earlier spans reach and raw the text's bytes; then what follows the last span. A piece is cut from bytes, which takes no
    longer the further behind it lies."""
    return f"""transform(array(CAST(text AS BINARY)), raw -> transform(array({running(f"transform({spans}, x -> x.f)", "greatest")}), reach ->
 concat(array_join(transform({spans}, (x, i) -> transform(array(coalesce(get(reach, i - 1), 0)), p -> {piece})[0]), ''),
  CAST(substring(raw, coalesce(element_at(reach, -1), 0) + 1) AS STRING)))[0])[0]"""


_BEFORE = "CAST(substring(raw, p + 1, greatest(x.b - p, 0)) AS STRING)"
#: The text with a blank for every character of a match: terms are looked for outside of matches, at the same places
#: (matches are ASCII).
_MASKED = _rebuilt("base", f"concat({_BEFORE}, repeat(' ', greatest(0, x.f - greatest(x.b, p))))")


def _terms(text: str) -> str:
    """SQL for the distinct terms of the SQL string text, in lower case."""
    runs = f"regexp_extract_all({text}, {_quoted(TERM)}, 0)"
    pairs = (f"CASE WHEN rlike({text}, {_quoted(_CJK)}) THEN regexp_extract_all({text}, {_quoted(BIGRAM)}, 1) "
             f"ELSE CAST(array() AS array<string>) END")
    return f"array_distinct(transform(array_distinct(concat({runs}, {pairs})), t -> lower(t)))"


def _term_places(text: str) -> str:
    """SQL for the terms of the SQL string text, every occurrence with its place."""
    upto = lambda size: running(f"transform(ps, p -> {size}(p))", "+")
    m = "concat(ps[i], substring(ps[i + 1], 1, 1))"
    # Cut before every pair and inside every run, a pair is a piece of one such character and the first of the next piece.
    pairs = f"""transform(array(split({text}, {_quoted(f'(?={_CJK}{{2}})|(?<={_CJK})(?={_CJK})')}, -1)), ps ->
  transform(array({upto('length')}), cs -> transform(array({upto('octet_length')}), bs ->
   transform(filter(sequence(0, size(ps) - 1), i -> i + 1 < size(ps) AND rlike(ps[i], {_quoted('^' + _CJK + '$')})
                    AND rlike(ps[i + 1], {_quoted('^' + _CJK)})),
    i -> named_struct('s', cs[i] - 1, 'e', cs[i] + 1, 'b', bs[i] - octet_length(ps[i]), 'f', bs[i] - octet_length(ps[i]) + octet_length({m}),
                      'm', {m})))[0])[0])[0]"""
    return (f"concat({places(text, TERM)}, CASE WHEN rlike({text}, {_quoted(_CJK + '{2}')}) THEN {pairs} "
            f"ELSE CAST(array() AS {_PLACE}) END)")


def base_table(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """doc_id, key, base spans in order, and, only where there are spans, the text without them."""
    d = docs.select("doc_id", C.row_key(F.col("doc_id"), F.col("text")).alias("key"), C.whole("text").alias("text"))
    kinds = [_of_kind("email", EMAIL, "@"), _of_kind("ip", IP, "."), _of_kind("card", CARD, None),
             _of_kind("phone", PHONE, "+")]
    d = d.withColumn("base", F.expr(f"array_sort(concat({', '.join(kinds)}))"))
    return d.select("doc_id", "key", "base", F.expr(f"CASE WHEN size(base) > 0 THEN {_MASKED} END").alias("masked"))


def holders(base: DataFrame) -> DataFrame:
    """The distinct documents with matches: id (short, for the joins that follow), key, masked, entities."""
    found = base.where("masked IS NOT NULL").select("key", "masked", F.array_distinct("base.entity").alias("entities"))
    one = found.groupBy("key").agg(F.first("masked").alias("masked"), F.first("entities").alias("entities"))
    return C.materialize(one.withColumn("id", F.monotonically_increasing_id()), "holders")


def disclosures(docs: DataFrame, base: DataFrame, held_by: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(id, term, part): terms of a document that give away at least ``disclose`` of the information of one of its entities.

    With N documents, part >= d means n_t <= n_et (N / n_e)^(1 - d), and n_et <= n_e, so a term in more than
    n_e^d N^(1 - d) documents discloses no entity of n_e documents. Such pairs are left out before they are counted;
    no pair that could disclose is.
    """
    rows = C.materialize(base.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "rows")
    known = F.lit(float(max(rows.count(), 1)))
    mentions = held_by.select("id", "key", F.explode("entities").alias("entity"))
    # Entities of the same documents disclose and are disclosed alike: they are one class, so that a text with very many
    # entities and terms does not pair them all. A class is named by its documents (their number and two hashes of their set).
    sets = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("x"),
                                          F.bit_xor(F.xxhash64(F.lit(2), "key")).alias("y"))
    # A hair above the bound, for rounding.
    most = F.pow(F.col("n_e").cast("double"), F.lit(policy.disclose)) * F.pow(known, F.lit(1 - policy.disclose)) * 1.000001
    entities = C.materialize(sets.where(F.col("n_e") < known).select(
        "entity", "n_e", most.alias("most"), F.xxhash64("n_e", "x", "y").alias("class")), "entities")
    held = C.sized_join(mentions.select("id", "entity"), entities, "entity", "inner").select(
        "id", F.col("class").alias("entity"), "n_e", "most").distinct()
    held = held.groupBy("id").agg(F.collect_list(F.struct("entity", "n_e", "most")).alias("held"), F.max("most").alias("top"))
    top = entities.agg(F.coalesce(F.max("most"), F.lit(0.0))).first()[0]
    each = C.once(docs.select(C.row_key(F.col("doc_id"), F.col("text")).alias("key"), "text"), rows.where("n > 1").select("key"))
    words = each.select(F.explode(F.expr(_terms("coalesce(text, '')"))).alias("term"))
    # Counted before the join. Terms of so many documents that a join would deal them to one task, and that disclose
    # nothing, are few (at most a thousand times the terms of a document) and taken out by a broadcast.
    counts = C.materialize(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "counts")
    hot = counts.where((F.col("n_t") > top) & (F.col("n_t") * 1000 > known)).select("term")
    own = held_by.select("id", "masked").join(held, "id")
    own = own.select("id", "held", "top", F.explode(F.expr(_terms("masked"))).alias("term"))
    own = C.sized_join(own, hot, "term", "left_anti")
    own = C.sized_join(own, counts.where(F.col("n_t") <= top), "term", "inner").where("n_t <= top")
    pairs = C.materialize(own.select("id", "term", "n_t", F.explode(F.expr("filter(held, x -> n_t <= x.most)")).alias("x"))
                          .select("id", "term", "n_t", "x.entity", "x.n_e"), "pairs")
    log2 = lambda c: F.log2(c.cast("double"))
    rules = (pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.first("n_t").alias("n_t"),
                                                 F.first("n_e").alias("n_e"))
             .withColumn("part", log2(F.col("n_et") * known / (F.col("n_e") * F.greatest("n_t", "n_et")))
                         / log2(known / F.col("n_e")))
             .where(F.col("part") >= policy.disclose).select("entity", "term", "part"))
    rules = C.materialize(rules, "rules")
    return (C.sized_join(pairs.select("id", "entity", "term"), rules, ["entity", "term"], "inner")
            .groupBy("id", "term").agg(F.max("part").alias("part")))


def find(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """doc_id, key, base spans and added terms (s, k, e, b, f, part), no text."""
    base = C.materialize(base_table(docs, policy), "pii")
    held_by = holders(base)
    rules = C.materialize(disclosures(docs, base, held_by, policy), "disclosures")
    # Every occurrence is looked up by a join: a text of many terms and rules takes no longer for each term.
    some = held_by.select("id", "masked").join(rules.select("id").distinct(), "id")
    here = some.select("id", F.explode(F.expr(_term_places("masked"))).alias("x")).select("id", F.lower("x.m").alias("term"), "x.s", "x.e", "x.b", "x.f")
    added = here.join(rules, ["id", "term"]).groupBy("id").agg(F.array_sort(F.collect_set(F.struct(
        "s", F.lit(4).alias("k"), "e", "b", "f", "part"))).alias("terms"))
    added = held_by.select("id", "key").join(added, "id").select("key", "terms")
    return base.select("doc_id", "key", "base").join(added, "key", "left").select(
        "doc_id", "key", "base", F.coalesce("terms", F.expr(
            "CAST(array() AS array<struct<s:int,k:int,e:int,b:int,f:int,part:double>>)")).alias("terms"))


_NAME = "element_at(array({}), x.k + 1)".format(", ".join(f"'{k}'" for k in KINDS))
_JOINED = f"array_join(transform({{}}, x -> concat({_NAME}, ':', x.s, ':', x.e)), ',')"
_ALL = ("array_sort(concat(transform(base, x -> struct(x.s AS s, x.k AS k, x.e AS e, x.b AS b, x.f AS f, 0D AS part)), terms))")
_MARK = ("CASE WHEN x.k < 4 THEN concat('[', upper({name}), ']') WHEN x.part >= {remove} THEN '' ELSE '[WORD]' END")


def redact(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """docs with matches replaced by their kind and disclosing terms generalised or removed; other columns unchanged."""
    key, own = C.free(docs, "__key", "__spans")
    spans = (find(docs, policy).where("size(base) + size(terms) > 0").groupBy("key")
             .agg(F.first("base").alias("base"), F.first("terms").alias("terms"))
             .select(F.col("key").alias(key), F.expr(_ALL).alias(own)))
    spans = C.materialize(spans, "spans")
    weight = spans.agg(F.coalesce(F.sum(F.size(own)), F.lit(0))).first()[0]  # bounds what a broadcast would hold
    mark = _MARK.format(name=_NAME, remove=policy.remove)
    text = F.expr(_rebuilt(own, f"CASE WHEN x.b >= p THEN concat({_BEFORE}, {mark}) ELSE '' END"))
    keyed = docs.withColumn(key, C.row_key(F.col("doc_id"), F.col("text")))
    keyed = C.sized_join(keyed, spans, key, "left", weight)
    return keyed.withColumn("text", F.when(F.col(own).isNull(), F.col("text")).otherwise(text)).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(C.documents(spark, sf_dir))
    count = lambda k: F.expr(f"CAST(size(filter(base, x -> x.k = {k})) AS BIGINT)")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])],
        F.sha2(F.expr(_JOINED.format("base")), 256).alias("base_sha256"),
        F.expr(_JOINED.format(_ALL)).alias("spans"), F.size("terms").cast("long").alias("n_term"))


QUERIES = {"op10_pii": op10_pii}
SQL: dict[str, str] = {}
