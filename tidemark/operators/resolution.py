"""References to files: candidates joined with the file index under unique or ordered match rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import clean, strip_suffix

# What a runtime extension may stand for in the sources.
RUNTIME = {"js": ("ts", "tsx"), "jsx": ("tsx",), "mjs": ("mts", "ts"), "cjs": ("cts", "ts")}


def expand_aliases(references: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates of references (ref_id, package, target) by alias rules (package, prefix, suffix, replacement).

    Rules are joined by package, which bounds what a reference meets to its own package's rules.
    """
    j = references.join(rules, "package")
    held = F.startswith("target", "prefix") & F.endswith("target", "suffix") & (
        F.length("target") >= F.length("prefix") + F.length("suffix"))
    star = F.substring(F.col("target"), F.length("prefix") + 1, F.length("target") - F.length("prefix") - F.length("suffix"))
    return j.where(held).select("ref_id", F.replace("replacement", F.lit("*"), star).alias("candidate"))


def relative_candidates(references: DataFrame) -> DataFrame:
    """(ref_id, candidate): relative targets (ref_id, directory, target) below their source's directory, others below the root."""
    t = strip_suffix(F.col("target"))
    at = F.when(F.startswith(t, F.lit(".")), F.concat_ws("/", "directory", t)).otherwise(t)
    # A filter would be pushed below and clean the path once more.
    return references.select("ref_id", F.explode(F.array_compact(F.array(clean(at)))).alias("candidate"))


def runtime_candidates(candidates: DataFrame) -> DataFrame:
    """The candidates with priority 0 and, with priority 1, what their runtime extension may stand for."""
    ext = F.regexp_extract("candidate", r"\.([a-z]+)$", 1)
    table = F.create_map(*[x for k, v in RUNTIME.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    stem = F.regexp_replace("candidate", r"\.[a-z]+$", ".")
    one = lambda c, n: F.struct(c.alias("candidate"), F.lit(n).alias("priority"))
    more = F.transform(F.coalesce(F.try_element_at(table, ext), F.array().cast("array<string>")), lambda e: one(F.concat(stem, e), 1))
    # One pass: a union would read and clean the references twice.
    return candidates.select("ref_id", F.inline(F.concat(F.array(one(F.col("candidate"), 0)), more)))


def unique_match(references: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Each reference's outcome by its candidates of the first priority that has a file: one file resolves it, several
    are ambiguous, none leaves it unresolved. Candidates may occur again: only those that have a file are folded."""
    hit = candidates.join(files.select(F.col("path").alias("candidate")), "candidate")
    first = hit.groupBy("ref_id", "priority").agg(F.countDistinct("candidate").alias("n"), F.min("candidate").alias("path"))
    best = first.groupBy("ref_id").agg(F.min_by(F.struct("n", "path"), "priority").alias("m"))
    j = references.join(best, "ref_id", "left")
    return j.select("ref_id", F.when(F.col("m").isNull(), "unresolved").when(F.col("m.n") > 1, "ambiguous").otherwise("resolved").alias("outcome"),
                    F.when(F.col("m.n") == 1, F.col("m.path")).alias("path"))


def ordered_match(references: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """The first candidate (by ordinal) that is a file, as include searches and module layouts take it."""
    hit = candidates.join(files.select(F.col("path").alias("candidate")), "candidate")
    best = hit.groupBy("ref_id").agg(F.min_by("candidate", "ordinal").alias("path"))
    return references.join(best, "ref_id", "left").select(
        "ref_id", F.when(F.col("path").isNull(), "unresolved").otherwise("resolved").alias("outcome"), "path")


def manifest_match(references: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages by the first segment of a name (ref_id, target); a name that two packages declare is ambiguous."""
    t = F.col("target")
    first = F.when(F.startswith(t, F.lit("@")), F.regexp_extract(t, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(t, r"^([^/.:]+)", 1))
    named = packages.where("manifest_name IS NOT NULL").groupBy(F.col("manifest_name").alias("first")).agg(
        F.countDistinct("package").alias("n"), F.min("package").alias("package"))
    j = references.withColumn("first", first).join(named, "first", "left")
    return j.select("ref_id", F.when(F.col("n").isNull(), "external").when(F.col("n") > 1, "ambiguous").otherwise("package").alias("outcome"),
                    F.when(F.col("n") == 1, F.col("package")).alias("package"))


def python_match(references: DataFrame, files: DataFrame) -> DataFrame:
    """Import references (ref_id, path, module, name) to files: a module beats nothing, a module and a package of one
    name are ambiguous, an absolute name without a file is external, a relative one unresolved."""
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    tail = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    folder = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1 - F.greatest(dots - 1, F.lit(0)), F.lit(0)))
    base = F.when(dots > 0, F.concat_ws("/", F.array_join(folder, "/"), tail)).otherwise(tail)
    r = references.withColumn("base", F.regexp_replace(base, "^/|/$", "")).withColumn("relative", dots > 0)
    own = r.select("ref_id", F.col("base").alias("stem"), F.lit(1).alias("rank"))
    named = r.where("name IS NOT NULL").select("ref_id", F.regexp_replace(F.concat_ws("/", "base", "name"), "^/", "").alias("stem"), F.lit(0))
    stems = own.union(named)
    options = stems.select("ref_id", "rank", "stem", F.explode(F.array(
        F.concat("stem", F.lit(".py")), F.regexp_replace(F.concat_ws("/", "stem", F.lit("__init__.py")), "^/", ""))).alias("candidate"))
    hit = options.join(files.select(F.col("path").alias("candidate")), "candidate").groupBy("ref_id", "rank").agg(
        F.countDistinct("candidate").alias("n"), F.min("candidate").alias("file"))
    best = hit.groupBy("ref_id").agg(F.min_by(F.struct("n", "file"), "rank").alias("m"))
    return r.join(best, "ref_id", "left").select(
        "ref_id", F.when(F.col("m").isNull(), F.when(F.col("relative"), "unresolved").otherwise("external"))
        .when(F.col("m.n") > 1, "ambiguous").otherwise("resolved").alias("outcome"), F.when(F.col("m.n") == 1, F.col("m.file")).alias("file"))


#: Endings that a script's relative target may leave out, tried in this order.
SCRIPT_ENDINGS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "vue")


def alias_candidates(references: DataFrame, rules: DataFrame) -> DataFrame:
    """(ref_id, candidate) of references (ref_id, path, target) by the alias rules of the deepest rule package around them."""
    from ..functions.paths import nearest_package

    roots = rules.select("package").distinct()
    own = nearest_package(references.select("path").distinct(), roots).select("path", "package")
    found = expand_aliases(references.join(own, "path"), rules)
    return found.select("ref_id", clean(F.col("candidate")).alias("candidate")).where("candidate IS NOT NULL").distinct()


def script_match(references: DataFrame, files: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """Targets of scripts (ref_id, directory, target; exact: candidates other than the relative ones): the file itself, what
    its runtime extension stands for, the name with an ending, the folder's index, the first of these kinds that has a file."""
    exact = relative_candidates(references) if exact is None else exact
    ends = F.array(*[F.lit(f".{e}") for e in SCRIPT_ENDINGS])
    longer = exact.select("ref_id", F.explode(F.transform(ends, lambda e: F.concat("candidate", e))).alias("candidate"), F.lit(2))
    index = exact.select("ref_id", F.explode(F.transform(ends, lambda e: F.concat(F.col("candidate"), F.lit("/index"), e))).alias("candidate"), F.lit(3))
    return unique_match(references.select("ref_id").distinct(), runtime_candidates(exact).union(longer).union(index), files)


def include_candidates(references: DataFrame) -> DataFrame:
    """(ref_id, candidate, ordinal) of includes (ref_id, directory, target): beside the source, below the root, below include and src."""
    places = F.array(F.concat_ws("/", "directory", "target"), F.col("target"), F.concat(F.lit("include/"), "target"), F.concat(F.lit("src/"), "target"))
    return references.select("ref_id", F.posexplode(F.transform(places, clean)).alias("ordinal", "candidate")).where("candidate IS NOT NULL")


def rust_candidates(references: DataFrame) -> DataFrame:
    """(ref_id, candidate, ordinal) of paths (ref_id, path, target) that begin with crate, self or super. A file owns its
    folder if it is mod, lib or main, else the folder of its name; the source root is the path up to the first src.
    Segments are dropped from the end until a module is found; a module is a file or a folder's mod file."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.rs$", "")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    own = F.when(name.isin("mod", "lib", "main"), folder).otherwise(F.concat_ws("/", F.when(folder != "", folder), name))
    parent = F.regexp_replace(own, "/?[^/]*$", "")
    root = F.regexp_extract("path", r"^((?:.*?/)?src)/", 1)
    parts = F.split("target", "::")
    up = F.size(F.filter(parts, lambda x: x == "super"))
    base = F.when(parts[0] == "crate", root).when(parts[0] == "self", own).when(up == 1, parent).otherwise(F.regexp_replace(parent, "/?[^/]*$", ""))
    rest = F.filter(parts, lambda x: ~x.isin("crate", "self", "super") & (x != ""))
    r = references.where(parts[0].isin("crate", "self", "super")).select("ref_id", base.alias("base"), rest.alias("rest")).where("size(rest) > 0")
    stems = F.transform(F.sequence(F.size("rest"), F.lit(1), F.lit(-1)), lambda k: F.concat_ws(
        "/", F.when(F.col("base") != "", F.col("base")), F.array_join(F.slice("rest", 1, k), "/")))
    both = F.flatten(F.transform(stems, lambda x: F.array(F.concat(x, F.lit(".rs")), F.concat(x, F.lit("/mod.rs")))))
    return r.select("ref_id", F.posexplode(both).alias("ordinal", "candidate"))


def java_candidates(references: DataFrame) -> DataFrame:
    """(ref_id, candidate, ordinal) of qualified names (ref_id, path, target): below the source's own java folder, the usual
    source folders and the root; a nested type's outer types follow."""
    own = F.regexp_extract("path", r"^(.*?/java/)", 1)
    parts = F.split(F.regexp_replace("target", r"\.\*$", ""), r"\.")
    stems = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit(".java")))
    roots = F.array(own, F.lit("src/main/java/"), F.lit("src/test/java/"), F.lit("src/"), F.lit(""))
    every = F.flatten(F.transform(stems, lambda x: F.transform(roots, lambda r: F.concat(r, x))))
    return references.select("ref_id", F.posexplode(every).alias("ordinal", "candidate"))


def language_match(references: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """ref_id, outcome, file of imports (ref_id, path, language, module, name) by the rules of their language. A name
    without a file is external; a relative target, a quoted include or a crate path without one is unresolved."""
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    r = references.select("ref_id", "path", "language", directory.alias("directory"), F.col("module").alias("target"), "name", "module")
    of = lambda *names: r.where(F.col("language").isin(*names))
    scripts = of("javascript", "typescript").where(F.startswith("target", F.lit(".")))
    script = script_match(scripts, files)
    paths_ = of("c", "cpp", "rust", "java")
    tried = (include_candidates(of("c", "cpp")).select("ref_id", "ordinal", "candidate")
             .union(rust_candidates(of("rust")).select("ref_id", "ordinal", "candidate"))
             .union(java_candidates(of("java")).select("ref_id", "ordinal", "candidate")))
    local = F.col("target").rlike("^(crate|self|super)(::|$)")
    ordered = ordered_match(paths_.select("ref_id", local.alias("local")), tried, files).join(
        paths_.select("ref_id", local.alias("local")), "ref_id").select(
        "ref_id", F.when((F.col("outcome") == "unresolved") & ~F.col("local"), "external").otherwise(F.col("outcome")).alias("outcome"), "path")
    if aliases is not None:
        other = of("javascript", "typescript").where(~F.startswith("target", F.lit(".")))
        named = script_match(other.select("ref_id"), files, alias_candidates(other, aliases)).where("outcome <> 'unresolved'")
        script = script.union(named)
        scripts = scripts.select("ref_id").union(named.select("ref_id"))
    rest = r.where(~F.col("language").isin("c", "cpp", "rust", "java", "python")).join(scripts.select("ref_id"), "ref_id", "left_anti").select(
        "ref_id", F.lit("external").alias("outcome"), F.lit(None).cast("string").alias("path"))
    own = python_match(of("python").select("ref_id", "path", "module", "name"), files)
    return own.union(script).union(ordered).union(rest).toDF("ref_id", "outcome", "file")
