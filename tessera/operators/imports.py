"""Module names to files, by the rules of the importing file's language.

Every import becomes a few keys with a rank (the nearest scope's meaning first), every file the keys that it answers to;
they meet by one equality join, and the files of the best rank that any has are the candidates. Aliases and module
scopes are found by the ancestors of the importing file, so no prefix is compared with all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relationships import nearest_scope

# Source endings that an alias's target may carry, languages that resolve like TypeScript.
TS_ENDINGS = r"\.(d\.ts|tsx|ts|jsx|js|mjs|cjs)$"
TS_FAMILY = ("typescript", "javascript")
_IMPORT = ["path", "ordinal"]


def normalized(path: Column) -> Column:
    """A slash-separated path without `.`, empty and resolvable `..` parts."""
    step = lambda done, part: F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), "/$", "")


def joined(*parts: Column) -> Column:
    return normalized(F.concat_ws("/", *parts))


def family(language: Column) -> Column:
    return F.when(language.isin(*TS_FAMILY), "typescript").otherwise(language)


def ts_alias_rules(configs: DataFrame) -> DataFrame:
    """Alias rules (root, pattern, targets) of tsconfig files (path, content); targets are from the top of the tree.

    A file that isn't JSON, or whose paths are no lists of text, has no rules. Map-only, without Python.
    """
    shape = "compilerOptions struct<baseUrl:string, paths:map<string,array<string>>>"
    options = F.from_json("content", shape)["compilerOptions"]
    rows = configs.select(folder(F.col("path")).alias("root"), F.coalesce(options["baseUrl"], F.lit(".")).alias("base"), F.explode(options["paths"]).alias("pattern", "given"))
    return rows.select("root", "pattern", F.transform(F.filter("given", lambda t: t.isNotNull()), lambda t: joined(F.col("root"), F.col("base"), t)).alias("targets")).filter(F.size("targets") > 0)


def go_module_scopes(manifests: DataFrame) -> DataFrame:
    """(root, module) of go.mod files (path, content)."""
    name = F.regexp_extract("content", r'(?m)^\s*module\s+"?([^\s"]+?)"?\s*(?://.*)?$', 1)
    return manifests.select(folder(F.col("path")).alias("root"), name.alias("module")).filter("module <> ''")


def python_scopes(files: DataFrame) -> DataFrame:
    """(root, searched): where absolute imports of Python files below a root are looked for; a `src` folder comes first.

    Everything is below the root "", which is searched itself.
    """
    src = files.filter(F.col("language") == "python").select(F.regexp_extract("path", r"^(?:(.*?)/)?src/", 1).alias("root"), F.col("path").rlike(r"(^|/)src/").alias("has")).filter("has").select("root").distinct()
    inferred = src.select("root", F.array(joined(F.col("root"), F.lit("src")), F.col("root")).alias("searched"))
    top = files.sparkSession.range(1).select(F.lit("").alias("root"), F.array(F.lit("")).alias("searched"))
    return inferred.unionByName(top.join(inferred.filter("root = ''"), "root", "left_anti"))


def file_keys(files: DataFrame) -> DataFrame:
    """(family, key, target): what an import may call each file (path, language, module).

    Python: its path without ending, a package's folder. Go: its folder. Haskell: its module. Other languages: its path,
    also without a leading src, an index file's folder, and every tail of these.
    """
    kind = family(F.col("language"))
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    plain = F.regexp_replace(stem, r"^src/", "")
    index = F.col("path").rlike(r"(^|/)index\.[^./]+$") & (kind == "typescript")
    whole = F.concat(F.array(stem, plain), F.when(index, F.array(folder(stem), folder(plain))).otherwise(F.array().cast("array<string>")))
    tails = F.flatten(F.transform(whole, lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda k: F.array_join(F.slice(F.split(p, "/"), k, F.lit(1 << 20)), "/"))))
    python = F.when(F.col("path").rlike(r"(^|/)__init__\.py$"), F.array(stem, folder(stem))).otherwise(F.array(stem))
    keys = F.when(kind == "python", python).when(kind == "go", F.array(F.concat(F.lit("/"), folder(F.col("path"))))).when(kind == "haskell", F.array(F.trim("module"))).otherwise(tails)
    return files.select(kind.alias("family"), F.explode(F.array_distinct(keys)).alias("key"), F.col("path").alias("target")).filter("key <> ''")


def _relative(module: Column, path: Column) -> Column:
    """What a Python-like relative module (leading dots) names, as a path."""
    dots = F.length(F.regexp_extract(module, r"^\.+", 0))
    up = F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0)))
    return normalized(F.concat(folder(path), up, F.lit("/"), F.replace(F.expr("ltrim('.', module)"), F.lit("."), F.lit("/"))))


def _keys(rows: DataFrame, *keys: tuple[int, Column]) -> DataFrame:
    """Rows (path, ordinal, family, rank, key) of the keys that aren't null."""
    made = F.array(*[F.struct(F.lit(rank).alias("rank"), key.alias("key")) for rank, key in keys])
    return rows.select(*_IMPORT, "family", F.explode(made).alias("k")).select(*_IMPORT, "family", "k.rank", "k.key").filter("key <> ''")


def _python(imports: DataFrame, scopes: DataFrame) -> DataFrame:
    rows = nearest_scope(imports.filter("family = 'python'"), scopes)
    # `from p import c` means the module p.c first, then p.
    child = F.when((F.col("kind") == "from") & (F.col("name") != "*"), F.concat("module", F.when(F.col("module").rlike(r"^\.+$"), "").otherwise("."), "name"))
    rows = rows.select("*", F.posexplode(F.array(child, F.col("module"))).alias("place", "wanted")).filter("wanted <> ''").drop("module").withColumnRenamed("wanted", "module")
    near = rows.filter(F.startswith("module", F.lit("."))).select(*_IMPORT, "family", (F.col("place") * 2).alias("rank"), _relative(F.col("module"), F.col("path")).alias("key"))
    far = rows.filter(~F.startswith("module", F.lit("."))).select(*_IMPORT, "family", "place", F.replace("module", F.lit("."), F.lit("/")).alias("m"), F.posexplode("searched").alias("k", "at"))
    return near.unionByName(far.select(*_IMPORT, "family", (F.col("place") * 2 + F.col("k")).alias("rank"), joined(F.col("at"), F.col("m")).alias("key")))


def _go(imports: DataFrame, scopes: DataFrame) -> DataFrame:
    rows = imports.filter("family = 'go'")
    relative = F.col("module").rlike(r"^\.{1,2}(/|$)")
    near = rows.filter(relative).select(*_IMPORT, "family", F.lit(0).alias("rank"), F.concat(F.lit("/"), joined(folder(F.col("path")), F.col("module"))).alias("key"))
    # A package's path begins with its module's; the ancestors of the path meet the modules by equality.
    parts = F.split("module", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    nearest = nearest_scope(rows.filter(~relative).select("path").distinct(), scopes.select("root", F.col("module").alias("own_module"))).select("path", F.col("root").alias("own_root"))
    far = rows.filter(~relative).withColumn("under", F.explode(above)).join(scopes.select("root", F.col("module").alias("under")), "under").join(nearest, "path", "left")
    depth = F.size(F.split("root", "/"))
    order = F.when(F.col("root").eqNullSafe(F.col("own_root")), 0).otherwise((1 << 30) - F.length("under") * 4096 - depth * 64)
    return near.unionByName(far.select(*_IMPORT, "family", order.cast("int").alias("rank"), F.concat(F.lit("/"), joined(F.col("root"), F.expr("substring(module, length(under) + 1)"))).alias("key")))


def _typescript(imports: DataFrame, rules: DataFrame) -> DataFrame:
    rows = imports.filter("family = 'typescript'")
    # All rules of the nearest configuration count; one without a star means its whole pattern.
    grouped = rules.groupBy("root").agg(F.collect_list(F.struct("pattern", "targets")).alias("rules"))
    rows = nearest_scope(rows, grouped)

    def star(r: Column) -> Column:
        before = F.substring_index(r["pattern"], "*", 1)
        after = F.when(F.contains(r["pattern"], F.lit("*")), F.regexp_replace(r["pattern"], r"^[^*]*\*", ""))
        fits = F.startswith(F.col("module"), before) & F.endswith(F.col("module"), after) & (F.length("module") >= F.length(before) + F.length(after))
        middle = F.col("module").substr(F.length(before) + 1, F.length("module") - F.length(before) - F.length(after))
        return F.when(after.isNull(), F.when(F.col("module") == r["pattern"], "")).when(fits, middle)

    met = F.filter(F.transform("rules", lambda r: F.struct(star(r).alias("star"), r["targets"].alias("targets"))), lambda m: m["star"].isNotNull())
    rows = rows.withColumn("met", F.coalesce(met, F.array().cast("array<struct<star:string,targets:array<string>>>")))
    path = F.flatten(F.transform("met", lambda m: F.transform(m["targets"], lambda t: normalized(F.replace(t, F.lit("*"), m["star"])))))
    aliased = rows.filter(F.size("met") > 0).withColumn("p", F.explode(path))
    bare = F.regexp_replace("p", TS_ENDINGS, "")
    by_alias = _keys(aliased, (0, bare), (0, F.when(bare == F.col("p"), F.concat("p", F.lit("/index")))))
    rest = rows.filter(F.size("met") == 0)
    relative = F.col("module").rlike(r"^\.{1,2}/")
    named = relative & F.col("module").rlike(TS_ENDINGS)  # names the file itself
    exact = rest.filter(named).select(*_IMPORT, "family", F.lit(-1).alias("rank"), joined(folder(F.col("path")), F.col("module")).alias("key"))
    other = _general(rest.filter(~named))
    return by_alias.unionByName(exact).unionByName(other)


def _general(rows: DataFrame) -> DataFrame:
    """Relative paths, relative dots, or a name whose separators are slashes, dots or double colons."""
    slashed = F.replace(F.replace("module", F.lit("::"), F.lit("/")), F.lit("."), F.lit("/"))
    key = F.when(F.col("module").rlike(r"^\.{1,2}/"), joined(folder(F.col("path")), F.col("module"))).when(F.startswith("module", F.lit(".")), _relative(F.col("module"), F.col("path"))).otherwise(F.regexp_replace(slashed, "^/+|/+$", ""))
    return _keys(rows, (0, key))


def import_targets(imports: DataFrame, files: DataFrame, ts_rules: DataFrame, go_scopes: DataFrame) -> DataFrame:
    """Imports (path, ordinal, module, name, kind) with `targets`, the files that each may mean, and `resolution`.

    files: path, language, module (a Haskell file's own name). One target is resolved, several are ambiguous. Without any
    it is `internal` if an alias or a Go module scope claims the name, else external.
    """
    if "module" not in files.columns:
        files = files.withColumn("module", F.lit(None).cast("string"))
    module = F.regexp_replace(F.trim("module"), r"""^["']+|["']+$""", "")
    rows = imports.withColumn("module", F.replace(module, F.lit("\\"), F.lit("/"))).join(files.select("path", family(F.col("language")).alias("family")), "path", "left")
    other = rows.filter(F.col("family").isNull() | ~F.col("family").isin("python", "go", "haskell", "typescript"))
    wanted = _python(rows, python_scopes(files)).unionByName(_go(rows, go_scopes)).unionByName(_typescript(rows, ts_rules)).unionByName(_general(other))
    wanted = wanted.unionByName(rows.filter("family = 'haskell'").select(*_IMPORT, "family", F.lit(0).alias("rank"), F.col("module").alias("key")))
    # A rank below 0 names a file with its ending.
    whole = files.select(family(F.col("language")).alias("family"), F.col("path").alias("key"), F.col("path").alias("target"))
    hits = wanted.filter("rank >= 0").join(file_keys(files), ["family", "key"]).unionByName(wanted.filter("rank < 0").join(whole, ["family", "key"]))
    by_rank = hits.groupBy(*_IMPORT, "rank").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    best = by_rank.groupBy(*_IMPORT).agg(F.min_by("targets", "rank").alias("targets"))
    claimed = wanted.filter("family = 'go'").select(*_IMPORT).union(_claimed(rows, ts_rules)).distinct().withColumn("claimed", F.lit(True))
    out = imports.join(best, _IMPORT, "left").join(claimed, _IMPORT, "left")
    n = F.coalesce(F.size("targets"), F.lit(0))
    return out.withColumn("resolution", F.when(n == 1, "resolved").when(n > 1, "ambiguous").when(F.col("claimed"), "internal").otherwise("external")).drop("claimed")


def _claimed(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """TypeScript imports that an alias of their nearest configuration matches, whether or not a file is there."""
    grouped = rules.groupBy("root").agg(F.collect_list("pattern").alias("patterns"))
    near = nearest_scope(rows.filter("family = 'typescript'"), grouped)
    fits = lambda p: F.when(F.contains(p, F.lit("*")), F.startswith(F.col("module"), F.substring_index(p, "*", 1)) & F.endswith(F.col("module"), F.regexp_replace(p, r"^[^*]*\*", "")) & (F.length("module") >= F.length(p) - 1)).otherwise(F.col("module") == p)
    return near.filter(F.exists("patterns", fits)).select(*_IMPORT)
