"""Relationships between declarations: calls, references, bases, imports, flows. Joins whose strategy Spark picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bounds import RELATION_LIMIT, bounded_per


def callers_and_callees(callables: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, symbol, direction, other_file, other_symbol) for every declared callable, each pair once."""
    own = callables.select("file", "symbol").distinct()
    calls = edges.filter(F.col("kind") == "internal")
    callers = own.join(calls, (F.col("file") == F.col("to_file")) & (F.col("symbol") == F.col("to_symbol"))).select("file", "symbol", F.lit("caller").alias("direction"), F.col("from_file").alias("other_file"), F.col("from_symbol").alias("other_symbol"))
    callees = own.join(calls, (F.col("file") == F.col("from_file")) & (F.col("symbol") == F.col("from_symbol"))).select("file", "symbol", F.lit("callee").alias("direction"), F.col("to_file").alias("other_file"), F.col("to_symbol").alias("other_symbol"))
    return callers.unionByName(callees).distinct()


def class_references(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls that construct a class."""
    return edges.join(classes.select(F.col("path").alias("to_file"), F.col("name").alias("to_symbol")).distinct(), ["to_file", "to_symbol"], "left_semi").select(F.col("to_file").alias("class_file"), F.col("to_symbol").alias("class_name"), F.col("from_file").alias("file"), F.col("from_symbol").alias("symbol"), F.lit("call").alias("via")).distinct()


def first_references(earlier: DataFrame, imports: DataFrame, keys: list[str]) -> DataFrame:
    """Import references only where no earlier reference from that file exists, after the earlier ones."""
    fresh = imports.join(earlier.select(*keys).distinct(), keys, "left_anti")
    return earlier.unionByName(fresh, allowMissingColumns=True)


def resolve_bases(classes: DataFrame, bindings: DataFrame, languages: DataFrame) -> DataFrame:
    """Each base name's class: of the same file, else the imported one, else one of a qualified module, else
    the only one of that name anywhere (not for Python). Rows without any stay unresolved.

    bindings: (path, name, target_path, target_name) of imports.
    """
    bases = classes.select("path", F.col("name").alias("class_name"), F.explode("bases").alias("base"))
    short = F.element_at(F.split("base", r"\."), -1)
    module = F.regexp_extract("base", r"^(.*)\.[^.]*$", 1)
    named = classes.select(F.col("path").alias("p"), F.col("name").alias("n")).distinct()
    bases = bases.withColumn("short", short).withColumn("module", module)
    same = bases.join(named, (F.col("p") == F.col("path")) & (F.col("n") == F.col("base")), "left").withColumn("same", F.col("p")).drop("p", "n")
    imported = bindings.select(F.col("path").alias("ip"), F.col("name").alias("iname"), F.col("target_path").alias("imported")).dropDuplicates(["ip", "iname"])
    with_import = same.join(imported, (F.col("ip") == F.col("path")) & (F.col("iname") == F.col("base")), "left").drop("ip", "iname")
    stem = named.select(F.regexp_replace(F.regexp_replace("p", r"\.[^./]+$", ""), "/", ".").alias("m"), F.col("n").alias("mn"), F.col("p").alias("qualified"))
    qualified = with_import.join(stem, (F.col("m") == F.col("module")) & (F.col("mn") == F.col("short")), "left").drop("m", "mn")
    unique = named.groupBy(F.col("n").alias("un")).agg(F.count("*").alias("k"), F.min("p").alias("only")).filter("k = 1").select("un", "only")
    everywhere = qualified.join(unique, F.col("un") == F.col("base"), "left").join(languages, "path", "left")
    only = F.when(F.coalesce(F.col("language"), F.lit("")) != "python", F.col("only"))
    return everywhere.select("path", "class_name", "base", F.coalesce("same", "imported", "qualified", only).alias("base_path"), F.when(F.col("same").isNotNull(), "same-file").when(F.col("imported").isNotNull(), "import").when(F.col("qualified").isNotNull(), "qualified").when(only.isNotNull(), "unique-name").alias("via")).distinct()


def subclasses(resolved: DataFrame) -> DataFrame:
    """The inverse: classes of each resolved base."""
    known = resolved.filter(F.col("base_path").isNotNull())
    return known.groupBy("base_path", F.element_at(F.split("base", r"\."), -1).alias("base_name")).agg(F.array_sort(F.collect_set(F.struct("path", "class_name"))).alias("subclasses"))


def type_references(functions: DataFrame, visible: DataFrame) -> DataFrame:
    """Functions whose parameter type, return type or decorator contains a class name visible in their file.

    Containment is plain: `User` is also found in `UserList`. The file is the join key, the text a residual.
    """
    texts = functions.select("path", "name", F.explode(F.array_compact(F.concat(F.col("params.type"), F.array("return_type"), F.coalesce("decorators", F.array().cast("array<string>"))))).alias("type_text"))
    return texts.join(visible.select("path", "class_name", "class_path"), "path").filter(F.contains("type_text", F.col("class_name"))).select("class_path", "class_name", "path", F.col("name").alias("function")).distinct()


def flow_membership(callables: DataFrame, steps: DataFrame) -> DataFrame:
    """Flows that each callable takes part in, with its first step there."""
    return callables.select("file", "symbol").distinct().join(steps, ["file", "symbol"]).groupBy("file", "symbol", "flow_id").agg(F.min("step_index").alias("first_step"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Candidate files of each import (module, name): the child module first, then the module or its package.

    All candidates of the best kind are kept; several make the import ambiguous.
    """
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    targets = files.select(F.regexp_replace(F.regexp_replace(stem, r"/(__init__|index|mod)$", ""), "/", ".").alias("module_key"), F.col("path").alias("target"))
    child = F.struct(F.concat_ws(".", "module", "name").alias("module_key"), F.lit(0).alias("rank"))
    own = F.struct(F.col("module").alias("module_key"), F.lit(1).alias("rank"))
    wanted = imports.select("path", "ordinal", "module", "name", F.explode(F.when(F.col("name").isNull(), F.array(own)).otherwise(F.array(child, own))).alias("w")).select("path", "ordinal", "module", "name", "w.*")
    hits = wanted.join(targets, "module_key")
    best = hits.withColumn("best", F.min("rank").over(Window.partitionBy("path", "ordinal"))).filter("rank = best")
    found = best.groupBy("path", "ordinal").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    out = imports.join(found, ["path", "ordinal"], "left")
    n = F.coalesce(F.size("targets"), F.lit(0))
    return out.withColumn("resolution", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("external"))


def nearest_scope(paths: DataFrame, scopes: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """The enclosing scope of each path that is nearest: the deepest root, then the longest.

    A path's own ancestors are exploded and joined by equality, so no range join is needed.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    wanted = paths.withColumn("ancestor", F.explode(above))
    joined = wanted.join(scopes, F.col("ancestor") == F.col(root))
    depth = F.when(F.col(root) == "", 0).otherwise(F.size(F.split(root, "/")))
    place = F.row_number().over(Window.partitionBy(path).orderBy(depth.desc(), F.length(root).desc(), root))
    found = joined.withColumn("place", place).filter("place = 1").drop("place", "ancestor")
    return paths.join(found.drop(*[c for c in paths.columns if c != path]), path, "left")


def affected_pages(inventory: DataFrame, surface: DataFrame, declared: DataFrame) -> DataFrame:
    """(source, page): pages named for a source or its surface rows, less pages whose declared source is another, plus declared ones."""
    by_name = inventory.select(F.col("path").alias("source"), "page")
    by_surface = surface.filter(F.col("source_path").isNotNull()).select(F.col("source_path").alias("source"), F.col("canonical_path").alias("page"))
    guessed = by_name.unionByName(by_surface).distinct()
    elsewhere = guessed.join(declared.select("page", F.col("source").alias("other")), "page").filter(F.col("source") != F.col("other")).select("source", "page")
    return guessed.join(elsewhere, ["source", "page"], "left_anti").unionByName(declared.select("source", "page")).distinct()


def touching(edges: DataFrame, changed: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Edges with a changed end: two semi joins and a union, not an OR join."""
    c = changed.select(changed.columns[0]).distinct()
    left = edges.join(c.toDF(source), source, "left_semi")
    right = edges.join(c.toDF(target), target, "left_semi")
    return left.select(edges.columns).unionByName(right.select(edges.columns)).distinct()


def dependency_gaps(used: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Used but undeclared, and declared but unused."""
    missing = used.select(*keys).distinct().join(declared, keys, "left_anti").withColumn("state", F.lit("undeclared"))
    return missing.unionByName(declared.select(*keys).distinct().join(used, keys, "left_anti").withColumn("state", F.lit("unused")))


def summary(callables: DataFrame, edges: DataFrame, steps: DataFrame, limit: int = RELATION_LIMIT) -> DataFrame:
    """All relationships of each callable in total order, bounded per kind with exact totals."""
    calls = callers_and_callees(callables, edges).select("file", "symbol", F.col("direction").alias("relation"), F.concat_ws(":", "other_file", "other_symbol").alias("value"))
    flows = flow_membership(callables, steps).select("file", "symbol", F.lit("flow").alias("relation"), F.col("flow_id").alias("value"))
    return bounded_per(calls.unionByName(flows).distinct(), ["file", "symbol", "relation"], [F.lower("value"), F.col("value")], limit)
