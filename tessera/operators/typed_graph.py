"""A typed graph from inventories: containment, imports, calls, entry points, reads and writes, declared dependencies.

Every source gives observations of one shape; their union is read and merged once. A task already counts equal ones among
the rows that it has, and an edge keeps its least samples only, so one seen a billion times costs small rows and no list.
Symbols stand for the concept that owns them: their own, their class's, else their file's; one that several concepts
claim is never given to one of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest
from .graph import shuffled

# Kinds of edges and of what they lead to.
KINDS = ("contains", "imports", "calls", "entrypoint_for", "reads", "writes", "depends_on", "supersedes")
CONCEPT, EXTERNAL, UNRESOLVED = "concept", "external", "unresolved"
IDENTITY = ["kind", "source", "target_kind", "target", "origin", "resolution"]
OBSERVATION = [*IDENTITY, "evidence"]
SAMPLES = 3


def _owned(places: DataFrame, concepts: DataFrame) -> DataFrame:
    """(path, named, locator): the concept that owns each place (path, named), an empty name for the file; null where there is none.

    All steps but one are dealt by (path, named), so that places, owners and what asks for them are moved once each.
    """
    own = concepts.groupBy(F.col("source_path").alias("path"), F.coalesce("symbol", F.lit("")).alias("tried")).agg(F.count("*").alias("n"), F.min("locator").alias("found")).filter("n = 1").drop("n")
    names = F.array_distinct(F.array(F.col("named"), F.substring_index("named", ".", 1), F.lit("")))
    tried = places.distinct().select("path", "named", F.posexplode(names).alias("rank", "tried")).join(shuffled(own), ["path", "tried"], "left")
    return tried.groupBy("path", "named").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.col("rank"))).alias("locator"))


def owners(places: DataFrame, concepts: DataFrame) -> DataFrame:
    """(path, symbol, locator): the concept that owns each place; null where there is none."""
    return _lifted(places.select("path", "symbol").distinct(), concepts, "path", "symbol", "locator")


def _lifted(rows: DataFrame, concepts: DataFrame, path: str, symbol: str, name: str) -> DataFrame:
    named = F.coalesce(F.col(symbol), F.lit(""))
    found = _owned(rows.filter(F.col(path).isNotNull()).select(F.col(path).alias("path"), named.alias("named")), concepts)
    found = found.withColumnsRenamed({"path": "lp", "named": "ln", "locator": name})
    return rows.join(shuffled(found), (F.col(path) == F.col("lp")) & (named == F.col("ln")), "left").drop("lp", "ln")


def _observed(rows: DataFrame, kind: Column | str, origin: str, target_kind: Column | str, resolution: Column | str) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.filter("source IS NOT NULL").select(text(kind).alias("kind"), "source", text(target_kind).alias("target_kind"), "target", F.lit(origin).alias("origin"), text(resolution).alias("resolution"), "evidence")


def containment(concepts: DataFrame) -> DataFrame:
    """File concepts contain those of their symbols, a class's concept those of its members."""
    inner = concepts.filter("symbol IS NOT NULL")
    parent = F.when(F.contains("symbol", F.lit(".")), F.substring_index("symbol", ".", 1))
    rows = _lifted(inner.select("source_path", parent.alias("parent"), F.col("locator").alias("target"), F.concat_ws(":", "source_path", "symbol").alias("evidence")), concepts, "source_path", "parent", "source")
    return _observed(rows.filter("source <> target"), "contains", "inventory", CONCEPT, "resolved")


def call_observations(calls: DataFrame, concepts: DataFrame) -> DataFrame:
    """Calls (from_path, from_symbol, to_path, to_symbol, expression, kind, evidence) between the concepts of both ends."""
    rows = _lifted(_lifted(calls, concepts, "from_path", "from_symbol", "source"), concepts, "to_path", "to_symbol", "lifted")
    inside = (F.col("kind") == "internal") & F.col("lifted").isNotNull()
    target_kind = F.when(inside, CONCEPT).when(F.col("kind") == "external", EXTERNAL).otherwise(UNRESOLVED)
    resolution = F.when(inside, "resolved").when(F.col("kind") == "internal", "unresolved").otherwise(F.col("kind"))
    rows = rows.withColumns({"target_kind": target_kind, "resolution": resolution, "target": F.when(inside, F.col("lifted")).otherwise(F.coalesce("expression", F.lit("<dynamic>")))})
    return _observed(rows, "calls", "call-resolution", F.col("target_kind"), F.col("resolution"))


def import_observations(imports: DataFrame, concepts: DataFrame) -> DataFrame:
    """Imports (path, module, targets, resolution, evidence); several targets lead to each as ambiguous, none to the module's name."""
    no_symbol = F.lit(None).cast("string")
    rows = imports.select("*", F.explode_outer("targets").alias("to_path")).withColumn("none", no_symbol)
    rows = _lifted(_lifted(rows, concepts, "path", "none", "source"), concepts, "to_path", "none", "lifted")
    there = F.col("lifted").isNotNull()
    kind = F.when(there, CONCEPT).when(F.col("resolution") == "external", EXTERNAL).otherwise(UNRESOLVED)
    resolution = F.when(there, F.col("resolution")).when(F.col("resolution") == "external", "external").otherwise("unresolved")
    rows = rows.withColumns({"target_kind": kind, "how": resolution, "target": F.coalesce("lifted", "module")})
    return _observed(rows, "imports", "import-resolution", F.col("target_kind"), F.col("how"))


def entry_observations(entries: DataFrame, concepts: DataFrame) -> DataFrame:
    """Entry points (category, path, symbol, evidence), each for the concept that it starts."""
    rows = _lifted(entries, concepts, "path", "symbol", "target").filter("target IS NOT NULL").withColumn("source", F.concat_ws(":", F.lit("entry"), "category", "path", "symbol"))
    return _observed(rows, "entrypoint_for", "entry-points", CONCEPT, "resolved")


def effect_observations(effects: DataFrame, concepts: DataFrame) -> DataFrame:
    """Reads and writes (path, symbol, effect: reads or writes, kind, target, evidence) of outside resources."""
    rows = _lifted(effects.withColumnRenamed("target", "resource"), concepts, "path", "symbol", "source").withColumn("target", F.concat_ws(":", "kind", "resource"))
    return _observed(rows.filter(F.col("effect").isin("reads", "writes")), F.col("effect"), "data-flow", EXTERNAL, "external")


def dependency_observations(dependencies: DataFrame, concepts: DataFrame) -> DataFrame:
    """Declared packages (path, package, explicit, evidence); one that is only imported isn't a dependency."""
    rows = _lifted(dependencies.filter("explicit").withColumn("none", F.lit(None).cast("string")), concepts, "path", "none", "source").withColumn("target", F.col("package"))
    return _observed(rows, "depends_on", "manifest", EXTERNAL, "external")


def pieces_of(*observations: DataFrame) -> DataFrame:
    """Different observations, each with how often it was made (n). No order of rows matters."""
    rows = reduce(DataFrame.unionByName, [o.select(OBSERVATION) for o in observations])
    return rows.groupBy(*OBSERVATION).agg(F.count("*").alias("n"))


def edges_of(pieces: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One edge for each (kind, source, target, origin, resolution): its key, its `samples` least pieces of evidence, how many
    observations it has, how many of the different pieces are shown, and whether some aren't.

    Pieces are dealt by edge, once, and numbered and counted where they are; keys, which don't compress, are made of what is left.
    """
    place = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy(F.asc_nulls_last("evidence")))
    least = F.array_sort(F.collect_list(F.when(F.col("place") <= samples, F.col("evidence")))).alias("samples")
    out = pieces.withColumn("place", place).groupBy(*IDENTITY).agg(F.sum("n").alias("observed"), F.count("evidence").alias("pieces"), least)
    emitted = F.least("pieces", F.lit(samples).cast("bigint"))
    return out.select(digest(F.concat_ws("\x1f", *IDENTITY)).alias("key"), *IDENTITY, "observed", "samples", emitted.alias("emitted"), (F.col("pieces") > emitted).alias("truncated"))


def merged(*observations: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The edges of all observations."""
    return edges_of(pieces_of(*observations), samples)


def coverage(edges: DataFrame) -> DataFrame:
    """(kind, edges, observed, emitted, omitted) of a graph, by kind of edge."""
    per = edges.groupBy("kind").agg(F.count("*").alias("edges"), F.sum("observed").alias("observed"), F.sum("emitted").alias("emitted"))
    return per.withColumn("omitted", F.col("observed") - F.col("emitted"))


def problems(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """(key, problem) of edges that can't stand: unknown kinds (a plug-in's have a slash), concepts that aren't there,
    keys that aren't their identity's, counts that contradict each other."""
    known = concepts.select(F.col("locator").alias("target"), F.lit(True).alias("known")).distinct()
    j = edges.join(shuffled(known), "target", "left")
    odd_kind = ~F.col("kind").isin(*KINDS) & ~F.col("kind").rlike(r"^[a-z0-9.-]+/[a-z0-9_.-]+$")
    identity = digest(F.concat_ws("\x1f", "kind", "source", "target_kind", "target", "origin", "resolution"))
    found = F.when(odd_kind, "unknown-kind").when((F.col("target_kind") == CONCEPT) & F.col("known").isNull(), "unknown-concept").when(F.col("key") != identity, "wrong-key").when((F.col("emitted") != F.size("samples")) | (F.col("observed") < F.col("emitted")), "wrong-counts")
    return j.select("key", found.alias("problem")).filter("problem IS NOT NULL")
