"""Lint rules: each is a function of the wiki's frames to issues (severity, category, message, path)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}
MEDIA_WARNING = 2 << 20


def rule(function):
    RULES[function.__name__] = function
    return function


def issues(df: DataFrame, severity: str, category: str, message: Column, path: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"), path.alias("path"))


@rule
def required_structure(wiki):
    missing = wiki["required"].join(wiki["pages"], "path", "left_anti")
    return issues(missing, "error", "structure", F.lit("required page is missing"), F.col("path"))


@rule
def stale_manifest(wiki):
    changed = wiki["sync"].filter(F.col("change") != "unchanged")
    return issues(changed, "warning", "sync", F.concat(F.lit("source is "), "change"), F.col("path"))


@rule
def selection_identity(wiki):
    differs = wiki["selection"].filter(~F.col("recorded").eqNullSafe(F.col("live")))
    return issues(differs, "error", "selection", F.lit("source selection differs from the recorded one"), F.lit(None).cast("string"))


@rule
def broken_links(wiki):
    broken = wiki["links"].filter(F.col("target_class") == "page").join(wiki["pages"].select(F.col("path").alias("resolved")), "resolved", "left_anti")
    return issues(broken, "error", "broken_links", F.concat(F.lit("no such page: "), "raw_target"), F.col("path"))


@rule
def media(wiki):
    lost = wiki["links"].filter(F.col("target_class") == "asset").join(wiki["assets"].select(F.col("asset").alias("resolved")), "resolved", "left_anti")
    large = wiki["assets"].filter(F.col("bytes") > MEDIA_WARNING)
    return issues(lost, "error", "media", F.concat(F.lit("no such asset: "), "raw_target"), F.col("path")).unionByName(issues(large, "warning", "media", F.lit("asset is large"), F.col("asset")))


@rule
def diagrams(wiki):
    bad = wiki["clicks"].join(wiki["pages"].select(F.col("path").alias("target")), "target", "left_anti")
    return issues(bad, "error", "diagram", F.concat(F.lit("diagram leads to no page: "), "target"), F.col("path"))


@rule
def orphans(wiki):
    inbound = wiki["links"].filter(F.col("resolved").isNotNull() & (F.col("resolved") != F.col("path"))).select(F.col("resolved").alias("path"))
    alone = wiki["pages"].filter(F.col("path") != "index.md").join(inbound, "path", "left_anti")
    return issues(alone, "warning", "orphan", F.lit("no page links here"), F.col("path"))


@rule
def coverage(wiki):
    keys = ["kind", "name"]
    lacking = wiki["code"].join(wiki["documented"], keys, "left_anti")
    extra = wiki["documented"].join(wiki["code"], keys, "left_anti")
    return issues(lacking, "warning", "coverage", F.concat_ws(" ", F.lit("undocumented"), "kind", "name"), F.lit(None).cast("string")).unionByName(issues(extra, "warning", "coverage", F.concat_ws(" ", F.lit("documents no"), "kind", "name"), F.lit(None).cast("string")))


@rule
def flow_diagnostics(wiki):
    cut = wiki["flows"].filter(F.col("truncated"))
    return issues(cut, "info", "flow", F.lit("trace is cut at its depth"), F.col("flow_id"))


@rule
def dependency_coverage(wiki):
    return issues(wiki["dependency_gaps"], "warning", "dependency", F.concat_ws(" ", "state", "package"), F.lit(None).cast("string"))


@rule
def infrastructure_coverage(wiki):
    lacking = wiki["infrastructure"].join(wiki["documented_infrastructure"], "path", "left_anti")
    extra = wiki["documented_infrastructure"].join(wiki["infrastructure"], "path", "left_anti")
    return issues(lacking, "warning", "infrastructure", F.lit("undocumented"), F.col("path")).unionByName(issues(extra, "warning", "infrastructure", F.lit("documents nothing that exists"), F.col("path")))


@rule
def conventions(wiki):
    breaking = wiki["pages"].filter(~F.element_at(F.split("path", "/"), -1).rlike(r"^[A-Za-z0-9._-]+\.md$"))
    return issues(breaking, "info", "convention", F.lit("page name has unusual characters"), F.col("path"))


@rule
def knowledge(wiki):
    stale = wiki["freshness"].filter(F.col("state").isin("source-missing", "source-changed", "basis-incompatible"))
    return issues(stale, "warning", "knowledge", F.concat(F.lit("concept is "), "state"), F.col("locator"))


@rule
def unsupported_sources(wiki):
    counted = wiki["files"].filter(~F.col("supported")).groupBy("language").agg(F.count("*").alias("n"))
    return issues(counted, "info", "unsupported", F.concat(F.col("n").cast("string"), F.lit(" files in "), "language"), F.lit(None).cast("string"))


class FrameMissing(KeyError):
    """A rule asked for a frame that isn't given."""


class _Frames(dict):
    def __missing__(self, name: str):
        raise FrameMissing(name)


def lint(wiki: dict[str, DataFrame], only: list[str] | None = None, extra: dict[str, Callable] | None = None, tell_missing: bool = False) -> DataFrame:
    """All rules whose frames are given, own and plugged in, in severity order.

    tell_missing: an issue for each rule that wasn't run, with the frame it lacks. Errors of a rule's own are raised.
    """
    found, spark = [], next(iter(wiki.values())).sparkSession
    for name, function in {**RULES, **(extra or {})}.items():
        if only is None or name in only:
            try:
                found.append(function(_Frames(wiki)))
            except FrameMissing as lacking:
                if tell_missing:
                    found.append(spark.createDataFrame([("info", "lint", f"rule {name} not run: no frame {lacking.args[0]}", None)], "severity string, category string, message string, path string"))
    out = reduce(DataFrame.unionByName, found)
    return out.orderBy(F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2), "category", "path", "message")
