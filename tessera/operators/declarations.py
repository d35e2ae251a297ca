"""Declaration selectors, projections, sanitizing, schema requirements, and impact of a change set."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.hashing import canonical_json, corpus_identity
from .graph import checkpointed, shuffled
from .relationships import touching


def parse_selector(selector: str) -> tuple[str | None, str, int | None]:
    """file:Owner.symbol#n as (file, symbol, occurrence); the file and the number may be absent."""
    file, colon, rest = selector.partition(":")
    symbol, mark, number = (rest if colon else selector).rpartition("#")
    if mark and number.isdigit():
        return (file if colon else None), symbol, int(number)
    return (file if colon else None), (rest if colon else selector), None


def select_declarations(records: DataFrame, selector: str) -> DataFrame:
    """Declarations (path, symbol, name, occurrence) that a selector names; a bare name matches any owner's."""
    file, symbol, number = parse_selector(selector)
    named = F.col("symbol") == symbol
    found = records.filter((F.col("path") == file) & named) if file is not None else records.filter(named | (F.col("name") == symbol))
    return found if number is None else found.filter(F.col("occurrence") == number)


def with_occurrence(records: DataFrame, position: str = "line") -> DataFrame:
    """The number of each repeat of a name in its file."""
    return records.withColumn("occurrence", F.row_number().over(Window.partitionBy("path", "symbol").orderBy(position)))


def names_only(files: DataFrame) -> DataFrame:
    """Records reduced to their names."""
    return files.select("path", F.transform("functions", lambda f: f["name"]).alias("functions"), F.transform("classes", lambda c: c["name"]).alias("classes"))


def sanitized(value, is_path: bool = False):
    """A payload without identity-bearing keys, absolute paths replaced in path fields."""
    if isinstance(value, dict):
        out = {}
        for key, child in value.items():
            plain = re.sub(r"[^a-z0-9]+", "_", key.casefold()).strip("_")
            if any(w in plain for w in ("locator", "actor", "author", "remote")) or plain.endswith(("hash", "hashes")):
                continue
            out[key] = sanitized(child, bool({"path", "paths", "dir", "dirs", "directory", "directories", "output"} & set(plain.split("_"))))
        return out
    if isinstance(value, list):
        return [sanitized(v, is_path) for v in value]
    absolute = is_path and isinstance(value, str) and bool(re.match(r"[/\\]|[A-Za-z]:[/\\]", value))
    return "[REDACTED:absolute-path]" if absolute else value


@F.pandas_udf(StringType())
def sanitized_udf(column: pd.Series) -> pd.Series:
    """JSON text sanitized, in canonical form."""
    return column.map(lambda t: None if t is None else canonical_json(sanitized(json.loads(t))))


def required_fields(schema, document: dict, seen: frozenset = frozenset()) -> tuple[set[str], bool]:
    """(required properties, unknown) of a plain object or array schema; anything composed is unknown."""
    if not isinstance(schema, dict):
        return set(), True
    reference = schema.get("$ref")
    if reference is not None:
        if not isinstance(reference, str) or not reference.startswith("#/") or reference in seen:
            return set(), True
        target = document
        for part in reference[2:].split("/"):
            target = target.get(part.replace("~1", "/").replace("~0", "~")) if isinstance(target, dict) else None
        return required_fields(target, document, seen | {reference})
    if any(k in schema for k in ("oneOf", "anyOf", "allOf", "not", "if", "patternProperties")):
        return set(), True
    out, unknown = set(), False
    if schema.get("type") == "array":
        inner, unknown = required_fields(schema.get("items", {}), document, seen)
        return {f"[].{x}" for x in inner}, unknown
    for name in schema.get("required", []):
        out.add(name)
    for name, child in (schema.get("properties") or {}).items():
        if isinstance(child, dict) and (child.get("type") in ("object", "array") or "$ref" in child):
            inner, bad = required_fields(child, document, seen)
            unknown |= bad
            out |= {f"{name}.{x}" for x in inner if name in out}
    return out, unknown


# Files that declare dependencies.
MANIFESTS = r"(^|/)(pyproject\.toml|setup\.(py|cfg)|requirements[^/]*\.(txt|in)|Pipfile|package\.json|go\.mod|Cargo\.toml|[^/]+\.cabal|stack\.yaml)$"


def impact(changed: DataFrame, pages: DataFrame, edges: DataFrame, operations: DataFrame, findings: DataFrame, concepts: DataFrame | None = None, relations: DataFrame | None = None, identity: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(section, item) of all that a change set (path) reaches, and one identity row over them.

    pages: source, page; edges: src, dst; operations: handler, operation; findings: path, rule; concepts: locator,
    source_path; relations: key, source, target, both locators. A concept is reached if its source has changed, a relation
    if either end has; manifests among the changed paths are a section of their own. The identity is `identity`'s, by
    default a digest over all rows in order, which tells any two results apart.
    """
    c = changed.select("path").distinct()
    own = lambda section, df, source, item: df.join(shuffled(c.withColumnRenamed("path", source)), source, "left_semi").select(F.lit(section).alias("section"), F.col(item).alias("item"))
    near = touching(edges, shuffled(c)).select(F.lit("edge").alias("section"), F.concat_ws(" -> ", "src", "dst").alias("item"))
    found = findings.join(shuffled(c), "path", "left_semi").select(F.lit("finding").alias("section"), F.concat_ws(" ", "rule", "path").alias("item"))
    rows = own("page", pages, "source", "page").unionByName(near).unionByName(own("operation", operations, "handler", "operation")).unionByName(found)
    rows = rows.unionByName(c.filter(F.col("path").rlike(MANIFESTS)).select(F.lit("manifest").alias("section"), F.col("path").alias("item")))
    if concepts is not None:
        rows = rows.unionByName(own("concept", concepts, "source_path", "locator"))
        if relations is not None:
            ends = concepts.join(shuffled(c.withColumnRenamed("path", "source_path")), "source_path", "left_semi").select("locator").distinct()
            rows = rows.unionByName(touching(relations.select("key", "source", "target"), shuffled(ends), "source", "target").select(F.lit("relation").alias("section"), F.col("key").alias("item")))
    rows = checkpointed(rows.distinct())
    return rows.unionByName((identity or rows_identity)(rows).select(F.lit("identity").alias("section"), F.col("corpus_id").alias("item")))


def rows_identity(rows: DataFrame) -> DataFrame:
    """One row: a digest over (section, item) in order; digested in the cluster, the sorted lines pass through the driver one by one."""
    return corpus_identity(rows.select(F.concat_ws("\x1f", "section", F.coalesce("item", F.lit(""))).alias("path"), F.lit("").alias("content")))


def summed_identity(rows: DataFrame) -> DataFrame:
    """One row: a digest of the sum of 48 bits of each (section, item)'s SHA-256, which needs no order and no row on the driver."""
    first = F.left(F.sha2(F.concat_ws("\x1f", "section", F.coalesce("item", F.lit(""))), 256), F.lit(12))
    total = F.sum(F.conv(first, 16, 10).cast("decimal(20,0)"))
    return rows.agg(F.concat(F.lit("sha256:"), F.sha2(total.cast("string"), 256)).alias("corpus_id"))


def broad_context(concepts: DataFrame, pages: DataFrame, relations: DataFrame, relevance: DataFrame, limits: tuple[int, int, int] = (20, 20, 40)) -> DataFrame:
    """The concepts, pages and relations of the most relevant sources, each up to its own limit."""
    rank = relevance.select("source_path", "score")
    top = lambda df, kind, item, most: df.join(rank, "source_path").select(F.lit(kind).alias("collection"), F.col(item).alias("item"), "score").dropDuplicates(["item"]).withColumn("place", F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("score"), "item"))).filter(F.col("place") <= most)
    return top(concepts, "concept", "locator", limits[0]).unionByName(top(pages, "page", "canonical_path", limits[1])).unionByName(top(relations, "relation", "key", limits[2]))


def external_use(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """Per language: external packages used, and those not declared."""
    used = imports.select("language", "package").distinct()
    known = declared.select("language", "package").distinct().withColumn("ok", F.lit(True))
    return used.join(known, ["language", "package"], "left").groupBy("language").agg(F.count("*").alias("used"), F.count_if(F.col("ok").isNull()).alias("undeclared"))


def site_links(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Links of built HTML pages (path, html) to files that don't exist."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r'(?:href|src)="([^"#?]+)'), F.lit(1))).alias("href")
    local = pages.select("path", href).filter(~F.col("href").rlike(r"^([a-z][a-z0-9+.-]*:|//)"))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    target = F.when(F.startswith("href", F.lit("/")), F.expr("substring(href, 2)")).otherwise(F.concat(folder, F.col("href")))
    return local.withColumn("target", target).join(files.select(F.col("path").alias("target")), "target", "left_anti")


def uncovered_sources(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Python sources without a page, and why: an empty file, a package marker, a test, or plain lack."""
    lacking = files.join(pages.select(F.col("source_path").alias("path")).distinct(), "path", "left_anti")
    why = F.when(F.trim("content") == "", "empty").when(F.endswith("path", F.lit("__init__.py")), "package-marker").when(F.col("path").rlike(r"(^|/)(tests?/|test_[^/]*$|conftest\.py$)"), "test").otherwise("undocumented")
    return lacking.select("path", why.alias("reason"))
