"""Grouped counts and summaries. Unknown stays null; a domain's missing members get zero only where they were evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bounds import bounded_per

# The closed domains that counts are filled up to.
PAGE_KINDS = ["index", "log", "module", "entity", "flow", "workflow", "guide", "dependencies", "infrastructure", "conventions", "overview"]
FRESHNESS = ["current", "nonsemantic-source-change", "source-changed", "source-missing", "basis-incompatible", "unknown"]


def zero_filled(df: DataFrame, column: str, domain: list[str], total: str | None = "total") -> DataFrame:
    """(member, count) for every member of a closed domain, and a total row."""
    members = df.sparkSession.createDataFrame([(m,) for m in domain], f"{column} string")
    counted = df.groupBy(column).agg(F.count("*").alias("count"))
    out = F.broadcast(members).join(counted, column, "left").select(column, F.coalesce("count", F.lit(0)).alias("count"))
    if total is None:
        return out
    return out.unionByName(out.agg(F.lit(total).alias(column), F.sum("count").alias("count")))


def rollup_counts(df: DataFrame, column: str, measures: dict[str, Column]) -> DataFrame:
    """Measures per group and over all (group null), in one pass."""
    return df.rollup(column).agg(F.grouping(column).alias("is_total"), *[m.alias(n) for n, m in measures.items()])


def coverage(concepts: DataFrame, states: list[str] = FRESHNESS, evaluated: bool = True) -> DataFrame:
    """Per kind and in total: concepts, modelled or not, compared, and a count per state (null if not evaluated)."""
    known = lambda c: c if evaluated else F.lit(None).cast("bigint")
    measures = {
        "total": F.count("*"),
        "modeled": F.count_if(F.col("modeled")),
        "unmodeled": F.count_if(~F.col("modeled")),
        "compared": known(F.count_if(F.col("modeled") & F.col("state").isNotNull())),
        **{s.replace("-", "_"): known(F.count_if(F.col("state") == s)) for s in states},
    }
    return rollup_counts(concepts, "kind", measures)


# What the evidence of a concept can be.
EVIDENCE = ["present", "missing", "invalid", "unknown", "not-applicable"]


def concept_counts(concepts: DataFrame, evaluated: bool = True) -> DataFrame:
    """(dimension, member, count) of concepts (kind, evidence, state): kinds that occur, every evidence state, every freshness
    state; the latter's counts are null where freshness isn't evaluated."""
    of = lambda name, df, column: df.select(F.lit(name).alias("dimension"), F.col(column).alias("member"), F.col("count"))
    kinds = of("kind", concepts.groupBy("kind").agg(F.count("*").alias("count")), "kind")
    evidence = of("evidence", zero_filled(concepts, "evidence", EVIDENCE, None), "evidence")
    states = of("freshness", zero_filled(concepts, "state", FRESHNESS, None), "state")
    if not evaluated:
        states = states.withColumn("count", F.lit(None).cast("bigint"))
    return kinds.unionByName(evidence).unionByName(states)


def coverage_by_kind(concepts: DataFrame, kinds: list[str], evaluated: bool = True) -> DataFrame:
    """Per kind (others together as `other`) and in total: concepts, modelled or not, compared, and modelled ones by state.

    concepts: kind, modeled, compared, state. One that isn't modelled but compared is an error. Without an evaluation
    nothing is compared and the states are null.
    """
    if not concepts.filter("compared AND NOT modeled").isEmpty():
        raise ValueError("a concept that isn't modelled can't have been compared")
    known = lambda c: c if evaluated else F.lit(None).cast("bigint")
    folded = concepts.withColumn("kind", F.when(F.col("kind").isin(kinds), F.col("kind")).otherwise("other"))
    measures = {
        "total": F.count("*"),
        "modeled": F.count_if(F.col("modeled")),
        "unmodeled": F.count_if(~F.col("modeled")),
        "compared": F.count_if(F.col("compared")) if evaluated else F.lit(0).cast("bigint"),
        **{s.replace("-", "_"): known(F.count_if(F.col("modeled") & (F.col("state") == s))) for s in FRESHNESS},
    }
    return rollup_counts(folded, "kind", measures)


def reason_histogram(concepts: DataFrame, reasons: list[str], evaluated: bool = True) -> DataFrame:
    """(reason, count) of concepts' freshness reasons; codes that aren't among `reasons` count together as `other`."""
    folded = concepts.withColumn("reason", F.when(F.col("reason").isin(reasons), F.col("reason")).otherwise("other"))
    return (folded if evaluated else folded.limit(0)).groupBy("reason").agg(F.count("*").alias("count"))


def percent(hits: Column, total: Column) -> Column:
    """A share in percent to one decimal; 100.0 of nothing."""
    return F.when(total == 0, F.lit(100.0)).otherwise(F.bround(hits * 100.0 / total, 1))


def documented_share(code: DataFrame, documented: DataFrame, kind: str = "kind", name: str = "name") -> DataFrame:
    """Per kind: names in code, those documented, and their share."""
    marked = code.select(kind, name).distinct().join(documented.select(kind, name).distinct().withColumn("doc", F.lit(1)), [kind, name], "left")
    counted = marked.groupBy(kind).agg(F.count("*").alias("total"), F.count("doc").alias("documented"))
    return counted.withColumn("percent", percent(F.col("documented"), F.col("total")))


def event_summary(events: DataFrame) -> DataFrame:
    """One row over an event log: strict validations and their pass rate, mean time of successful syncs, totals."""
    strict = (F.col("event") == "validation") & F.coalesce(F.col("strict"), F.lit(False))
    passed = F.coalesce(F.col("passed"), F.lit(False))
    finish = F.col("event") == "trigger_finish"
    failed = finish & F.col("exit_code").isNotNull() & (F.col("exit_code") != 0)
    success = finish & (F.col("exit_code") == 0) & F.col("duration_ms").isNotNull()
    n, good = F.count_if(strict), F.count_if(strict & passed)
    return events.agg(
        F.when(n > 0, F.bround(good * 100.0 / n, 1)).alias("pass_percent"),
        n.alias("validations"),
        (n - good).alias("failures"),
        F.bround(F.avg(F.when(success, F.col("duration_ms"))), 1).alias("mean_sync_ms"),
        F.count_if(success).alias("successful_syncs"),
        F.count_if(F.col("event") == "trigger_start").alias("sync_attempts"),
        (n - good + F.count_if(failed)).alias("total_failures"),
        F.count("*").alias("events"),
    )


def latest_failures(events: DataFrame, limit: int = 5) -> DataFrame:
    """The last failed validations and syncs, newest first."""
    failed = ((F.col("event") == "validation") & ~F.coalesce(F.col("passed"), F.lit(False))) | ((F.col("event") == "trigger_finish") & F.col("exit_code").isNotNull() & (F.col("exit_code") != 0))
    return events.filter(failed).orderBy(F.desc("seq")).limit(limit)


def latest_summary(events: DataFrame, column: str = "knowledge_summary") -> DataFrame:
    """The newest valid summary, by a maximum and not a sort."""
    return events.filter(F.col(column).isNotNull()).agg(F.max_by(column, "seq").alias(column), F.max("seq").alias("seq"))


def buckets(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths per top package."""
    return paths.groupBy(F.split(path, "/")[0].alias("package")).agg(F.count("*").alias("count"))


def diagnostics(issues: DataFrame, groups: int = 8, examples: int = 1) -> DataFrame:
    """The first groups of (category, kind) with exact totals and their least few messages as examples."""
    keys = ["category", "kind"]
    per = issues.groupBy(*keys).agg(F.count("*").alias("total"))
    shown = per.withColumn("groups", per.select(F.count("*")).scalar()).orderBy(*keys).limit(groups)
    messages = issues.select(*keys, F.substring("message", 1, 200).alias("message")).distinct()
    least = messages.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("message"))).filter(F.col("place") <= examples)
    held = least.groupBy(*keys).agg(F.array_sort(F.collect_list("message")).alias("examples"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    return shown.alias("s").join(held.alias("h"), same, "left").select(*[f"s.{k}" for k in keys], "total", "examples", "groups").orderBy(*keys)


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count")).filter("count > 1")


def capped_with_counts(df: DataFrame, per: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first rows of each group under a cap, with their place and how many were observed, emitted and left out."""
    rows = bounded_per(df, per, order, cap).drop("returned", "truncated").withColumnRenamed("total", "observed")
    return rows.withColumn("emitted", F.least("observed", F.lit(cap))).withColumn("omitted", F.col("observed") - F.col("emitted"))


def assets(references: DataFrame, files: DataFrame) -> DataFrame:
    """Per media type: files, referenced ones, unreferenced ones."""
    used = references.select("asset").distinct().withColumn("used", F.lit(True))
    marked = files.select("asset", "media_type").distinct().join(used, "asset", "left")
    return marked.groupBy("media_type").agg(F.count("*").alias("files"), F.count("used").alias("referenced"), F.count_if(F.col("used").isNull()).alias("unreferenced"))


def publication_totals(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("pages"), F.count_if(F.col("mapped")).alias("mapped"), F.count_if(F.col("excluded")).alias("excluded"), F.count_if(~F.col("mapped") & ~F.col("excluded")).alias("uncovered"))
