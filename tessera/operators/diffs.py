"""Snapshot comparisons: sync diff, moves, freshness, API and tree diffs, audits, identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sync_diff(recorded: DataFrame, live: DataFrame, key: str = "path") -> DataFrame:
    """(key, change): new, removed, unchanged, metadata-only (semantic hash equal) or changed. One full outer join."""
    a = recorded.select(F.col(key).alias("k"), F.col("hash").alias("h0"), F.col("semantic_hash").alias("s0"), F.lit(True).alias("in0"))
    b = live.select(F.col(key).alias("k"), F.col("hash").alias("h1"), F.col("semantic_hash").alias("s1"), F.lit(True).alias("in1"))
    both = a.join(b, "k", "full_outer")
    change = F.when(F.col("in0").isNull(), "new").when(F.col("in1").isNull(), "removed").when(F.coalesce(F.col("h0"), F.lit("")) == F.col("h1"), "unchanged").when(F.col("s0").eqNullSafe(F.col("s1")), "metadata-only").otherwise("changed")
    return both.select(F.col("k").alias(key), change.alias("change"))


def unique_moves(before: DataFrame, after: DataFrame, keys: list[str], place: str = "path", strict: bool = False) -> DataFrame:
    """Entities that one place had and another has now: the key occurs in one place on either side.

    strict: a key with several occurrences in its one place makes the move ambiguous, an error.
    """
    one = lambda df, x: df.groupBy(*keys).agg(F.count("*").alias(f"n_{x}"), F.count_distinct(place).alias(f"places_{x}"), F.min(place).alias(x)).filter(F.col(f"places_{x}") == 1)
    moved = one(before, "old").join(one(after, "new"), keys).filter(F.col("old") != F.col("new"))
    if strict and not moved.filter("n_old <> 1 OR n_new <> 1").isEmpty():
        raise ValueError("several occurrences make a move ambiguous")
    return moved.select(*keys, F.col("old").alias(f"old_{place}"), F.col("new").alias(f"new_{place}"))


def renamed_pages(recorded: DataFrame, live: DataFrame, key: str = "path", page: str = "page") -> DataFrame:
    return recorded.select(key, F.col(page).alias("old_page")).join(live.select(key, F.col(page).alias("new_page")), key).filter("old_page <> new_page")


def infrastructure_moves(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Removed and added paths of equal (adapter, content hash, observation hash), if one to one."""
    keys = ["adapter", "content_hash", "observation_hash"]
    one = lambda df, x: df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("path").alias(x)).filter("n = 1").drop("n")
    return one(removed, "old_path").join(one(added, "new_path"), keys).select("adapter", "old_path", "new_path")


def infrastructure_plan(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """(path, action, moved_from): added, changed, unchanged, removed and moved resources."""
    joined = recorded.alias("r").join(live.alias("l"), F.col("r.path") == F.col("l.path"), "full_outer")
    action = F.when(F.col("r.path").isNull(), "added").when(F.col("l.path").isNull(), "removed").when(F.col("r.content_hash") == F.col("l.content_hash"), "unchanged").otherwise("changed")
    plan = joined.select(F.coalesce("r.path", "l.path").alias("path"), action.alias("action"))
    moves = infrastructure_moves(recorded.join(plan.filter("action = 'removed'"), "path", "left_semi"), live.join(plan.filter("action = 'added'"), "path", "left_semi"))
    to = moves.select(F.col("new_path").alias("path"), F.col("old_path").alias("moved_from"))
    gone = moves.select(F.col("old_path").alias("path"))
    return plan.join(gone, "path", "left_anti").join(to, "path", "left").withColumn("action", F.when(F.col("moved_from").isNotNull(), "moved").otherwise(F.col("action")))


def freshness(recorded: DataFrame, live: DataFrame | None, sources: DataFrame) -> DataFrame:
    """(locator, state, reason): the first rule that holds, over two left joins.

    recorded and live: locator, scope, source_path, extractor_ref, producer, source_content_hash,
    concept_observation_hash; recorded also has modeled. sources: paths that exist now.
    """
    if live is None:
        return recorded.select("locator", F.lit("unknown").alias("state"), F.lit("no-live-evaluation").alias("reason"))
    fields = ["scope", "source_path", "extractor_ref", "producer", "source_content_hash", "concept_observation_hash"]
    l = live.select("locator", *[F.col(f).alias(f"l_{f}") for f in fields], F.lit(True).alias("has_live"))
    s = sources.select(F.col("path").alias("source_path"), F.lit(True).alias("exists")).distinct()
    j = recorded.join(l, "locator", "left").join(s, "source_path", "left")
    reliable = F.col("scope").isNotNull() & F.col("source_path").isNotNull() & F.col("source_content_hash").isNotNull() & F.col("concept_observation_hash").isNotNull()
    same = lambda f: F.col(f).eqNullSafe(F.col(f"l_{f}"))
    rules = [
        (~F.coalesce(F.col("modeled"), F.lit(True)), "unknown", "unmodeled"),
        (~reliable, "unknown", "basis-unreliable"),
        (F.col("exists").isNull(), "source-missing", "source-absent"),
        (F.col("has_live").isNull() | F.col("l_source_content_hash").isNull(), "unknown", "live-basis-unavailable"),
        (~same("source_path"), "basis-incompatible", "source-path"),
        (~same("scope"), "basis-incompatible", "scope"),
        (~same("extractor_ref"), "basis-incompatible", "extractor"),
        (~same("producer"), "basis-incompatible", "producer"),
        (same("source_content_hash") & same("concept_observation_hash"), "current", "equal"),
        (same("concept_observation_hash"), "nonsemantic-source-change", "bytes-only"),
        (same("source_content_hash"), "basis-incompatible", "observation-differs"),
    ]
    state, reason = F.when(*_pair(rules[0], 1)), F.when(*_pair(rules[0], 2))
    for rule in rules[1:]:
        state, reason = state.when(*_pair(rule, 1)), reason.when(*_pair(rule, 2))
    return j.select("locator", state.otherwise("source-changed").alias("state"), reason.otherwise("both-differ").alias("reason"))


def _pair(rule: tuple, k: int) -> tuple[Column, Column]:
    return rule[0], F.lit(rule[k])


def operations_diff(operations: DataFrame, parameters: DataFrame, responses: DataFrame) -> DataFrame:
    """Findings (code, severity, operation, detail) between the baseline and candidate sides of an API."""
    keys = ["method", "route"]
    route = F.regexp_replace("path", r"\{[^}]*\}", "{}")
    ops = operations.withColumn("route", route).withColumn("n", F.count("*").over(Window.partitionBy("side", "method", "route")))
    old, new = ops.filter("side = 'baseline'"), ops.filter("side = 'candidate'")
    twice = ops.filter("n > 1").select(*keys).distinct()
    label = F.concat_ws(" ", "method", "path")
    made = lambda df, code, severity, detail: df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("operation"), detail.alias("detail"))
    named = old.withColumn("operation", label)
    out = made(named.join(twice, keys, "left_semi"), "ambiguous-route", "advisory", F.lit("several paths share a route"))
    clear = named.join(twice, keys, "left_anti")
    out = out.unionByName(made(clear.join(new.select(*keys), keys, "left_anti"), "operation-removed", "breaking", F.lit("absent from candidate")))
    kept = clear.join(new.select(*keys, F.col("path").alias("new_path"), F.col("request_required").alias("new_required")), keys)
    body = kept.filter(F.coalesce("new_required", F.lit(False)) & ~F.coalesce("request_required", F.lit(False)))
    out = out.unionByName(made(body, "required-input-added", "breaking", F.lit("request body")))
    inputs = lambda side, path: parameters.filter(F.col("side") == side).select("method", F.col("path").alias(path), "location", "name", "required")
    now = kept.join(inputs("candidate", "new_path"), ["method", "new_path"]).filter("required")
    before = inputs("baseline", "path").filter("required").drop("required")
    added = now.join(before, ["method", "path", "location", "name"], "left_anti")
    out = out.unionByName(made(added, "required-input-added", "breaking", F.concat_ws(" ", F.col("location"), F.col("name"))))
    codes = lambda side, path, name: responses.filter(F.col("side") == side).groupBy("method", F.col("path").alias(path)).agg(F.collect_set("status_code").alias(name))
    both = kept.join(codes("baseline", "path", "c0"), ["method", "path"]).join(codes("candidate", "new_path", "c1"), ["method", "new_path"], "left")
    c1 = F.coalesce("c1", F.array().cast("array<string>"))
    gone = both.withColumn("c1", c1).withColumn("detail", F.explode(F.array_except("c0", "c1")))
    lost = gone.filter(F.col("detail").rlike(r"^2\d\d$") & ~F.arrays_overlap("c1", F.array(F.lit("2XX"), F.lit("default"))))
    out = out.unionByName(made(lost, "success-response-removed", "breaking", F.col("detail")))
    return out.unionByName(made(gone.filter("detail = '2XX'"), "response-range-changed", "advisory", F.col("detail"))).distinct()


def diff_status(findings: DataFrame) -> DataFrame:
    """breaking over advisory over compatible, with counts."""
    breaking = F.count_if(F.col("severity") == "breaking")
    return findings.agg(F.when(breaking > 0, "breaking").when(F.count("*") > 0, "advisory").otherwise("compatible").alias("status"), breaking.alias("breaking_count"), (F.count("*") - breaking).alias("advisory_count"))


def json_leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) of every leaf of a JSON text: objects by name, lists by position."""
    import json

    import pandas as pd

    kind = df.schema[key].dataType.simpleString()

    def walk(value, path):
        if isinstance(value, dict) and value:
            for k in value:
                yield from walk(value[k], f"{path}.{k}")
        elif isinstance(value, list) and value:
            for k, v in enumerate(value):
                yield from walk(v, f"{path}[{k}]")
        else:
            yield path, json.dumps(value, sort_keys=True, ensure_ascii=False)

    def run(frames):
        for frame in frames:
            rows = [(k, p, v) for k, t in zip(frame[key], frame[text]) if t is not None for p, v in walk(json.loads(t), "$")]
            yield pd.DataFrame(rows, columns=[key, "path", "value"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, path string, value string")


def json_diff(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, left, right) where two JSON trees differ or one lacks a leaf."""
    a = json_leaves(left, key, text).withColumnRenamed("value", "left")
    b = json_leaves(right, key, text).withColumnRenamed("value", "right")
    return a.join(b, [key, "path"], "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))


def audit_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only one side has (as often as the other lacks them), and repeated keys: empty if the record sets are equal.

    Both sides are dealt by their keys and sorted once; each row's place among its equals, left ones first, says the rest.
    """
    columns = left.columns
    both = left.withColumn("is_right", F.lit(False)).unionByName(right.select(columns).withColumn("is_right", F.lit(True)))
    equal = Window.partitionBy(*keys, *[c for c in columns if c not in keys]).orderBy("is_right")
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = both.repartition(*keys).withColumns({"place": F.row_number().over(equal), "n_left": F.count_if(~F.col("is_right")).over(whole(equal)), "n": F.count("*").over(whole(equal))})
    rows = rows.withColumn("n_key", F.count_if(~F.col("is_right")).over(Window.partitionBy(*keys)))
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    problems = F.array_compact(F.array(
        F.when(~F.col("is_right") & (F.col("place") > F.col("n") - F.col("n_left")), "left-only"),
        F.when(F.col("is_right") & (F.col("place") > 2 * F.col("n_left")), "right-only"),
        F.when(~F.col("is_right") & (F.col("n_key") > 1) & named, "repeated"),
    ))
    return rows.select(*columns, F.explode(problems).alias("problem"))


def identity_collisions(allocations: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Coordinates (uid, natural key, locator, alias) that name more than one identity."""
    by = lambda kind, column, other: allocations.groupBy(F.col(column).alias("value")).agg(F.array_sort(F.collect_set(other)).alias("identities")).filter(F.size("identities") > 1).select(F.lit(kind).alias("coordinate"), "value", "identities")
    out = by("uid", "uid", "natural_key").unionByName(by("natural_key", "natural_key", "uid")).unionByName(by("locator", "locator", "uid"))
    if aliases is not None:
        names = aliases.select(F.col("alias").alias("value"), "uid").unionByName(allocations.select(F.col("locator").alias("value"), "uid"))
        clash = names.groupBy("value").agg(F.array_sort(F.collect_set("uid")).alias("identities")).filter(F.size("identities") > 1)
        out = out.unionByName(clash.select(F.lit("alias").alias("coordinate"), "value", "identities"))
    return out.distinct()


def allocate_identities(ledger: DataFrame, concepts: DataFrame, tag: str = "concept") -> DataFrame:
    """(natural_key, uid, is_new): an existing identity stays, others are derived from their key.

    A key that the ledger gives to several identities is an error.
    """
    from ..functions.hashing import stable_uid

    known = ledger.select("natural_key", F.col("uid").alias("known")).distinct()
    if not known.groupBy("natural_key").count().filter("count > 1").isEmpty():
        raise ValueError("a natural key has several identities")
    return concepts.select("natural_key").distinct().join(known, "natural_key", "left").select("natural_key", F.coalesce("known", stable_uid(tag, F.col("natural_key"))).alias("uid"), F.col("known").isNull().alias("is_new"))


def current_lineage(events: DataFrame) -> DataFrame:
    """Latest state of each uid from append-only events, with the aliases its moves left behind."""
    latest = events.groupBy("uid").agg(F.max_by(F.struct("locator", "lifecycle"), "seq").alias("s"), F.array_sort(F.collect_set("locator")).alias("all"))
    return latest.select("uid", "s.locator", "s.lifecycle", F.array_except("all", F.array("s.locator")).alias("aliases"))


def retired(owners: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded owners that their source no longer has; an owner recorded twice is ambiguous, an error."""
    if not owners.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError("an owner is recorded more than once")
    return owners.join(live.select(*keys).distinct(), keys, "left_anti")


def missing_pages(expected: DataFrame, present: DataFrame, refreshed: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Expected pages that are absent or in another case, less those refreshed or retired."""
    due = expected.join(refreshed.select("path").distinct(), "path", "left_anti").join(tombstones.select("page").distinct(), "page", "left_anti")
    folded = present.select(F.lower("page").alias("f"), F.col("page").alias("found"))
    j = due.join(folded, F.lower("page") == F.col("f"), "left")
    return j.filter(F.col("found").isNull() | (F.col("found") != F.col("page"))).select("path", "page", F.when(F.col("found").isNull(), "absent").otherwise("wrong-case").alias("problem"))


def page_transitions(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """(path, old_page, new_page, action): create, retain, rename or retire each owner's page."""
    a, b = recorded.select("path", F.col("page").alias("old_page")), live.select("path", F.col("page").alias("new_page"))
    action = F.when(F.col("old_page").isNull(), "create").when(F.col("new_page").isNull(), "retire").when(F.col("old_page") == F.col("new_page"), "retain").otherwise("rename")
    return a.join(b, "path", "full_outer").withColumn("action", action)


def reconcile(existing: DataFrame, incoming: DataFrame, key: str = "owner_key") -> DataFrame:
    """Pending maintenance after new evidence: opened, kept, reopened or resolved by owner."""
    a = existing.select(key, F.col("state").alias("was"), F.col("basis").alias("old_basis"))
    b = incoming.select(key, F.col("basis").alias("new_basis"))
    j = a.join(b, key, "full_outer")
    event = F.when(F.col("was").isNull(), "opened").when(F.col("new_basis").isNull(), F.when(F.col("was") == "resolved", "kept").otherwise("resolved")).when((F.col("was") == "resolved") & (F.col("old_basis") != F.col("new_basis")), "reopened").when(F.col("old_basis") != F.col("new_basis"), "updated").otherwise("kept")
    state = F.when(event == "resolved", "resolved").when(event == "kept", F.col("was")).otherwise("open")
    return j.select(key, event.alias("event"), state.alias("state"), F.coalesce("new_basis", "old_basis").alias("basis"))


def compatibility(recorded: DataFrame, live: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, compatible, differing): analysis inputs that differ, field by field."""
    j = recorded.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).join(live.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), key)
    differing = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]))
    return j.select(key, (F.size(differing) == 0).alias("compatible"), differing.alias("differing"))


def publication_impact(baseline: DataFrame, candidate: DataFrame, pages: DataFrame, excluded_globs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(topic changes, pages no topic covers). Topics: topic, page, hash; pages: path."""
    a, b = baseline.select("topic", F.col("hash").alias("h0")), candidate.select("topic", F.col("hash").alias("h1"))
    a, b = (x.groupBy("topic").agg(F.max(c).alias(c)) for x, c in ((a, "h0"), (b, "h1")))
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") == F.col("h1"), "unchanged").otherwise("changed")
    left = pages.join(candidate.select(F.col("page").alias("path")).distinct(), "path", "left_anti")
    for glob in excluded_globs:
        left = left.filter(~F.col("path").rlike(glob_regex(glob)))
    return a.join(b, "topic", "full_outer").withColumn("change", change), left


def glob_regex(glob: str) -> str:
    """A shell glob (* ** ?) as a Java regular expression over whole paths."""
    out = ""
    k = 0
    while k < len(glob):
        if glob[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        else:
            c = glob[k]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else ("\\" + c if not c.isalnum() and c not in "/_-" else c)
            k += 1
    return f"^{out}$"


def review_findings(changed: DataFrame, mapping: DataFrame, changed_pages: DataFrame, pages: DataFrame, new_imports: DataFrame, represented: DataFrame, infrastructure: str = r"(^|/)(Dockerfile[^/]*|docker-compose[^/]*\.ya?ml|requirements[^/]*\.txt|pyproject\.toml|package\.json|go\.mod|Cargo\.toml)$") -> DataFrame:
    """Findings (rule, severity, path, page) on a change set: one frame per rule, united and in a fixed order."""
    row = lambda df, rule, severity, page=None: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("path"), (F.col(page) if page else F.lit(None).cast("string")).alias("page"))
    uncovered = changed.join(mapping, "path", "left_anti")
    owned = changed.join(mapping, "path")
    missing = owned.join(pages.select("page").distinct(), "page", "left_anti")
    still = owned.join(pages.select("page").distinct(), "page", "left_semi").join(changed_pages.select("page").distinct(), "page", "left_anti")
    imports = new_imports.join(represented, ["path", "module"], "left_anti").withColumn("m", F.col("module"))
    infra = changed.filter(F.col("path").rlike(infrastructure))
    return row(uncovered, "uncovered-source", "warning").unionByName(row(missing, "missing-page", "error", "page")).unionByName(row(still, "page-unchanged", "warning", "page")).unionByName(row(imports, "import-unrepresented", "info", "m")).unionByName(row(infra, "infrastructure-changed", "info")).orderBy(F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2), "rule", "path", "page")
