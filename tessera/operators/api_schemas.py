"""Differences between two sides of an API: operations, inputs, bodies by media type and field, responses.

What a body requires is found by expanding its schema over rows of nodes and edges, one level or reference a round, for
all bodies of all APIs at once. A reference already on the way to a field is a cycle, and leaves the body unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import shuffled, stored

# Fixed value: how deep a schema is read.
MOST_DEPTH = 32
_API = ["api", "side"]
_BODY = ["api", "side", "method", "path", "location", "code", "name"]


def body_fields(facts: DataFrame) -> DataFrame:
    """(api, side, method, path, location, code, name, fields, unknown) of each body: the fields that it requires, and whether
    composition, a cycle or a reference to nowhere hides some. Read-only fields aren't required."""
    # A place is one row, with what stands inside it, so that a round is one join and one written table.
    held = facts.filter("fact IN ('node', 'edge')").groupBy(*_API, "pointer").agg(
        F.collect_list(F.when(F.col("fact") == "node", F.struct("state", F.col("child").alias("to")))).alias("nodes"),
        F.collect_list(F.when(F.col("fact") == "edge", F.struct("child", "step", F.col("required").alias("needed")))).alias("edges"),
    )
    places = shuffled(stored(held.select(*_API, "pointer", F.explode_outer("nodes").alias("node"), "edges").select(*_API, "pointer", "node.state", "node.to", "edges")))
    bodies = shuffled(stored(facts.filter("fact = 'body'").select(*_BODY, "pointer").withColumn("body", F.xxhash64(*_BODY))))
    waiting = bodies.filter("pointer IS NOT NULL").select(*_API, "body", "pointer", F.lit("").alias("field"), F.lit(False).alias("needed"), F.array("pointer").alias("passed"), F.lit(0).alias("depth"))
    out = None
    while not waiting.isEmpty():
        met = waiting.join(places, [*_API, "pointer"], "left")
        looped = F.array_contains("passed", F.col("to"))
        lost = F.col("state").isNull() | (F.col("state") == "unknown") | (F.col("depth") > MOST_DEPTH) | F.coalesce(looped, F.lit(False))
        met = stored(met.withColumn("lost", lost).withColumn("edges", F.when(~F.col("lost") & (F.col("state") == "plain"), F.col("edges"))))
        said = met.filter(F.col("lost") | (F.col("needed") & (F.col("state") == "plain"))).select("body", F.when(F.col("needed"), F.col("field")).alias("field"), "lost")
        out = said if out is None else out.unionByName(said)
        known = met.filter(~F.col("lost"))
        onward = known.filter("state = 'reference'").select(*_API, "body", F.col("to").alias("pointer"), "field", "needed", F.concat("passed", F.array("to")).alias("passed"), "depth")
        inside = known.filter("state = 'plain'").select(*_API, "body", "field", "passed", "depth", F.explode("edges").alias("e"))
        inside = inside.select(*_API, "body", F.col("e.child").alias("pointer"), F.concat("field", "e.step").alias("field"), "e.needed", "passed", (F.col("depth") + 1).alias("depth"))
        waiting = onward.unionByName(inside)
    found = out.groupBy("body").agg(F.array_sort(F.collect_set("field")).alias("fields"), F.bool_or("lost").alias("unknown")) if out is not None else bodies.limit(0).select("body", F.array().cast("array<string>").alias("fields"), F.lit(False).alias("unknown"))
    return bodies.join(shuffled(found), "body", "left").select(*_BODY, F.coalesce("fields", F.array().cast("array<string>")).alias("fields"), F.coalesce("unknown", F.lit(False)).alias("unknown"))


def api_differences(facts: DataFrame) -> DataFrame:
    """Findings (api, code, severity, operation, detail) of facts with the sides `baseline` and `candidate`.

    Operations meet by method and route shape; a shape that several paths have is ambiguous. What can break a caller is
    `breaking`, unless a problem in either side's operation makes it uncertain; everything else is `advisory`.
    """
    facts = shuffled(stored(facts))  # what is derived from it isn't broadcast either
    route = F.regexp_replace("path", r"\{[^}]+\}", "{}")
    ops = facts.filter("fact = 'operation'").withColumn("route", route).withColumn("n", F.count("*").over(Window.partitionBy("api", "side", "method", "route")))
    keys = ["api", "method", "route"]
    label = F.concat_ws(" ", "method", "path")
    problems = facts.filter("fact = 'problem'")
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    made = lambda df, code, severity, detail: df.select("api", F.lit(code).alias("code"), text(severity).alias("severity"), "operation", text(detail).alias("detail"))
    out = made(problems.withColumn("operation", F.concat_ws(" ", "method", "path")), "unresolved-contract", "advisory", F.concat_ws(": ", "side", "detail"))
    parts = facts.filter("fact = 'components'").groupBy("api").agg(F.max(F.when(F.col("side") == "baseline", F.col("detail"))).alias("b"), F.max(F.when(F.col("side") == "candidate", F.col("detail"))).alias("c"))
    out = out.unionByName(made(parts.filter(~F.col("b").eqNullSafe(F.col("c"))).withColumn("operation", F.lit("")), "components-changed", "advisory", "shared components differ"))
    old = ops.filter("side = 'baseline'").withColumn("operation", label)
    new = ops.filter("side = 'candidate'")
    twice = ops.filter("n > 1").select(*keys).distinct()
    out = out.unionByName(made(old.join(twice, keys, "left_semi"), "ambiguous-route", "advisory", "several paths have this route's shape"))
    clear = old.join(twice, keys, "left_anti")
    # A candidate whose path can't be read may still have the operation.
    unread = problems.filter("side = 'candidate'").select("api", route.alias("route"), F.lit(True).alias("unread")).distinct()
    gone = clear.join(new.select(*keys), keys, "left_anti").join(unread, ["api", "route"], "left")
    out = out.unionByName(made(gone, "operation-removed", F.when(F.col("unread"), "advisory").otherwise("breaking"), F.when(F.col("unread"), "unresolved in candidate").otherwise("absent from candidate")))
    kept = clear.select(*keys, "path", "operation", F.col("required").alias("old_required"), F.col("detail").alias("old_text")).join(new.select(*keys, F.col("path").alias("new_path"), F.col("required").alias("new_required"), F.col("detail").alias("new_text")), keys)
    doubt = lambda side, path: problems.filter(F.col("side") == side).select("api", F.col("path").alias(path), F.col("method").alias("m"), F.lit(True).alias(f"{side}_doubt")).distinct()
    for side, path in (("baseline", "path"), ("candidate", "new_path")):
        found = doubt(side, path)
        of_op = kept.select(*keys, path).join(found, ["api", path]).filter(F.col("m").isNull() | (F.col("m") == F.col("method"))).select(*keys, f"{side}_doubt").distinct()
        kept = kept.join(shuffled(of_op), keys, "left")
    kept = shuffled(stored(kept.withColumn("severity", F.when(F.coalesce("baseline_doubt", F.lit(False)) | F.coalesce("candidate_doubt", F.lit(False)), "advisory").otherwise("breaking"))))
    severity = F.col("severity")
    out = out.unionByName(made(kept.filter("new_required AND NOT old_required"), "required-input-added", severity, "request body"))
    out = out.unionByName(made(kept.filter("old_text <> new_text"), "contract-changed", "advisory", "schemas, security or metadata differ"))
    # Inputs by what they are on the wire.
    given = facts.filter("fact = 'parameter'").groupBy("api", "side", "method", "path", "location", "name").agg(F.count("*").alias("k"), F.bool_or("required").alias("required"))
    wire = ["api", "method", "path", "new_path", "location", "name"]
    both = kept.select(*keys, "path", "new_path", "operation", "severity")
    before = both.join(given.filter("side = 'baseline'").drop("side"), ["api", "method", "path"]).select(*both.columns, "location", "name", F.col("k").alias("k0"), F.col("required").alias("required0"))
    after = both.join(given.filter("side = 'candidate'").drop("side").withColumnRenamed("path", "new_path"), ["api", "method", "new_path"]).select(*both.columns, "location", "name", F.col("k").alias("k1"), F.col("required").alias("required1"))
    inputs = after.join(shuffled(before.select(*wire, "k0", "required0")), wire, "full_outer")
    clash = (F.coalesce("k0", F.lit(1)) > 1) | (F.coalesce("k1", F.lit(1)) > 1)
    inputs = inputs.drop("operation", "severity", "route").join(both.select("api", "method", "path", "new_path", "operation", "severity"), ["api", "method", "path", "new_path"])
    named = F.concat_ws(" ", "location", "name")
    out = out.unionByName(made(inputs.filter(clash), "ambiguous-wire-input", "advisory", named))
    out = out.unionByName(made(inputs.filter(~clash & F.col("required1") & ~F.coalesce("required0", F.lit(False))), "required-input-added", severity, named))
    # Bodies: media types of both sides, and the fields that a request newly or a response no longer requires.
    fields = shuffled(stored(body_fields(facts)))
    side = lambda name, path: fields.filter(F.col("side") == name).select("api", "method", F.col("path").alias(path), "location", "code", "name", F.col("fields").alias(f"{name}_fields"), F.col("unknown").alias(f"{name}_unknown"))
    one, two = both.join(side("baseline", "path"), ["api", "method", "path"]), both.join(side("candidate", "new_path"), ["api", "method", "new_path"])
    at = ["api", "method", "path", "new_path", "operation", "severity", "location", "name"]
    same_code = F.coalesce("code", F.lit(""))
    pairs = one.withColumn("c", same_code).select(*at, "c", "baseline_fields", "baseline_unknown").join(shuffled(two.withColumn("c", same_code).select(*at, "c", "candidate_fields", "candidate_unknown")), [*at, "c"], "full_outer")
    pairs = shuffled(stored(pairs))
    hidden = F.coalesce("baseline_unknown", F.lit(False)) | F.coalesce("candidate_unknown", F.lit(False))
    place = F.concat_ws(" ", F.col("location"), F.when(F.col("c") != "", F.col("c")))
    unknown = pairs.filter(hidden).groupBy("api", "operation", "location").agg(F.count("*").alias("bodies"))
    for location in ("request", "response"):
        out = out.unionByName(made(unknown.filter(F.col("location") == location), f"{location}-schema-unknown", "advisory", "composition, a cycle or a reference hides fields"))
    # As long as anything of an operation's requests is hidden, nothing is said about their fields.
    visible = pairs.join(unknown.select("api", "operation", "location"), ["api", "operation", "location"], "left_anti")
    shared = visible.filter("baseline_fields IS NOT NULL AND candidate_fields IS NOT NULL")
    added = shared.filter("location = 'request'").withColumn("field", F.explode(F.array_except("candidate_fields", "baseline_fields")))
    out = out.unionByName(made(added, "required-input-added", severity, F.concat_ws(" ", "name", F.col("field"))))
    dropped = shared.filter("location = 'response'").withColumn("field", F.explode(F.array_except("baseline_fields", "candidate_fields")))
    out = out.unionByName(made(dropped, "response-field-optional", "advisory", F.concat_ws(" ", "c", "name", F.col("field"))))
    media = pairs.filter("candidate_fields IS NULL").join(two.select("api", "operation", "location", same_code.alias("c")).distinct(), ["api", "operation", "location", "c"], "left_semi")
    out = out.unionByName(made(media, "media-type-removed", "advisory", F.concat_ws(" ", place, F.col("name"))))
    # Responses.
    codes = lambda s, path, name: facts.filter((F.col("fact") == "response") & (F.col("side") == s)).groupBy("api", "method", F.col("path").alias(path)).agg(F.collect_set("code").alias(name))
    answers = both.join(codes("baseline", "path", "c0"), ["api", "method", "path"]).join(codes("candidate", "new_path", "c1"), ["api", "method", "new_path"], "left").withColumn("c1", F.coalesce("c1", F.array().cast("array<string>")))
    lost = answers.withColumn("detail", F.explode(F.array_except("c0", "c1")))
    out = out.unionByName(made(lost.filter(F.col("detail").rlike(r"^2\d\d$") & ~F.arrays_overlap("c1", F.array(F.lit("2XX"), F.lit("default")))), "success-response-removed", severity, F.col("detail")))
    return out.unionByName(made(lost.filter("detail = '2XX'"), "response-range-changed", "advisory", F.col("detail"))).distinct()


def api_status(exports: DataFrame, findings: DataFrame) -> DataFrame:
    """(api, status, breaking_count, advisory_count) of every API: breaking over advisory over compatible."""
    breaking = F.count_if(F.col("severity") == "breaking")
    counted = findings.groupBy("api").agg(breaking.alias("breaking_count"), (F.count("*") - breaking).alias("advisory_count"))
    b, a = F.coalesce("breaking_count", F.lit(0)), F.coalesce("advisory_count", F.lit(0))
    status = F.when(b > 0, "breaking").when(a > 0, "advisory").otherwise("compatible")
    return exports.select("api").distinct().join(shuffled(counted), "api", "left").select("api", status.alias("status"), b.cast("bigint").alias("breaking_count"), a.cast("bigint").alias("advisory_count"))
