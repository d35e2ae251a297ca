"""What calls pass: arguments matched to parameters, and the values of parameters followed along traces.

Matching is one join of call sites with their callee's parameters; following is a loop over depths, each step of which
joins the parameters of one depth with those of their parent steps, for all flows at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, parent_steps, shuffled
from .scopes import declarations


def call_edges(resolved: DataFrame) -> DataFrame:
    """Resolved calls as edges of a call graph, in the order in which a file makes them."""
    kind = F.when(F.col("kind") == "ambiguous", "unresolved").otherwise(F.col("kind"))
    name = F.coalesce("expression", F.lit("<dynamic>"))
    return resolved.select(F.col("from_path").alias("from_file"), "from_symbol", F.col("to_path").alias("to_file"), F.coalesce("to_symbol", name).alias("to_symbol"), name.alias("name"), kind.alias("kind"), "line", F.col("ordinal").alias("edge_ordinal"))


def call_arguments(facts: DataFrame) -> DataFrame:
    """(file, edge_ordinal, col, arguments): each call's arguments as written."""
    written = F.transform("arguments", lambda a: F.when(a["keyword"].isNull() | a["keyword"].isin("*"), a["text"]).when(a["keyword"] == "**", F.concat(F.lit("**"), a["text"])).otherwise(F.concat(a["keyword"], F.lit("="), a["text"])))
    return facts.filter("fact = 'call'").select(F.col("path").alias("file"), F.col("opens").alias("edge_ordinal"), "col", written.alias("arguments"))


def bind_arguments(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(file, edge_ordinal, to_path, to_symbol, parameter, via, text, root) of each call with a known callee.

    via: position, keyword, default, rest (gathered by *args or **kwargs), missing (no argument and no default), surplus (no
    such parameter), unknown (a * or ** argument may give it).
    """
    declared = declarations(facts.filter("fact = 'binding'")).filter("n = 1").select(F.col("target").alias("to_path"), F.col("symbol").alias("to_symbol"), "parameters")
    sites = resolved.filter("kind = 'internal'").select(F.col("from_path").alias("file"), F.col("ordinal").alias("edge_ordinal"), "to_path", "to_symbol")
    calls = facts.filter("fact = 'call'").select(F.col("path").alias("file"), F.col("opens").alias("edge_ordinal"), "arguments")
    j = sites.join(shuffled(calls), ["file", "edge_ordinal"]).join(shuffled(declared), ["to_path", "to_symbol"])
    positional = F.filter("parameters", lambda p: p["kind"] == "positional")
    starred = F.exists("arguments", lambda a: a["keyword"].eqNullSafe("*"))
    mapped = F.exists("arguments", lambda a: a["keyword"].eqNullSafe("**"))
    first_star = F.coalesce(F.array_min(F.transform(F.filter("arguments", lambda a: a["keyword"].eqNullSafe("*")), lambda a: a["position"])), F.lit(1 << 30))
    j = j.withColumns({"places": F.transform(positional, lambda p: p["name"]), "starred": starred, "mapped": mapped, "first_star": first_star, "names": F.transform("parameters", lambda p: p["name"])})
    j = j.withColumns({"rest": F.get(F.filter("parameters", lambda p: p["kind"] == "rest"), F.lit(0))["name"], "keywords": F.get(F.filter("parameters", lambda p: p["kind"] == "keywords"), F.lit(0))["name"]})
    key = ["file", "edge_ordinal", "to_path", "to_symbol"]
    # Each argument's parameter; then the parameters that no argument has named.
    given = j.select("*", F.explode("arguments").alias("a"))
    named = F.exists("parameters", lambda p: (p["name"] == F.col("a.keyword")) & p["kind"].isin("positional", "keyword"))
    place = F.get("places", F.col("a.position"))
    plain = F.col("a.keyword").isNull() & (F.col("a.position") < F.col("first_star"))
    parameter = F.when(plain, F.coalesce(place, "rest")).when(F.col("a.keyword").isin("*", "**") | F.col("a.keyword").isNull(), F.lit(None)).when(named, F.col("a.keyword")).otherwise(F.col("keywords"))
    via = (
        F.when(F.col("a.keyword").isin("*", "**") | (F.col("a.keyword").isNull() & ~plain), "unknown").when(plain & place.isNotNull(), "position").when(plain & F.col("rest").isNotNull(), "rest")
        .when(plain, "surplus").when(named, "keyword").when(F.col("keywords").isNotNull(), "rest").otherwise("surplus")
    )
    met = given.select(*key, parameter.alias("parameter"), via.alias("via"), F.col("a.text").alias("text"), F.col("a.root").alias("root"))
    filled = met.filter(F.col("via").isin("position", "keyword")).select(*key, "parameter").distinct()
    wanted = j.select(*key, "starred", "mapped", F.explode("parameters").alias("p")).filter(F.col("p.kind").isin("positional", "keyword"))
    left = wanted.select(*key, F.col("p.name").alias("parameter"), F.when(F.col("mapped") | F.col("starred") & (F.col("p.kind") == "positional"), "unknown").when(F.col("p.defaulted"), "default").otherwise("missing").alias("via")).join(shuffled(filled), [*key, "parameter"], "left_anti")
    nothing = F.lit(None).cast("string")
    return met.unionByName(left.withColumns({"text": nothing, "root": nothing}))


def parameter_origins(steps: DataFrame, bound: DataFrame, facts: DataFrame) -> DataFrame:
    """(flow_id, step_index, parameter, via, text, origin_step, origin): where each parameter of a trace's steps gets its value.

    An argument that is a parameter of the caller, and not bound again there, is followed to the step that gave that one its
    value; the origin of anything else is the text at its own call. A parameter of the entry is its own origin.
    """
    placed = checkpointed(parent_steps(steps))
    parents = placed.select("flow_id", F.col("step_index").alias("parent_step"), F.col("file").alias("caller"), F.col("symbol").alias("caller_symbol"))
    scopes = facts.filter("fact = 'scope' AND what = 'function'").select(F.col("path").alias("caller"), F.col("symbol").alias("caller_symbol"), "scope")
    bindings = facts.filter("fact = 'binding'").groupBy(F.col("path").alias("caller"), "scope", F.col("name").alias("root")).agg((F.count("*") == 1).alias("once"), F.min("what").alias("what"))
    passed_on = bindings.filter("once AND what = 'parameter'").join(shuffled(scopes), ["caller", "scope"]).select("caller", "caller_symbol", "root", F.lit(True).alias("passed_on"))
    calls = placed.filter("depth > 0 AND kind = 'internal'").join(shuffled(parents), ["flow_id", "parent_step"]).select("flow_id", "step_index", "parent_step", "depth", F.col("caller").alias("file"), "edge_ordinal", "caller", "caller_symbol")
    rows = calls.join(shuffled(bound.filter("parameter IS NOT NULL")), ["file", "edge_ordinal"]).join(shuffled(passed_on), ["caller", "caller_symbol", "root"], "left")
    plain = F.coalesce(F.col("passed_on") & (F.col("text") == F.col("root")), F.lit(False))
    rows = checkpointed(rows.select("flow_id", "step_index", "parent_step", "depth", "parameter", "via", "text", F.when(plain, F.col("root")).alias("from_parameter")))
    known = rows.limit(0).select("flow_id", "step_index", "parameter", F.lit(0).alias("origin_step"), F.lit("").alias("origin"))
    out = None
    for depth in range(1, (rows.agg(F.max("depth")).first()[0] or 0) + 1):
        before = known.select("flow_id", F.col("step_index").alias("parent_step"), F.col("parameter").alias("from_parameter"), "origin_step", "origin")
        at = rows.filter(F.col("depth") == depth).join(shuffled(before), ["flow_id", "parent_step", "from_parameter"], "left")
        start = F.when(F.col("from_parameter").isNull(), F.col("step_index")).otherwise(F.col("parent_step"))
        found = at.select("flow_id", "step_index", "parameter", "via", "text", F.coalesce("origin_step", start).alias("origin_step"), F.coalesce("origin", "from_parameter", "text").alias("origin"))
        found = checkpointed(found)
        known = found.filter(F.col("via").isin("position", "keyword")).select("flow_id", "step_index", "parameter", "origin_step", "origin")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.limit(0).select("flow_id", "step_index", "parameter", "via", "text", F.lit(0).alias("origin_step"), F.lit("").alias("origin"))
