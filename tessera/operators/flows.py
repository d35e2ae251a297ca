"""Data flow along a trace, call resolution, and leads from described entries to declared flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold_udf
from .graph import parent_steps, shuffled

# How many steps, boundary effects, transfers and gaps a summary of one flow holds.
STEPS, EFFECTS, TRANSFERS, GAPS = 12, 8, 12, 12
ORDER = ["flow_id", "step_index"]


def _first(df: DataFrame, most: int) -> DataFrame:
    """The first rows of each flow, with how many there are."""
    per = Window.partitionBy("flow_id")
    numbered = df.withColumn("observed", F.count("*").over(per)).withColumn("n", F.row_number().over(per.orderBy("step_index", *[c for c in ("effect_kind", "target") if c in df.columns])))
    return numbered.filter(F.col("n") <= most).withColumn("emitted", F.least("observed", F.lit(most))).drop("n")


def data_flow(steps: DataFrame, effects: DataFrame, flows: DataFrame, arguments: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transfers, boundaries, gaps) of each flow's first steps.

    A transfer is the call that led to a step, from the step it came from, with its call site and, where `arguments`
    (file, edge_ordinal, col, arguments) are given, what it passes; a boundary an effect that leaves the code; a gap a
    call that leads nowhere known, or a trace that is cut.
    """
    shown = parent_steps(steps.filter(F.col("step_index") < STEPS))
    parents = shown.select("flow_id", F.col("step_index").alias("parent_step"), F.col("symbol").alias("from_symbol"), F.col("file").alias("site_file"))
    calls = shown.filter(F.col("depth") > 0).join(shuffled(parents), ["flow_id", "parent_step"], "left")
    if arguments is None:
        calls = calls.withColumns({"col": F.lit(None).cast("int"), "arguments": F.lit(None).cast("array<string>")})
    else:
        calls = calls.join(shuffled(arguments.select(F.col("file").alias("site_file"), "edge_ordinal", "col", "arguments")), ["site_file", "edge_ordinal"], "left")
    transfers = _first(calls.select("flow_id", "step_index", F.col("from_symbol").alias("from"), F.col("symbol").alias("to"), F.col("parent_step").alias("from_step"), F.col("step_index").alias("to_step"), "site_file", "edge_ordinal", "line", "col", F.col("name").alias("call"), "arguments", "kind"), TRANSFERS)
    leaving = effects.filter(F.col("effect_kind") == "boundary_effects").select(F.col("path").alias("file"), "symbol", "effect_kind", F.col("kind").alias("effect"), "target")
    boundaries = _first(shown.join(shuffled(leaving), ["file", "symbol"]).select(*ORDER, "symbol", "effect_kind", "effect", "target"), EFFECTS)
    lost = calls.filter(F.col("kind").isin("unresolved", "external")).select(*ORDER, F.concat("kind", F.lit("_call")).alias("gap"), F.coalesce("name", "symbol").alias("target"))
    known = boundaries.select("flow_id", "target").distinct()
    lost = lost.join(shuffled(known), ["flow_id", "target"], "left_anti").select(*ORDER, "gap", "target")
    long = steps.groupBy("flow_id").agg(F.count("*").alias("n")).filter(F.col("n") > STEPS).select("flow_id", F.lit(STEPS).alias("step_index"), F.lit("step_limit").alias("gap"), F.lit(f"first {STEPS} steps").alias("target"))
    cut = flows.filter("truncated").select("flow_id", F.lit(STEPS + 1).alias("step_index"), F.lit("truncated_flow").alias("gap"), F.lit("depth limit").alias("target"))
    return transfers, boundaries, _first(lost.unionByName(long).unionByName(cut), GAPS)


def coverage(steps: DataFrame) -> DataFrame:
    """Steps observed, shown and left out of each flow."""
    counted = steps.groupBy("flow_id").agg(F.count("*").alias("observed"))
    return counted.withColumn("emitted", F.least("observed", F.lit(STEPS))).withColumn("omitted", F.col("observed") - F.col("emitted"))


def resolve_calls(calls: DataFrame, callables: DataFrame, bindings: DataFrame) -> DataFrame:
    """Call names to callables: of the same file, then through an import, then of the receiver's type; a class
    stands for its constructor. Several candidates leave a call unresolved; a name bound to no file is external.

    calls: from_file, from_symbol, name, receiver_type, line, edge_ordinal; callables: file, symbol, name, owner;
    bindings: path, name, target_path (null outside the code), target_name.
    """
    local = callables.filter(F.col("owner").isNull()).groupBy(F.col("file").alias("from_file"), "name").agg(F.count("*").alias("local_n"), F.min("symbol").alias("local_symbol"))
    bound = bindings.select(F.col("path").alias("from_file"), "name", F.col("target_path").alias("bound_file"), F.col("target_name").alias("bound_symbol"), F.lit(True).alias("is_bound")).dropDuplicates(["from_file", "name"])
    method = callables.filter(F.col("owner").isNotNull()).groupBy(F.col("owner").alias("receiver_type"), "name").agg(F.count("*").alias("method_n"), F.min("file").alias("method_file"), F.min("symbol").alias("method_symbol"))
    j = calls.join(local, ["from_file", "name"], "left").join(bound, ["from_file", "name"], "left").join(method, ["receiver_type", "name"], "left")
    has_receiver = F.col("receiver_type").isNotNull()
    to_file = F.when(has_receiver & (F.col("method_n") == 1), F.col("method_file")).when(~has_receiver & (F.col("local_n") == 1), F.col("from_file")).when(~has_receiver, F.col("bound_file"))
    to_symbol = F.when(has_receiver & (F.col("method_n") == 1), F.col("method_symbol")).when(~has_receiver & (F.col("local_n") == 1), F.col("local_symbol")).when(~has_receiver, F.col("bound_symbol"))
    kind = F.when(to_file.isNotNull(), "internal").when(~has_receiver & F.col("is_bound"), "external").otherwise("unresolved")
    return j.select("from_file", "from_symbol", to_file.alias("to_file"), F.coalesce(to_symbol, "name").alias("to_symbol"), "name", kind.alias("kind"), "line", "edge_ordinal")


def entry_leads(descriptions: DataFrame, flows: DataFrame) -> DataFrame:
    """Described functions (path, symbol, description) with the one flow that declares them as its entry;
    a function described twice or declared by several flows leads nowhere."""
    one = descriptions.withColumn("key", casefold_udf("symbol")).withColumn("k", F.count("*").over(Window.partitionBy("path", "key"))).filter("k = 1").drop("k")
    declared = flows.withColumn("key", casefold_udf("symbol")).select(F.col("file").alias("path"), "key", "flow_id").withColumn("k", F.count("*").over(Window.partitionBy("path", "key"))).filter("k = 1").drop("k")
    return one.join(declared, ["path", "key"]).select("path", "symbol", "description", "flow_id")
