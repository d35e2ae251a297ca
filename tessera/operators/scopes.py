"""What a called name means: the nearest binding of the scope tree, followed through imports, receivers and constructions.

A use carries the numbers of the scopes it sees, innermost first. Exploded, they meet the bindings by equality, and the
least place in that list wins; so a use costs its nesting depth, and no range join is needed. Imports are followed by
a loop of joins over what is still open; each round's rows are written as
a compressed table, of which the next steps read the columns that they need.
"""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import shuffled, stored

# Fixed value: how many bindings one call may be followed through.
MOST_HOPS = 32
_USE = ["path", "use"]


def module_index(files: DataFrame) -> DataFrame:
    """(module, target): the dotted name of every Python file, a package's by its folder."""
    stem = F.regexp_replace(F.regexp_replace("path", r"\.pyi?$", ""), r"/__init__$", "")
    return files.filter(F.col("path").rlike(r"\.pyi?$")).select(F.replace(stem, F.lit("/"), F.lit(".")).alias("module"), F.col("path").alias("target")).distinct()


def scope_chains(scopes: DataFrame) -> DataFrame:
    """(path, scope, chain) of a scope tree given by intervals (path, scope, what, opens, closes): the scopes that enclose
    each one, innermost first; a class other than the scope itself is left out, since its names aren't seen in functions."""
    inner, outer = scopes.alias("i"), scopes.select("path", *[F.col(c).alias(f"o_{c}") for c in ("scope", "what", "opens", "closes")]).alias("o")
    around = inner.join(shuffled(outer), "path").filter((F.col("o_opens") <= F.col("opens")) & (F.col("closes") <= F.col("o_closes")) & ((F.col("o_what") != "class") | (F.col("o_scope") == F.col("scope"))))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("o_opens")).alias("o"), F.col("o_scope").alias("s"))))
    return around.groupBy("path", "scope").agg(F.transform(ordered, lambda x: x["s"]).alias("chain"))


def nearest_bindings(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """Uses (path, use, name, chain, ...) with `found`, all the bindings of the name in the nearest scope that has any; null without."""
    seen = uses.select(*_USE, "name", F.posexplode("chain").alias("place", "scope"))
    own = [c for c in bindings.columns if c not in ("path", "scope", "name")]
    met = seen.join(shuffled(bindings.select("path", "scope", "name", F.struct("scope", *own).alias("binding"))), ["path", "scope", "name"])
    met = met.select(*_USE, "place", "binding").repartition(*_USE)  # for both groups and the join
    by_scope = met.groupBy(*_USE, "place").agg(F.collect_list("binding").alias("found"))
    best = by_scope.groupBy(*_USE).agg(F.min_by("found", "place").alias("found"))
    return uses.join(shuffled(best), _USE, "left")


def declarations(bindings: DataFrame) -> DataFrame:
    """(target, symbol, n, what, plain, lines) of functions and classes; n above 1 where a symbol is defined again."""
    own = bindings.filter(F.col("what").isin("function", "class"))
    return own.groupBy(F.col("path").alias("target"), "symbol").agg(F.count("*").alias("n"), F.min("what").alias("declared"), F.bool_and("plain").alias("usual"), F.array_sort(F.collect_list("line")).alias("lines"), F.first("parameters").alias("parameters"))


def _state(kind: str | Column, reason: str | Column | None = None) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    reason = F.lit(reason).cast("string") if reason is None or isinstance(reason, str) else reason
    return [kind.alias("kind"), reason.alias("reason")]


_OPEN = ["path", "use", "target", "symbol", "module", "members", "kind", "reason", "candidates"]


def _first_step(found: DataFrame) -> DataFrame:
    """Uses with their bindings as open (kind null) or settled rows; `value` rows keep what made them."""
    n, one = F.size("found"), F.col("found")[0]
    imports = F.forall("found", lambda b: (b["what"] == "import") & b["plain"])
    # import a.b and import a.c bind one name: the longest module that the expression goes through counts.
    whole = F.concat_ws(".", F.array(F.col("name")), "tail")
    through = F.filter(F.transform("found", lambda b: b["module"]), lambda m: F.startswith(whole, F.concat(m, F.lit("."))))
    longest = F.array_max(F.transform(through, lambda m: F.struct(F.length(m).alias("l"), m.alias("m"))))["m"]
    plain_module = F.coalesce(longest, F.when(n > 0, F.col("name")))
    plain_members = F.slice(F.concat(F.array("name"), "tail"), F.size(F.split(plain_module, r"\.")) + 1, F.lit(1 << 20))
    nothing = F.lit(None).cast("string")
    what = one["what"]
    known = F.when(F.col("name").isin(sorted(dir(builtins))), "external").otherwise("unresolved")
    kind = (
        F.when(F.col("expression").isNull(), "unresolved")
        .when(F.col("found").isNull() & F.col("starred"), "unresolved")
        .when(F.col("found").isNull(), known)
        .when(imports & (F.size("tail") == 0), "unresolved")
        .when(imports, nothing)
        .when((n > 1) & F.forall("found", lambda b: (b["what"].isin("function", "class")) & (b["symbol"] == one["symbol"])), "open")
        .when(n > 1, "unresolved")
        .when(what.isin("function", "class"), "open")
        .when((what == "receiver") & (F.size("tail") == 1), "open")
        .when((what == "import") & (one["member"].isNotNull() | (F.size("tail") > 0)), nothing)
        .otherwise("unresolved")
    )
    reason = (
        F.when(F.col("expression").isNull(), "dynamic")
        .when(F.col("found").isNull() & F.col("starred"), "star-import")
        .when(F.col("found").isNull(), F.when(known == "external", "builtin").otherwise("unbound"))
        .when(F.col("kind") != "unresolved", nothing)
        .when(imports, "module-called")
        .when(n > 1, "rebound")
        .otherwise(F.concat(what, F.lit("-binding")))
    )
    symbol = F.concat_ws(".", F.array(one["symbol"]), "tail")
    module = F.when(imports, plain_module).otherwise(one["module"])
    members = F.when(imports, plain_members).otherwise(F.concat(F.when(one["member"].isNotNull(), F.array(one["member"])).otherwise(F.array().cast("array<string>")), F.col("tail")))
    return found.withColumn("kind", kind).withColumn("reason", reason).withColumns({"target": F.when(F.col("kind") == "open", F.col("path")), "symbol": F.when(F.col("kind") == "open", symbol), "module": F.when(F.col("kind").isNull(), module), "members": F.when(F.col("kind").isNull(), members), "candidates": F.lit(None).cast("array<struct<path:string,symbol:string>>")})


def _followed(rows: DataFrame, modules: DataFrame, tops: DataFrame) -> DataFrame:
    """One more step of rows (path, use, module, members): into the module, its binding, or a child module."""
    by_module = modules.groupBy("module").agg(F.sort_array(F.collect_set("target")).alias("paths"))
    own = by_module.select("module", F.col("paths").alias("own"))
    child = by_module.select(F.col("module").alias("child"), F.col("paths").alias("children"))
    head, rest = F.col("members")[0], F.slice("members", 2, F.lit(1 << 20))
    j = rows.withColumn("child", F.concat_ws(".", "module", head)).join(shuffled(own), "module", "left").join(shuffled(child), "child", "left")
    j = j.withColumn("at", F.when(F.size("own") == 1, F.col("own")[0])).withColumn("head", head)
    j = j.join(shuffled(tops.select(F.col("path").alias("at"), F.col("name").alias("head"), "bound")), ["at", "head"], "left")
    # A package that imports its own child module binds nothing new.
    itself = (F.size("bound") == 1) & (F.col("bound")[0]["module"] == F.col("module")) & (F.col("bound")[0]["member"] == F.col("head"))
    j = j.withColumn("bound", F.when(~F.coalesce(itself, F.lit(False)), F.col("bound")))
    n_own, n_child, one = F.coalesce(F.size("own"), F.lit(0)), F.coalesce(F.size("children"), F.lit(0)), F.col("bound")[0]
    declared = F.forall("bound", lambda b: b["what"].isin("function", "class") & (b["symbol"] == one["symbol"]))
    again = (F.size("bound") == 1) & (one["what"] == "import")
    to_child = ((n_own == 0) | F.col("bound").isNull()) & (n_child == 1)
    kind = (
        F.when(n_own > 1, "ambiguous")
        .when(F.col("bound").isNotNull() & declared, "open")
        .when(again & (one["member"].isNotNull() | (F.size(rest) > 0)), F.lit(None))
        .when(F.col("bound").isNotNull(), "unresolved")
        .when(to_child & (F.size(rest) > 0), F.lit(None))
        .when(to_child, "unresolved")
        .when(n_child > 1, "ambiguous")
        .when(n_own == 0, "external")
        .otherwise("unresolved")
    )
    reason = F.when(kind == "unresolved", F.when(F.col("bound").isNotNull(), F.when(F.size("bound") > 1, "rebound").otherwise(F.concat(one["what"], F.lit("-binding")))).when(to_child, "module-called").otherwise("not-in-module")).when(kind == "ambiguous", "several-modules").when(kind == "external", "outside")
    either = F.when(n_own > 1, F.col("own")).otherwise(F.col("children"))
    candidates = F.when(kind == "ambiguous", F.transform(either, lambda p: F.struct(p.alias("path"), F.concat_ws(".", "members").alias("symbol"))))
    through = F.when(one["member"].isNotNull(), F.concat(F.array(one["member"]), rest)).otherwise(rest)
    out = j.select(
        "path", "use", "passed", F.when(kind == "open", F.col("at")).alias("target"), F.when(kind == "open", F.concat_ws(".", F.array(one["symbol"]), rest)).alias("symbol"),
        F.when(kind.isNull(), F.when(again, one["module"]).otherwise(F.col("child"))).alias("module"), F.when(kind.isNull(), F.when(again, through).otherwise(rest)).alias("members"),
        *_state(kind, reason), candidates.alias("candidates"),
    )
    step = F.concat_ws(":", "module", F.concat_ws(".", "members"))
    looped = F.col("kind").isNull() & F.array_contains("passed", step)
    out = out.withColumn("looped", looped).withColumn("passed", F.when(F.col("kind").isNull(), F.concat("passed", F.array(step))))
    return out.withColumns({"kind": F.when(F.col("looped"), "unresolved").otherwise(F.col("kind")), "reason": F.when(F.col("looped"), "import-cycle").otherwise(F.col("reason"))}).drop("looped")


def follow_imports(rows: DataFrame, modules: DataFrame, bindings: DataFrame) -> DataFrame:
    """Open rows followed until none is left; one that comes back to where it was, or isn't settled after MOST_HOPS steps, is unresolved."""
    top = bindings.filter((F.col("scope") == 0) & (F.col("name") != "*"))
    tops = stored(top.groupBy("path", "name").agg(F.collect_list(F.struct("what", "symbol", "module", "member")).alias("bound")))
    modules = stored(modules)
    done, waiting = None, stored(rows.filter("kind IS NULL").select(*_OPEN, F.array(F.concat_ws(":", "module", F.concat_ws(".", "members"))).alias("passed")))
    settled = rows.filter("kind IS NOT NULL").select(*_OPEN)
    for _ in range(MOST_HOPS):
        if waiting.isEmpty():
            return settled if done is None else settled.unionByName(done)
        step = stored(_followed(waiting, modules, tops))
        ended = step.filter("kind IS NOT NULL").select(*_OPEN)
        done = ended if done is None else done.unionByName(ended)
        waiting = step.filter("kind IS NULL")
    endless = waiting.select(*_OPEN).withColumns({"kind": F.lit("unresolved"), "reason": F.lit("import-cycle")})
    return settled.unionByName(done).unionByName(endless)


def resolve_scoped_calls(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """The callable that each call of Python facts names, over files and scopes.

    (from_path, from_symbol, ordinal, line, col, expression, kind, reason, to_path, to_symbol, candidates, constructor).
    kind is internal, external, ambiguous or unresolved; a reason says why. A name means the nearest scope's binding; one
    bound again there means nothing certain. `x = C(...)`, bound once, makes `x.m()` the method m of the class C, unless C
    has bases, decorators, a metaclass or methods that change what attributes give, or m is set on its instances.
    """
    bindings = facts.filter("fact = 'binding'").select("path", "scope", "name", "what", "symbol", "module", "member", "expression", F.coalesce("plain", F.lit(False)).alias("plain"), "line", "parameters")
    bindings = stored(bindings)
    chains = facts.filter("fact = 'scope'").select("path", "scope", "chain")
    calls = stored(facts.filter("fact = 'call'").select("path", F.concat(F.lit("call:"), F.col("opens")).alias("use"), "chain", "symbol", "line", "col", "opens", "expression"))
    known = bindings.select("path", "scope", "name", "what", "symbol", "module", "member", "expression", "plain")
    # What made a value is a use as well, seen from the scope that binds the value.
    made = bindings.filter("what = 'value' AND expression IS NOT NULL").join(shuffled(chains), ["path", "scope"]).select("path", F.concat_ws(":", F.lit("made"), "scope", "name", "expression").alias("use"), "chain", "expression").distinct()
    uses = calls.select("path", "use", "chain", "expression").unionByName(made)
    parts = F.split("expression", r"\.")
    stars = bindings.filter("name = '*'").select("path").distinct().withColumn("star", F.lit(True))
    uses = uses.withColumns({"name": parts[0], "tail": F.slice(parts, 2, F.lit(1 << 20))}).join(shuffled(stars), "path", "left").withColumn("starred", F.coalesce("star", F.lit(False))).drop("star")
    found = stored(_first_step(nearest_bindings(stored(uses), known)).drop("chain"))
    settled = follow_imports(found, modules, bindings)
    declared = declarations(bindings)
    checked = settled.join(shuffled(declared.select("target", "symbol", "n", "declared", "usual", "lines")), ["target", "symbol"], "left")
    is_open = F.col("kind") == "open"
    kind = F.when(~is_open, F.col("kind")).when(F.col("n") == 1, "internal").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    reason = F.when(~is_open, F.col("reason")).when(F.col("n") > 1, "defined-again").when(F.col("n").isNull(), "not-declared")
    candidates = F.when(is_open & (F.col("n") > 1), F.transform("lines", lambda _: F.struct(F.col("target").alias("path"), F.col("symbol").alias("symbol")))).otherwise(F.col("candidates"))
    ends = stored(checked.select("path", "use", "target", "symbol", "declared", "usual", *_state(kind, reason), candidates.alias("candidates")))
    # Values that one construction made: the method is looked up in its class.
    one = F.col("found")[0]
    values = found.filter((F.size("found") == 1) & (one["what"] == "value") & one["expression"].isNotNull() & (F.size("tail") == 1) & F.startswith("use", F.lit("call:")))
    values = values.select("path", "use", F.concat_ws(":", F.lit("made"), one["scope"], "name", one["expression"]).alias("made"), F.col("tail")[0].alias("member"), one["expression"].alias("constructor"))
    classes = ends.filter(F.startswith("use", F.lit("made:"))).select("path", F.col("use").alias("made"), F.col("target").alias("class_path"), F.col("symbol").alias("class_symbol"), "declared", "usual", F.col("kind").alias("class_kind"))
    class_scopes = facts.filter("fact = 'scope' AND what = 'class'").select(F.col("path").alias("class_path"), F.col("symbol").alias("class_symbol"), "scope")
    blocked = bindings.filter("what IN ('attribute', 'value', 'import', 'class')").join(shuffled(class_scopes), (F.col("path") == F.col("class_path")) & (bindings["scope"] == class_scopes["scope"])).select("class_path", "class_symbol", F.col("name").alias("member"), F.lit(True).alias("blocked")).distinct()
    built = values.join(shuffled(classes), ["path", "made"], "left").withColumn("method", F.concat_ws(".", "class_symbol", "member")).join(shuffled(blocked), ["class_path", "class_symbol", "member"], "left")
    methods = declared.select(F.col("target").alias("class_path"), F.col("symbol").alias("method"), F.col("n").alias("n_methods"))
    built = built.join(shuffled(methods), ["class_path", "method"], "left")
    why = (
        F.when(F.col("class_kind") == "ambiguous", "constructor-ambiguous").when(F.col("class_kind") != "internal", "constructor-unavailable").when(F.col("declared") != "class", "constructor-not-class")
        .when(~F.col("usual"), "constructor-dispatch-unsupported").when(F.col("blocked"), "constructor-member-replaced").when(F.col("n_methods").isNull(), "constructor-method-unavailable").when(F.col("n_methods") > 1, "constructor-method-ambiguous").otherwise("constructed-receiver")
    )
    built = built.select("path", "use", "constructor", why.alias("why"), "class_path", "method")
    out = calls.join(shuffled(ends.select("path", "use", "target", F.col("symbol").alias("to_symbol"), "kind", "reason", "candidates")), ["path", "use"], "left").join(shuffled(built), ["path", "use"], "left")
    got = F.col("why") == "constructed-receiver"
    final_kind = F.when(F.col("why").isNull(), F.col("kind")).when(got, "internal").when(F.col("why").isin("constructor-ambiguous", "constructor-method-ambiguous"), "ambiguous").otherwise("unresolved")
    inside = final_kind == "internal"
    return out.select(
        F.col("path").alias("from_path"), F.col("symbol").alias("from_symbol"), F.col("opens").alias("ordinal"), "line", "col", "expression", final_kind.alias("kind"), F.coalesce("why", "reason").alias("reason"),
        F.when(inside, F.when(got, F.col("class_path")).otherwise(F.col("target"))).alias("to_path"), F.when(inside, F.when(got, F.col("method")).otherwise(F.col("to_symbol"))).alias("to_symbol"), "candidates", "constructor",
    )


def resolve_go_calls(calls: DataFrame, functions: DataFrame, packages: DataFrame) -> DataFrame:
    """Go calls to functions and methods within the package that their binding proves.

    calls: path, ordinal, name, binding (builtin, import, package, receiver), module, receiver; functions: path, name,
    receiver, exported; packages: path, package (its name), module (the import path of its folder). A receiver's methods
    may stand in any file of its package; an import sees exported names alone; several matches are ambiguous, a module
    that no file has is external.
    """
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    places = packages.select("path", folder.alias("folder"), "package", "module")
    callable_ = functions.join(places, "path").select("folder", "package", "module", F.col("path").alias("to_path"), F.concat_ws(".", "receiver", "name").alias("to_symbol"), "exported")
    own = calls.join(places.select("path", "folder", "package"), "path", "left").withColumn("wanted", F.when(F.col("binding") == "receiver", F.concat_ws(".", "receiver", "name")).otherwise(F.col("name")))
    near = own.filter(F.col("binding").isin("package", "receiver")).join(callable_.select("folder", "package", "to_path", F.col("to_symbol").alias("wanted")), ["folder", "package", "wanted"])
    far = own.filter(F.col("binding") == "import").join(callable_.filter("exported").select("module", "to_path", F.col("to_symbol").alias("wanted")), ["module", "wanted"])
    hits = near.select("path", "ordinal", "to_path", "wanted").unionByName(far.select("path", "ordinal", "to_path", "wanted"))
    hits = hits.groupBy("path", "ordinal").agg(F.array_sort(F.collect_set("to_path")).alias("targets"))
    inside = packages.select("module").distinct().withColumn("inside", F.lit(True))
    j = own.join(hits, ["path", "ordinal"], "left").join(inside, "module", "left")
    n = F.coalesce(F.size("targets"), F.lit(0))
    kind = F.when(F.col("binding") == "builtin", "external").when(n == 1, "internal").when(n > 1, "ambiguous").when((F.col("binding") == "import") & F.col("inside").isNull(), "external").otherwise("unresolved")
    return j.select("path", "ordinal", "name", kind.alias("kind"), F.when(n == 1, F.col("targets")[0]).alias("to_path"), F.col("wanted").alias("to_symbol"), F.when(n > 1, F.col("targets")).alias("candidates"))
