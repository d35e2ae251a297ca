"""Call resolution and data flow over Python files whose text is written from the supplied rows, one file a customer.

The oracle never sees the text: it states what each file's calls mean from the rows alone.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, api_schemas, arguments, flows, graph, imports, ledger, maintenance, publication, scopes, scoring, typed_graph
from ..sources.api_exports import export_facts
from ..sources.python_scopes import python_facts
from ..sources.yaml_streams import infrastructure_resources as resources_in
from .queries import query
from .surface import Knowledge
from .wiki_queries import frame


def written(*lines: str | tuple[str, list[str]]) -> str:
    """SQL for a text of these lines; {k} is the row's key, {n} the next one, and a pair holds lines under a condition."""

    def one(line: str) -> str:
        parts = line.replace("'", "''").replace("{k}", "' || c_custkey || '").replace("{n}", "' || (c_custkey + 1) || '").replace("{passed}", "' || passed || '")
        return f"'{parts}' || chr(10)"

    return " || ".join(one(x) if isinstance(x, str) else f"CASE WHEN {x[0]} THEN {' || '.join(map(one, x[1]))} ELSE '' END" for x in lines)


_PASSED = "CASE c_custkey % 6 WHEN 5 THEN 'y=x' WHEN 3 THEN 'x' WHEN 1 THEN '*x' ELSE 'x, ' || c_custkey || ', 7, z=x' END"
_TEXT = written(
    "from pkg.m{n} import run as other", "import pkg.m{n} as mod",
    ("c_custkey % 5 < 2", ["from pkg.m{n} import helper"]), ("c_custkey % 5 >= 2", ["def helper():", "    pass"]),
    "class Box:", "    def step(self):", "        return helper()", "    def go(self):", "        return self.step()",
    ("c_custkey % 7 = 0", ["class Box:", "    def step(self):", "        pass"]),
    "def run(x, y=0, *more, z=1):",
    ("c_custkey % 3 = 0", ["    def helper():", "        pass"]), ("c_custkey % 4 = 0", ["    x = Box()"]),
    "    box = Box()", "    box.step()", "    helper()", "    other({passed})", "    mod.helper()", "    len(x)", "    x.go()", "    return lambda: helper()",
)
_FILES = f"SELECT 'pkg/m' || c_custkey || '.py' AS path, {_TEXT} AS content FROM (SELECT c_custkey, {_PASSED} AS passed FROM customer)"


def _helper(k: str, column: str) -> str:
    """What `helper` at the top of file k is: its own function, or one that the next files hand on."""
    place = f"({k} + CASE {k} % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)"
    there = f"{place} <= top"
    return {"kind": f"CASE WHEN {there} THEN 'internal' ELSE 'external' END", "path": f"CASE WHEN {there} THEN 'pkg/m' || {place} || '.py' END", "symbol": f"CASE WHEN {there} THEN 'helper' END"}[column]


_HERE = "'pkg/m' || k || '.py'"
_OWN = {c: f"CASE WHEN k % 3 = 0 THEN {v} ELSE {_helper('k', c)} END" for c, v in (("kind", "'internal'"), ("path", _HERE), ("symbol", "'run.<locals>.helper'"))}
_NEXT = {c: f"CASE WHEN k + 1 > top THEN {v} ELSE {_helper('(k + 1)', c)} END" for c, v in (("kind", "'external'"), ("path", "NULL"), ("symbol", "NULL"))}
_TWICE = "CASE WHEN k % 7 = 0 THEN 'ambiguous' ELSE 'internal' END"
_ONCE = f"CASE WHEN k % 7 <> 0 THEN {_HERE} END"
#: Every call: its file's number, the caller, its place there, the expression, and what it means.
_MEANT = f"""n AS (SELECT c_custkey AS k, (SELECT max(c_custkey) FROM customer) AS top, {_PASSED} AS passed FROM customer),
c AS (SELECT k, top, 'Box.step' AS from_symbol, 1 AS ord, 'helper' AS expression, {_helper("k", "kind")} AS kind, {_helper("k", "path")} AS to_path, {_helper("k", "symbol")} AS to_symbol, '' AS passed FROM n
UNION ALL SELECT k, top, 'Box.go', 1, 'self.step', {_TWICE}, {_ONCE}, CASE WHEN k % 7 <> 0 THEN 'Box.step' END, '' FROM n
UNION ALL SELECT k, top, 'run', 0, 'Box', {_TWICE}, {_ONCE}, CASE WHEN k % 7 <> 0 THEN 'Box' END, '' FROM n WHERE k % 4 = 0
UNION ALL SELECT k, top, 'run', 1, 'Box', {_TWICE}, {_ONCE}, CASE WHEN k % 7 <> 0 THEN 'Box' END, '' FROM n
UNION ALL SELECT k, top, 'run', 2, 'box.step', {_TWICE}, {_ONCE}, CASE WHEN k % 7 <> 0 THEN 'Box.step' END, '' FROM n
UNION ALL SELECT k, top, 'run', 3, 'helper', {_OWN["kind"]}, {_OWN["path"]}, {_OWN["symbol"]}, '' FROM n
UNION ALL SELECT k, top, 'run', 4, 'other', CASE WHEN k < top THEN 'internal' ELSE 'external' END, CASE WHEN k < top THEN 'pkg/m' || (k + 1) || '.py' END, CASE WHEN k < top THEN 'run' END, passed FROM n
UNION ALL SELECT k, top, 'run', 5, 'mod.helper', {_NEXT["kind"]}, {_NEXT["path"]}, {_NEXT["symbol"]}, '' FROM n
UNION ALL SELECT k, top, 'run', 6, 'len', 'external', NULL, NULL, 'x' FROM n
UNION ALL SELECT k, top, 'run', 7, 'x.go', 'unresolved', NULL, NULL, '' FROM n
UNION ALL SELECT k, top, 'run.<locals>.<lambda>', 1, 'helper', {_OWN["kind"]}, {_OWN["path"]}, {_OWN["symbol"]}, '' FROM n)"""


def code_files(t) -> DataFrame:
    return frame(t, _FILES)


def _resolved(t) -> tuple[DataFrame, DataFrame]:
    files = code_files(t)
    facts = graph.stored(python_facts(files))
    return facts, graph.finished(lambda: scopes.resolve_scoped_calls(facts, scopes.module_index(files)))


@query(f"""WITH {_MEANT} SELECT 'pkg/m' || k || '.py' AS from_path, from_symbol, expression, kind, to_path, to_symbol, count(*) AS n FROM c GROUP BY ALL""")
def scoped_calls(t):
    return _resolved(t)[1].groupBy("from_path", "from_symbol", "expression", "kind", "to_path", "to_symbol").agg(F.count("*").alias("n"))


_GIVEN = """SELECT k, 'x' AS parameter, CASE k % 6 WHEN 5 THEN 'missing' WHEN 1 THEN 'unknown' ELSE 'position' END AS via, CASE WHEN k % 6 NOT IN (1, 5) THEN 'x' END AS text FROM s
UNION ALL SELECT k, 'y', CASE WHEN k % 6 = 5 THEN 'keyword' WHEN k % 6 = 3 THEN 'default' WHEN k % 6 = 1 THEN 'unknown' ELSE 'position' END, CASE WHEN k % 6 = 5 THEN 'x' WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) END FROM s
UNION ALL SELECT k, 'z', CASE WHEN k % 2 = 0 THEN 'keyword' ELSE 'default' END, CASE WHEN k % 2 = 0 THEN 'x' END FROM s
UNION ALL SELECT k, 'more', 'rest', '7' FROM s WHERE k % 2 = 0 UNION ALL SELECT k, NULL, 'unknown', '*x' FROM s WHERE k % 6 = 1"""


@query(f"""WITH {_MEANT}, s AS (SELECT k FROM c WHERE expression = 'other' AND kind = 'internal') SELECT 'pkg/m' || k || '.py' AS file, parameter, via, text FROM ({_GIVEN})""")
def argument_bindings(t):
    facts, resolved = _resolved(t)
    return arguments.bind_arguments(facts, resolved).filter("to_symbol = 'run'").select("file", "parameter", "via", "text")


#: Steps of each file's `run`, two calls deep: the calls, and under each the calls of what it leads to.
_STEPS = f"""{_MEANT}, a AS (SELECT k, ord AS o, -1 AS p, expression, kind, to_path, to_symbol, passed, 'run' AS caller FROM c WHERE from_symbol = 'run'),
b AS (SELECT a.k, a.o, c.ord AS p, c.expression, c.kind, c.to_path, c.to_symbol, c.passed, a.to_symbol AS caller FROM a JOIN c ON c.from_symbol = a.to_symbol AND 'pkg/m' || c.k || '.py' = a.to_path WHERE a.kind = 'internal'),
i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, p) AS step FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
j AS (SELECT i.*, CASE WHEN i.p < 0 THEN 0 ELSE q.step END AS parent FROM i LEFT JOIN i q ON q.k = i.k AND q.o = i.o AND q.p = -1 AND i.p >= 0),
e AS (SELECT {_HERE} AS path, 'helper' AS symbol, 'db' AS effect, 'table' || (k % 9) AS target FROM n WHERE k % 5 >= 2 UNION ALL SELECT {_HERE}, 'run', 'net', CASE WHEN k % 2 = 0 THEN 'len' ELSE 'host' END FROM n),
w AS (SELECT k, step, to_path AS path, to_symbol AS symbol FROM j WHERE step < 12 UNION ALL SELECT k, 0, {_HERE}, 'run' FROM n),
x AS (SELECT k, step, e.symbol, effect, target FROM w JOIN e USING (path, symbol))"""


def _flow_parts(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts, resolved = _resolved(t)
    edges = arguments.call_edges(resolved)
    starts = frame(t, "SELECT 'f' || c_custkey AS flow_id, 'pkg/m' || c_custkey || '.py' AS file, 'run' AS symbol FROM customer")
    steps = graph.checkpointed(graph.traces(starts, edges, 2))
    effects = frame(t, "SELECT 'pkg/m' || c_custkey || '.py' AS path, 'helper' AS symbol, 'boundary_effects' AS effect_kind, 'db' AS kind, 'table' || (c_custkey % 9) AS target FROM customer WHERE c_custkey % 5 >= 2 UNION ALL SELECT 'pkg/m' || c_custkey || '.py', 'run', 'boundary_effects', 'net', CASE WHEN c_custkey % 2 = 0 THEN 'len' ELSE 'host' END FROM customer")
    return flows.data_flow(steps, effects, starts.select("flow_id", F.lit(False).alias("truncated")), arguments.call_arguments(facts))


_CAPPED = "count(*) OVER (PARTITION BY k) AS observed, least(count(*) OVER (PARTITION BY k), {}) AS emitted"


@query(f"""WITH {_STEPS} SELECT 'f' || k AS flow_id, caller AS from_symbol, coalesce(to_symbol, expression) AS to_symbol, parent AS from_step, step AS to_step, expression AS call, passed AS arguments, CASE kind WHEN 'ambiguous' THEN 'unresolved' ELSE kind END AS kind, {_CAPPED.format(12)} FROM j WHERE step < 12""")
def flow_transfers(t):
    rows = _flow_parts(t)[0]
    return rows.select("flow_id", F.col("from").alias("from_symbol"), F.col("to").alias("to_symbol"), *[F.col(c).cast("bigint").alias(c) for c in ("from_step", "to_step")], "call", F.concat_ws(", ", "arguments").alias("arguments"), "kind", "observed", "emitted")


@query(f"""WITH {_STEPS} SELECT 'f' || k AS flow_id, step, symbol, effect, target, {_CAPPED.format(8)} FROM x""")
def flow_boundaries(t):
    return _flow_parts(t)[1].select("flow_id", F.col("step_index").cast("bigint").alias("step"), "symbol", "effect", "target", "observed", "emitted")


@query(f"""WITH {_STEPS}, g AS (SELECT k, step, CASE kind WHEN 'external' THEN 'external_call' ELSE 'unresolved_call' END AS gap, expression AS target FROM j WHERE step < 12 AND kind <> 'internal' AND NOT EXISTS (SELECT 1 FROM x WHERE x.k = j.k AND x.target = j.expression)
UNION ALL SELECT k, 12, 'step_limit', 'first 12 steps' FROM j GROUP BY k HAVING count(*) >= 12) SELECT 'f' || k AS flow_id, step, gap, target, {_CAPPED.format(12)} FROM g""")
def flow_gaps(t):
    return _flow_parts(t)[2].select("flow_id", F.col("step_index").cast("bigint").alias("step"), "gap", "target", "observed", "emitted")


# API exports -------------------------------------------------------------------------------------------------


def exported(*lines: str | tuple[str, str]) -> str:
    """SQL for a JSON document; < and > stand for braces, ' for quotes, {k} is the row's key, a pair has text under a condition."""

    def one(text: str) -> str:
        return "'" + text.replace("'", '"').replace("{k}", "' || c_custkey || '") + "'"

    whole = " || ".join(one(x) if isinstance(x, str) else f"CASE WHEN {x[0]} THEN {one(x[1])} ELSE '' END" for x in lines)
    return f"replace(replace({whole}, '<', chr(123)), '>', chr(125))"


def _document(new: bool) -> str:
    """One side of customer k's API; the candidate differs by what k is divisible by."""
    when = lambda by: f"c_custkey % {by} = 0" if new else "1 = 0"
    old = lambda by: "1 = 0" if new else f"c_custkey % {by} = 0"
    return exported(
        "<'openapi':'3.1.0','paths':<",
        ("NOT (" + when(11) + ")", "'/items/<" + ("key" if new else "id") + ">':<'post':<'parameters':[<'name':'X-Trace','in':'header'>,<'name':'q','in':'query','required':"),
        (f"NOT ({when(11)}) AND {when(13)}", "true"), (f"NOT ({when(11)}) AND NOT ({when(13)})", "false"),
        ("NOT (" + when(11) + ")", ">],'requestBody':<'content':<'application/json':<'schema':<'$ref':'#/components/schemas/A'>>"),
        (f"NOT ({when(11)}) AND {old(6)}", ",'text/plain':<'schema':<'type':'string'>>"),
        ("NOT (" + when(11) + ")", ">>,'responses':<'200':<'content':<'application/json':<'schema':<'$ref':'#/components/schemas/B'>>>>"),
        (f"NOT ({when(11)}) AND {old(8)}", ",'201':<>"),
        ("NOT (" + when(11) + ")", ">>>"),
        ">,'components':<'schemas':<'A':<'type':'object','required':['id'],'properties':<'id':<'type':'string'>,'b':<'$ref':'#/components/schemas/B'>,'list':<'type':'array','items':<'$ref':'#/components/schemas/B'>>>>,'B':<",
        ("c_custkey % 7 = 0", "'allOf':[]>"), ("c_custkey % 7 <> 0", "'type':'object','required':["),
        (f"c_custkey % 7 <> 0 AND {when(3)}", "'n'"), (f"c_custkey % 7 <> 0 AND {old(4)}", "'m'"),
        ("c_custkey % 7 <> 0", "],'properties':<'n':<'type':'integer'>"), ("c_custkey % 7 <> 0 AND c_custkey % 5 = 0", ",'a':<'$ref':'#/components/schemas/A'>"), ("c_custkey % 7 <> 0", ">>"), ">>>",
    )


_EXPORTS = f"SELECT 'api' || c_custkey AS api, 'baseline' AS side, {_document(False)} AS document FROM customer UNION ALL SELECT 'api' || c_custkey, 'candidate', {_document(True)} FROM customer"
_SHAPED = """k AS (SELECT c_custkey AS k, c_custkey % 7 = 0 OR c_custkey % 5 = 0 AND c_custkey % 7 <> 0 AS hidden FROM customer), o AS (SELECT * FROM k WHERE k % 11 <> 0),
f AS (SELECT 'components-changed' AS code, 'advisory' AS severity, k, 'shared components differ' AS detail FROM k WHERE k % 7 <> 0 AND (k % 3 = 0 OR k % 4 = 0)
UNION ALL SELECT 'operation-removed', 'breaking', k, 'absent from candidate' FROM k WHERE k % 11 = 0
UNION ALL SELECT 'contract-changed', 'advisory', k, 'schemas, security or metadata differ' FROM o WHERE k % 13 = 0 OR k % 6 = 0 OR k % 8 = 0
UNION ALL SELECT 'required-input-added', 'breaking', k, 'query q' FROM o WHERE k % 13 = 0
UNION ALL SELECT 'media-type-removed', 'advisory', k, 'request text/plain' FROM o WHERE k % 6 = 0
UNION ALL SELECT 'success-response-removed', 'breaking', k, '201' FROM o WHERE k % 8 = 0
UNION ALL SELECT 'request-schema-unknown', 'advisory', k, 'composition, a cycle or a reference hides fields' FROM o WHERE hidden
UNION ALL SELECT 'response-schema-unknown', 'advisory', k, 'composition, a cycle or a reference hides fields' FROM o WHERE hidden
UNION ALL SELECT 'required-input-added', 'breaking', k, 'application/json ' || place FROM o, (VALUES ('/b/n'), ('/list/*/n')) p(place) WHERE NOT hidden AND k % 3 = 0
UNION ALL SELECT 'response-field-optional', 'advisory', k, '200 application/json /m' FROM o WHERE NOT hidden AND k % 4 = 0)"""


@query(f"""WITH {_SHAPED} SELECT 'api' || k AS api, code, severity, CASE code WHEN 'components-changed' THEN '' ELSE 'POST /items/' || chr(123) || 'id' || chr(125) END AS operation, detail FROM f""")
def api_schema_findings(t):
    # Braces mark tables in a frame's SQL, so those of the routes are written as the document's are.
    return api_schemas.api_differences(export_facts(frame(t, _EXPORTS)))


@query(f"""WITH {_SHAPED}, c AS (SELECT k, count(*) FILTER (severity = 'breaking') AS b, count(*) FILTER (severity <> 'breaking') AS a FROM f GROUP BY k) SELECT 'api' || k AS api, CASE WHEN b > 0 THEN 'breaking' WHEN a > 0 THEN 'advisory' ELSE 'compatible' END AS status, coalesce(b, 0) AS breaking_count, coalesce(a, 0) AS advisory_count FROM k LEFT JOIN c USING (k)""")
def api_schema_status(t):
    exports = frame(t, _EXPORTS)
    findings = api_schemas.api_differences(export_facts(exports))
    return api_schemas.api_status(exports, findings)


# Imports by language -----------------------------------------------------------------------------------------

_SOURCES = """SELECT 'app' || (p_partkey % 9) || '/src/m' || (p_partkey % 23) || '.ts' AS path, 'typescript' AS language FROM part UNION SELECT 'app' || (p_partkey % 9) || '/shared/m' || (p_partkey % 31) || '.js', 'javascript' FROM part WHERE p_size > 25
UNION SELECT 'go' || (p_partkey % 7) || '/p' || (p_partkey % 17) || '/f' || (p_size % 3) || '.go', 'go' FROM part UNION SELECT 'py' || (p_partkey % 5) || '/src/pk/m' || (p_partkey % 19) || '.py', 'python' FROM part
UNION SELECT 'app' || (n_nationkey % 9) || '/src/main.ts', 'typescript' FROM nation UNION SELECT 'go' || (n_nationkey % 7) || '/main.go', 'go' FROM nation UNION SELECT 'py' || (n_nationkey % 5) || '/src/run.py', 'python' FROM nation"""
_USED = """SELECT CASE o_orderkey % 4 WHEN 1 THEN 'go' || (o_custkey % 7) || '/main.go' WHEN 2 THEN 'py' || (o_custkey % 5) || '/src/run.py' ELSE 'app' || (o_custkey % 9) || '/src/main.ts' END AS path, o_orderkey AS ordinal,
CASE o_orderkey % 4 WHEN 1 THEN 'ex.org/g' || (o_custkey % 8) || '/p' || (o_orderkey % 20) WHEN 2 THEN 'pk' WHEN 3 THEN './m' || (o_orderkey % 37) ELSE '@/m' || (o_orderkey % 37) END AS module,
CASE WHEN o_orderkey % 4 = 2 THEN 'm' || (o_orderkey % 25) END AS name, CASE WHEN o_orderkey % 4 = 2 THEN 'from' END AS kind FROM orders"""


@query(f"""WITH f AS ({_SOURCES}), u AS ({_USED}), r AS (SELECT *, split_part(path, '/', 1) AS top FROM u),
w AS (SELECT path, ordinal, top || '/src/' || substr(module, 3) || '.ts' AS target FROM r WHERE module LIKE './%' OR module LIKE '@%' UNION ALL SELECT path, ordinal, top || '/shared/' || substr(module, 3) || '.js' FROM r WHERE module LIKE '@%'
UNION ALL SELECT path, ordinal, top || '/src/pk/' || name || '.py' FROM r WHERE module = 'pk'),
h AS (SELECT w.path, ordinal, target FROM w JOIN f ON f.path = target UNION ALL SELECT r.path, ordinal, f.path FROM r JOIN f ON f.language = 'go' AND regexp_replace(f.path, '/[^/]*$', '') = 'go' || substr(module, 9) WHERE module LIKE 'ex.org/g%'),
g AS (SELECT path, ordinal, count(DISTINCT target) AS n, min(target) AS first FROM h GROUP BY ALL)
SELECT u.path, u.ordinal, coalesce(n, 0) AS n, first, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' WHEN module LIKE '@%' OR module LIKE 'ex.org/g%' AND module NOT LIKE 'ex.org/g7/%' THEN 'internal' ELSE 'external' END AS resolution FROM u LEFT JOIN g USING (path, ordinal)""")
def import_targets(t):
    rules = frame(t, "SELECT DISTINCT 'app' || (n_nationkey % 9) AS root FROM nation").select("root", F.lit("@/*").alias("pattern"), F.array(F.concat("root", F.lit("/src/*")), F.concat("root", F.lit("/shared/*"))).alias("targets"))
    modules = frame(t, "SELECT DISTINCT 'go' || (n_nationkey % 7) AS root, 'ex.org/g' || (n_nationkey % 7) AS module FROM nation")
    found = imports.import_targets(frame(t, _USED), frame(t, _SOURCES), rules, modules)
    return found.select("path", "ordinal", F.coalesce(F.size("targets"), F.lit(0)).cast("bigint").alias("n"), F.col("targets")[0].alias("first"), "resolution")


# Maintenance evidence ----------------------------------------------------------------------------------------

_LOG = """SELECT user_id AS record, event_id AS seq, CASE WHEN event_id % 20 < 2 THEN 'register' WHEN event_id % 20 < 10 THEN 'observe' WHEN event_id % 20 < 14 THEN 'acknowledge' WHEN event_id % 20 < 15 THEN 'delete' WHEN event_id % 20 < 16 THEN 'delete-target'
WHEN event_id % 20 < 17 THEN 'ambiguous-move' ELSE 'confirm-move' END AS kind, CASE WHEN event_id % 31 > 0 THEN 'b' || (event_id // 7 % 2) END AS basis, CASE WHEN event_id % 5 > 0 THEN 'o' || (event_id % 9) END AS owner FROM events"""
_WHOLE = "presence = 'present' AND target = 'present'"
#: The state machine by recursion over each record's events: what the event's error is, then the state where it has none.
_REPLAYED = f"""e AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY seq) AS i FROM ({_LOG})),
s AS (SELECT DISTINCT record, 0 AS i, CAST(NULL AS BIGINT) AS seq, '' AS kind, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS presence, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS basis, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS VARCHAR) AS owner, 0 AS version FROM e
UNION ALL SELECT record, i, seq, kind, error, CASE WHEN error IS NOT NULL THEN presence WHEN kind = 'delete' THEN 'deleted' WHEN kind = 'ambiguous-move' THEN 'ambiguous' ELSE 'present' END,
CASE WHEN error IS NOT NULL OR kind IN ('delete', 'ambiguous-move') THEN target WHEN kind = 'delete-target' THEN 'deleted' ELSE 'present' END,
CASE WHEN error IS NOT NULL THEN status WHEN kind = 'acknowledge' OR kind = 'observe' AND b = held THEN 'acknowledged' ELSE 'open' END,
CASE WHEN error IS NOT NULL OR kind IN ('delete-target', 'ambiguous-move') THEN basis WHEN kind = 'delete' THEN NULL ELSE b END,
CASE WHEN error IS NOT NULL OR kind = 'observe' THEN held WHEN kind = 'acknowledge' THEN b END, CASE WHEN error IS NULL AND kind IN ('register', 'confirm-move') THEN o ELSE owner END, CASE WHEN error IS NOT NULL THEN version WHEN kind = 'register' THEN 1 ELSE version + 1 END
FROM (SELECT s.record, e.i, e.seq, e.kind, s.presence, s.target, s.status, s.basis, s.held, s.owner, s.version, e.basis AS b, e.owner AS o,
CASE WHEN e.kind = 'register' THEN CASE WHEN presence IS NOT NULL THEN 'registered-before' END WHEN presence IS NULL THEN 'not-registered'
WHEN e.kind IN ('observe', 'acknowledge', 'delete-target') AND NOT ({_WHOLE}) THEN 'not-present' WHEN e.kind = 'acknowledge' AND (e.basis IS NULL OR s.basis IS NULL OR e.basis <> s.basis) THEN 'stale-basis'
WHEN e.kind = 'delete' AND presence = 'deleted' THEN 'deleted-before' WHEN e.kind = 'ambiguous-move' AND presence = 'ambiguous' THEN 'ambiguous-before'
WHEN e.kind = 'confirm-move' AND {_WHOLE} THEN 'nothing-moved' WHEN e.kind = 'confirm-move' AND e.owner IS NULL THEN 'no-owner' END AS error FROM s JOIN e ON e.record = s.record AND e.i = s.i + 1))"""


def _history(t) -> DataFrame:
    return maintenance.replay(frame(t, _LOG))


@query(f"""WITH RECURSIVE {_REPLAYED} SELECT record, seq, kind, error, presence, target AS target_presence, status, basis, held AS acknowledged, owner, CAST(version AS BIGINT) AS version FROM s WHERE i > 0""")
def maintenance_replay(t):
    return _history(t)


@query(f"""WITH RECURSIVE {_REPLAYED}, c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY record ORDER BY i DESC) = 1)
SELECT record, presence, target AS target_presence, status, basis, held AS acknowledged, owner, CAST(version AS BIGINT) AS version FROM c WHERE presence IS NOT NULL""")
def maintenance_records(t):
    return maintenance.current_records(_history(t))


# Identities over snapshots -----------------------------------------------------------------------------------

#: Six snapshots of a coordinate or two for each customer, by its key's last digit: 3 moves (and moves back where the key
#: is 3 more than a multiple of 20), 4 is deleted and recreated elsewhere, 6 moves and is taken again, others have a hole.
_KEYS = "SELECT c_custkey AS k, c_custkey % 10 AS d, s FROM customer, (VALUES (1), (2), (3), (4), (5), (6)) v(s)"
_SNAPSHOTS = f"""SELECT s AS snapshot, CASE WHEN d IN (3, 6) AND s >= 3 AND NOT (k % 20 = 3 AND s >= 5) THEN 'n' WHEN d = 4 AND s >= 4 THEN 'q' ELSE 'm' END || k AS locator FROM ({_KEYS}) WHERE CASE WHEN d IN (3, 6) THEN TRUE WHEN d = 4 THEN s <> 3 ELSE s <> 1 + k % 6 END
UNION ALL SELECT s, 'm' || k FROM ({_KEYS}) WHERE d = 6 AND s >= 5"""
_MOVED = "SELECT 3 AS snapshot, 'm' || c_custkey AS old_locator, 'n' || c_custkey AS new_locator FROM customer WHERE c_custkey % 10 IN (3, 6) UNION ALL SELECT 5, 'n' || c_custkey, 'm' || c_custkey FROM customer WHERE c_custkey % 20 = 3"
#: The intervals in closed form: coordinate, from, to, how, first coordinate and snapshot of the identity, conflict.
_SPANS = """p AS (SELECT c_custkey AS k, c_custkey % 10 AS d, 1 + c_custkey % 6 AS hole FROM customer),
f AS (SELECT 'm' || k AS locator, 1 AS valid_from, 2 AS valid_to, 'allocated' AS how, 'm' || k AS root_locator, 1 AS root_from, NULL AS conflict FROM p WHERE d IN (3, 4, 6)
UNION ALL SELECT 'n' || k, 3, CASE WHEN k % 20 = 3 THEN 4 ELSE 6 END, 'moved', 'm' || k, 1, NULL FROM p WHERE d IN (3, 6) UNION ALL SELECT 'm' || k, 5, 6, 'moved', 'm' || k, 1, NULL FROM p WHERE k % 20 = 3
UNION ALL SELECT 'm' || k, 5, 6, 'allocated', 'm' || k, 5, 'alias-owned' FROM p WHERE d = 6 UNION ALL SELECT 'q' || k, 4, 6, 'allocated', 'q' || k, 4, NULL FROM p WHERE d = 4
UNION ALL SELECT 'm' || k, 1, hole - 1, 'allocated', 'm' || k, 1, NULL FROM p WHERE d NOT IN (3, 4, 6) AND hole > 1
UNION ALL SELECT 'm' || k, hole + 1, 6, CASE WHEN hole > 1 THEN 'returned' ELSE 'allocated' END, 'm' || k, CASE WHEN hole > 1 THEN 1 ELSE 2 END, NULL FROM p WHERE d NOT IN (3, 4, 6) AND hole < 6)"""


def _intervals(t) -> DataFrame:
    return ledger.identity_intervals(frame(t, _SNAPSHOTS), frame(t, _MOVED))


@query(f"""WITH {_SPANS} SELECT locator, CAST(valid_from AS BIGINT) AS valid_from, CAST(valid_to AS BIGINT) AS valid_to, how, root_locator, CAST(root_from AS BIGINT) AS root_from, CAST(conflict AS VARCHAR) AS conflict FROM f""")
def identity_intervals(t):
    return _intervals(t).select("locator", *[F.col(c).cast("bigint").alias(c) for c in ("valid_from", "valid_to")], "how", "root_locator", F.col("root_from").cast("bigint").alias("root_from"), "conflict")


@query(f"""WITH {_SPANS}, g AS (SELECT root_locator, root_from, max_by(locator, valid_from) AS locator, max(valid_to) AS ends, min(valid_from) AS since, list(DISTINCT locator) AS places FROM f GROUP BY ALL)
SELECT locator, coalesce(array_to_string(list_sort(list_filter(places, lambda x: x <> locator)), ','), '') AS aliases, CAST(since AS BIGINT) AS since, CAST(CASE WHEN ends < 6 THEN ends + 1 END AS BIGINT) AS retired_at FROM g""")
def identity_records(t):
    found = ledger.identity_records(_intervals(t), 6)
    return found.select("locator", F.concat_ws(",", "aliases").alias("aliases"), F.col("since").cast("bigint").alias("since"), F.col("retired_at").cast("bigint").alias("retired_at"))


_KEPT_SOURCES = "SELECT 'r' || p_partkey AS path, 'k8s' AS adapter, 'c' || p_partkey AS content_hash, 'o' || p_partkey AS observation_hash, 'page' || p_partkey AS page FROM part WHERE p_partkey % 8 < 6"
_LIVE_SOURCES = """SELECT 'r' || p_partkey AS path, 'k8s' AS adapter, 'c' || p_partkey || CASE WHEN p_partkey % 8 = 1 THEN 'x' ELSE '' END AS content_hash, 'o' || p_partkey AS observation_hash, 'page' || p_partkey AS page FROM part WHERE p_partkey % 8 IN (0, 1, 5, 6)
UNION ALL SELECT 's' || p_partkey, 'k8s', 'c' || p_partkey, 'o' || p_partkey, 'moved' || p_partkey FROM part WHERE p_partkey % 8 = 2"""
_DEAD = "SELECT 'r' || p_partkey AS path, 'page' || p_partkey AS page FROM part WHERE p_partkey % 8 = 7 OR p_partkey % 16 = 6"


@query("""SELECT path, action, page, moved_from FROM (SELECT 'r' || p_partkey AS path, CASE p_partkey % 8 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'changed' WHEN 3 THEN 'removed' WHEN 4 THEN 'removed' WHEN 5 THEN 'deselected' WHEN 6 THEN CASE WHEN p_partkey % 16 = 6 THEN 'revived' ELSE 'added' END
WHEN 7 THEN CASE WHEN p_partkey % 3 = 0 THEN 'repair' ELSE 'buried' END END AS action, 'page' || p_partkey AS page, CAST(NULL AS VARCHAR) AS moved_from FROM part WHERE p_partkey % 8 <> 2
UNION ALL SELECT 's' || p_partkey, 'moved', 'moved' || p_partkey, 'r' || p_partkey FROM part WHERE p_partkey % 8 = 2)""")
def infrastructure_sync(t):
    live = frame(t, _LIVE_SOURCES)
    chosen = frame(t, "SELECT 'r' || p_partkey AS path FROM part WHERE p_partkey % 8 <> 5 UNION ALL SELECT 's' || p_partkey FROM part")
    live = live.join(chosen, "path", "left_semi")
    pages = frame(t, "SELECT 'page' || p_partkey AS page FROM part WHERE p_partkey % 3 = 0")
    return ledger.infrastructure_sync(frame(t, _KEPT_SOURCES), frame(t, _DEAD), live, pages, chosen)


# The typed graph of the files --------------------------------------------------------------------------------

_CONCEPTS = """SELECT 'mod:pkg/m' || c_custkey || '.py' AS locator, 'pkg/m' || c_custkey || '.py' AS source_path, CAST(NULL AS VARCHAR) AS symbol FROM customer
UNION ALL SELECT 'c:pkg/m' || c_custkey || '.py:run', 'pkg/m' || c_custkey || '.py', 'run' FROM customer UNION ALL SELECT 'c:pkg/m' || c_custkey || '.py:helper', 'pkg/m' || c_custkey || '.py', 'helper' FROM customer WHERE c_custkey % 5 >= 2
UNION ALL SELECT 'c:pkg/m' || c_custkey || '.py:Box', 'pkg/m' || c_custkey || '.py', 'Box' FROM customer UNION ALL SELECT 'c:pkg/m' || c_custkey || '.py:Box#2', 'pkg/m' || c_custkey || '.py', 'Box' FROM customer WHERE c_custkey % 7 = 0"""
_OBSERVED = f"""{_MEANT}, o AS (SELECT 'contains' AS kind, 'mod:' || source_path AS source, 'concept' AS target_kind, locator AS target, 'inventory' AS origin, 'resolved' AS resolution, source_path || ':' || symbol AS evidence FROM ({_CONCEPTS}) WHERE symbol IS NOT NULL
UNION ALL SELECT 'calls', CASE WHEN from_symbol LIKE 'Box%' THEN CASE WHEN k % 7 = 0 THEN 'mod:' || {_HERE} ELSE 'c:' || {_HERE} || ':Box' END ELSE 'c:' || {_HERE} || ':run' END, CASE kind WHEN 'internal' THEN 'concept' WHEN 'external' THEN 'external' ELSE 'unresolved' END,
CASE WHEN kind = 'internal' THEN 'c:' || to_path || ':' || split_part(to_symbol, '.', 1) ELSE expression END, 'call-resolution', CASE kind WHEN 'internal' THEN 'resolved' ELSE kind END, from_symbol || ':' || expression FROM c
UNION ALL SELECT 'imports', 'mod:' || {_HERE}, CASE WHEN k < top THEN 'concept' ELSE 'external' END, CASE WHEN k < top THEN 'mod:pkg/m' || (k + 1) || '.py' ELSE 'pkg.m' || (k + 1) END, 'import-resolution', CASE WHEN k < top THEN 'resolved' ELSE 'external' END, name FROM n, (VALUES ('other'), ('mod'), ('helper')) v(name) WHERE name <> 'helper' OR k % 5 < 2)"""


def _pieces(t, facts: DataFrame, resolved: DataFrame, concepts: DataFrame) -> DataFrame:
    calls = resolved.withColumn("evidence", F.concat_ws(":", "from_symbol", "expression"))
    targets = scopes.module_index(code_files(t)).groupBy("module").agg(F.collect_set("target").alias("targets"))
    bound = facts.filter("fact = 'binding' AND what = 'import'").select("path", "module", F.col("name").alias("evidence")).join(graph.shuffled(targets), "module", "left")
    bound = bound.withColumn("resolution", F.when(F.col("targets").isNull(), "external").otherwise("resolved"))
    observed = (typed_graph.containment(concepts), typed_graph.call_observations(calls, concepts), typed_graph.import_observations(bound, concepts))
    # Written one after the other, so that the shuffles of one are gone when the next one starts.
    return typed_graph.pieces_of(*map(graph.stored, observed))


def _concepts(t) -> DataFrame:
    return graph.stored(frame(t, _CONCEPTS))


def _graph(t, facts: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    concepts = _concepts(t)
    return typed_graph.edges_of(graph.finished(lambda: _pieces(t, facts, resolved, concepts))), concepts


def _edges(t) -> DataFrame:
    """The graph alone: of what led to it, nothing but its pieces is left on disk."""
    return typed_graph.edges_of(graph.finished(lambda: _pieces(t, *_resolved(t), _concepts(t))))


@query(f"""WITH {_OBSERVED}, g AS (SELECT kind, source, target_kind, target, origin, resolution, count(*) AS observed, list_sort(list(DISTINCT evidence)) AS pieces FROM o GROUP BY ALL)
SELECT 'sha256:' || sha256(concat_ws(chr(31), kind, source, target_kind, target, origin, resolution)) AS key, kind, source, target, resolution, observed, array_to_string(pieces[1:3], ',') AS samples, least(len(pieces), 3) AS emitted, len(pieces) > 3 AS truncated FROM g""")
def typed_edges(t):
    return _edges(t).select("key", "kind", "source", "target", "resolution", "observed", F.concat_ws(",", "samples").alias("samples"), "emitted", "truncated")


@query(f"""WITH {_OBSERVED}, g AS (SELECT kind, source, target, origin, resolution, count(*) AS observed, least(count(DISTINCT evidence), 3) AS emitted FROM o GROUP BY ALL)
SELECT kind, count(*) AS edges, CAST(sum(observed) AS BIGINT) AS observed, CAST(sum(emitted) AS BIGINT) AS emitted, CAST(sum(observed) - sum(emitted) AS BIGINT) AS omitted FROM g GROUP BY kind""")
def typed_edge_coverage(t):
    return typed_graph.coverage(_edges(t))


# Budgets -----------------------------------------------------------------------------------------------------

#: Every customer's request: its orders as sources and as concepts, and a relation between each two that follow each other.
_WANTED = """SELECT o_custkey AS request, 'source' AS kind, 's' || o_orderkey AS item, CAST(o_orderkey AS BIGINT) AS place, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority, CAST(o_orderkey % 2 AS BIGINT) AS fresh, 'deep' AS detail, repeat('d', CAST(o_orderkey % 90 AS INT)) AS deep, repeat('s', CAST(o_orderkey % 30 AS INT)) AS slim, 'x' AS summary, CAST(NULL AS VARCHAR) AS source_path, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM orders
UNION ALL SELECT o_custkey, 'concept', 'c' || o_orderkey, CAST(o_orderkey AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, 's' || o_orderkey, NULL, NULL FROM orders
UNION ALL SELECT o_custkey, 'relation', 'r' || o_orderkey, CAST(o_orderkey AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'c' || o_orderkey, 'c' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders"""


@query()
def joint_budgets(t):
    entries = frame(t, _WANTED).withColumnsRenamed({"a": "from", "b": "to"})
    budgets = frame(t, "SELECT c_custkey AS request, 40 + c_custkey % 100 AS tokens FROM customer")
    return scoring.fit_joint_requests(entries, budgets)


# Infrastructure files ----------------------------------------------------------------------------------------


def _lines(*lines: str) -> str:
    return " || ".join("'" + x.replace("{k}", "' || p_partkey || '").replace("{size}", "' || p_size || '").replace("{five}", "' || (p_partkey % 5) || '") + "' || chr(10)" for x in lines)


_MANIFEST = _lines("apiVersion: apps/v1", "kind: Deployment", "metadata:", "  name: d{k}", "  namespace: n{five}", "spec:", "  replicas: {size}", "---", "apiVersion: v1", "kind: Service", "metadata:", "  name: s{k}", "spec:", "  ports:", "  - port: 80", "  - port: {size}")
_SERVICES = _lines("base: &b", "  image: i{k}", "services:", "  one:", "    <<: *b", "  two:", "    <<: *b", "    image: own")
_YAML = f"""SELECT 'k8s/p' || p_partkey || '.yaml' AS path, {_MANIFEST} || CASE WHEN p_partkey % 10 = 3 THEN 'kind: Again' || chr(10) ELSE '' END AS content FROM part
UNION ALL SELECT 'c' || p_partkey || '/docker-compose.yml', {_SERVICES} FROM part WHERE p_partkey % 4 = 0"""


@query("""SELECT path, CAST(document AS BIGINT) AS document, adapter, kind, name, scope, facts FROM (
SELECT 'k8s/p' || p_partkey || '.yaml' AS path, 0 AS document, 'kubernetes' AS adapter, 'Deployment' AS kind, 'd' || p_partkey AS name, 'n' || (p_partkey % 5) AS scope, 'api=apps/v1;replicas=' || p_size AS facts FROM part WHERE p_partkey % 10 <> 3
UNION ALL SELECT 'k8s/p' || p_partkey || '.yaml', 1, 'kubernetes', 'Service', 's' || p_partkey, '', 'api=v1;ports=80,' || p_size FROM part WHERE p_partkey % 10 <> 3
UNION ALL SELECT 'k8s/p' || p_partkey || '.yaml', NULL, NULL, 'refused', 'a repeated key', '', '' FROM part WHERE p_partkey % 10 = 3
UNION ALL SELECT 'c' || p_partkey || '/docker-compose.yml', 0, 'compose', 'service', name, '', 'image=' || CASE name WHEN 'one' THEN 'i' || p_partkey ELSE 'own' END FROM part, (VALUES ('one'), ('two')) v(name) WHERE p_partkey % 4 = 0)""")
def infrastructure_resources(t):
    found = resources_in(frame(t, _YAML))
    facts = F.array_join(F.transform(F.array_sort(F.map_entries("facts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("path", F.col("document").cast("bigint").alias("document"), "adapter", "kind", "name", "scope", facts.alias("facts"))


# Publication -------------------------------------------------------------------------------------------------

#: A topic a customer: those of 0 by 7 are retired, of 1 by 7 new; by 3 an input changes, by 5 it is lost, by 11 the target.
_TOPIC_ROWS = "SELECT 'baseline' AS side, c_custkey AS k FROM customer WHERE c_custkey % 7 <> 1 UNION ALL SELECT 'candidate', c_custkey FROM customer WHERE c_custkey % 7 <> 0"
_TOPICS = f"SELECT side, 't' || k AS topic, 'o' AS owner, 'p' || k AS wiki_page, CAST(NULL AS VARCHAR) AS anchor, 'wiki' AS edit_at FROM ({_TOPIC_ROWS})"
_INPUTS = f"SELECT side, 't' || k AS topic, 'd' AS dependency, 'arch/' || k AS page, CASE WHEN side = 'baseline' THEN 'h' || k WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'x' || k ELSE 'h' || k END AS hash FROM ({_TOPIC_ROWS})"
_TARGETS = f"SELECT side, 't' || k AS topic, CASE WHEN side = 'candidate' AND k % 11 = 0 THEN 'missing' ELSE 'available' END AS state, CASE WHEN side = 'baseline' OR k % 11 <> 0 THEN 'g' || k END AS hash FROM ({_TOPIC_ROWS})"
_FOUND_TOPICS = """t AS (SELECT c_custkey AS k, c_custkey % 7 = 0 AS gone, c_custkey % 7 = 1 AS fresh, CASE WHEN c_custkey % 7 = 0 THEN 'h' || c_custkey WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'x' || c_custkey ELSE 'h' || c_custkey END AS rest,
CASE WHEN c_custkey % 7 = 0 THEN 'not-evaluated' WHEN c_custkey % 11 = 0 THEN 'missing' ELSE 'available' END AS state FROM customer),
f AS (SELECT *, CASE WHEN NOT gone AND rest IS NULL THEN 'incomplete' ELSE 'needs-review' END AS status,
'sha256:' || sha256(concat_ws(chr(31), 't' || k, 'o', 'p' || k, chr(28), 'wiki', 'd' || chr(30) || coalesce(rest, chr(28)), state, CASE state WHEN 'available' THEN 'g' || k ELSE chr(28) END, 'pinned', 'v1', 'wiki')) AS basis,
list_filter([CASE WHEN gone OR fresh OR rest IS NULL OR k % 3 = 0 THEN 'dependency-changed d' END, CASE WHEN rest IS NULL THEN 'evidence-unavailable d' END, CASE WHEN fresh THEN 'initial-review' END, CASE WHEN gone THEN 'mapping-retired' END, CASE state WHEN 'missing' THEN 'target missing' END,
CASE WHEN gone OR fresh OR state = 'missing' THEN 'target-changed' END], lambda r: r IS NOT NULL) AS reasons FROM t)"""


def _topic_findings(t) -> DataFrame:
    pages = frame(t, f"SELECT side, 'arch/' || k AS path, 'u' || k AS uid FROM ({_TOPIC_ROWS})")
    settings = frame(t, "SELECT DISTINCT CASE WHEN r_regionkey = 0 THEN 'baseline' ELSE 'candidate' END AS side, 'v1' AS release_tag, 'pinned' AS source_policy, 'wiki' AS destination FROM region")
    return publication.topic_findings(frame(t, _TOPICS), frame(t, _INPUTS), pages, frame(t, _TARGETS), settings)


@query(f"""WITH {_FOUND_TOPICS} SELECT 't' || k AS topic, status, gone AS retired, array_to_string(reasons, ';') AS reasons, basis AS review_basis FROM f WHERE len(reasons) > 0""")
def topic_findings(t):
    return _topic_findings(t).select("topic", "status", "retired", F.concat_ws(";", "reasons").alias("reasons"), "review_basis")


@query(f"""WITH {_FOUND_TOPICS}, r AS (SELECT k, k % 2 = 0 AS good FROM t WHERE (k % 2 = 0 OR k % 4 = 1)), g AS (SELECT * FROM f WHERE len(reasons) > 0)
SELECT 't' || r.k AS topic, CASE WHEN g.k IS NULL THEN 'idle' WHEN NOT good THEN 'stale' WHEN g.status = 'incomplete' OR NOT g.gone AND g.state <> 'available' THEN 'blocked' ELSE 'matched' END AS state, CASE WHEN t.gone THEN 'retired' ELSE 'still-current' END AS decision FROM r JOIN t USING (k) LEFT JOIN g ON g.k = r.k WHERE NOT good OR g.k IS NOT NULL
UNION ALL SELECT 't' || g.k, 'missing', CASE WHEN g.gone THEN 'retired' ELSE 'still-current' END FROM g LEFT JOIN r ON r.k = g.k WHERE status = 'needs-review' AND NOT (coalesce(good, FALSE) AND (g.gone OR g.state = 'available'))""")
def review_states(t):
    found = graph.checkpointed(_topic_findings(t))
    kept = found.filter("CAST(substring(topic, 2) AS BIGINT) % 2 = 0").select("topic", "owner", F.when(F.col("retired"), "retired").otherwise("still-current").alias("decision"), "review_basis")
    old = frame(t, "SELECT 't' || c_custkey AS topic, 'o' AS owner, CASE WHEN c_custkey % 7 = 0 THEN 'retired' ELSE 'still-current' END AS decision, 'old' AS review_basis FROM customer WHERE c_custkey % 4 = 1")
    return publication.review_states(found, kept.unionByName(old))


_WIKI_FILES = "SELECT 'Page-' || p_partkey || '.md' AS path, CAST(p_size AS BIGINT) AS bytes FROM part UNION ALL SELECT CASE p_partkey % 3 WHEN 0 THEN 'sub/page-' || p_partkey || '.md' WHEN 1 THEN 'img/' || p_partkey || '.png' ELSE 'a?/' || p_partkey || '.md' END, 1 FROM part WHERE p_size = 9"
_WIKI_LINKS = "SELECT 'Page-' || p_partkey || '.md' AS path, CASE p_partkey % 6 WHEN 0 THEN 'Page ' || (p_partkey * 2) WHEN 1 THEN 'page-' || p_partkey WHEN 2 THEN 'https://x/' || p_partkey WHEN 3 THEN 'Page-' || p_partkey || '#s' || (p_partkey % 4) WHEN 4 THEN 'img/' || p_partkey || '.png' ELSE '../up' END AS target, p_partkey % 6 = 4 AS image, FALSE AS wiki FROM part"


@query(f"""WITH f AS ({_WIKI_FILES}), v AS (SELECT path FROM f WHERE path NOT LIKE '%?%'), r AS (SELECT path, replace(regexp_replace(path, '^.*/|[.]md$', '', 'g'), ' ', '-') AS route FROM v WHERE path LIKE '%.md'), k AS (SELECT lower(route) AS key, count(*) AS n, min(route) AS served FROM r GROUP BY 1),
l AS (SELECT path, target, replace(regexp_replace(target, '#.*$', ''), ' ', '-') AS name FROM ({_WIKI_LINKS}) WHERE target NOT LIKE 'https%' AND target NOT LIKE '../%'), j AS (SELECT l.*, v.path AS exact, k.served FROM l LEFT JOIN v ON v.path = l.name LEFT JOIN k ON k.key = lower(name))
SELECT path, 'invalid-path' AS kind, '' AS detail FROM f WHERE path LIKE '%?%' UNION ALL SELECT 'Home.md', 'missing-home', '' UNION ALL SELECT path, 'route-collision', key FROM r JOIN k ON key = lower(route) WHERE n > 1
UNION ALL SELECT path, 'unsafe-link', target FROM ({_WIKI_LINKS}) WHERE target LIKE '../%' UNION ALL SELECT path, 'missing-link', target FROM j WHERE exact IS NULL AND served IS NULL UNION ALL SELECT path, 'unsafe-link', target FROM j WHERE exact IS NULL AND served <> name
UNION ALL SELECT path, 'missing-anchor', target FROM j WHERE served = name AND target LIKE '%#%' AND target NOT LIKE '%#s3' """)
def wiki_problems(t):
    anchors = frame(t, "SELECT 'Page-' || p_partkey || '.md' AS path, 's3' AS anchor FROM part UNION ALL SELECT 'sub/page-' || p_partkey || '.md', 's3' FROM part")
    return publication.wiki_problems(frame(t, _WIKI_FILES), frame(t, _WIKI_LINKS), anchors)


# The named operations over the files' graph ------------------------------------------------------------------

_PAGES = "SELECT 'module' AS kind, 'modules/m' || c_custkey || '.md' AS canonical_path, 'pkg/m' || c_custkey || '.py' AS source_path FROM customer UNION ALL SELECT 'flow', 'flows/m' || c_custkey || '.md', 'pkg/m' || c_custkey || '.py' FROM customer"


def knowledge(t) -> Knowledge:
    """The files' frames, each derived when an operation reads it; facts, resolution and graph once."""
    read = cache(lambda: graph.checkpointed(python_facts(code_files(t))))

    @cache
    def resolved() -> DataFrame:
        facts = read()  # read before, since finished() deletes what is stored within it
        return graph.finished(lambda: scopes.resolve_scoped_calls(facts, scopes.module_index(code_files(t))))

    built = cache(lambda: _graph(t, read(), resolved()))

    def linked() -> DataFrame:
        targets = scopes.module_index(code_files(t)).withColumnRenamed("target", "dst")
        return read().filter("fact = 'binding' AND what = 'import'").select(F.col("path").alias("src"), "module").join(graph.shuffled(targets), "module").select("src", "dst").distinct()

    return Knowledge(
        concepts=lambda: built()[1], relationships=lambda: built()[0], graph_edges=lambda: built()[0], surface=lambda: frame(t, _PAGES),
        callables=lambda: read().filter("fact = 'binding' AND what = 'function'").select(F.col("path").alias("file"), "symbol").distinct(), edges=lambda: arguments.call_edges(resolved()), dependencies=linked,
        inventory=lambda: frame(t, _PAGES).select(F.col("source_path").alias("path"), F.col("canonical_path").alias("page")), declared=lambda: frame(t, _PAGES).limit(0).select(F.col("source_path").alias("source"), F.col("canonical_path").alias("page")),
    )


@query(f"""WITH {_MEANT}, a AS (SELECT {_HERE} AS file, from_symbol AS symbol, kind, count(*) AS calls FROM c WHERE to_path = 'pkg/m8.py' AND to_symbol = 'run' GROUP BY ALL),
b AS (SELECT to_path AS file, coalesce(to_symbol, expression) AS symbol, CASE kind WHEN 'ambiguous' THEN 'unresolved' ELSE kind END AS kind, count(*) AS calls FROM c WHERE k = 8 AND from_symbol = 'run' GROUP BY ALL)
SELECT 'caller' AS relation, file, symbol, kind, calls, count(*) OVER () AS total FROM a UNION ALL SELECT 'callee', file, symbol, kind, calls, count(*) OVER () FROM b
UNION ALL SELECT 'page', canonical_path, NULL, 'page', 1, count(*) OVER () FROM ({_PAGES}) WHERE source_path = 'pkg/m8.py'""")
def symbol_operation(t):
    return knowledge(t).query("symbol", "pkg/m8.py:run", limit=40).select("relation", "file", "symbol", "kind", "calls", "total")


_INCIDENT = f"""WITH {_OBSERVED}, e AS (SELECT kind, source, target, resolution, count(*) AS observed FROM o GROUP BY kind, source, target_kind, target, origin, resolution),
b AS (SELECT 'out' AS direction, * FROM e WHERE source = 'c:pkg/m8.py:run' UNION ALL SELECT 'in', * FROM e WHERE target = 'c:pkg/m8.py:run')
SELECT direction, kind, source, target, resolution, observed, count(*) OVER () AS total FROM b"""


@query(_INCIDENT)
def related_operation(t):
    return knowledge(t).query("related", "c:pkg/m8.py:run", limit=60).select("direction", "kind", "source", "target", "resolution", "observed", "total")


@query(_INCIDENT.replace("AS total FROM b", "AS total FROM b WHERE kind = 'calls' AND direction = 'in'"))
def typed_operation(t):
    return knowledge(t).query("typed", "c:pkg/m8.py:run", limit=60, direction="in", kinds=["calls"]).select("direction", "kind", "source", "target", "resolution", "observed", "total")


@query(f"""WITH e AS (SELECT 'pkg/m' || c_custkey || '.py' AS src, 'pkg/m' || (c_custkey + 1) || '.py' AS dst FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer))
SELECT 'inbound' AS direction, src AS neighbor, (SELECT count(*) FROM e x WHERE x.dst = e.src) AS fan_in, (SELECT count(*) FROM e x WHERE x.src = e.src) AS fan_out FROM e WHERE dst = 'pkg/m8.py'
UNION ALL SELECT 'outbound', dst, (SELECT count(*) FROM e x WHERE x.dst = e.dst), (SELECT count(*) FROM e x WHERE x.src = e.dst) FROM e WHERE src = 'pkg/m8.py'""")
def dependency_operation(t):
    return knowledge(t).query("dependency", "pkg/m8.py").select("direction", "neighbor", "fan_in", "fan_out")


@query(f"""SELECT kind, canonical_path, source_path FROM ({_PAGES}) WHERE kind = 'flow' ORDER BY canonical_path LIMIT 100""")
def surface_operation(t):
    return knowledge(t).query("surface", limit=100, kinds=["flow"]).select("kind", "canonical_path", "source_path")


_REACHED = f"""{_OBSERVED}, h AS (SELECT 'pkg/m' || c_custkey || '.py' AS path FROM customer WHERE c_nationkey = 3), p AS (SELECT * FROM ({_CONCEPTS}) WHERE source_path IN (SELECT path FROM h)),
d AS (SELECT 'pkg/m' || c_custkey || '.py' AS src, 'pkg/m' || (c_custkey + 1) || '.py' AS dst FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer)),
x AS (SELECT 'page' AS section, canonical_path AS item FROM ({_PAGES}) WHERE source_path IN (SELECT path FROM h) UNION SELECT 'edge', src || ' -> ' || dst FROM d WHERE src IN (SELECT path FROM h) OR dst IN (SELECT path FROM h)
UNION SELECT 'concept', locator FROM p UNION SELECT 'relation', 'sha256:' || sha256(concat_ws(chr(31), kind, source, target_kind, target, origin, resolution)) FROM o WHERE source IN (SELECT locator FROM p) OR target IN (SELECT locator FROM p))"""


@query(f"""WITH {_REACHED} SELECT section, item, place, total FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY lower(item), item) AS place, count(*) OVER (PARTITION BY section) AS total FROM x) WHERE place <= 50
UNION ALL SELECT 'identity', 'sha256:' || sha256(string_agg(section || chr(31) || item || '@' || sha256('') || chr(10), '' ORDER BY section || chr(31) || item)), 1, 1 FROM x""".replace("|| '@' ||", "|| chr(0) ||"))
def impact_of_changes(t):
    changed = frame(t, "SELECT 'pkg/m' || c_custkey || '.py' AS path FROM customer WHERE c_nationkey = 3")
    return knowledge(t).query("impact", limit=50, changed=changed).select("section", "item", F.col("place").cast("bigint").alias("place"), "total")


# Counts over concepts ----------------------------------------------------------------------------------------

_STATES = ["current", "nonsemantic-source-change", "source-changed", "source-missing", "basis-incompatible", "unknown"]
_EVIDENCE = ["present", "missing", "invalid", "unknown", "not-applicable"]
_COUNTED = """SELECT o_orderstatus || substr(o_orderpriority, 1, 1) AS kind, CASE o_custkey % 6 WHEN 0 THEN 'present' WHEN 1 THEN 'missing' WHEN 2 THEN 'unknown' ELSE 'present' END AS evidence, o_orderkey % 4 > 0 AS modeled, o_orderkey % 4 > 0 AND o_orderkey % 3 = 0 AS compared,
CASE o_custkey % 5 WHEN 0 THEN 'current' WHEN 1 THEN 'source-changed' WHEN 2 THEN 'source-missing' ELSE 'unknown' END AS state, CASE o_custkey % 7 WHEN 0 THEN 'equal' WHEN 1 THEN 'source-absent' ELSE 'code' || (o_custkey % 7) END AS reason FROM orders"""


def _domain(members: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{m}')" for m in members) + ") v(member)"


@query(f"""WITH c AS ({_COUNTED}) SELECT 'kind' AS dimension, kind AS member, count(*) AS count FROM c GROUP BY kind UNION ALL SELECT 'evidence', member, count(kind) FROM {_domain(_EVIDENCE)} LEFT JOIN c ON evidence = member GROUP BY member
UNION ALL SELECT 'freshness', member, count(kind) FROM {_domain(_STATES)} LEFT JOIN c ON state = member GROUP BY member""")
def concept_counts(t):
    return aggregates.concept_counts(frame(t, _COUNTED))


_PER_STATE = ", ".join(f"count(*) FILTER (modeled AND state = '{s}') AS {s.replace('-', '_')}" for s in _STATES)


@query(f"""WITH c AS (SELECT *, CASE WHEN kind IN ('O1', 'F2', 'P3') THEN kind ELSE 'other' END AS k FROM ({_COUNTED})) SELECT k AS kind, CAST(grouping(k) AS BIGINT) AS is_total, count(*) AS total, count(*) FILTER (modeled) AS modeled, count(*) FILTER (NOT modeled) AS unmodeled, count(*) FILTER (compared) AS compared, {_PER_STATE} FROM c GROUP BY ROLLUP (k)""")
def coverage_by_kind(t):
    found = aggregates.coverage_by_kind(frame(t, _COUNTED), ["O1", "F2", "P3"])
    return found.withColumn("is_total", F.col("is_total").cast("bigint"))


@query(f"""SELECT CASE WHEN reason IN ('equal', 'source-absent', 'code3') THEN reason ELSE 'other' END AS reason, count(*) AS count FROM ({_COUNTED}) GROUP BY 1""")
def reason_histogram(t):
    return aggregates.reason_histogram(frame(t, _COUNTED), ["equal", "source-absent", "code3"])


@query("""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), i AS (SELECT dst AS node, count(*) AS fan_in FROM e GROUP BY dst) SELECT node, fan_in, CAST(0 AS BIGINT) AS fan_out, row_number() OVER (ORDER BY fan_in DESC, lower(node), node) AS place FROM i QUALIFY place <= 25""")
def most_depended(t):
    edges = frame(t, "SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem")
    return graph.most_depended(edges, 25).withColumn("place", F.col("place").cast("bigint"))
