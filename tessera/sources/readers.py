"""Sources: pages, events, diffs, ignore rules, selections, stores, API exports, build files, Python code."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import utf8_truncate
from ..operators.relationships import nearest_scope
from .yaml_streams import compose

EVENT_SCHEMA = "ts string, event string, strict boolean, passed boolean, exit_code int, duration_ms bigint, issue_count int, knowledge_summary string"


def wiki_pages(spark: SparkSession, root: str, kinds: list[str] | None = None) -> DataFrame:
    """Pages of a folder of Markdown, one whole file a row; the kind is the top folder, the title the first heading."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    name = F.regexp_replace(F.input_file_name(), r"^[a-z]+:/*", "/")
    path = F.regexp_replace(name, F.lit("^.*" + re.escape("/" + root.rstrip("/").split("/")[-1] + "/")), F.lit(""))
    pages = raw.select(path.alias("path"), F.col("value").alias("content"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    kind = F.when(F.contains(F.col("path"), F.lit("/")), F.split("path", "/")[0]).otherwise(stem)
    if kinds is not None:
        pages = pages.filter(kind.isin(kinds))
    title = F.nullif(F.trim(F.regexp_extract("content", r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)), F.lit(""))
    return pages.select(kind.alias("kind"), stem.alias("id"), F.concat(F.lit("wiki://"), "path").alias("uri"), "path", F.coalesce(title, stem).alias("title"), "content")


def document_pages(documents: DataFrame) -> DataFrame:
    """The documents table as pages."""
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return documents.select(F.col("lang").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc://"), path).alias("uri"), path.alias("path"), F.col("doc_id").cast("string").alias("title"), F.col("text").alias("content"), F.col("doc_id").alias("ordinal"))


def window_seconds(value: str | int | None) -> int | None:
    """A look-back window: days, or a number with d, h or m; at least 1."""
    if value is None or value == "":
        return None
    match = re.fullmatch(r"(\d+)([dhm]?)", str(value).strip().lower())
    if not match or int(match[1]) < 1:
        raise ValueError("a window is a positive number of days, or one with d, h or m")
    return int(match[1]) * {"": 86400, "d": 86400, "h": 3600, "m": 60}[match[2]]


def events(spark: SparkSession, path: str, last: str | int | None = None, now=None) -> DataFrame:
    """An event log (JSON lines) since a look-back; lines that aren't JSON are skipped, a bad time is null and stays out."""
    raw = spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path).withColumn("at", F.try_to_timestamp("ts"))
    return since(raw, last, now)


def since(log: DataFrame, last: str | int | None, now=None, column: str = "at") -> DataFrame:
    seconds = window_seconds(last)
    if seconds is None:
        return log
    moment = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return log.filter(F.col(column) >= moment - F.make_dt_interval(secs=F.lit(seconds)))


DIFF_SCHEMA = "path string, old_path string, kind string"


def diff_paths(text: str, strict: bool = False) -> list[tuple[str, str | None, str]]:
    """(path, old path, kind) of the files a unified diff touches. Hunk bodies are passed over by counting their lines.

    strict: at most 1 MiB, and a/ and b/ before every path.
    """
    if strict and len(text.encode()) > 1 << 20:
        raise ValueError("a diff has at most 1 MiB")

    def name(raw: str, side: str) -> str | None:
        raw = raw.split("\t")[0].strip()
        if raw.startswith('"') and raw.endswith('"'):
            raw = json.loads(raw)
        if raw == "/dev/null":
            return None
        if raw.startswith(side + "/"):
            return raw[2:]
        if strict:
            raise ValueError(f"a path without {side}/")
        return raw

    out: dict[str, tuple[str | None, str]] = {}
    before, old_left, new_left, moved = None, 0, 0, None
    for line in text.splitlines():
        if old_left > 0 or new_left > 0:
            old_left -= line[:1] in (" ", "-", "")
            new_left -= line[:1] in (" ", "+", "")
            continue
        hunk = re.match(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", line)
        if hunk:
            old_left, new_left = (1 if g is None else int(g) for g in hunk.groups())
        elif line.startswith(("rename from ", "copy from ")):
            moved = line.split(" from ", 1)[1]
        elif line.startswith(("rename to ", "copy to ")):
            kind, path = line.split(" to ", 1)
            out[path] = (moved, kind)
        elif line.startswith("--- "):
            before = name(line[4:], "a")
        elif line.startswith("+++ "):
            after = name(line[4:], "b")
            if after is None and before is not None:
                out[before] = (None, "deleted")
            elif after is not None:
                out.setdefault(after, (before if before != after else None, "added" if before is None else "modified"))
    return [(path, *rest) for path, rest in out.items()]


def diff_files(diffs: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    kind = diffs.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            rows = [(k, *r) for k, t in zip(frame[key], frame[text]) for r in diff_paths(t or "", strict)]
            yield pd.DataFrame(rows, columns=[key, "path", "old_path", "kind"])

    return diffs.select(key, text).mapInPandas(run, f"{key} {kind}, {DIFF_SCHEMA}")


def ignore_rules(text: str, base: str = "") -> list[dict]:
    """Rules of one ignore file, in order."""
    rules = []
    for raw in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", raw)
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        anchored, line = line.startswith("/"), line.removeprefix("/")
        folder, line = line.endswith("/"), line.rstrip("/")
        if line:
            rules.append({"base": base.strip("/"), "pattern": line, "negated": negated, "anchored": anchored, "folder": folder})
    return rules


def _glob(pattern: str, any_character: str) -> str:
    """A file glob as a regular expression; * and ? stand for `any_character`."""

    def put(m: re.Match) -> str:
        if m["set"]:
            inner = m["set"].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            return f"(?={any_character})[" + ("^" if m["not"] else "") + ("\\" if inner[0] in "^]" else "") + inner + "]"
        return {"*": f"{any_character}*", "?": any_character}.get(m[0][0], re.escape(m[0]))

    return re.sub(r"\[(?P<not>!?)(?P<set>\]?[^\]]*)\]|\*+|.", put, pattern, flags=re.DOTALL)


def rule_regex(rule: dict) -> str:
    """An ignore rule as one regular expression over whole paths.

    A rule with a slash, or anchored by one, is matched against the path below its base; others against any of its
    parts. A folder's rule covers what is in it, any other also what is below a match.
    """
    pattern, base = rule["pattern"], re.escape(rule["base"] + "/") if rule["base"] else ""
    path, part = _glob(pattern, "."), _glob(pattern, "[^/]")
    if pattern.endswith("/**"):
        body = re.escape(pattern[:-3]) + "(?:/.*)?"
    elif rule["folder"]:
        body = rf"(?:{re.escape(pattern)}(?:/.*)?|{path}/.*)" if rule["anchored"] or "/" in pattern else rf"(?:[^/]*/)*{part}/.*"
    elif "/" in pattern:
        body = rf"{path}(?:/.*)?"
    else:
        body = part if rule["anchored"] else rf"(?:[^/]*/)*{part}(?:/.*)?"
    return rf"(?s)^{base}{body}$"


def not_ignored(files: DataFrame, rules: list[dict], column: str = "path") -> DataFrame:
    """Files whose last matching rule, if any, is a negated one; JVM only."""
    verdicts = [F.when(F.regexp_like(F.col(column), F.lit(rule_regex(r))), F.lit(r["negated"])) for r in reversed(rules)]
    return files.filter(F.coalesce(*verdicts, F.lit(True)))


def selected(files: DataFrame, includes: list[str], excludes: list[str], column: str = "path") -> DataFrame:
    """Files under any include and under no exclude; JVM only."""
    under = lambda roots: F.exists(F.array(*[F.lit(r) for r in roots]).cast("array<string>"), lambda r: (F.col(column) == r) | F.startswith(F.col(column), F.concat(r, F.lit("/"))))
    return files.filter(under(includes) & ~under(excludes))


def select_slice(store: DataFrame, locators: list[str], max_records: int = 1000, max_bytes: int = 8 << 20, column: str = "locator") -> DataFrame:
    """Records of some locators by a filter that reaches the scan; over its limits it fails, it never cuts."""
    rows = store.filter(F.col(column).isin(locators))
    size = F.octet_length(F.to_json(F.struct(*store.columns)))
    seen = rows.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    if seen.n > max_records or (seen.b or 0) > max_bytes:
        raise ValueError(f"the slice has {seen.n} records and {seen.b} bytes, over its limits")
    return rows


def owners_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The package that owns each path: the nearest root above it."""
    return nearest_scope(paths, roots)


def augmented(pages: DataFrame, sources: DataFrame, owners: DataFrame, file_bytes: int = 1 << 20, total_bytes: int = 16 << 20) -> DataFrame:
    """Module pages with their source text, fenced, after their own; sources over a limit fail."""
    joined = owners.select("path", "source_path").join(sources.select(F.col("path").alias("source_path"), F.col("content").alias("code")), "source_path")
    size = joined.agg(F.max(F.octet_length("code")).alias("m"), F.sum(F.octet_length("code")).alias("s")).first()
    if (size.m or 0) > file_bytes or (size.s or 0) > total_bytes:
        raise ValueError("source text over its limits")
    fenced = F.concat(F.col("content"), F.lit("\n\n```\n"), F.col("code"), F.lit("\n```\n"))
    return pages.join(joined.select("path", "code"), "path", "left").withColumn("content", F.when(F.col("code").isNotNull(), fenced).otherwise(F.col("content"))).drop("code")


def openapi_operations(exports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations, parameters, responses) of API exports (side, document as JSON or YAML)."""
    methods = ("get", "put", "post", "delete", "options", "head", "patch", "trace")

    def rows_of(side, text, what):
        document = json.loads(text) if text.lstrip().startswith("{") else bounded_yaml(text)
        for path, item in sorted((document.get("paths") or {}).items()):
            for method in methods:
                op = item.get(method)
                if not isinstance(op, dict):
                    continue
                if what == "operations":
                    yield side, method.upper(), path, bool((op.get("requestBody") or {}).get("required", False))
                elif what == "parameters":
                    for p in [*item.get("parameters", []), *op.get("parameters", [])]:
                        if "name" in p:
                            yield side, method.upper(), path, p.get("in", "unknown"), p["name"], bool(p.get("required", False))
                else:
                    for code in op.get("responses") or {}:
                        yield side, method.upper(), path, str(code)

    schemas = {
        "operations": "side string, method string, path string, request_required boolean",
        "parameters": "side string, method string, path string, location string, name string, required boolean",
        "responses": "side string, method string, path string, status_code string",
    }

    def table(what):
        def run(frames):
            for frame in frames:
                rows = [r for s, t in zip(frame["side"], frame["document"]) for r in rows_of(s, t, what)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schemas[what].split(", ")])

        return exports.select("side", "document").mapInPandas(run, schemas[what])

    return table("operations"), table("parameters"), table("responses")


def dockerfile(text: str) -> list[tuple[int, str, str, str | None]]:
    """(line, instruction, arguments, stage) of a Dockerfile; continued lines are joined, comments passed over."""
    out, stage, held, first = [], None, "", 0
    for number, line in enumerate(text.splitlines(), 1):
        if line.lstrip().startswith("#") or not (line.strip() or held):
            continue
        first = first or number
        held += line.rstrip().removesuffix("\\") + " " if line.rstrip().endswith("\\") else line
        if line.rstrip().endswith("\\"):
            continue
        word, _, rest = held.strip().partition(" ")
        if word.upper() == "FROM":
            named = re.search(r"\bAS\s+(\S+)", rest, re.IGNORECASE)
            stage = named[1] if named else rest.split()[0] if rest.split() else None
        out.append((first, word.upper(), " ".join(rest.split()), stage))
        held, first = "", 0
    return out


# What tells one kind of infrastructure file from another.
INFRASTRUCTURE = {"kubernetes": ("apiVersion", "kind"), "prometheus": ("scrape_configs",), "grafana": ("datasources",), "promtail": ("clients", "positions"), "loki": ("schema_config",), "envoy": ("static_resources",), "buf": ("version", "lint"), "github-actions": ("on", "jobs"), "compose": ("services",)}


def infrastructure_kind(text: str) -> str | None:
    """The adapter for a YAML text by its top-level keys, read without a YAML parser."""
    keys = {m[1].strip("\"'") for m in re.finditer(r"^([A-Za-z_\"'][\w.\"'-]*)\s*:", text, re.MULTILINE)}
    return next((name for name, need in INFRASTRUCTURE.items() if all(k in keys for k in need)), None)


def infrastructure(files: DataFrame) -> DataFrame:
    """(path, adapter, name, content_hash) of infrastructure files (path, content)."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                adapter = "dockerfile" if re.search(r"(^|/)Dockerfile[^/]*$", path) else infrastructure_kind(content or "")
                if adapter:
                    name = re.search(r"^\s{0,4}name:\s*[\"']?([\w.-]+)", content or "", re.MULTILINE)
                    rows.append((path, adapter, name[1] if name else None))
            yield pd.DataFrame(rows, columns=["path", "adapter", "name"])

    found = files.select("path", "content").mapInPandas(run, "path string, adapter string, name string")
    return found.join(files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash")), "path")


INVENTORY = "path string, language string, kind string, name string, owner string, ordinal int, bases array<string>, params array<struct<name:string,type:string>>, return_type string, decorators array<string>, module string, line int"


def python_declarations(path: str, text: str) -> list[tuple]:
    """Classes, functions, methods, imports and routes of Python source; source that doesn't parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    rows: list[tuple] = []
    seen: dict[tuple, int] = {}

    def add(kind, name, owner, node, bases=(), params=(), returns=None, decorators=(), module=None):
        seen[kind, owner, name] = ordinal = seen.get((kind, owner, name), 0) + 1
        rows.append((path, "python", kind, name, owner, ordinal, list(bases), [{"name": n, "type": t} for n, t in params], returns, list(decorators), module, node.lineno))

    def visit(body, owner):
        for node in body:
            if isinstance(node, ast.ClassDef):
                add("class", node.name, owner, node, [ast.unparse(b) for b in node.bases], decorators=[ast.unparse(d) for d in node.decorator_list])
                visit(node.body, node.name)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                decorators = [ast.unparse(d) for d in node.decorator_list]
                params = [(a.arg, ast.unparse(a.annotation) if a.annotation else None) for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]]
                add("method" if owner else "function", node.name, owner, node, (), params, ast.unparse(node.returns) if node.returns else None, decorators)
                for d in decorators:
                    route = re.match(r"\w+\.(get|put|post|delete|patch|options|head)\(\s*['\"]([^'\"]*)", d)
                    if route:
                        add("route", f"{route[1].upper()} {route[2]}", node.name, node)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    add("import", None, owner, node, module=a.name)
            elif isinstance(node, ast.ImportFrom):
                for a in node.names:
                    add("import", a.name, owner, node, module="." * node.level + (node.module or ""))

    visit(tree.body, None)
    return rows


def python_inventory(files: DataFrame) -> DataFrame:
    """Declarations of Python files (path, content); map-only. Other languages come as inventory JSON."""

    def run(frames):
        for frame in frames:
            rows = [r for p, t in zip(frame["path"], frame["content"]) for r in python_declarations(p, t or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.sub(r"<[^>]*>+", "", INVENTORY).split(", ")])

    return files.select("path", "content").mapInPandas(run, INVENTORY)


def _routers(tree: ast.AST) -> dict[str, str]:
    """Names bound to an application or a router, with the prefix their routes have."""
    prefixes: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and ast.unparse(node.value.func).split(".")[-1] in ("FastAPI", "APIRouter"):
            prefix = next((k.value.value for k in node.value.keywords if k.arg == "prefix" and isinstance(k.value, ast.Constant)), "")
            prefixes |= {t.id: prefix for t in node.targets if isinstance(t, ast.Name)}
    for node in ast.walk(tree):  # app.include_router(router, prefix="/x") in the same file
        if isinstance(node, ast.Call) and ast.unparse(node.func).endswith(".include_router") and node.args and isinstance(node.args[0], ast.Name) and node.args[0].id in prefixes:
            more = next((k.value.value for k in node.keywords if k.arg == "prefix" and isinstance(k.value, ast.Constant)), "")
            prefixes[node.args[0].id] = more + prefixes[node.args[0].id]
    return prefixes


def routes_of(path: str, text: str) -> list[tuple]:
    """(path, method, route, handler, status, response, parameters, line) of route decorators on known routers."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    prefixes, rows = _routers(tree), []
    for node in ast.walk(tree):
        for d in getattr(node, "decorator_list", []) if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else []:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.func.value.id in prefixes and d.args and isinstance(d.args[0], ast.Constant)):
                continue
            options = {k.arg: k.value for k in d.keywords}
            methods = [d.func.attr.upper()] if d.func.attr != "api_route" else [e.value.upper() for e in getattr(options.get("methods"), "elts", [])]
            route = prefixes[d.func.value.id] + str(d.args[0].value)
            within = set(re.findall(r"\{(\w+)", route))
            parameters = [{"name": a.arg, "location": "path" if a.arg in within else "query or body", "type": ast.unparse(a.annotation) if a.annotation else None} for a in [*node.args.args, *node.args.kwonlyargs]]
            status = options.get("status_code")
            response = ast.unparse(options["response_model"]) if "response_model" in options else ast.unparse(node.returns) if node.returns else None
            rows += [(path, m, route, node.name, status.value if isinstance(status, ast.Constant) else 200, response, parameters, node.lineno) for m in methods]
    return rows


ROUTES = "path string, method string, route string, handler string, status int, response string, parameters array<struct<name:string,location:string,type:string>>, line int"


def api_routes(files: DataFrame) -> DataFrame:
    """Routes that Python files (path, content) declare on applications and routers; map-only."""

    def run(frames):
        for frame in frames:
            rows = [r for p, t in zip(frame["path"], frame["content"]) for r in routes_of(p, t or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.sub(r"<[^>]*>+", "", ROUTES).split(", ")])

    return files.select("path", "content").mapInPandas(run, ROUTES)


def bounded_yaml(text: str, most_bytes: int = 1 << 20):
    """The one document of a YAML text as plain JSON values; what `yaml_streams.compose` refuses, and several documents, are errors."""
    documents = compose(text, typed=True, most_bytes=most_bytes)
    if len(documents) > 1:
        raise ValueError("several YAML documents")
    return documents[0] if documents else None


def inventory_json(spark: SparkSession, path: str) -> DataFrame:
    """Inventories other extractors wrote (TypeScript, Go, Rust, Haskell): the same rows, unknown fields ignored."""
    return spark.read.schema(INVENTORY).json(path)


def entry_points(inventory: DataFrame) -> DataFrame:
    """(id, category, file, symbol): routes, command lines, decorated tasks and mains, each once, with a stable id."""
    pick = lambda cond, category: inventory.filter(cond).select(F.lit(category).alias("category"), F.col("path").alias("file"), F.coalesce(F.when(F.col("kind") == "route", F.col("owner")), "name").alias("symbol"))
    decorated = lambda words: F.exists("decorators", lambda d: d.rlike(words))
    rows = pick(F.col("kind") == "route", "api").unionByName(pick((F.col("kind") == "function") & decorated(r"(^|\.)(command|group)(\(|$)"), "cli")).unionByName(pick((F.col("kind") == "function") & decorated(r"(^|\.)(task|job|scheduled)(\(|$)"), "process")).unionByName(pick((F.col("kind") == "function") & (F.col("name") == "main"), "main")).distinct()
    return rows.withColumn("id", F.substring(F.sha2(F.concat_ws("\x1f", "category", "file", "symbol"), 256), 1, 16))


def truncated(text: str, limit: int) -> str:
    return utf8_truncate(text, limit)


def latest_by_place(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest `order`."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("__n = 1").drop("__n")
