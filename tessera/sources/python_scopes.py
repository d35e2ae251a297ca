"""Facts about names in Python files: a scope tree with intervals, the bindings of each scope, and the calls with their arguments.

One pass over a file's syntax tree; map-only. What a name means is settled by joins over these rows (operators/scopes.py).
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame

ARGUMENT = "struct<position:int,keyword:string,text:string,root:string>"
PARAMETER = "struct<name:string,kind:string,defaulted:boolean>"
FACTS = (
    "path string, fact string, scope int, parent int, chain array<int>, name string, symbol string, what string, module string, member string, expression string,"
    f" plain boolean, line int, col int, opens int, closes int, arguments array<{ARGUMENT}>, parameters array<{PARAMETER}>"
)
COLUMNS = ["path", "fact", "scope", "parent", "chain", "name", "symbol", "what", "module", "member", "expression", "plain", "line", "col", "opens", "closes", "arguments", "parameters"]
#: Rows that are sent together.
SENT = 20_000
#: Methods that decide what an attribute or a construction gives, so that a class's own methods don't.
DISPATCH = {"__new__", "__getattribute__", "__getattr__", "__call__", "__init_subclass__", "__class_getitem__"}


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a name or a chain of attributes on one."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def absolute_module(path: str, level: int, module: str) -> str:
    """The module that `from ..module` names in a file, dotted from the root."""
    if not level:
        return module
    package = path.split("/")[:-1]
    package = package[: len(package) - (level - 1)] if level > 1 else package
    return ".".join([*package, *([module] if module else [])])


class _Scope:
    def __init__(self, number: int, parent: _Scope | None, kind: str, symbol: str, opens: int):
        self.number, self.parent, self.kind, self.symbol, self.opens = number, parent, kind, symbol, opens
        self.closes, self.elsewhere = opens, {}
        # A class's names are seen in its own body only.
        outer = [s for s in (parent.seen if parent else []) if s.kind != "class"]
        self.seen = [self, *outer]

    @property
    def prefix(self) -> str:
        return {"module": "", "class": f"{self.symbol}."}.get(self.kind, f"{self.symbol}.<locals>.")


class _Reader(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.rows, self.ticks, self.scopes = path, [], 0, []
        self.now: _Scope = None

    def row(self, fact: str, scope: _Scope, **more) -> None:
        self.rows.append({"path": self.path, "fact": fact, "scope": scope.number, **more})

    def tick(self) -> int:
        self.ticks += 1
        return self.ticks

    def enter(self, kind: str, symbol: str) -> _Scope:
        new = _Scope(len(self.scopes), self.now, kind, symbol, self.tick())
        self.scopes.append(new)
        self.now = new
        return new

    def leave(self) -> None:
        self.now.closes = self.tick()
        self.now = self.now.parent

    def bind(self, name: str, what: str, line: int, scope: _Scope | None = None, **more) -> None:
        scope = scope or self.now
        where = scope.elsewhere.get(name)
        if where == "global":
            scope = self.scopes[0]
        elif where == "nonlocal":
            outer = [s for s in scope.seen[1:] if s.kind not in ("class", "module")]
            scope = next((s for s in outer if any(r["fact"] == "binding" and r["scope"] == s.number and r["name"] == name for r in self.rows)), outer[0] if outer else scope)
        self.row("binding", scope, name=name, what=what, line=line, **more)

    def read(self, tree: ast.Module) -> list[dict]:
        self.enter("module", "<module>")
        self.visit_all(tree.body)
        self.leave()
        for s in self.scopes:
            self.row("scope", s, parent=s.parent.number if s.parent else None, what=s.kind, symbol=s.symbol, chain=[x.number for x in s.seen], opens=s.opens, closes=s.closes)
        return self.rows

    def visit_all(self, nodes) -> None:
        for node in nodes:
            if node is not None:
                self.visit(node)

    def function(self, node, symbol: str, owner: str | None) -> None:
        a = node.args
        self.visit_all([*a.defaults, *a.kw_defaults])
        self.enter("function", symbol)
        plain = [*a.posonlyargs, *a.args]
        for k, p in enumerate([*plain, *filter(None, [a.vararg]), *a.kwonlyargs, *filter(None, [a.kwarg])]):
            receiver = owner is not None and k == 0 and plain
            self.bind(p.arg, "receiver" if receiver else "parameter", p.lineno, symbol=owner if receiver else None)
        body = node.body if isinstance(node.body, list) else [node.body]
        self.declare(body)
        self.visit_all(body)
        self.leave()

    def declare(self, body: list) -> None:
        """`global` and `nonlocal` hold for a whole function, so they are read first."""
        waiting = list(body)
        while waiting:
            node = waiting.pop()
            if isinstance(node, (ast.Global, ast.Nonlocal)):
                self.now.elsewhere |= dict.fromkeys(node.names, "global" if isinstance(node, ast.Global) else "nonlocal")
            elif not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                waiting.extend(ast.iter_child_nodes(node))

    @staticmethod
    def parameters(a: ast.arguments, bound: bool) -> list[dict]:
        plain = [*a.posonlyargs, *a.args]
        out = [{"name": p.arg, "kind": "positional", "defaulted": k >= len(plain) - len(a.defaults)} for k, p in enumerate(plain)]
        out += [{"name": a.vararg.arg, "kind": "rest", "defaulted": True}] if a.vararg else []
        out += [{"name": p.arg, "kind": "keyword", "defaulted": d is not None} for p, d in zip(a.kwonlyargs, a.kw_defaults)]
        out += [{"name": a.kwarg.arg, "kind": "keywords", "defaulted": True}] if a.kwarg else []
        return out[1:] if bound and plain else out

    def visit_FunctionDef(self, node) -> None:
        self.visit_all(node.decorator_list)
        symbol = self.now.prefix + node.name
        within = self.now.symbol if self.now.kind == "class" else None
        static = any(dotted(d) == "staticmethod" for d in node.decorator_list)
        bound = within is not None and not static
        self.bind(node.name, "function", node.lineno, symbol=symbol, parameters=self.parameters(node.args, bound), plain=not node.decorator_list or static)
        self.function(node, symbol, within if bound else None)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node) -> None:
        self.function(node, f"{self.now.prefix}<lambda>", None)

    def visit_ClassDef(self, node) -> None:
        self.visit_all([*node.decorator_list, *node.bases, *[k.value for k in node.keywords]])
        symbol = self.now.prefix + node.name
        own = {m.name for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))}
        usual = not node.decorator_list and not node.keywords and all(dotted(b) == "object" for b in node.bases) and not own & DISPATCH
        first = next((m for m in node.body if isinstance(m, ast.FunctionDef) and m.name == "__init__"), None)
        self.bind(node.name, "class", node.lineno, symbol=symbol, plain=usual, parameters=self.parameters(first.args, True) if first else [])
        self.enter("class", symbol)
        self.visit_all(node.body)
        self.leave()

    def comprehension(self, node) -> None:
        self.visit(node.generators[0].iter)
        self.enter("comprehension", self.now.symbol)
        for k, g in enumerate(node.generators):
            self.visit_all([g.target, *([g.iter] if k else []), *g.ifs])
        self.visit_all([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])
        self.leave()

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = comprehension

    def visit_NamedExpr(self, node) -> None:
        scope = self.now
        while scope.kind == "comprehension":
            scope = scope.parent
        self.bind(node.target.id, "value", node.lineno, scope)
        self.visit(node.value)

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.bind(a.asname or a.name.split(".")[0], "import", node.lineno, module=a.name, plain=a.asname is None)

    def visit_ImportFrom(self, node) -> None:
        for a in node.names:
            self.bind(a.asname or a.name, "import", node.lineno, module=absolute_module(self.path, node.level, node.module or ""), member=a.name, plain=False)

    def visit_Assign(self, node) -> None:
        self.visit(node.value)
        made = dotted(node.value.func) if isinstance(node.value, ast.Call) else None
        for t in node.targets:
            if isinstance(t, ast.Name):
                self.bind(t.id, "value", node.lineno, expression=made)
            else:
                self.visit(t)

    def visit_AnnAssign(self, node) -> None:
        if node.value is not None:
            self.visit_Assign(ast.copy_location(ast.Assign([node.target], node.value), node))
        elif isinstance(node.target, ast.Name):
            self.bind(node.target.id, "value", node.lineno)

    def visit_Name(self, node) -> None:
        if isinstance(node.ctx, (ast.Store, ast.Del)):
            self.bind(node.id, "value", node.lineno)

    def visit_Attribute(self, node) -> None:
        if isinstance(node.ctx, ast.Store) and isinstance(node.value, ast.Name):
            held = next((s for s in self.now.seen if s.kind == "function" and s.parent.kind == "class" and any(r["scope"] == s.number and r.get("what") == "receiver" and r["name"] == node.value.id for r in self.rows)), None)
            if held is not None:
                self.row("binding", held.parent, name=node.attr, what="attribute", line=node.lineno)
        self.visit(node.value)

    def visit_ExceptHandler(self, node) -> None:
        if node.name:
            self.bind(node.name, "value", node.lineno)
        self.generic_visit(node)

    def visit_MatchAs(self, node) -> None:
        if node.name:
            self.bind(node.name, "value", node.lineno)
        self.generic_visit(node)

    visit_MatchStar = visit_MatchAs

    def visit_MatchMapping(self, node) -> None:
        if node.rest:
            self.bind(node.rest, "value", node.lineno)
        self.generic_visit(node)

    def visit_Call(self, node) -> None:
        root = lambda v: (dotted(v) or "").split(".")[0] or None
        given = [{"position": k, "keyword": "*" if isinstance(v, ast.Starred) else None, "text": ast.unparse(v), "root": root(v)} for k, v in enumerate(node.args)]
        given += [{"position": None, "keyword": k.arg or "**", "text": ast.unparse(k.value), "root": root(k.value)} for k in node.keywords]
        self.row("call", self.now, symbol=self.now.symbol, chain=[s.number for s in self.now.seen], expression=dotted(node.func), line=node.lineno, col=node.col_offset, opens=self.tick(), arguments=given)
        self.generic_visit(node)


def scope_facts(path: str, text: str) -> list[dict]:
    """All facts of a file; one row `error` where it can't be parsed."""
    try:
        return _Reader(path).read(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError) as wrong:
        return [{"path": path, "fact": "error", "scope": 0, "name": type(wrong).__name__}]


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of Python files (path, content): rows `scope`, `binding`, `call` and `error`."""

    def table(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([[r.get(c) for c in COLUMNS] for r in rows], columns=COLUMNS).astype({c: "Int64" for c in ("scope", "parent", "line", "col", "opens", "closes")})

    def run(frames):
        for frame in frames:
            held: list[dict] = []
            for path, text in zip(frame["path"], frame["content"]):
                held += scope_facts(path, text or "")
                if len(held) >= SENT:
                    yield table(held)
                    held = []
            yield table(held)

    # A small table's few row groups would leave all the parsing to as few tasks, and so would partitions that are
    # coalesced by their bytes: what parsing costs isn't seen in them. A number that is given is kept.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "content").repartition(tasks, "path").mapInPandas(run, FACTS)
