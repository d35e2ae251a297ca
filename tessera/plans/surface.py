"""The ten named query operations over one set of frames, and the plug-in points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import declarations, diffs, graph, relationships
from ..operators.bounds import bounded_per, clamp_limit
from ..sources import readers

COST = {"explain": "snapshot-index-only", "concept": "snapshot-index-only", "related": "snapshot-index-only", "surface": "snapshot-index-only", "typed": "snapshot-index-only", "symbol": "full-inventory", "entrypoint": "full-inventory", "flow-segment": "full-inventory", "dependency": "full-inventory", "impact": "targeted-extraction"}
COMPONENTS = ("extractor", "lint_rule", "entrypoint_detector", "diagram_style", "prompt_template", "skill")


class Plugins:
    """Functions of a caller's own, by component type: an extractor maps files to inventory rows, a lint rule
    maps the wiki's frames to issues, a detector maps an inventory to entry points."""

    def __init__(self):
        self.components: dict[str, dict[str, Callable]] = {c: {} for c in COMPONENTS}

    def register(self, component: str, name: str, function: Callable) -> None:
        if component not in self.components:
            raise ValueError(f"component must be one of {COMPONENTS}")
        if name in self.components[component]:
            raise ValueError(f"{component} {name} is registered already")
        self.components[component][name] = function


class Frames(dict):
    """Frames by name; one given as a function is made when it is first read."""

    def __getitem__(self, name: str) -> DataFrame:
        if not isinstance(found := super().__getitem__(name), DataFrame):
            self[name] = found = found()
        return found

    def get(self, name: str, default: DataFrame | None = None) -> DataFrame | None:
        return self[name] if name in self else default


class Knowledge:
    """Frames by name (concepts, relationships, surface, graph_edges, callables, edges, starts, dependencies,
    recorded, live, sources, declared, inventory); an operation needs those it reads, and makes no others."""

    def __init__(self, **frames: DataFrame | Callable[[], DataFrame]):
        self.frames = Frames(frames)

    def query(self, operation: str, value: str | None = None, limit: int = 20, **options):
        if operation not in COST:
            raise ValueError(f"operation must be one of {sorted(COST)}")
        return getattr(self, "_" + operation.replace("-", "_"))(value, clamp_limit(limit), **options)

    def _explain(self, value, limit):
        states = diffs.freshness(self.frames["recorded"], self.frames.get("live"), self.frames["sources"])
        return self.frames["recorded"].join(states, "locator").filter(F.col("locator") == value).limit(limit)

    def _concept(self, value, limit):
        c = self.frames["concepts"]
        coordinates = [x for x in ("locator", "uid", "natural_key", "canonical_path") if x in c.columns]
        match = F.lit(False)
        for x in coordinates:
            match = match | (F.col(x) == value)
        return c.filter(match).limit(limit)

    def _related(self, value, limit, direction="both", kinds=None):
        return graph.incident(self.frames["relationships"], value, direction, kinds, limit=limit)

    def _surface(self, value, limit, kinds=None):
        pages = self.frames["surface"]
        pages = pages if kinds is None else pages.filter(F.col("kind").isin(kinds))
        pages = pages if value is None else pages.filter((F.col("canonical_path") == value) | (F.col("source_path") == value))
        return pages.orderBy("canonical_path").limit(limit)

    def _typed(self, value, limit, **filters):
        return graph.incident(self.frames["graph_edges"], value, limit=limit, **filters)

    def _symbol(self, value, limit):
        callers = graph.call_neighbors(self.frames["callables"], self.frames["edges"], value, "callers", limit).withColumn("relation", F.lit("caller"))
        callees = graph.call_neighbors(self.frames["callables"], self.frames["edges"], value, "callees", limit).withColumn("relation", F.lit("callee"))
        pages = self.frames["surface"].filter(F.col("source_path") == value.rpartition(":")[0]).select(F.col("canonical_path").alias("file"), F.lit(None).cast("string").alias("symbol"), F.lit("page").alias("kind"), F.lit(1).cast("bigint").alias("calls"), F.lit(None).cast("bigint").alias("total"), F.lit("page").alias("relation"))
        pages = pages.withColumn("total", pages.select(F.count("*")).scalar())
        return callers.unionByName(callees).unionByName(pages)

    def _entrypoint(self, value, limit):
        start = self.frames["starts"].filter(F.col("flow_id") == value)
        return graph.overview(graph.traces(start, self.frames["edges"]), min(limit, graph.STEP_LIMIT))

    def _flow_segment(self, value, limit, offset=0):
        return graph.segment(self.frames["callables"], self.frames["edges"], value, limit, offset)

    def _dependency(self, value, limit):
        near = graph.neighborhood(self.frames["dependencies"], value)
        return near.join(graph.shuffled(graph.degrees(self.frames["dependencies"])), F.col("neighbor") == F.col("node"), "left").drop("node").orderBy("direction", "neighbor").limit(limit)

    def _impact(self, value, limit, changed: DataFrame | None = None, patch: str | None = None):
        """All sections a change set (paths, or a unified diff) reaches, each up to the limit, and their identity."""
        if patch is not None:
            named = {(p,) for path, old, _ in readers.diff_paths(patch) for p in (path, old) if p}
            changed = self.frames["surface"].sparkSession.createDataFrame(sorted(named), "path string")
        pages = relationships.affected_pages(self.frames["inventory"], self.frames["surface"], self.frames["declared"])
        nothing = lambda columns: changed.limit(0).select(*[F.col("path").alias(c) for c in columns])
        given = lambda name, *columns: self.frames[name] if name in self.frames else nothing(columns)
        rows = declarations.impact(changed, pages, given("dependencies", "src", "dst"), given("operations", "handler", "operation"), given("findings", "path", "rule"), self.frames.get("concepts"), self.frames.get("graph_edges"))
        return bounded_per(rows, ["section"], [F.lower("item"), F.col("item")], limit)
