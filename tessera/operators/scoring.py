"""Scores, queues, health and budgets."""

from __future__ import annotations

import heapq
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bounds import QUEUE_LIMIT, require_limit
from .graph import shuffled
from .groups import by_group

# What each reason for maintenance weighs.
FRESHNESS_WEIGHT = {"source-missing": 90, "source-changed": 70, "basis-incompatible": 25, "unknown": 5, "nonsemantic-source-change": 0, "current": 0}
LINT_WEIGHT = {"error": 100, "warning": 30, "info": 5}
WORK_WEIGHT = {"open": 40, "other": 10}
UNREACHABLE_WEIGHT, FAN_IN_MOST = 10, 20


def _weights(column, table: dict, default: int):
    out = F.lit(default)
    for key, weight in table.items():
        out = F.when(column == key, weight).otherwise(out)
    return out


def maintenance_queue(pages: DataFrame, work: DataFrame, fresh: DataFrame, issues: DataFrame, metrics: DataFrame, reachable: DataFrame, limit: int = 50) -> DataFrame:
    """Pages by the summed weight of their reasons. Reasons are rows, so each input is scanned once.

    Unknown freshness and fan-in only add to a page that has another reason.
    """
    limit = require_limit(limit, QUEUE_LIMIT)
    page = pages.filter(F.col("kind") != "log").select(F.col("canonical_path").alias("path"), "kind", "source_path")
    state = page.join(fresh.select("path", "state"), "path", "left").select("path", F.coalesce("state", F.lit("unknown")).alias("state"))
    reason = lambda df, code, weight: df.select("path", code.alias("code"), weight.cast("int").alias("weight"))
    primary = reason(state.filter(~F.col("state").isin("current", "unknown", "nonsemantic-source-change")), F.concat(F.lit("freshness:"), "state"), _weights(F.col("state"), FRESHNESS_WEIGHT, 5))
    primary = primary.unionByName(reason(work.filter(F.size("signals") > 0), F.lit("semantic-work"), F.when(F.col("status") == "open", WORK_WEIGHT["open"]).otherwise(WORK_WEIGHT["other"])))
    primary = primary.unionByName(reason(issues, F.concat(F.lit("lint:"), "category"), _weights(F.col("severity"), LINT_WEIGHT, 5)))
    primary = primary.unionByName(reason(reachable.filter(F.col("reachable") == F.lit(False)), F.lit("unreachable"), F.lit(UNREACHABLE_WEIGHT)))
    primary = primary.join(page.select("path"), "path", "left_semi")
    listed = primary.select("path").distinct()
    extra = reason(state.filter(F.col("state").isin("unknown", "nonsemantic-source-change")), F.concat(F.lit("freshness:"), "state"), _weights(F.col("state"), FRESHNESS_WEIGHT, 5))
    fan = page.join(metrics.select("source_path", "fan_in"), "source_path").filter("fan_in > 0")
    extra = extra.unionByName(reason(fan, F.lit("fan-in"), F.least("fan_in", F.lit(FAN_IN_MOST)))).join(listed, "path", "left_semi")
    scored = primary.unionByName(extra).groupBy("path").agg(F.sum("weight").alias("score"), F.array_sort(F.collect_list(F.struct("code", "weight"))).alias("reasons"))
    actionable = issues.select("path").union(state.filter(F.col("state").isin("source-missing", "source-changed")).select("path")).union(work.filter((F.col("status") == "open") & (F.size("signals") > 0)).select("path")).distinct().withColumn("a", F.lit(True))
    rows = scored.join(page, "path").join(actionable, "path", "left").withColumn("classification", F.when(F.col("a"), "actionable").otherwise("informational")).drop("a")
    return rows.withColumn("total", rows.select(F.count("*")).scalar()).orderBy(F.desc("score"), "path").limit(limit)


def health(snapshots: DataFrame, strict: bool = False) -> DataFrame:
    """(id, status, degraded, unhealthy) by ordered rules; strict makes two degrading reasons unhealthy.

    Columns: id, mismatch, availability, snapshot, governance, drift, evaluated, expired_reviews, verification.
    """
    c = F.col
    soft = F.when(c("drift") == "indeterminate", "freshness-indeterminate").when(c("drift") == "nonsemantic-change", "nonsemantic-source-change")
    none = F.lit(None).cast("string")
    unhealthy = F.array_compact(F.array(F.when(c("mismatch"), "source-selection-mismatch"), F.when(c("availability") == "unsupported", "knowledge-unsupported"), F.when(c("snapshot") == "mixed", "mixed-snapshot"), F.when(c("governance") == "invalid", "invalid-governance"), F.when(c("drift") == "stale-confirmed", "stale-confirmed"), soft if strict else none, F.when(c("verification").isin("failed", "invalid", "stale"), F.concat(F.lit("verification-"), "verification"))))
    degraded = F.array_compact(F.array(F.when(c("availability") == "degraded", "knowledge-degraded"), none if strict else soft, F.when(~c("evaluated"), "freshness-unevaluated"), F.when(c("expired_reviews") > 0, "expired-reviews")))
    absent = c("availability") == "absent"
    empty = F.array().cast("array<string>")
    out = snapshots.select("id", F.when(absent, F.when(c("mismatch"), F.array(F.lit("source-selection-mismatch"))).otherwise(empty)).otherwise(unhealthy).alias("unhealthy"), F.when(absent, empty).otherwise(degraded).alias("degraded"), absent.alias("absent"))
    status = F.when(F.size("unhealthy") > 0, "unhealthy").when(F.col("absent"), "absent").when(F.size("degraded") > 0, "degraded").otherwise("healthy")
    return out.select("id", status.alias("status"), "degraded", "unhealthy")


def worklist(signals: DataFrame, centrality: DataFrame, p1_budget: int = 20) -> DataFrame:
    """Documentation work by priority, then centrality; P1 items over the budget wait.

    signals: path, signal, priority (P0, P1, P2). A path takes its most urgent priority.
    """
    per = signals.groupBy("path").agg(F.min("priority").alias("priority"), F.array_sort(F.collect_set("signal")).alias("signals"))
    scored = per.join(centrality.select("path", "score"), "path", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("priority").orderBy(F.desc("score"), "path"))
    return scored.withColumn("place", place).withColumn("deferred", (F.col("priority") == "P1") & (F.col("place") > p1_budget)).orderBy("priority", "place")


def context_priority(files: DataFrame, changed: DataFrame, edges: DataFrame, focus: DataFrame) -> DataFrame:
    """high for changed files and the focus, medium for import neighbours of these, low for others."""
    high = changed.select("path").union(focus.select("path")).distinct()
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))
    medium = ends.join(high, F.col("a") == F.col("path"), "left_semi").select(F.col("b").alias("path")).distinct()
    marked = files.select("path").join(high.withColumn("h", F.lit(1)), "path", "left").join(medium.withColumn("m", F.lit(1)), "path", "left")
    return marked.select("path", F.when(F.col("h") == 1, "high").when(F.col("m") == 1, "medium").otherwise("low").alias("priority"))


LEVELS = ("deep", "slim", "summary")


def fit_sources(entries: list[dict], budget_bytes: int, fixed: int = 0) -> list[dict]:
    """Keeps a list of sources under a byte budget: the last one is demoted a level, then dropped, again and again.

    entries: path, priority, detail and one text per level. The size is that of the whole encoding after each step.
    """
    kept = [dict(e) for e in entries]

    def size() -> int:
        return fixed + len(json.dumps({e["path"]: e[e["detail"]] for e in kept}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode())

    while kept and size() > budget_bytes:
        last = kept[-1]
        if last["detail"] == LEVELS[-1]:
            kept.pop()
        else:
            last["detail"] = LEVELS[LEVELS.index(last["detail"]) + 1]
    return kept


def fit_requests(entries: DataFrame, budgets: DataFrame) -> DataFrame:
    """Greedy fits of many requests at once, each in its own group.

    entries: request, path, place, priority, detail, deep, slim, summary, fresh (rank, lower is fresher);
    budgets: request, tokens. Within a priority fresher sources come first.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        order = {"high": 0, "medium": 1, "low": 2}
        rows = sorted(frame.to_dict("records"), key=lambda r: (order.get(r["priority"], 2), r["fresh"], r["place"]))
        kept = {e["path"]: e["detail"] for e in fit_sources(rows, int(rows[0]["tokens"]) * 4)}
        return pd.DataFrame([(r["request"], r["path"], kept.get(r["path"]), r["path"] not in kept) for r in rows], columns=["request", "path", "detail", "omitted"])

    return entries.join(budgets, "request").groupBy("request").applyInPandas(run, "request string, path string, detail string, omitted boolean")


PRIORITIES = {"high": 0, "medium": 1, "low": 2}
# At equal rank the higher gives way first.
_DROP, _CONCEPT, _DEMOTE, _RELATION = 2, 3, 4, 5


class JointFit:
    """One budget over sources, concepts and relations, in steps that each cost the logarithm of what is left.

    Every item that can give way is in a heap under its rank (priority, freshness, kind, place); entries that no longer
    hold are passed over when they come up. The size is that of the whole encoding, kept up to date item by item.
    """

    def __init__(self, sources: list[dict], concepts: list[dict], relations: list[dict]):
        self.sources, self.concepts, self.relations = [dict(s) for s in sources], list(concepts), list(relations)
        self.rank = {s["path"]: (PRIORITIES.get(s["priority"], 2), s.get("fresh") or 0) for s in sources}
        of = lambda c: self.rank.get(c["source_path"], (2, 0))
        self.best = min(range(len(concepts)), key=lambda k: (of(concepts[k]), concepts[k]["locator"]), default=None)
        self.required = {min(self.sources, key=lambda s: (self.rank[s["path"]], s["path"]))["path"]} if sources else set()
        if self.best is not None:
            self.required.add(concepts[self.best]["source_path"])
        self.where = {c["locator"]: k for k, c in enumerate(concepts)}
        self.kept = {"s": set(range(len(sources))), "c": set(range(len(concepts))), "r": set(range(len(relations)))}
        self.bytes = {"s": [self._source(s) for s in self.sources], "c": [_encoded(c["locator"]) for c in concepts], "r": [_encoded(r) for r in relations]}
        self.size = len('{"c": [], "r": [], "s": {}}') + sum(map(sum, self.bytes.values())) + sum(2 * max(0, len(x) - 1) for x in self.kept.values())
        self.incident: dict[int, list[int]] = {}
        for k, r in enumerate(relations):
            for end in {self.where.get(r["from"]), self.where.get(r["to"])} - {None}:
                self.incident.setdefault(end, []).append(k)
        self.heap: list[tuple] = []
        for k in range(len(self.sources)):
            self._offer_source(k)
        for k, c in enumerate(concepts):
            if k != self.best:
                self._offer((*of(c), _CONCEPT, k))
        for k in range(len(relations)):
            self._offer(self._relation(k))

    @staticmethod
    def _source(s: dict) -> int:
        return _encoded(s["path"]) + 2 + _encoded(s[s["detail"]])

    def _offer(self, key: tuple) -> None:
        heapq.heappush(self.heap, tuple(-x for x in key))

    def _offer_source(self, k: int) -> None:
        s = self.sources[k]
        if s["detail"] != LEVELS[-1]:
            self._offer((*self.rank[s["path"]], _DEMOTE, k))
        elif s["path"] not in self.required:
            self._offer((*self.rank[s["path"]], _DROP, k))

    def _relation(self, k: int) -> tuple:
        ends = {self.where.get(self.relations[k][x]) for x in ("from", "to")} & self.kept["c"]
        return (*min((self.rank.get(self.concepts[e]["source_path"], (2, 0)) for e in ends), default=(3, 1)), _RELATION, k)

    def _remove(self, what: str, k: int) -> None:
        self.kept[what].discard(k)
        self.size -= self.bytes[what][k] + (2 if self.kept[what] else 0)

    def step(self) -> bool:
        """Lets the lowest-ranked item give way; False if nothing may."""
        while self.heap:
            key = tuple(-x for x in heapq.heappop(self.heap))
            kind, k = key[2:]
            if kind == _RELATION:
                if k not in self.kept["r"] or self._relation(k) != key:
                    continue
                self._remove("r", k)
            elif kind == _CONCEPT:
                self._remove("c", k)
                for r in self.incident.get(k, []):
                    if r in self.kept["r"]:
                        if {self.where.get(self.relations[r][x]) for x in ("from", "to")} & self.kept["c"]:
                            self._offer(self._relation(r))
                        else:
                            self._remove("r", r)
            elif kind == _DEMOTE:
                s = self.sources[k]
                s["detail"] = LEVELS[LEVELS.index(s["detail"]) + 1]
                self.size += self._source(s) - self.bytes["s"][k]
                self.bytes["s"][k] = self._source(s)
                self._offer_source(k)
            else:
                self._remove("s", k)
            return True
        return False

    def fit(self, budget_bytes: int) -> bool:
        """Whether what is left fits; otherwise nothing does."""
        while self.size > budget_bytes:
            if not self.step():
                return False
        return True


def _encoded(value) -> int:
    return len(json.dumps(value, ensure_ascii=False, sort_keys=True).encode())


def fit_joint(sources: list[dict], concepts: list[dict], relations: list[dict], budget_bytes: int) -> dict[str, list]:
    """One budget over sources, concepts and relations. The lowest-ranked choice yields first: relations, then
    source detail, concepts, whole sources. The best source and best concept, with its source, always stay; a relation
    goes with the last of its concepts. {} where even those don't fit."""
    fit = JointFit(sources, concepts, relations)
    if not fit.fit(budget_bytes):
        return {}
    return {name: [all_[k] for k in sorted(fit.kept[x])] for name, x, all_ in (("sources", "s", fit.sources), ("concepts", "c", fit.concepts), ("relations", "r", fit.relations))}


def fit_joint_requests(entries: DataFrame, budgets: DataFrame) -> DataFrame:
    """(request, kind, item, detail, omitted) of many requests, each in its own group.

    entries: request, kind (source, concept, relation), item (path, locator or key), place, priority, fresh (lower is
    fresher), detail, deep, slim, summary, source_path, from, to; budgets: request, tokens of four bytes. Where a request's
    best source and concept don't fit, everything is omitted.
    """

    def run(rows: list[dict]) -> list[tuple]:
        of = lambda kind: [r for r in rows if r["kind"] == kind]
        sources = [{"path": r["item"]} | {c: r[c] for c in ("priority", "fresh", "detail", *LEVELS)} for r in of("source")]
        concepts = [{"locator": r["item"], "source_path": r["source_path"]} for r in of("concept")]
        relations = [{"key": r["item"], "from": r["from"], "to": r["to"]} for r in of("relation")]
        left = fit_joint(sources, concepts, relations, int(rows[0]["tokens"]) * 4)
        detail = {("source", s["path"]): s["detail"] for s in left.get("sources", [])} | {("concept", c["locator"]): None for c in left.get("concepts", [])} | {("relation", r["key"]): None for r in left.get("relations", [])}
        return [(r["request"], r["kind"], r["item"], detail.get((r["kind"], r["item"])), (r["kind"], r["item"]) not in detail) for r in rows]

    kind = entries.schema["request"].dataType.simpleString()
    return by_group(entries.join(shuffled(budgets), "request"), "request", ["place"], run, f"request {kind}, kind string, item string, detail string, omitted boolean")
