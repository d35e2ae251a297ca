"""Publication: what changes of the architecture mean for public topics, which reviews still hold, and whether a wiki can go out.

Topics, their inputs and targets meet as two sides by full outer joins. A finding's review basis is a digest of all that
a reviewer looked at, so a decision holds as long as nothing of it changes, and reopens by itself when something does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest
from .diffs import glob_regex
from .graph import checkpointed

# Folders that are never public, endings of pages that aren't checked and of images.
PRIVATE = (".git", ".hg", ".svn", "node_modules", "__pycache__")
OTHER_PAGES = r"(?i)\.(markdown|textile|rst|rdoc|org|mediawiki|asciidoc)$"
IMAGES = r"(?i)\.(png|jpe?g|gif|svg|webp|avif|apng|bmp|ico)$"


def _sides(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of both sides by key: old_ and new_ values, and whether each side has the key."""
    of = lambda side, x: df.filter(F.col("side") == side).select(*keys, *[F.col(v).alias(f"{x}_{v}") for v in values], F.lit(True).alias(f"in_{x}"))
    return of("baseline", "old").join(of("candidate", "new"), keys, "full_outer")


def topic_findings(topics: DataFrame, inputs: DataFrame, pages: DataFrame, targets: DataFrame, settings: DataFrame) -> DataFrame:
    """(topic, status, owner, retired, reasons, review_basis) of the topics that anything has happened to.

    All frames have `side`, baseline or candidate. topics: topic, owner, wiki_page, anchor, edit_at; inputs: topic, dependency,
    page (of the architecture, or null), hash (null where it can't be had); pages: path, uid; targets: topic, state (available,
    missing, unresolved-anchor), hash; settings: one row a side: release_tag, source_policy, destination. `reasons` is sorted.
    Without a baseline every topic awaits its first review.
    """
    fields = ["owner", "wiki_page", "anchor", "edit_at"]
    both = _sides(topics, ["topic"], fields)
    retired = F.col("in_new").isNull()
    same = lambda *names: F.lit(True) if not names else F.forall(F.array(*[F.col(f"old_{n}").eqNullSafe(F.col(f"new_{n}")) for n in names]), lambda x: x)
    bound = inputs.filter("page IS NOT NULL").select("side", "topic", "page").distinct()
    shape = inputs.groupBy("side", "topic").agg(F.array_sort(F.collect_set("dependency")).alias("dependencies"))
    shapes = _sides(shape, ["topic"], ["dependencies"]).drop("in_old", "in_new")
    row = lambda df, reason: df.select("topic", reason.alias("reason"))
    text = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    # Pages that a topic was bound to and that have moved since; one that it still names is an outdated binding.
    uid = lambda side, x: pages.filter((F.col("side") == side) & F.col("uid").isNotNull()).select("uid", F.col("path").alias(x))
    moved = uid("baseline", "page").join(uid("candidate", "moved_to"), "uid").filter("page <> moved_to")
    led = bound.filter("side = 'baseline'").join(moved, "page").select("topic", "page", "moved_to")
    reasons = row(led, text("architecture-page-moved", F.col("page"), F.col("moved_to")))
    outdated = led.join(bound.filter("side = 'candidate'").select("topic", "page"), ["topic", "page"], "left_semi").select("topic", F.lit(True).alias("outdated")).distinct()
    mapped = both.join(shapes, "topic", "left")
    changed = F.when(retired, "mapping-retired").when(F.col("in_old").isNull(), "initial-review").when(~same(*fields, "dependencies"), "mapping-changed")
    reasons = reasons.unionByName(row(mapped, changed))
    ins = _sides(inputs.groupBy("side", "topic", "dependency").agg(F.max("hash").alias("hash")), ["topic", "dependency"], ["hash"])
    differs = ~(F.col("old_hash").eqNullSafe(F.col("new_hash")) & F.col("in_old").eqNullSafe(F.col("in_new")))
    reasons = reasons.unionByName(row(ins.filter(differs), text("dependency-changed", F.col("dependency"))))
    # What a topic rests on now; one that is gone rests on what it had.
    live = both.select("topic", retired.alias("gone"))
    now = ins.join(live, "topic").filter(F.when(F.col("gone"), F.col("in_old")).otherwise(F.col("in_new"))).select("topic", "dependency", F.when(F.col("gone"), F.col("old_hash")).otherwise(F.col("new_hash")).alias("hash"))
    lacking = now.filter("hash IS NULL").select("topic", "dependency")
    reasons = reasons.unionByName(row(lacking, text("evidence-unavailable", F.col("dependency"))))
    at = _sides(targets, ["topic"], ["state", "hash"]).drop("in_old", "in_new")
    goal = both.select("topic", "in_old").join(at, "topic", "left").withColumn("state", F.coalesce("new_state", F.lit("not-evaluated")))
    reasons = reasons.unionByName(row(goal.filter(F.col("state").isin("missing", "unresolved-anchor")), text("target", F.col("state"))))
    other = ~(F.coalesce("old_state", F.lit("not-evaluated")).eqNullSafe(F.col("state")) & F.col("old_hash").eqNullSafe(F.col("new_hash")))
    setting = {r.side: r for r in settings.collect()}  # one row a side
    here, before = setting.get("candidate"), setting.get("baseline")
    if before is not None:
        reasons = reasons.unionByName(row(goal.filter(other), F.lit("target-changed")))
        if here is not None and here.release_tag != before.release_tag:
            reasons = reasons.unionByName(row(goal, F.lit("release-tag-changed")))
    told = reasons.filter("reason IS NOT NULL").groupBy("topic").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x1c"))
    rests = now.groupBy("topic").agg(F.array_sort(F.collect_list(F.concat_ws("\x1e", "dependency", part("hash")))).alias("rests"))
    mine = both.select("topic", retired.alias("retired"), *[F.when(retired, F.col(f"old_{f}")).otherwise(F.col(f"new_{f}")).alias(f) for f in fields])
    j = mine.join(told, "topic").join(rests, "topic", "left").join(goal.select("topic", "state", F.col("new_hash").alias("target_hash")), "topic").join(outdated, "topic", "left").join(lacking.select("topic", F.lit(True).alias("lacking")).distinct(), "topic", "left")
    scope = [F.lit("\x1c" if here is None or here[x] is None else here[x]) for x in ("source_policy", "release_tag", "destination")]
    basis = digest(F.concat_ws("\x1f", "topic", *[part(f) for f in fields], F.concat_ws("\x1d", F.coalesce("rests", F.array().cast("array<string>"))), "state", part("target_hash"), *scope))
    incomplete = ~F.col("retired") & (F.coalesce("outdated", F.lit(False)) | F.coalesce("lacking", F.lit(False)) | (F.col("state") == "unresolved-anchor"))
    return j.select("topic", F.when(incomplete, "incomplete").otherwise("needs-review").alias("status"), "owner", "retired", "state", "reasons", basis.alias("review_basis"))


def reviewed_findings(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with their status after the decisions (topic, owner, decision, review_basis) that hold.

    A decision holds for the basis, the owner and the kind of finding it was made for: `retired` for a topic that is gone,
    `still-current` for one whose target is available. An incomplete finding can't be decided.
    """
    findings = findings.withColumn("due", F.when(F.col("retired"), "retired").otherwise("still-current"))
    held = reviews.select("topic", "owner", F.col("decision").alias("due"), "review_basis", F.lit(True).alias("held")).distinct()
    j = findings.join(held, ["topic", "owner", "due", "review_basis"], "left")
    decided = F.coalesce("held", F.lit(False)) & (F.col("status") == "needs-review") & (F.col("retired") | (F.col("state") == "available"))
    status = F.when(decided & F.col("retired"), "reviewed-retired").when(decided, "reviewed-current").otherwise(F.col("status"))
    return j.select("topic", status.alias("status"), "owner", "retired", "state", "reasons", "review_basis")


def review_states(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """(topic, state, decision): every decision as matched, stale (of another basis, owner or kind), blocked (its finding can't be
    decided) or idle (its topic has no finding); and every finding without a matched one as missing."""
    reviewed = reviewed_findings(findings, reviews)
    now = reviewed.select("topic", F.col("owner").alias("now_owner"), F.col("review_basis").alias("now_basis"), F.when(F.col("retired"), "retired").otherwise("still-current").alias("due"), "status")
    j = reviews.join(now, "topic", "left")
    fits = (F.col("owner") == F.col("now_owner")) & (F.col("review_basis") == F.col("now_basis")) & (F.col("decision") == F.col("due"))
    state = F.when(F.col("now_basis").isNull(), "idle").when(~F.coalesce(fits, F.lit(False)), "stale").when(F.startswith("status", F.lit("reviewed")), "matched").otherwise("blocked")
    given = j.select("topic", state.alias("state"), "decision")
    lacking = reviewed.filter("status = 'needs-review'").select("topic", F.lit("missing").alias("state"), F.when(F.col("retired"), "retired").otherwise("still-current").alias("decision"))
    return given.unionByName(lacking)


def page_coverage(pages: DataFrame, inputs: DataFrame, exclusions: list[str]) -> DataFrame:
    """(path, state): each architecture page of the candidate as mapped, excluded or unmapped."""
    mapped = inputs.filter("side = 'candidate' AND page IS NOT NULL").select(F.col("page").alias("path"), F.lit(True).alias("mapped")).distinct()
    out = F.lit(False)
    for glob in exclusions:
        out = out | F.col("path").rlike(glob_regex(glob))
    here = pages.filter("side = 'candidate'").select("path").distinct().join(mapped, "path", "left")
    return here.select("path", F.when(F.col("mapped"), "mapped").when(out, "excluded").otherwise("unmapped").alias("state"))


def publication_state(reviewed: DataFrame, coverage: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: complete, review_required, ready, and the counts behind them."""
    of = lambda df, column, test: df.select(F.count_if(test(F.col(column)))).scalar()
    counts = {"incomplete": of(reviewed, "status", lambda c: c == "incomplete"), "pending": of(reviewed, "status", lambda c: c == "needs-review"), "unmapped": of(coverage, "state", lambda c: c == "unmapped"), "unavailable": of(targets.filter("side = 'candidate'"), "state", lambda c: c != "available")}
    one = reviewed.agg(F.count_if(F.startswith("status", F.lit("reviewed"))).alias("reviewed")).withColumns(counts)
    complete = F.col("incomplete") == 0
    required = (F.col("incomplete") > 0) | (F.col("pending") > 0) | (F.col("unmapped") > 0)
    return one.select(complete.alias("complete"), required.alias("review_required"), (complete & ~required & (F.col("unavailable") == 0)).alias("ready"), "incomplete", "pending", "reviewed", "unmapped", "unavailable")


def route(path: Column) -> Column:
    """The name under which a flat wiki serves a page: its file name without ending, spaces as hyphens."""
    return F.replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md$", ""), F.lit(" "), F.lit("-"))


def wiki_problems(files: DataFrame, links: DataFrame, anchors: DataFrame, file_bytes: int = 4 << 20, total_bytes: int = 256 << 20) -> DataFrame:
    """(path, kind, detail) of all that keeps a set of files from going out as a wiki.

    files: path, bytes; links: path, target (as written), image, wiki (of the [[...]] form); anchors: path, anchor.
    """
    row = lambda df, kind, detail=None: df.select("path", F.lit(kind).alias("kind"), (detail if detail is not None else F.lit("")).alias("detail"))
    parts = F.split("path", "/")
    private = F.exists(parts, lambda p: F.lower(p).isin(*PRIVATE))
    bad = F.col("path").rlike(r'^/|//|/$|[\x00-\x1f\\:*?"<>|]') | F.exists(parts, lambda p: p.isin("", ".", "..") | p.rlike(r"[. ]$")) | private
    valid = checkpointed(files.filter(~bad))
    out = row(files.filter(bad), "invalid-path").unionByName(row(valid.filter(F.col("bytes") > file_bytes), "file-limit"))
    total = valid.agg(F.sum("bytes").alias("b")).filter(F.col("b") > total_bytes).withColumn("path", F.lit(""))
    out = out.unionByName(row(total, "total-limit"))
    # Every folder and file name, as file systems that don't tell case would see it.
    prefixes = valid.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("at"))
    spelled = prefixes.select("path", "at", F.lower("at").alias("folded"))
    several = spelled.groupBy("folded").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first <> last").select("folded", "first")
    out = out.unionByName(row(spelled.join(several, "folded").filter("at <> first").select("path", "at").distinct(), "path-collision", F.col("at")))
    whole = valid.select(F.lower("path").alias("folded")).distinct()
    out = out.unionByName(row(spelled.filter(F.lower("path") != F.col("folded")).join(whole, "folded", "left_semi").select("path", "at").distinct(), "tree-collision", F.col("at")))
    home = valid.agg(F.count_if(F.col("path") == "Home.md").alias("n")).filter("n = 0").withColumn("path", F.lit("Home.md"))
    out = out.unionByName(row(home, "missing-home")).unionByName(row(valid.filter(F.col("path").rlike(OTHER_PAGES)), "unsupported-page"))
    routed = checkpointed(valid.filter(F.lower("path").endswith(".md")).select("path", route(F.col("path")).alias("route")))
    shared = routed.groupBy(F.lower("route").alias("key")).agg(F.count("*").alias("n"), F.min("path").alias("to"), F.min("route").alias("served"))
    out = out.unionByName(row(routed.withColumn("key", F.lower("route")).join(shared.filter("n > 1"), "key"), "route-collision", F.col("key")))
    # Links: outside ones pass; a file of that path is meant first, then the page served under that name.
    scheme = F.lower(F.regexp_extract("target", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    local = links.withColumn("scheme", scheme).withColumn("outside", scheme.isin("http", "https", "mailto") | F.startswith("target", F.lit("//")))
    out = out.unionByName(row(local.filter("scheme <> '' AND NOT outside"), "unsafe-link", F.col("target")))
    local = local.filter("scheme = '' AND NOT outside")
    bare = F.regexp_replace("target", r"[?#].*$", "")
    rooted = F.startswith("target", F.lit("/"))
    out = out.unionByName(row(local.filter(rooted & ~F.col("wiki")), "unsafe-link", F.col("target")))
    local = local.filter(~rooted | F.col("wiki")).withColumns({"name": F.regexp_replace(F.regexp_replace(bare, r"^/+", ""), r"^(\./)+", ""), "fragment": F.regexp_extract("target", r"#(.*)$", 1)})
    up = F.array_contains(F.split("name", "/"), "..")
    out = out.unionByName(row(local.filter(up), "unsafe-link", F.col("target")))
    local = local.filter(~up).withColumn("served_as", F.replace(F.regexp_replace("name", r"\.md$", ""), F.lit(" "), F.lit("-"))).withColumn("key", F.lower("served_as"))
    exact = valid.select(F.col("path").alias("name"), F.col("path").alias("exact"))
    j = local.join(exact, "name", "left").join(shared.select("key", "to", "served"), "key", "left")
    found = F.when(F.col("name") == "", F.col("path")).otherwise(F.coalesce("exact", "to"))
    j = checkpointed(j.withColumn("found", found).withColumn("odd", (F.col("name") != "") & F.col("exact").isNull() & F.col("to").isNotNull() & (F.col("served") != F.col("served_as"))))
    out = out.unionByName(row(j.filter("found IS NULL"), "missing-link", F.col("target"))).unionByName(row(j.filter("odd"), "unsafe-link", F.col("target")))
    good = j.filter("found IS NOT NULL AND NOT odd")
    page = F.lower("found").endswith(".md")
    out = out.unionByName(row(good.filter(F.col("image") & page), "image-page", F.col("target"))).unionByName(row(good.filter(F.col("image") & ~page & ~F.col("found").rlike(IMAGES)), "image-format", F.col("target")))
    known = anchors.select(F.col("path").alias("found"), F.col("anchor").alias("fragment")).distinct()
    return out.unionByName(row(good.filter("fragment <> ''").join(known, ["found", "fragment"], "left_anti"), "missing-anchor", F.col("target"))).distinct()
