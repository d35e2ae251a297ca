"""Reports over whole frames: the doctor's summary, queue qualification, publication candidates, and their Markdown forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import markdown_table
from .aggregates import FRESHNESS, zero_filled
from .markdown import PLACEHOLDER
from .scoring import health

SEVERITIES = ["error", "warning", "info"]


def qualification_counts(queue: DataFrame, state: str = "state", domain: list[str] = FRESHNESS) -> DataFrame:
    """(state, count) over all pages a queue looked at, also those it didn't select; states nobody has count 0."""
    return zero_filled(queue.withColumnRenamed(state, "state"), "state", domain)


def doctor(pages: DataFrame, freshness: DataFrame, issues: DataFrame, sessions: DataFrame, listed: int = 20) -> DataFrame:
    """Rows (section, item, count, message) of one report.

    Sections: pages by kind, freshness by state, issues by severity, health by status, and the first `listed` issues in
    severity order with their total as count. Closed domains are filled up with zeros.
    """
    row = lambda df, section, item: df.select(F.lit(section).alias("section"), F.col(item).alias("item"), F.col("count"), F.lit(None).cast("string").alias("message"))
    kinds = pages.groupBy("kind").agg(F.count("*").alias("count"))
    states = zero_filled(freshness, "state", FRESHNESS, None)
    severities = zero_filled(issues, "severity", SEVERITIES, None)
    statuses = health(sessions).groupBy("status").agg(F.count("*").alias("count"))
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    first = issues.orderBy(rank, "category", "path", "message").limit(listed)
    named = first.select(F.lit("issue").alias("section"), F.concat_ws(":", "severity", "category").alias("item"), issues.select(F.count("*")).scalar().alias("count"), F.concat_ws(" ", "path", "message").alias("message"))
    return row(kinds, "pages", "kind").unionByName(row(states, "freshness", "state")).unionByName(row(severities, "issues", "severity")).unionByName(row(statuses, "health", "status")).unionByName(named)


def candidate_problems(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(path, problem, detail) of a wiki laid out flat, where a page is found by its name alone, whatever its case.

    pages: path; links: path, target (a page name). A name that several pages have, a name with characters that file
    systems or links don't take, a link to a name nobody has, and a wiki without a home page are problems.
    """
    file = F.element_at(F.split("path", "/"), -1)
    name = F.lower(F.regexp_replace(F.regexp_replace(file, r"\.md$", ""), "[ -]+", "-"))
    named = pages.select("path", name.alias("name"), file.alias("file"))
    taken = named.groupBy("name").agg(F.count("*").alias("n"))
    twice = named.join(taken.filter("n > 1"), "name").select("path", F.lit("duplicate-name").alias("problem"), F.col("name").alias("detail"))
    odd = named.filter(F.col("file").rlike(r'[\\:*?"<>|]')).select("path", F.lit("unsafe-name").alias("problem"), F.col("file").alias("detail"))
    wanted = links.select("path", F.col("target").alias("detail"), F.lower(F.regexp_replace(F.regexp_replace("target", r"#.*$", ""), "[ -]+", "-")).alias("name"))
    dead = wanted.filter("name <> ''").join(taken, "name", "left_anti").select("path", F.lit("dead-link").alias("problem"), "detail")
    home = named.agg(F.count_if(F.col("name") == "home").alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("path"), F.lit("no-home").alias("problem"), F.lit(None).cast("string").alias("detail"))
    return twice.unionByName(odd).unionByName(dead).unionByName(home)


def projected_table(generated: DataFrame, existing: DataFrame, keys: list[str], written: list[str]) -> DataFrame:
    """Rows of a generated table with what people wrote into the same rows before.

    A written column keeps its existing value where the key still exists and the value is no placeholder; of several
    existing rows with one key none is taken. Rows that are gone go; the generated columns are those of now.
    """
    once = existing.groupBy(*keys).agg(F.count("*").alias("n"), *[F.first(c).alias(f"old_{c}") for c in written]).filter("n = 1").drop("n")
    joined = generated.join(once, keys, "left")
    blank = lambda c: F.col(c).isNull() | F.regexp_like(F.col(c), F.lit("(?i)^" + PLACEHOLDER.pattern + "$"))
    return joined.withColumns({c: F.when(~blank(f"old_{c}"), F.col(f"old_{c}")).otherwise(F.col(c)) for c in written}).select(*generated.columns)


def owned_sections(sections: DataFrame, ownership: DataFrame, owners: list[str]) -> DataFrame:
    """Sections (path, ordinal, title) whose title an owner has on that kind of page, in page order.

    ownership: kind, title, owner; a title without a row there is owned by nobody and left out.
    """
    wanted = ownership.filter(F.col("owner").isin(owners)).select("kind", F.lower("title").alias("t"), "owner").distinct()
    return sections.join(wanted, (sections["kind"] == wanted["kind"]) & (F.lower(sections["title"]) == F.col("t"))).select(sections["*"], "owner").orderBy("path", "ordinal")


def rendered(title: str, counts: dict[str, int], rows: DataFrame, columns: list[str], limit: int = 200) -> str:
    """A report: title, counts, and a bounded table with what was left out."""
    total = rows.count()
    head = [f"# {title}", "", *[f"- {k}: {v}" for k, v in counts.items()], ""]
    return "\n".join(head) + markdown_table(rows, columns, limit) + (f"\n{total - limit} more rows\n" if total > limit else "")


def impact_report(impact: DataFrame) -> str:
    counts = {r.section: r["count"] for r in impact.filter("section <> 'identity'").groupBy("section").count().orderBy("section").collect()}
    identity = impact.filter("section = 'identity'").first()
    return rendered("Impact", counts | ({"identity": identity["item"]} if identity else {}), impact.filter("section <> 'identity'").orderBy("section", "item"), ["section", "item"])


def api_report(findings: DataFrame) -> str:
    from .diffs import diff_status

    status = diff_status(findings).first()
    return rendered("API changes", {"status": status.status, "breaking": status.breaking_count, "advisory": status.advisory_count}, findings.orderBy("severity", "code", "operation", "detail"), ["severity", "code", "operation", "detail"])


def publication_report(changes: DataFrame, uncovered: DataFrame) -> str:
    counts = {r.change: r["count"] for r in changes.groupBy("change").count().orderBy("change").collect()}
    return rendered("Publication", counts | {"uncovered pages": uncovered.count()}, changes.orderBy("topic"), ["topic", "change"])


def queue_report(queue: DataFrame) -> str:
    return rendered("Maintenance queue", {"selected": queue.count()}, queue.orderBy(F.desc("score"), "path"), ["path", "score"])


def lineage_problems(events: DataFrame) -> DataFrame:
    """(uid, problem) of a ledger whose rows name what they follow: uid, predecessor (null for a first).

    A predecessor that no row has is missing; rows that follow each other in a ring are a cycle (of one: self); an
    identity that several follow is forked.
    """
    from .graph import cycles

    links = events.filter(F.col("predecessor").isNotNull()).select(F.col("uid").alias("src"), F.col("predecessor").alias("dst")).distinct()
    missing = links.join(events.select(F.col("uid").alias("dst")).distinct(), "dst", "left_anti").select(F.col("src").alias("uid"), F.lit("missing-predecessor").alias("problem"))
    ring = cycles(links).select(F.col("node").alias("uid"), F.when(F.col("size") > 1, "cycle").otherwise("self").alias("problem"))
    forked = links.groupBy(F.col("dst").alias("uid")).agg(F.count_distinct("src").alias("n")).filter("n > 1").select("uid", F.lit("forked").alias("problem"))
    return missing.unionByName(ring).unionByName(forked).distinct()


def numbered_chunks(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, chunk, body): a long text in pieces of `size` characters, numbered from 0; put together they are the text."""
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1))
    at = df.filter(F.col(text).isNotNull()).withColumn("chunk", F.explode(places))
    return at.select(key, "chunk", F.substring(F.col(text), F.col("chunk") * size + 1, F.lit(size)).alias("body"))


def basis_page(df: DataFrame, basis: DataFrame, expected: str, order: list, offset: int, limit: int) -> DataFrame:
    """A page of an ordered result that belongs to a basis (one row, hash): asked for with another hash it is an error."""
    from .bounds import page_of

    held = basis.select("hash").first()
    if held is None or held["hash"] != expected:
        raise ValueError("the result changed since the first page")
    return page_of(df, order, offset, limit)

