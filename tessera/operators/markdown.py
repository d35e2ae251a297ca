"""Markdown: sections with extents and identity, link observations and their resolution."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..functions.text import SLICE, join_path, mask_fences

HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*")
TARGET = re.compile(r"(!?)\[([^\]\n]*)\]\(\s*<?([^\s)>]+)>?(?:\s+[\"'][^\"']*[\"'])?\s*\)")
PLACEHOLDER = re.compile(r"\s*(?:|-|n/?a|tbd|todo|none|_?\(?(?:no|add|missing) description\)?_?)\s*\.?\s*", re.IGNORECASE)


def normalize(markdown: str) -> str:
    return markdown.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def _front_matter(lines: list[str]) -> int:
    """Lines of a leading block between --- lines; a block that isn't closed covers the whole text."""
    if not lines or lines[0].strip() != "---":
        return 0
    closed = next((k for k, line in enumerate(lines[1:], 1) if line.strip() in ("---", "...")), None)
    return len(lines) if closed is None else closed + 1


def headings(text: str) -> list[tuple[int, str, int, int]]:
    """(level, title, start, body start) of ATX headings outside front matter and fenced code."""
    lines = text.splitlines(keepends=True)
    skip, at, out = _front_matter([x.rstrip("\n") for x in lines]), 0, []
    masked = mask_fences(text).splitlines(keepends=True)
    for k, line in enumerate(lines):
        match = HEADING.fullmatch(masked[k].rstrip("\n")) if k >= skip else None
        if match:
            title = match[2] or ""
            title = "" if title and not title.strip("#") else re.sub(r"[ \t]+#+[ \t]*$", "", title)
            out.append((len(match[1]), title.strip(), at, at + len(line)))
        at += len(line)
    return out


def locator(page: str, path: list[str], occurrence: list[int]) -> str:
    """A section's address: its page, then each heading with the number of its repeat where it isn't the first."""
    steps = [quote(t, safe="") + (f"~{n}" if n > 1 else "") for t, n in zip(path, occurrence)]
    return f"{page}#{'/'.join(steps)}"


def parse_sections(markdown: str, page: str = "") -> tuple[str, list[dict]]:
    """(normalized text, sections in order). A parent is the nearest earlier heading of a smaller level; a
    section ends where the next heading of its level or a smaller one begins, its own text stops where any heading
    does. Its chapter is the title of the level-2 section that it is or is in."""
    text = normalize(markdown)
    found, open_at, seen = headings(text), [], {}
    sections: list[dict] = []
    for k, (level, title, start, body_start) in enumerate(found):
        while open_at and sections[open_at[-1]]["level"] >= level:
            sections[open_at.pop()]["end"] = start
        parent = open_at[-1] if open_at else None
        seen[parent, title] = number = seen.get((parent, title), 0) + 1
        above = sections[parent] if parent is not None else {"heading_path": [], "occurrence_path": [], "locator": None, "chapter": ""}
        path, occurrence = [*above["heading_path"], title], [*above["occurrence_path"], number]
        sections.append({"ordinal": k, "level": level, "title": title, "heading_path": path, "occurrence_path": occurrence, "occurrence": number, "parent": above["locator"], "locator": locator(page, path, occurrence), "start": start, "body_start": body_start, "end": len(text), "stop": len(text), "chapter": title if level == 2 else above["chapter"] if level > 2 else ""})
        if k:
            sections[k - 1]["stop"] = start
        open_at.append(k)
    return text, sections


SECTION_SCHEMA = "path string, locator string, ordinal int, level int, title string, heading_path array<string>, occurrence_path array<int>, occurrence int, parent string, start int, body_start int, end int, start_byte int, end_byte int, text string, sha256 string"


def sections(pages: DataFrame) -> DataFrame:
    """A row per section of each page (path, content); map-only."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                text, found = parse_sections(content or "", path)
                for s in found:
                    body = text[s["start"] : s["end"]]
                    start = len(text[: s["start"]].encode())
                    rows.append((path, s["locator"], s["ordinal"], s["level"], s["title"], s["heading_path"], s["occurrence_path"], s["occurrence"], s["parent"], s["start"], s["body_start"], s["end"], start, start + len(body.encode()), body, hashlib.sha256(body.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTION_SCHEMA.split(", ")])

    return pages.select("path", "content").mapInPandas(run, SECTION_SCHEMA)


FIELD_SCHEMA = "path string, kind string, id string, ordinal int, level int, title string, chapter string, heading_path array<string>, start int, end int, body string"


def own_texts(pages: DataFrame) -> DataFrame:
    """A row per section of each page (path, kind, id, content) with its own text, subsections apart; map-only.

    The text before the first section has ordinal -1 and level 0.
    """

    texts, number = pa.string(), pa.int32()
    kinds = [texts, texts, texts, number, number, texts, texts, pa.list_(texts), number, number, texts]
    made = pa.schema(list(zip([c.split()[0] for c in FIELD_SCHEMA.split(", ")], kinds)))

    def run(batches):
        for part in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            rows = []
            for path, kind, page_id, content in zip(*(c.to_pylist() for c in part.columns)):
                text, found = parse_sections(content or "", path)
                first = found[0]["start"] if found else len(text)
                rows.append((path, kind, page_id, -1, 0, "", "", [], 0, first, text[:first]))
                rows += [(path, kind, page_id, s["ordinal"], s["level"], s["title"], s["chapter"], s["heading_path"], s["body_start"], s["stop"], text[s["body_start"] : s["stop"]]) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=made)

    return pages.select("path", "kind", "id", "content").mapInArrow(run, FIELD_SCHEMA)


def section_extents(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Parent, end and occurrence of headings (doc, start, level, title, length) with windows alone.

    Each heading sees the places of its document's headings, which are few; the end is the nearest later heading of no
    greater level, the parent the nearest earlier one of a smaller level. Equal headings are one.
    """
    per = Window.partitionBy(doc).orderBy("start", "level", "title", "length")
    own, place = F.struct("start", "level", "title", "length"), F.struct(F.col("start").alias("s"), F.col("level").alias("l"))
    around = F.collect_list(place).over(per.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # Headings without a document have no others around them.
    seen = found.withColumns({"around": F.when(F.col(doc).isNotNull(), around), "again": F.lag(own).over(per).eqNullSafe(own)}).filter("NOT again")
    starts = lambda which: F.transform(F.filter("around", which), lambda x: x["s"])
    end = F.array_min(starts(lambda x: (x["s"] > F.col("start")) & (x["l"] <= F.col("level"))))
    parent = F.array_max(starts(lambda x: (x["s"] < F.col("start")) & (x["l"] < F.col("level"))))
    out = seen.select(doc, "start", "level", "title", "length", F.coalesce(end, F.col("length")).alias("end"), parent.alias("parent_start"))
    number = F.row_number().over(Window.partitionBy(doc, "parent_start", "title").orderBy("start"))
    return out.withColumn("occurrence", number)


LINK_SCHEMA = "path string, ordinal int, syntax string, start int, end int, raw_target string, target_class string, resolved string"


def classify(path: str, target: str) -> tuple[str, str | None]:
    """(class, page it leads to): the first rule that fits wins."""
    if target.startswith("#"):
        return "anchor", path
    if re.match(r"[a-z][a-z0-9+.-]*:", target, re.IGNORECASE) or target.startswith("//"):
        return ("external" if re.match(r"(https?|mailto|ftp):", target, re.IGNORECASE) else "unsupported-scheme"), None
    if target.startswith("/"):
        return "absolute", None
    page = join_path(path, target)
    if page is None:
        return "escape", None
    return ("page" if page.endswith(".md") else "asset"), page


def link_observations(pages: DataFrame) -> DataFrame:
    """A row per link occurrence outside code, in text order; map-only."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                text = re.sub(r"`[^`\n]*`", lambda m: " " * len(m[0]), mask_fences(content or ""))
                for k, m in enumerate(TARGET.finditer(text)):
                    kind, page = classify(path, m[3])
                    rows.append((path, k, "image" if m[1] else "inline", m.start(), m.end(), m[3], kind, page))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINK_SCHEMA.split(", ")])

    return pages.select("path", "content").mapInPandas(run, LINK_SCHEMA)


def resolve_links(links: DataFrame, registry: DataFrame) -> DataFrame:
    """Resolution of each page link by how many registry rows have its page: none, one or several."""
    counts = registry.groupBy(F.col("path").alias("resolved")).agg(F.count("*").alias("candidates"))
    joined = links.join(counts, "resolved", "left")
    n = F.coalesce("candidates", F.lit(0))
    outcome = F.when(F.col("target_class") == "external", "external").when(~F.col("target_class").isin("page", "anchor", "asset"), "unresolved")
    return joined.withColumn("resolution", outcome.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved"))


def html_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, href) of every link in raw HTML."""
    return pages.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(html_col, F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@F.pandas_udf(BooleanType())
def is_placeholder_udf(column: pd.Series) -> pd.Series:
    return column.map(lambda t: t is None or bool(PLACEHOLDER.fullmatch(t)))


@F.pandas_udf(StringType())
def rewrite_links_udf(path: pd.Series, content: pd.Series) -> pd.Series:
    """Page links as wiki links [[page|label]]; other links stay."""

    def one(p, text):
        def put(m):
            kind, page = classify(p, m[3])
            return f"[[{page.removesuffix('.md')}|{m[2]}]]" if kind == "page" and not m[1] else m[0]

        return TARGET.sub(put, text or "")

    return pd.Series([one(p, c) for p, c in zip(path, content)])
