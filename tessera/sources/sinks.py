"""Sinks: tables, event logs, diagrams and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest


def write_surface_index(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_store(records: DataFrame, path: str, locator: str = "locator", prefix: int = 2) -> None:
    """Records with their content hash, partitioned by a prefix of the locator's hash so that selective reads prune."""
    keyed = records.withColumn("content_hash", digest(F.to_json(F.struct(*records.columns)))).withColumn("part", F.substring(F.sha2(F.col(locator), 256), 1, prefix))
    keyed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def catalog(records: DataFrame) -> DataFrame:
    """Content-addressed objects: equal contents are stored once, with how many records hold them."""
    body = F.to_json(F.struct(*records.columns))
    return records.select(digest(body).alias("object_id"), F.octet_length(body).alias("bytes")).groupBy("object_id", "bytes").agg(F.count("*").alias("references"))


def mermaid(edges: DataFrame, group: str = "graph_id", source: str = "src", target: str = "dst") -> DataFrame:
    """A flowchart text per group, edges in a fixed order."""
    line = F.concat(F.lit("    "), F.regexp_replace(source, r"\W", "_"), F.lit(" --> "), F.regexp_replace(target, r"\W", "_"))
    return edges.select(group, line.alias("line")).distinct().groupBy(group).agg(F.concat(F.lit("flowchart LR\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("diagram"))


def markdown_table(rows: DataFrame, columns: list[str], limit: int = 1000) -> str:
    """A bounded report as a Markdown table."""
    escape = lambda v: ("" if v is None else json.dumps(v) if isinstance(v, (list, dict)) else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(escape(r[c]) for c in columns) + " |" for r in rows.select(*columns).limit(limit).collect()]
    return "\n".join(lines) + "\n"
