"""Digests, stable ids and canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def digest(column: Column) -> Column:
    """sha256:<hex> over the UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(column.cast("binary"), 256))


# Fixed value: the prefix of the identity format.
UID_PREFIX = "lw"


def stable_uid(tag: str, *parts: Column) -> Column:
    """lw:<tag>:<32 hex>: an id derived from an entity's natural key."""
    return F.concat(F.lit(f"{UID_PREFIX}:{tag}:"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32))


def canonical_json(value, form: str = "compact") -> str:
    """One of four encodings: compact, compact_line, ascii_compact, indented_line. Keys sorted, no NaN."""
    layout = {"indent": 2} if form == "indented_line" else {"separators": (",", ":")}
    text = json.dumps(value, ensure_ascii=form == "ascii_compact", sort_keys=True, allow_nan=False, **layout)
    return text + "\n" if form.endswith("_line") else text


def strict_json(text: str):
    """Parsed JSON; repeated keys and numbers that aren't finite are errors."""

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    def refuse(name):
        raise ValueError(f"{name} is not finite")

    return json.loads(text, object_pairs_hook=unique, parse_constant=refuse)


def canonical_json_udf(form: str = "compact"):
    """JSON text to its canonical encoding; null where it isn't strict JSON."""

    @F.pandas_udf(StringType())
    def run(column: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else canonical_json(strict_json(text), form)
            except ValueError:
                return None

        return column.map(one)

    return run


def canonical_size(column, form: str = "compact"):
    """Exact bytes of a JSON text's canonical encoding; null where it isn't strict JSON."""
    return F.octet_length(canonical_json_udf(form)(column))


def allowed_counts(column, names: list[str]):
    """A map's entries whose name is allowed and whose count isn't negative."""
    return F.map_filter(column, lambda k, v: k.isin(names) & (v >= 0))


def without_lines(value):
    """A record without its line metadata, at any depth."""
    if isinstance(value, dict):
        return {k: without_lines(v) for k, v in value.items() if k not in ("line", "end_line", "lineno", "end_lineno", "line_start", "line_end")}
    return [without_lines(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def semantic_hash_udf(column: pd.Series) -> pd.Series:
    """sha256 of a JSON record's canonical form, line numbers aside."""
    import hashlib

    return column.map(lambda t: None if t is None else "sha256:" + hashlib.sha256(canonical_json(without_lines(json.loads(t))).encode()).hexdigest())


def corpus_identity(pages: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row: the digest over (path, content digest) in path order, and the number of pages.

    Contents are digested in the cluster and the lines sorted by range; the driver takes the sorted lines one by one
    through an incremental hash, so it holds a partition's iterator and no list.
    """
    import hashlib

    digested = pages.select(F.col(path).alias("p"), F.sha2(F.col(content).cast("binary"), 256).alias("d"))
    whole, n = hashlib.sha256(), 0
    for row in digested.orderBy("p", "d").toLocalIterator(prefetchPartitions=True):
        whole.update(f"{row.p}\0{row.d}\n".encode())
        n += 1
    return pages.sparkSession.createDataFrame([("sha256:" + whole.hexdigest(), n)], "corpus_id string, pages bigint")
