"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines). Each paragraph hashes to one wide vector and a text's
fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo a power of two. Sums don't depend
on order, and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has two parts. IDENTITY lanes hold the paragraph's BLAKE2b digest, summed modulo 2^64: two texts
have the same lanes only if their paragraphs are the same (up to a digest collision). SKETCH lanes, summed
modulo 2^32 (more than a text can have windows, so none wraps), hold a signed count of the paragraph's byte windows; their inner products estimate how many
windows two texts share, so the likeness of texts is read off the fingerprints alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTITY, SKETCH, WINDOW = 4, 256, 16
#: Ids drawn for each range of the edits' shuffle; one of so many becomes a bound.
SAMPLED = 16
#: Ranges at most, so that the driver draws 1.6 million ids at most; ranges grow beyond that.
RANGES = 100_000
#: Odd multipliers of the window hash, one for each doubling of the window; fixed by a seed.
_MULTIPLIERS = np.random.default_rng(20260916).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLICE = 1 << 18


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= _MULTIPLIERS[6]
    h ^= h >> np.uint64(29)
    h *= _MULTIPLIERS[7]
    return h ^ (h >> np.uint64(32))


def _windows(data: np.ndarray) -> np.ndarray:
    """A hash for each window of WINDOW bytes, by doubling; a shorter text gives one for the whole."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[4]
    if len(data) < WINDOW:
        with np.errstate(over="ignore"):
            folded = np.uint64(len(data)) * _MULTIPLIERS[5]
            for x in h:
                folded = folded * _MULTIPLIERS[0] + x
        return np.asarray([folded], np.uint64)
    width, k = 1, 0
    while width < WINDOW:
        h = h[:-width] * _MULTIPLIERS[k] + h[width:]
        width, k = width * 2, k + 1
    return h


def _sketch(paragraph: bytes, lanes: np.ndarray) -> None:
    """Adds the paragraph's signed window counts to `lanes`, a slice at a time."""
    for low in range(0, max(1, len(paragraph) - WINDOW + 1), _SLICE):
        h = _mixed(_windows(np.frombuffer(paragraph[low : low + _SLICE + WINDOW - 1], np.uint8)))
        lane = (h >> np.uint64(40)).astype(np.int64) & (2 * SKETCH - 1)
        counts = np.bincount(lane, minlength=2 * SKETCH)
        lanes += counts[:SKETCH] - counts[SKETCH:]


class Fingerprint:
    """Lanes of one multiset of paragraphs; closed under + and -."""

    def __init__(self, identity=None, sketch=None):
        self.identity = np.zeros(IDENTITY, np.uint64) if identity is None else identity
        self.sketch = np.zeros(SKETCH, np.int64) if sketch is None else sketch

    @classmethod
    def of(cls, text: bytes) -> Fingerprint:
        out = cls()
        paragraphs = text.split(b"\n")
        digests = b"".join([hashlib.blake2b(p, digest_size=8 * IDENTITY).digest() for p in paragraphs])
        out.identity = np.frombuffer(digests, "<u8").reshape(-1, IDENTITY).sum(axis=0, dtype=np.uint64)
        short = sum(len(p) < WINDOW for p in paragraphs)
        if len(text) < _SLICE and not short:  # all windows at once, less those that span a line end
            data = np.frombuffer(text, np.uint8)
            h = _mixed(_windows(data))
            ends = np.flatnonzero(data == 10)
            if len(ends):
                inside = np.cumsum(data == 10)
                h = h[inside[WINDOW - 1 :] == inside[: len(h)] - (data[: len(h)] == 10)]
            counts = np.bincount((h >> np.uint64(40)).astype(np.int64) & (2 * SKETCH - 1), minlength=2 * SKETCH)
            out.sketch = counts[:SKETCH] - counts[SKETCH:]
        else:
            for p in paragraphs:
                _sketch(p, out.sketch)
        return out

    def inserted(self, paragraph: bytes) -> Fingerprint:
        more = Fingerprint.of(paragraph)
        return Fingerprint(self.identity + more.identity, self.sketch + more.sketch)

    def deleted(self, paragraph: bytes) -> Fingerprint:
        less = Fingerprint.of(paragraph)
        return Fingerprint(self.identity - less.identity, self.sketch - less.sketch)

    def hex(self) -> str:
        return self.identity.astype("<u8").tobytes().hex() + self.sketch.astype("<i4").tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> Fingerprint:
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw[: 8 * IDENTITY], "<u8").copy(), np.frombuffer(raw[8 * IDENTITY :], "<i4").astype(np.int64))

    def likeness(self, other: Fingerprint) -> float:
        """1 - |a-b|^2 / (|a|^2 + |b|^2) over the sketch lanes, held to [0, 1]."""
        if np.array_equal(self.identity, other.identity):
            return 1.0
        a, b = self.sketch.astype(np.float64), other.sketch.astype(np.float64)
        both, d = float(a @ a + b @ b), a - b
        return min(1.0, max(0.0, 1.0 - float(d @ d) / both)) if both else 0.0


def fingerprint_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint); a null text counts as empty. Map-only."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [Fingerprint.of(x.as_py() or b"").hex() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _row(doc_id, text: str) -> tuple:
    raw = text.encode()
    return doc_id, text, Fingerprint.of(raw)


def _edited(current: tuple, following: tuple) -> dict:
    doc_id, text, own = current
    half = len(text) // 2
    changed = (text[: len(text) - half] + following[1][:half]).encode()
    edited = Fingerprint.of(changed)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed).hexdigest(),
        "fingerprint": own.hex(),
        "edited_fingerprint": edited.hex(),
        "near_edited": own.likeness(edited),
        "near_next": own.likeness(following[2]),
    }


def fingerprints_with_edits(docs: DataFrame, target_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document, in descending doc_id.

    Ids drawn by a hash, some SAMPLED for each `target_bytes` of text, cut the documents into ranges; each range begins
    at one of them, so its first row is known beforehand and travels to the range before it as well. Every row meets the
    next one in its own task: one shuffle of the text, nothing gathered but the bounds (RANGES at most), which workers
    search by bisection.

    The last document's next is the first. Null texts count as empty; rows of equal doc_id follow each other by their
    text; a null doc_id comes last. Ids may be of any type that sorts. An empty table gives no rows; one row is its own
    next. Other columns are not looked at.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("doc_id").alias("n"), F.count("*").alias("rows"), F.max("doc_id").alias("top")).first()
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(1, min(size.n, RANGES, max(width, -(-int(size.b or 0) // target_bytes))))
    every = max(1, size.n // (SAMPLED * parts))
    drawn = rows.select("doc_id").filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).distinct()
    ids = sorted(r.doc_id for r in drawn.toLocalIterator())
    step = max(1, round(len(ids) / parts))
    bounds = ([] if not size.n else sorted({*ids[step // 2 :: step], size.top})) if parts > 1 else [size.top] if size.n else []
    return _stitched(rows, bounds, size.rows > size.n)


def _stitched(rows: DataFrame, bounds: list, nulls: bool) -> DataFrame:
    """Deals rows into the ranges that end at `bounds` (ascending), each range's first row to the range before as well."""
    kind, spark = rows.schema["doc_id"].dataType, rows.sparkSession
    n = len(bounds) + nulls
    shared = spark.sparkContext.broadcast(np.asarray(bounds, object if any(not isinstance(b, int) for b in bounds) else np.int64))

    @F.pandas_udf("part int, head boolean")
    def place(ids: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(shared.value, ids.to_numpy())  # the least bound that is not below the id
        return pd.DataFrame({"part": (len(shared.value) - 1 - at).astype(np.int32), "head": shared.value[at] == ids.to_numpy()})

    if bounds:
        placed = rows.withColumn("p", place(F.coalesce("doc_id", F.lit(bounds[-1]).cast(kind))))
        null = F.col("doc_id").isNull()  # nulls are a range of their own, behind all others
        placed = placed.select("doc_id", "text", F.when(null, len(bounds)).otherwise(F.col("p.part")).alias("part"), (null | F.col("p.head")).alias("head"))
    else:
        placed = rows.select("doc_id", "text", F.lit(0).alias("part"), F.lit(True).alias("head"))
    own = F.array(F.struct(F.col("part").alias("to"), F.lit(0).alias("extra")))
    copy = F.array(F.struct(F.pmod(F.col("part") + F.lit(n - 1), F.lit(max(1, n))).alias("to"), F.lit(1).alias("extra")))
    sent = placed.select("doc_id", "text", F.explode(F.when(F.col("head"), F.concat(own, copy)).otherwise(own)).alias("t"))
    sent = sent.select(F.col("t.to").alias("part"), F.col("t.extra").alias("extra"), "doc_id", "text")
    dealt = sent.repartitionById(max(1, n), F.col("part")).sortWithinPartitions("extra", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, out, extra_seen = None, [], False
        id_type = None
        for batch in batches:
            id_type = batch.column(2).type
            extras, ids, texts = batch.column(1), batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                extra = extras[k].as_py()
                if extra and extra_seen:
                    continue  # of several rows with the head's doc_id the first by text is the next one
                current = _row(ids[k].as_py(), texts[k].as_py())
                if previous is not None:
                    out.append(_edited(previous, current))
                extra_seen, previous = bool(extra), None if extra else current
                if len(out) >= 500:
                    yield _batch(out, id_type)
                    out = []
        if out:
            yield _batch(out, id_type)

    schema = f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)


def _batch(rows: list[dict], id_type) -> pa.RecordBatch:
    names = list(rows[0])
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
