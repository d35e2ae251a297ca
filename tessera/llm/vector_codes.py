"""Product-quantizer codes of vectors, with exact nearest entries found by annular norm pruning.

A part's nearest codebook entry lies in an annulus: if the best distance known is d, no entry whose norm differs from
the part's norm by more than d can be nearer. Entries are sorted by norm; the entries with the norms next to the part's
give the first d, a binary search of the sorted norms gives the annulus, bounds included, and the entries in it, and
no others, are compared exactly. Rows are taken in tiles of neighbours by norm, whose annuli nearly coincide; a tile is
compared with the span of its annuli, in which each row looks at its own. Components are integers, so sums are exact.

Each round is a pass over the vectors, which stay where they are: a task sends one row of sums for each entry that it
has used, and the codebooks (4 x 256 entries of a quarter vector, whatever the table) are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, sized

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries with the nearest norms, from which the first distance comes.
SEEDS = 4
#: Rows of a tile, which are neighbours by norm.
TILE = 128
#: Integers below this are exact in a double.
EXACT = 1 << 53
#: Errors of a whole vector stay below this.
MOST_ERROR = 1 << 62
LONG = (1 << 63) - 1


def bounds_of(size: int) -> list[int]:
    """Where the parts of a vector begin and end: of equal size where PARTS divides it, else as equal as can be."""
    return [size * k // PARTS for k in range(PARTS + 1)]


class Codebook:
    """The entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries.astype(np.float64) ** 2).sum(1)
        self.order = np.lexsort((np.arange(len(entries)), squares))
        self.entries, self.norms = entries[self.order], np.sqrt(squares[self.order])
        self.largest = int(np.abs(entries).max(initial=0))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of `parts`, ties to the entry with the lower index."""
        n, k = len(parts), len(self.entries)
        found, errors = np.zeros(n, np.int64), np.zeros(n, np.int64)
        most = parts.shape[1] * (int(np.abs(parts).max(initial=0)) + self.largest) ** 2
        kind = np.float64 if 4 * most < EXACT else np.int64
        norms = np.sqrt((parts.astype(np.float64) ** 2).sum(1))
        by_norm = np.argsort(norms, kind="stable")
        entries = self.entries.astype(kind)
        squares = (entries * entries).sum(1)
        for low in range(0, n, TILE):
            rows = by_norm[low : low + TILE]
            part, norm = parts[rows].astype(kind), norms[rows]
            own = (part * part).sum(1)[:, None]
            distance = lambda a, b: own - 2 * (part @ entries[a:b].T) + squares[a:b]
            seed = np.searchsorted(self.norms, norm)
            a, b = max(0, int(seed.min()) - SEEDS), min(k, int(seed.max()) + SEEDS)
            best = np.sqrt(distance(a, b).min(1).astype(np.float64))
            slack = 1e-9 * (norm + best + 1)  # norms are rounded; the annulus may only be wider for that
            first = np.searchsorted(self.norms, norm - best - slack, "left")
            end = np.searchsorted(self.norms, norm + best + slack, "right")
            a, b = int(first.min()), int(end.max())
            at = np.arange(a, b)
            inside = (at >= first[:, None]) & (at < end[:, None])
            near = np.where(inside, distance(a, b), np.inf if kind is np.float64 else LONG)
            least = near.min(1)
            found[rows] = np.where(near == least[:, None], self.order[a:b], k).min(1)
            errors[rows] = least
        return found, errors


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _coded(codebooks: list[np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, error by part) of the rows of `vectors`."""
    cuts = bounds_of(vectors.shape[1])
    both = [Codebook(book).nearest(vectors[:, cuts[p] : cuts[p + 1]]) for p, book in enumerate(codebooks)]
    return np.stack([x[0] for x in both], 1), np.stack([x[1] for x in both], 1)


def _sums(vectors: DataFrame, codebooks: list[np.ndarray], size: int) -> list:
    """Rows (part, entry, n, sums): how many parts have each entry, and the sums of their components."""
    sent = vectors.sparkSession.sparkContext.broadcast(codebooks)
    cuts = bounds_of(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        sums = [np.zeros((ENTRIES, cuts[p + 1] - cuts[p]), np.int64) for p in range(PARTS)]
        for batch in batches:
            rows = _matrix(batch.column(0), size)
            codes, _ = _coded(sent.value, rows)
            for p in range(PARTS):
                counts[p] += np.bincount(codes[:, p], minlength=ENTRIES)
                np.add.at(sums[p], codes[:, p], rows[:, cuts[p] : cuts[p + 1]])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e]), "sums": pa.array([sums[a][b] for a, b in zip(p, e)], pa.list_(pa.int64()))})

    per_task = vectors.select("v").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    widest = max(b - a for a, b in zip(cuts, cuts[1:]))
    total = lambda i: F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)"))
    rows = per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[total(i) for i in range(widest)]).alias("sums") if widest else F.array().alias("sums")).collect()
    sent.destroy()
    return rows


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """Rows (vec_id, label, v) of the vectors without null or non-finite components, as floors of 1024 times each."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = embeddings.filter(F.col("embedding").isNotNull() & F.forall("embedding", usable))
    size = F.greatest(F.size("embedding"), F.lit(1)).cast("double")
    most = F.floor(F.sqrt(F.lit(float(MOST_ERROR)) / (4 * size))).cast("double")
    scaled = lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE).cast("double"), -most), most).cast("int")
    return kept.select("vec_id", F.col("label") if "label" in embeddings.columns else F.lit(None).cast("int").alias("label"), F.transform("embedding", scaled).alias("v"))


def train_codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """The codebooks of rows (vec_id, v) and the vectors' size, which is that of the least vec_id; ([], 0) without rows."""
    first = vectors.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v")
    head = first.limit(1).collect()
    if not head:
        return [], 0
    size = len(head[0].v)
    same = vectors.filter(F.size("v") == size)
    begin = [r.v for r in same.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()]
    begin = np.array(begin, np.int64).reshape(len(begin), size)
    cuts = bounds_of(size)
    codebooks = [begin[:, a:b].copy() for a, b in zip(cuts, cuts[1:])]
    for _ in range(rounds):
        for r in _sums(same, codebooks, size):
            width = codebooks[r.part].shape[1]
            codebooks[r.part][r.entry] = [int(s) // r.n for s in r.sums[:width]]
    return codebooks, size


def codebooks_text(codebooks: list[np.ndarray]) -> str:
    """All components by part, entry and position, comma-joined."""
    return ",".join(str(x) for book in codebooks for entry in book.tolist() for x in entry)


def encode(vectors: DataFrame, codebooks: list[np.ndarray], size: int) -> DataFrame:
    """Rows (vec_id, label, code, error) of the vectors of that size."""
    sent = vectors.sparkSession.sparkContext.broadcast(codebooks)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = _coded(sent.value, _matrix(batch.column(2), size))
            text = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(errors.sum(1))], names=["vec_id", "label", "code", "error"])

    return vectors.filter(F.size("v") == size).select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256) of every vector that has only finite components.

    Repeated rows are vectors of their own; ties between equal ids go by the vector; a null vec_id comes last. Fewer
    than 256 vectors make as many entries. A size that 4 doesn't divide is cut as evenly as can be; an empty vector has
    code 00000000 and error 0. Vectors of another size than the one with the least vec_id can't be compared with it and
    go. Components of a size beyond which errors wouldn't fit in a long (131,072 with 64 components) count as that size.
    `label_error` is null where it doesn't fit. Null labels are one label. An empty table gives no rows; other columns
    are not looked at.
    """
    vectors = materialize(integer_vectors(embeddings), "vectors")
    codebooks, size = train_codebooks(vectors)
    coded = materialize(encode(vectors, codebooks, size), "codes") if codebooks else vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    if codebooks:
        release(vectors)
    by_label = sized(coded.groupBy(F.col("label").alias("l")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    digest = hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
