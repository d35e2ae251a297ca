"""Token counts by overlap resynchronisation.

A text of ordinary length is counted at once. A longer one is cut into chunks that overlap; the library encodes each
with offsets, and two neighbours are spliced at a boundary that both have inside their overlap.

A boundary is proven stable where, in both encodings, a pre-token begins there, at least `margin` characters (more
than the longest special string) lie between it and either end of the overlap, and all ids from it to the last such
place agree. The pre-tokenizer scans from left to right without looking back, so a scan that begins a match where the
whole text's scan begins one goes on as that does; what the left chunk's end tears is its last match and, of a special
string, less than `margin` characters. Where an overlap holds no such boundary (an endless word) or ids differ, it is
widened to twice the size until it holds one or all of the left chunk, which the wider chunk then replaces.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import UnitCounter, process_own, special_strings
from .common import byte_view, row_slices, string_column

#: Characters of a chunk, and of the part it shares with the one before it.
CHUNK_CHARS, OVERLAP_CHARS = 16_000, 400


@dataclasses.dataclass
class Chunk:
    """The library's encoding of text[start:]; token k of `ids` begins where `begins` says."""

    start: int
    encoding: object

    def token_at(self, place: int) -> int | None:
        """The token that begins a pre-token at this place of the whole text."""
        k = self.encoding.char_to_token(place - self.start)
        if k is None or self.encoding.token_to_chars(k)[0] != place - self.start:
            return None
        return k if k == 0 or self.encoding.token_to_word(k) != self.encoding.token_to_word(k - 1) else None


@dataclasses.dataclass
class Resynchroniser:
    """Counts long texts with one library; tells how often it spliced and widened."""

    library: object
    chunk: int = CHUNK_CHARS
    overlap: int = OVERLAP_CHARS
    splices: int = 0
    widenings: int = 0

    def __post_init__(self):
        self.margin = 1 + max(map(len, special_strings(self.library)), default=0)

    def _encoded(self, text: str, low: int, high: int) -> Chunk:
        return Chunk(low, self.library.encode(text[low:high], add_special_tokens=False))

    def _common(self, left: Chunk, right: Chunk, low: int, high: int) -> tuple[int, int] | None:
        """(left token, right token) at the first proven boundary in [low, high]."""
        first = last = None
        for places, stop in ((range(low, high + 1), 1), (range(high, low - 1, -1), 2)):
            for place in places:
                j = right.token_at(place)
                i = None if j is None else left.token_at(place)
                if i is not None:
                    first, last = (first or (i, j)), (i, j)
                    break
            if first is None:
                return None
        (i, j), (m, n) = first, last
        return first if left.encoding.ids[i:m] == right.encoding.ids[j:n] else None

    def count(self, text: str) -> int:
        end, total, spliced = min(len(text), self.chunk), 0, 0
        left = self._encoded(text, 0, end)
        while end < len(text):
            wide = self.overlap
            while True:
                low, high = max(left.start, end - wide), min(len(text), end + max(self.chunk, wide))
                right = self._encoded(text, low, high)
                if low == left.start:  # the wider chunk holds the left one and takes its place
                    break
                if found := self._common(left, right, low + self.margin, end - self.margin):
                    total, spliced = total + found[0] - spliced, found[1]
                    self.splices += 1
                    break
                wide *= 2
                self.widenings += 1
            left, end = right, high
        return total + len(left.encoding) - spliced


class TokenCounter:
    """Counts of any texts: short ones by a unit counter, longer ones by resynchronised chunks."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, memory: int = 400_000):
        self.units = UnitCounter(path, memory)
        self.long = Resynchroniser(self.units.library, chunk, overlap)

    def count(self, texts: list[str]) -> list[int]:
        short = iter(self.units.count_many([t for t in texts if len(t) <= self.long.chunk]))
        return [next(short) if len(t) <= self.long.chunk else self.long.count(t) for t in texts]


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, slice_bytes: int = 1 << 20, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, memory: int = 400_000
) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) for every document.

    `path` names a tokenizer that drops white space. A null text counts as empty, with no tokens. Repeated rows and
    ids, and null ids, give a row each; an empty table gives none; other columns are not looked at. Map-only: no
    shuffle; memory is bounded by a slice of `slice_bytes` of text (or one longer text), two chunks' encodings and the
    memory of short texts' units (0: none).
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = own or process_own(TokenCounter, path, chunk, overlap, memory)
            column = string_column(batch, "text")
            _, ends = byte_view(column)
            counts: list[int] = []
            for low, high in row_slices(ends, slice_bytes):
                counts += own.count(column.slice(low, high - low).to_pylist())
            tokens = np.asarray(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends)), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"doc_id {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return rows.mapInArrow(run, schema)
