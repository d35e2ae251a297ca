"""Encoders over public tokenizer files: whole texts by merge ranks, and counts of short texts by their units.

Special strings inside a text are what the library takes them for, and white space beyond ASCII may part words for
one engine and not for another; texts with either go through the library itself.
"""

from __future__ import annotations

import base64
import re

import numpy as np

#: White space beyond ASCII, and separators that only some engines count as white space.
ODD_SPACE = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])) + "]")
#: One space between ASCII letters or digits: a byte-level tokenizer's match always begins there.
SEAM = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Characters that are encoded in one go.
STRETCH = 1 << 18


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(library) -> tuple[str, ...]:
    return tuple(t.content for t in library.get_added_tokens_decoder().values())


def stretches(text: str, most: int = STRETCH) -> list[str]:
    """The text, cut at seams into stretches of about `most` characters; one without a seam stays whole."""
    out, low = [], 0
    while len(text) - low > most and (seam := SEAM.search(text, low + most)):
        out.append(text[low : seam.start()])
        low = seam.start()
    return [*out, text[low:]]


class ByteEncoder:
    """Ids of whole texts by a byte-level tokenizer. `ranks` may name its vocabulary as merge ranks for tiktoken."""

    def __init__(self, path: str, ranks: str | None = None):
        self.library = load(path)
        self.special = special_strings(self.library)
        self.by_ranks = self._ranked(ranks) if ranks else None

    @staticmethod
    def _ranked(path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _by_library(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as uint32."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.by_ranks is None or ODD_SPACE.search(text) or any(s in text for s in self.special):
            found = [self._by_library(part) for part in stretches(text)]
        else:
            found = [self.by_ranks.encode_to_numpy(part, disallowed_special=()) for part in stretches(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)


class UnitCounter:
    """Token counts by a tokenizer that drops white space, remembered per unit between white space.

    No match of its pre-tokenizer crosses ASCII white space, so a text's count is the sum of its units'. The memory
    has two generations and a bound, so that frequent units survive when it is full; 0 remembers nothing.
    """

    def __init__(self, path: str, memory: int = 400_000):
        self.library = load(path)
        self.special = special_strings(self.library)
        self.memory = memory
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False))

    def _learn(self, units: set[str]) -> None:
        new = units.difference(self.known)
        if len(self.known) + len(new) > self.memory // 2:
            self.older, self.known, new = self.known, {}, units
        again = new.intersection(self.older)
        self.known.update({u: self.older[u] for u in again})
        rest = list(new.difference(again))
        for low in range(0, len(rest), 2000):  # many units as one text, told apart by their tokens' offsets
            some = rest[low : low + 2000]
            got = self.library.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0, *(len(u) + 1 for u in some)])
            cuts = np.searchsorted(np.fromiter((o[0] for o in got.offsets), np.int64, len(got)), starts)
            self.known.update(zip(some, np.diff(cuts).tolist()))

    def count_many(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if not self.memory:
            return [self.whole(t) for t in texts]
        cut = [None if ODD_SPACE.search(t) else t.split() for t in texts]  # split() cuts at ASCII white space alone then
        new = set().union(*[u for u in cut if u])
        if not new <= self.known.keys():
            self._learn(new)
        known = self.known.__getitem__
        return [self.whole(t) if units is None else sum(map(known, units)) for t, units in zip(texts, cut)]


_kept: dict[tuple, object] = {}


def process_own(kind, *args):
    """The process's own encoder: a Python worker keeps it over its tasks."""
    if (kind, args) not in _kept:
        _kept[kind, args] = kind(*args)
    return _kept[kind, args]
