"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel of two words sums, over all ordered triples of letters that both contain with steps of at most REACH
between neighbours, the decayed lengths DECAY^span of their occurrences, and is raised to POWER (a product of kernels,
so a kernel), which sets whole matches off from partial ones. An insult with characters inserted or left out still has
most of its triples. Words are not compared with each other but with a few landmarks (Nyström): stems that mark
labelled toxic text, and ordinary words. The map of a word is its kernel values with the landmarks times the inverse
root of the landmarks' own kernel matrix; products of mapped landmarks give that matrix back. A sentence pools its
words' kernel values by their greatest before the map. A linear squared-hinge machine is trained on labelled
sentences, and a document is as toxic as its most toxic sentence.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, fold_of, materialize, row_slices, string_column

#: Decay of a letter of span, and the longest step between neighbours of a triple.
DECAY, REACH = 0.8, 3
#: Landmarks of either kind, the power of the kernel, and what steadies the landmarks' matrix, of its mean diagonal.
STEMS, ORDINARY, POWER, RIDGE = 64, 16, 3, 1e-4
#: The fit's bounds: rows of each label, whatever their length.
TOXIC_ROWS, CLEAN_ROWS = 1000, 2000
#: Bytes that are looked at together, and words.
SLICE, WORDS = 1 << 18, 4096
_GAP, _NONE = -1, -2


def _symbol_table() -> np.ndarray:
    """Bytes to symbols 0..61: letters whatever their case, digits that stand for letters, bytes beyond ASCII."""
    table = np.full(256, _NONE, np.int8)
    for k in range(26):
        table[65 + k] = table[97 + k] = k
    for digit, letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}.items():
        table[ord(digit)] = ord(letter) - 97
    for k, digit in enumerate("2689"):
        table[ord(digit)] = 26 + k
    table[128:192] = 30 + (np.arange(64) & 31)
    table[[9, 10, 11, 12, 13, 32]] = _GAP
    return table


SYMBOL = _symbol_table()
SENTENCE = np.zeros(256, bool)
SENTENCE[[10, 33, 46, 63]] = True


@dataclasses.dataclass
class Letters:
    """Letters of many rows without what lies between: each one's word and sentence, and sentences' rows."""

    symbol: np.ndarray
    word: np.ndarray
    sentence: np.ndarray
    row_of_sentence: np.ndarray
    opens: bool = True  # whether letters come before the first sentence end


def _sentence_ends(data: np.ndarray) -> np.ndarray:
    """Where sentences end: . ! ? before white space or at the end of the data, and line ends."""
    ends = SENTENCE[data]
    ends[:-1] &= (SYMBOL[data[1:]] == _GAP) | (data[:-1] == 10)
    return ends


def letters_of(data: np.ndarray, offsets: np.ndarray) -> Letters:
    """Words end at white space; words of one letter that follow each other ("i d i o t") are one word.

    Punctuation inside a word is passed over.
    """
    n = len(data)
    sym = SYMBOL[data]
    row_start = np.zeros(n + 1, np.int32)
    np.add.at(row_start, offsets[:-1], 1)
    sentence_at = np.cumsum(row_start[:n] + np.concatenate(([0], _sentence_ends(data)[:-1])) if n else row_start[:0])
    word_at = np.cumsum(row_start[:n] + (sym == _GAP))
    kept = np.flatnonzero(sym >= 0)
    if not len(kept):
        return Letters(*(np.zeros(0, np.int64),) * 4, False)
    symbol, word, sentence = sym[kept].astype(np.int32), word_at[kept], sentence_at[kept]
    new_word = np.concatenate(([True], word[1:] != word[:-1]))
    starts = np.flatnonzero(new_word)
    single = np.diff(np.append(starts, len(symbol))) == 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1] & (sentence[starts[1:]] == sentence[starts[:-1]])
    word = np.repeat(np.cumsum(~joined) - 1, np.diff(np.append(starts, len(symbol))))
    sentences, sentence = np.unique(sentence, return_inverse=True)
    first = kept[np.concatenate(([True], sentence[1:] != sentence[:-1]))]
    return Letters(symbol, word, sentence, np.searchsorted(offsets, first, side="right") - 1, bool(sentences[0] == sentence_at[0]))


def triples(symbol: np.ndarray, word: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of every letter triple inside a word; with a table, codes it maps to 0 are left out."""
    words, codes, weights = [], [], []
    for g in range(1, REACH + 1):
        for h in range(1, REACH + 1):
            span = g + h
            if len(symbol) <= span:
                continue
            code = (symbol[:-span] << 12) | (symbol[g : len(symbol) - h] << 6) | symbol[span:]
            ok = word[:-span] == word[span:]
            if wanted is not None:
                code = wanted[code]
                ok &= code > 0
            at = np.flatnonzero(ok)
            words.append(word[at])
            codes.append(code[at])
            weights.append(np.full(len(at), DECAY ** (span + 1), np.float32))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(words), np.concatenate(codes), np.concatenate(weights)


def _pieces(data: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """(piece, whether it ends where a sentence does) of a long row: about SLICE bytes each, cut behind the last sentence end.

    A sentence without end for so long is cut between two words of several letters; such a piece holds nothing else.
    """
    low, size = 0, SLICE
    while low < len(data):
        window = data[low : low + size]
        if low + size >= len(data):
            yield window, True
            return
        ends = np.flatnonzero(_sentence_ends(window)[:-1])
        if len(ends):
            yield window[: ends[-1] + 1], True
            low, size = low + int(ends[-1]) + 1, SLICE
            continue
        sym = SYMBOL[window]
        between = np.flatnonzero((sym[2:-2] == _GAP) & (sym[:-4] >= 0) & (sym[1:-3] >= 0) & (sym[3:-1] >= 0) & (sym[4:] >= 0))
        if len(between):
            yield window[: between[-1] + 3], False
            low, size = low + int(between[-1]) + 3, SLICE
        else:
            size *= 2


@dataclasses.dataclass
class StringKernelSVM:
    """Landmarks as triple weights, the Nyström map, the machine and its calibration."""

    wanted: np.ndarray  # code -> row of `first`, 0 for none
    first: np.ndarray  # where a code's entries begin
    landmark: np.ndarray  # an entry's landmark
    weight: np.ndarray  # and its weight there
    n: int
    whiten: np.ndarray
    slope: np.ndarray | None = None
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def with_landmarks(cls, landmarks: list[np.ndarray]) -> StringKernelSVM:
        symbol = np.concatenate(landmarks).astype(np.int32)
        owner = np.repeat(np.arange(len(landmarks)), [len(x) for x in landmarks])
        which, codes, weight = triples(symbol, owner)
        n = len(landmarks)
        entries, at = np.unique(codes.astype(np.int64) * n + which, return_inverse=True)
        known, first = np.unique(entries // n, return_index=True)
        wanted = np.zeros(1 << 18, np.int32)
        wanted[known] = np.arange(1, len(known) + 1)
        model = cls(wanted, np.concatenate(([0], first, [len(entries)])), entries % n, np.bincount(at, weight, len(entries)), n, np.eye(n))
        gram = model.kernel(Letters(symbol, owner, owner, np.arange(n))) ** POWER
        values, vectors = np.linalg.eigh(gram + RIDGE * np.trace(gram) / n * np.eye(n))
        model.whiten = (vectors / np.sqrt(values)) @ vectors.T
        return model

    def kernel(self, letters: Letters) -> np.ndarray:
        """Each sentence's words' greatest kernel value with each landmark, before the power."""
        out = np.zeros((len(letters.row_of_sentence), self.n))
        word, row, weight = triples(letters.symbol, letters.word, self.wanted)
        if not len(word):
            return out
        order = np.argsort(word, kind="stable")
        word, row, weight = word[order], row[order], weight[order]
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        sentence = letters.sentence[np.searchsorted(letters.word, word[heads])]
        for low in range(0, len(heads), WORDS):
            begin, stop = heads[low], heads[low + WORDS] if low + WORDS < len(heads) else len(word)
            rows = row[begin:stop]
            counts = self.first[rows + 1] - self.first[rows]
            entry = np.arange(counts.sum()) + np.repeat(self.first[rows] - (np.cumsum(counts) - counts), counts)
            place = np.repeat(np.searchsorted(heads[low : low + WORDS], np.arange(begin, stop), side="right") - 1, counts)
            words = len(heads[low : low + WORDS])
            value = np.bincount(place * self.n + self.landmark[entry], self.weight[entry] * np.repeat(weight[begin:stop], counts), words * self.n).reshape(words, self.n)
            of = sentence[low : low + WORDS]
            new = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            out[of[new]] = np.maximum(out[of[new]], np.maximum.reduceat(value, new, axis=0))
        return out

    def features(self, letters: Letters) -> np.ndarray:
        """The Nyström map of each sentence."""
        return self.kernel(letters) ** POWER @ self.whiten

    def margins(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each row's greatest sentence margin; a row without letters has the bias alone."""
        out, direct = np.full(len(ends) - 1, self.bias), self.whiten @ self.slope
        for low, high in row_slices(ends, SLICE):
            start, stop = int(ends[low]), int(ends[high])
            if stop - start > SLICE:
                out[low] = max(out[low], self._long_margin(flat[start:stop], direct))
                continue
            letters = letters_of(flat[start:stop], ends[low : high + 1] - start)
            np.maximum.at(out, low + letters.row_of_sentence, self.kernel(letters) ** POWER @ direct + self.bias)
        return out

    def _long_margin(self, data: np.ndarray, direct: np.ndarray) -> float:
        """The greatest margin in one long row, piece by piece; a sentence that goes on keeps its pooled values."""
        best, held = self.bias, np.zeros((1, self.n))
        for piece, ended in _pieces(data):
            letters = letters_of(piece, np.asarray([0, len(piece)]))
            pooled = self.kernel(letters)
            if letters.opens:
                pooled[0] = np.maximum(pooled[0], held[0])
            else:
                pooled = np.concatenate((held, pooled))
            if ended:
                best = max(best, float((pooled**POWER @ direct).max() + self.bias))
                pooled = np.zeros((1, self.n))
            held = pooled
        return best

    def scores(self, margins: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """The linear machine of least |w|^2/2 + sum cost * max(0, 1 - y (wx + b))^2, by Newton steps."""
    data = np.column_stack((x, np.ones(len(x)))).astype(np.float64)
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    w = np.zeros(data.shape[1])
    for _ in range(30):
        inside = y * (data @ w) < 1
        weighted = data[inside] * cost[inside, None]
        new = np.linalg.solve(ridge + weighted.T @ data[inside], weighted.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid: labels smoothed by their counts, fitted by damped Newton steps."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta, data = np.asarray([1.0, 0.0]), np.column_stack((margins, np.ones(len(margins))))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ theta, -30, 30)))
        hessian = data.T @ (data * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, data.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - np.clip(step, -1, 1)
    return max(0.05, float(theta[0])), float(theta[1])


def _grams(letters: Letters, size: int) -> np.ndarray:
    """Codes of the runs of `size` letters inside words."""
    s = letters.symbol.astype(np.int64)
    if len(s) < size:
        return np.zeros(0, np.int64)
    code = np.zeros(len(s) - size + 1, np.int64)
    for k in range(size):
        code = (code << 6) | s[k : len(s) - size + 1 + k]
    return np.unique(code[letters.word[: len(code)] == letters.word[size - 1 :]])


def choose_landmarks(docs: list[Letters], labels: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Stems that mark toxic rows, chosen to cover them one after another, and ordinary words of the others."""
    toxic = np.flatnonzero(labels > 0)
    candidates: list[tuple[int, int, np.ndarray, float]] = []
    for size in (8, 7, 6, 5, 4):
        sets = [_grams(d, size) for d in docs]
        codes = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(docs)), [len(s) for s in sets])
        known, at = np.unique(codes, return_inverse=True)
        hot = np.bincount(at, labels[owner] > 0, len(known))
        cold = np.bincount(at, labels[owner] == 0, len(known))
        odds = np.log((hot + 0.5) / (len(toxic) + 1)) - np.log((cold + 0.5) / (len(docs) - len(toxic) + 1))
        value = hot * np.maximum(odds - 1.5, 0)
        best = np.argsort(-value, kind="stable")[:600]
        best = best[(hot[best] >= 3) & (value[best] > 0)]
        chosen = np.full(len(known), -1)
        chosen[best] = np.arange(len(best))
        rows: list[list[int]] = [[] for _ in best]
        for k, doc in zip(chosen[at], owner):
            if k >= 0 and labels[doc] > 0:
                rows[k].append(doc)
        candidates += [(size, int(known[b]), np.asarray(r), float(odds[b])) for b, r in zip(best, rows)]
    place = {d: k for k, d in enumerate(toxic)}
    cover = np.zeros((len(candidates), len(toxic)), bool)
    for k, (_, _, rows, _) in enumerate(candidates):
        cover[k, [place[d] for d in rows]] = True
    weight = np.asarray([odds * (1 + 0.05 * size) for size, _, _, odds in candidates])
    need = np.ones(len(toxic))
    stems: list[np.ndarray] = []
    while len(candidates) and len(stems) < STEMS:
        gain = (cover @ need) * weight
        k = int(gain.argmax())
        if cover[k] @ need < 1:
            break
        size, code, _, _ = candidates[k]
        stems.append(np.asarray([(code >> (6 * (size - 1 - j))) & 63 for j in range(size)]))
        weight[k] = 0
        need[cover[k]] *= 0.3  # a row may hold several insults: later stems still gain a little from it
    rng = np.random.default_rng(seed)
    clean = np.flatnonzero(labels == 0)
    for d in rng.permutation(clean)[: 4 * ORDINARY]:
        letters = docs[d]
        words = [w for w in np.split(letters.symbol, np.flatnonzero(np.diff(letters.word)) + 1) if 4 <= len(w) <= 10]
        if words and len(stems) < STEMS + ORDINARY:
            stems.append(words[int(rng.integers(len(words)))])
    return stems


def fit(texts: list[str], labels: list[int]) -> StringKernelSVM | None:
    """A machine from labelled texts. A toxic text's label belongs to one of its sentences: the most toxic by the last fit."""
    y = np.asarray(labels)
    if not (y > 0).any() or not (y == 0).any():
        return None
    docs = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        docs.append(letters_of(data, np.asarray([0, len(data)])))
    landmarks = [x for x in choose_landmarks(docs, y) if len(x) >= 3]
    if not landmarks:
        return None
    model = StringKernelSVM.with_landmarks(landmarks)
    features = [model.features(d).astype(np.float32) for d in docs]
    zero = np.zeros(len(landmarks), np.float32)
    chosen = [x[np.linalg.norm(x, axis=1).argmax()] if len(x) else zero for x in features]
    ratio = float((y == 0).sum()) / float((y > 0).sum())
    for _ in range(3):
        rows, sign, cost = [], [], []
        for x, k, one in zip(features, y, chosen):
            if k > 0:
                if one.any():  # a toxic text none of whose sentences is near a landmark teaches nothing
                    rows.append(one)
                    sign.append(1.0)
                    cost.append(10.0 * min(ratio, 10))
            else:
                rows += [zero, *x]
                sign += [-1.0] * (1 + len(x))
                cost += [10.0 / (1 + len(x))] * (1 + len(x))
        model.slope, model.bias = squared_hinge(np.asarray(rows), np.asarray(sign), np.asarray(cost))
        chosen = [x[(x @ model.slope).argmax()] if len(x) else zero for x in features]
    margins = np.asarray([max([model.bias, *(x @ model.slope + model.bias)]) for x in features])
    model.scale = _calibrated(margins, y)
    return model


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most TOXIC_ROWS and CLEAN_ROWS documents outside the held-out fold, drawn by a hash of the id.

    The draw is made in the cluster over (id, label) pairs of documents that have a text; only what is drawn travels, of
    rows that repeat an id the least text alone.
    """
    fold = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), 5) != 0))
    known = fold.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    known = materialize(known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    draw = F.xxhash64("doc_id", F.lit(13))
    of = lambda label, n: known.filter(F.col("toxic") == label).select("doc_id", "toxic", draw.alias("d")).orderBy("d", "doc_id").limit(n)
    drawn = materialize(of(1, TOXIC_ROWS).unionAll(of(0, CLEAN_ROWS)), "drawn")
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic", "d").agg(F.min("text").alias("text")).orderBy("d", "doc_id")
    taken = [(r.text, r.toxic) for r in rows.toLocalIterator()]
    return [t for t, _ in taken], [y for _, y in taken]


def score_toxicity(docs: DataFrame, model: StringKernelSVM | None) -> DataFrame:
    """Rows (doc_id, score) for every document; map-only, every byte is read. Without a model the score is 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if own is None:
                scores = np.zeros(batch.num_rows)
            else:
                flat, ends = byte_view(string_column(batch, "text"))
                scores = own.scores(own.margins(flat, ends))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every document.

    A null or empty text has no letters and scores as such. Repeated rows, also of training documents, score as often as
    they occur; a null doc_id is in no fold (held_out null) and never trains. A text of several labels counts as toxic if
    one says so. Long texts are scored piece by piece as if whole. Other columns are not looked at. Without labels of
    both kinds every score is 0; an empty table gives no rows.
    """
    texts, y = training_sample(docs, labels)
    out = score_toxicity(docs, fit(texts, y))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
