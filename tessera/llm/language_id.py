"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes from both ends and gives every byte a distribution over the languages; a
document's probabilities are the mean over all its bytes. Training and inference are numpy: many windows
step through time together, so each step is a few matrix products. Weights are learned by backpropagation
through time: a start with Adam on a bounded, seeded sample of labelled text, then a step down the slope over the
distinct words of all of it, weighted by how often they occur.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import byte_view, fold_of, materialize, release, row_slices, sized, string_column

#: Hidden units of a direction, and bytes of a window.
HIDDEN, WINDOW = 10, 48
#: The start's bounds: rows a language and in all (every language has one at least), whatever their length; steps and windows a step.
ROWS, ROWS_IN_ALL, STEPS, BATCH = 300, 20_000, 260, 192
#: Steps over all words, relative to each weight matrix, of which the first that lowers the loss is taken; bytes of a pass's task; windows at once.
RATES, SHARE, WIDE = (0.004, 0.001, 0.0002, 0.0), 1 << 18, 1024
#: Half the score that CLEAN of the labelled rows reach, found to one of BINS, is the least that identifies; fewer than LABELLED rows set none.
CLEAN, BINS, LABELLED = 0.99, 1 << 16, 50
SLICE = 1 << 18


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclasses.dataclass
class Direction:
    """One gated recurrent unit: inputs (256 x 3H) for update, reset and candidate; recurrence (H x 2H), (H x H)."""

    inputs: np.ndarray
    gates: np.ndarray
    candidate: np.ndarray

    @classmethod
    def random(cls, rng: np.random.Generator, hidden: int) -> Direction:
        scale = 1 / np.sqrt(hidden)
        return cls(*(rng.uniform(-scale, scale, s).astype(np.float32) for s in ((256, 3 * hidden), (hidden, 2 * hidden), (hidden, hidden))))

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = h.shape[1]
        a = self.inputs[x]
        z_r = _sigmoid(a[:, : 2 * n] + h @ self.gates)
        z, r = z_r[:, :n], z_r[:, n:]
        c = np.tanh(a[:, 2 * n :] + (r * h) @ self.candidate)
        return h + z * (c - h), z, r, c


class ByteLanguageModel:
    """Both directions and the output layer (2H x K)."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forward, self.backward = Direction.random(rng, hidden), Direction.random(rng, hidden)
        self.out = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [p for d in (self.forward, self.backward) for p in (d.inputs, d.gates, d.candidate)] + [self.out, self.bias]

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """(T, B, K) of windows (T, B): the scores of each byte."""
        steps, batch = windows.shape
        n = self.forward.gates.shape[0]
        scores = np.empty((steps, batch, len(self.languages)), np.float32)
        h = np.zeros((batch, n), np.float32)
        for t in range(steps):
            h = self.forward.step(windows[t], h)[0]
            np.matmul(h, self.out[:n], out=scores[t])
        h = np.zeros((batch, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h = self.backward.step(windows[t], h)[0]
            scores[t] += h @ self.out[n:]
        scores += self.bias
        return scores

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        p = self.logits(windows)
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        return p

    def gradients(self, windows: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the masked bytes, and its gradient by backpropagation through time."""
        steps, batch = windows.shape
        n = self.forward.gates.shape[0]
        tapes, states = [], []
        for direction, order in ((self.forward, range(steps)), (self.backward, range(steps - 1, -1, -1))):
            h, tape = np.zeros((batch, n), np.float32), {}
            state = np.empty((steps, batch, n), np.float32)
            for t in order:
                new, z, r, c = direction.step(windows[t], h)
                tape[t] = (h, z, r, c)
                h = state[t] = new
            tapes.append((direction, order, tape))
            states.append(state)
        both = np.concatenate(states, axis=2)
        p = both @ self.out + self.bias
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        total = max(1.0, float(mask.sum()))
        picked = p[:, np.arange(batch), labels]
        loss = float(-(np.log(picked + 1e-9) * mask).sum() / total)
        d = p
        d[:, np.arange(batch), labels] -= 1
        d *= (mask / total)[:, :, None]
        grads_out = [np.einsum("tbh,tbk->hk", both, d, optimize=True), d.sum(axis=(0, 1))]
        d_both = d @ self.out.T
        grads = []
        for k, (direction, order, tape) in enumerate(tapes):
            g_in, g_gates, g_cand = (np.zeros_like(p) for p in (direction.inputs, direction.gates, direction.candidate))
            carried, d_in = np.zeros((batch, n), np.float32), np.empty((steps, batch, 3 * n), np.float32)
            for t in reversed(order):
                h, z, r, c = tape[t]
                dh = carried + d_both[t, :, k * n : (k + 1) * n]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                drh = dc @ direction.candidate.T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate((dz, dr), axis=1)
                carried = dh * (1 - z) + drh * r + dzr @ direction.gates.T
                g_cand += (r * h).T @ dc
                g_gates += h.T @ dzr
                d_in[t, :, : 2 * n], d_in[t, :, 2 * n :] = dzr, dc
            by_byte = np.argsort(windows, axis=None, kind="stable")
            seen, firsts = np.unique(windows.ravel()[by_byte], return_index=True)
            g_in[seen] = np.add.reduceat(d_in.reshape(-1, 3 * n)[by_byte], firsts, axis=0)
            grads += [g_in, g_gates, g_cand]
        return loss, grads + grads_out


def windows_of(data: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """A row of bytes as (count, size) windows, the last one filled up with spaces."""
    count = -(-len(data) // size)
    padded = np.full(count * size, 32, np.uint8)
    padded[: len(data)] = data
    return padded.reshape(count, size)


def fit(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = 11) -> ByteLanguageModel:
    """A model of the languages in `samples` (language, text), each language as likely as the others."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in samples})
    model = ByteLanguageModel(languages)
    if len(languages) < 2:
        return model
    texts = [[np.frombuffer(t.encode(), np.uint8) for l, t in samples if l == lang and t] for lang in languages]
    texts = [x or [np.zeros(1, np.uint8) + 32] for x in texts]
    parameters = model.parameters()
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(languages), BATCH)
        windows, mask = np.full((WINDOW, BATCH), 32, np.uint8), np.zeros((WINDOW, BATCH), np.float32)
        for b, k in enumerate(labels):
            text = texts[k][rng.integers(len(texts[k]))]
            length = min(len(text), int(rng.integers(3, WINDOW + 1)) if rng.random() < 0.3 else WINDOW)
            at = int(rng.integers(0, len(text) - length + 1))
            windows[:length, b] = text[at : at + length]
            mask[:length, b] = 1
        _, grads = model.gradients(windows, mask, labels)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(parameters, grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def _teaches() -> Column:
    """Whether a row's label may be learned from."""
    return F.col("lang").isNotNull() & (F.col("lang") != "") & (F.length("text") > 0) & (fold_of(F.col("doc_id"), 4) != 2)


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """The start's (language, whole text): at most ROWS rows a language and ROWS_IN_ALL in all, drawn by a hash of the id.

    Each language's least hashes are found in the cluster over (language, hash, id); only the drawn texts travel.
    """
    lang, number = F.col("lang").cast("string").alias("l"), F.col("doc_id").cast("string")
    labelled = docs.filter(_teaches())
    draw = F.pmod(F.xxhash64(number, F.lit(5)), F.lit(1 << 40)).alias("d")
    ids = labelled.select(lang, draw, "doc_id").distinct()
    counts = sized(ids.groupBy("l").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return []
    # Twice as many rows as wanted pass by their hash, so that a common language doesn't meet in one task.
    most = max(1, min(ROWS, ROWS_IN_ALL // languages))
    near = ids.join(counts, "l").filter(F.col("d") * F.col("n").cast("double") < F.lit((2.0 * most + 50) * (1 << 40))).drop("n")
    place = F.row_number().over(Window.partitionBy("l").orderBy("d", "doc_id"))
    drawn = materialize(near.withColumn("place", place).filter(F.col("place") <= most), "drawn")
    texts = labelled.select(lang, "doc_id", F.col("text").cast("string").alias("t"))
    rows = texts.join(F.broadcast(drawn), ["l", "doc_id"]).select("l", "d", "t").distinct().orderBy("l", "d", "t")
    return [(r.l, r.t) for r in rows.toLocalIterator()]


def scores_of(model: ByteLanguageModel, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each row's probabilities, the mean over its bytes; a row longer than SLICE is taken slice by slice."""
    sums = np.zeros((len(ends) - 1, len(model.languages)))
    whole = max(1, SLICE // WINDOW) * WINDOW
    for low, high in row_slices(ends, whole):
        if ends[high] - ends[low] > whole:
            groups = [[(low, a, min(int(ends[high]), a + whole))] for a in range(int(ends[low]), int(ends[high]), whole)]
        else:
            groups = [[(k, int(ends[k]), int(ends[k + 1])) for k in range(low, high) if ends[k + 1] > ends[k]]]
        for group in groups:
            if not group:
                continue
            lengths = np.asarray([b - a for _, a, b in group])
            counts = -(-lengths // WINDOW)
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            target = np.arange(lengths.sum()) + np.repeat(starts * WINDOW - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
            padded = np.full(int(counts.sum()) * WINDOW, 32, np.uint8)
            padded[target] = flat[group[0][1] : group[-1][2]]
            real = np.zeros(len(padded), np.float32)
            real[target] = 1
            p = model.probabilities(np.ascontiguousarray(padded.reshape(-1, WINDOW).T))
            by_window = np.einsum("tbk,bt->bk", p, real.reshape(-1, WINDOW), optimize=True)
            np.add.at(sums, np.asarray([k for k, _, _ in group]), np.add.reduceat(by_window, starts, axis=0))
    return sums / np.maximum(1, np.diff(ends))[:, None]


def identify(docs: DataFrame, model: ByteLanguageModel | None) -> DataFrame:
    """Rows (row, lang, score, own): each row as a struct, its language (und for a null text or one without a letter), its
    probability, and that of the row's own label where the label may be learned from and the text has a letter (else null).

    Map-only; every byte of every text is read. Memory is bounded by SLICE bytes of windows: a longer text is taken a
    slice at a time. Of languages as likely the first by name is taken. Repeated rows come as often as they are there, an
    empty table gives none; no column name of `docs` clashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ByteLanguageModel | None = shared.value
        for batch in batches:
            letter = np.asarray(batch.column(1).to_pylist(), bool)
            lang, score, own = ["und"] * batch.num_rows, np.zeros(batch.num_rows), [None] * batch.num_rows
            if model is not None and batch.num_rows:
                text = pa.RecordBatch.from_arrays([batch.column(0).field(at)], names=["text"])
                p = scores_of(model, *byte_view(string_column(text, "text")))
                best = p.argmax(axis=1)
                score = np.where(letter, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
                lang = [model.languages[b] if ok else "und" for b, ok in zip(best, letter)]
                labels = pc.index_in(batch.column(2), value_set=pa.array(model.languages, pa.string())).to_pylist()
                own = [None if k is None or not ok else min(1.0, float(p[i, k])) for i, (k, ok) in enumerate(zip(labels, letter))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(own, pa.float64())], names=["row", "lang", "score", "own"])

    label = F.when(_teaches(), F.col("lang").cast("string")) if {"lang", "doc_id"} <= set(docs.columns) else F.lit(None).cast("string")
    rows = docs.select(F.struct("*").alias("row"), letter.alias("letter"), label.alias("label"))
    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("lang", StringType()), StructField("score", DoubleType()), StructField("own", DoubleType())]))


def labelled_words(docs: DataFrame) -> DataFrame:
    """(l, w, n): every distinct word of the rows that teach, by language, and how often it occurs. Longer words are cut at 16 characters."""
    words = docs.filter(_teaches()).select(F.col("lang").cast("string").alias("l"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"\S{1,16}"), F.lit(0))).alias("w"))
    return words.groupBy("l", "w").agg(F.count("*").alias("n"))


def whole_loss(words: DataFrame, model: ByteLanguageModel, totals: dict[str, int], tasks: int, slope: bool) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy of a byte over all words, each language as likely as the others, and its gradient if asked for.

    A task lays its words end to end, a language at a time, and sends one row of sums.
    """
    shapes = [p.shape for p in model.parameters()]
    place = pa.array(model.languages, pa.string())
    share = np.asarray([1 / (totals[lang] * len(totals)) if lang in totals else 0 for lang in model.languages])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, sums = 0.0, [np.zeros(x) for x in shapes]
        for batch in batches:
            labels = pc.index_in(batch.column(0), value_set=place)
            for k in pc.unique(labels.drop_null()).to_pylist():
                rows = batch.filter(pc.equal(labels, k))
                data, ends = byte_view(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), string_column(rows, "w"), pa.scalar("", pa.large_string())))
                weights = np.repeat(rows.column(2).to_numpy() * share[k], np.diff(ends))
                windows = windows_of(data[ends[0] : ends[-1]])
                mask = np.zeros(windows.size, np.float32)
                mask[: len(weights)] = weights
                mask = mask.reshape(windows.shape)
                for low in range(0, len(windows), WIDE):
                    x, m = np.ascontiguousarray(windows[low : low + WIDE].T), np.ascontiguousarray(mask[low : low + WIDE].T)
                    if slope:
                        one, grads = model.gradients(x, m, np.full(x.shape[1], k))
                        for total, g in zip(sums, grads):
                            total += g
                    else:
                        one = -float((np.log(model.probabilities(x)[:, :, k] + 1e-9) * m).sum())
                    loss += one
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([np.concatenate([x.ravel() for x in sums]).tobytes() if slope else b""])], names=["loss", "sums"])

    loss, flat = 0.0, np.zeros(sum(int(np.prod(x)) for x in shapes))
    dealt = words.repartition(tasks, "w").sortWithinPartitions("l", "w")
    for r in dealt.mapInArrow(run, "loss double, sums binary").collect():
        loss += r.loss
        if slope:
            flat += np.frombuffer(r.sums)
    ends = np.cumsum([int(np.prod(x)) for x in shapes])
    return loss, [part.reshape(x) for part, x in zip(np.split(flat, ends[:-1]), shapes)]


def taught(model: ByteLanguageModel, docs: DataFrame) -> ByteLanguageModel:
    """`model`, led down the slope of its loss over every word of all rows that teach, by the first of RATES that lowers it (the last stays).

    The words are counted in the cluster. A pass sends the driver a row a task, and has as many tasks as shuffles at most.
    """
    words = materialize(labelled_words(docs), "words")
    size = F.octet_length("w") + 1
    per = words.groupBy("l").agg(F.sum(F.col("n") * size).alias("bytes"), F.sum(size).alias("distinct")).collect()
    if len(model.languages) > 1 and per:
        width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        tasks = max(1, min(width, sum(r.distinct for r in per) // SHARE))
        parameters, totals = model.parameters(), {r.l: r.bytes for r in per}
        start = [p.copy() for p in parameters]
        least, slope = whole_loss(words, model, totals, tasks, True)
        for rate in RATES:
            for p, kept, g in zip(parameters, start, slope):
                p[...] = kept - rate * np.linalg.norm(kept) / (np.linalg.norm(g) + 1e-12) * g
            if whole_loss(words, model, totals, tasks, False)[0] < least:
                break
    release(words)
    return model


def fitted(docs: DataFrame) -> ByteLanguageModel | None:
    """A model learned from all documents whose fold is not held out; None if none has a language.

    A bounded sample gives the weights to start from, all words the gradient of the step from there.
    """
    samples = training_sample(docs)
    return taught(fit(samples), docs) if samples else None


def least_score(scored: DataFrame) -> float:
    """Half the score that nearly all labelled rows reach in their own language (`own`), counted in bins over all of them."""
    bins = scored.filter("own IS NOT NULL").groupBy(F.floor(F.col("own") * BINS).alias("b")).agg(F.count("*").alias("n")).collect()
    bins = sorted((r.b, r.n) for r in bins)
    rows = sum(n for _, n in bins)
    if rows < LABELLED:
        return 0.0
    below = np.cumsum([n for _, n in bins])
    return 0.5 * bins[int(np.searchsorted(below, (1 - CLEAN) * (rows - 1), side="right"))][0] / BINS


def language_report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) for every document; a null doc_id is in no fold (held_out null) and never trains.

    Nulls and empty texts are `und` with score 0, as are all without a labelled text; long texts are read whole. Repeated
    rows, ties, empty tables and other columns are as in `identify`.
    """
    out = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), fitted(docs))
    return out.select("row.doc_id", (fold_of(F.col("row.doc_id"), 4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents with a language: not `und`, and with the least score for one. Scored rows are written, since that score is found over all of them."""
    scored = materialize(identify(docs, fitted(docs)), "identified")
    return scored.filter((F.col("lang") != "und") & (F.col("score") >= least_score(scored))).select("row.*")
