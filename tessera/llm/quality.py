"""Quality by an interpolated modified Kneser-Ney language model.

The model's tokens are bytes, its n-grams of order 5 (see `ngrams`). Counts come from all trusted text. Trusted
documents are dealt into folds by a hash of their text, so that copies meet in one fold, and each is scored by the
counts of the other folds: its perplexity is that of a text the model hasn't seen, as it is for all other documents.
A document is kept if its perplexity isn't above a quantile of the trusted ones' in its language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, sized
from .ngrams import held_out, in_blocks, ngram_counts, probabilities, score_rows

#: Folds of trusted documents.
FOLDS = 3
#: A text's mean is drawn to the trusted mean as by so many symbols more; so short texts don't swing.
PRIOR = 64
#: The quantile of a language's trusted perplexities.
QUANTILE = 0.995
#: A language's quantile is drawn to that of all languages' deviations from their means, as by so many documents more.
SHRUNK = 50


def _discount_values(table: DataFrame, models: list[str]) -> dict[str, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of each model from its counts of counts."""
    n = table.agg(*[F.count(F.when(F.col(m) == k, 1)).alias(f"{m}_{k}") for m in models for k in (1, 2, 3, 4)]).first()
    out = {}
    for m in models:
        n1, n2, n3, n4 = (float(n[f"{m}_{k}"]) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        usual = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3) if n1 and n2 and n3 else (0.5, 0.75, 0.9)
        out[m] = tuple(min(max(d, low), high) for d, low, high in zip(usual, (0.05, 0.1, 0.1), (0.95, 1.9, 2.9)))
    return out


def _smoothing(table: DataFrame, models: list[str]) -> dict[str, tuple[Column, Column, Column]]:
    """What a count keeps, a context's total, and its share for the lower order: all that its counts have lost."""
    out, values = {}, _discount_values(table, models)
    for m in models:
        d1, d2, d3 = values[m]
        c = F.col(m)
        discount = F.least(F.when(c == 1, d1).when(c == 2, d2).otherwise(d3), c)
        out[m] = (c - discount, F.sum(c), F.try_divide(F.sum(discount), F.sum(c)))
    return out


def kneser_ney(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (code, *models): the probability of each wanted n-gram's last byte after the others. `counts` may be empty.

    p(order n) is the discounted count over the context's total, plus what the context holds back times p(order n-1).
    Lower orders count the distinct bytes before an n-gram.
    """
    return probabilities(counts, wanted, lambda m: F.count(F.when(F.col(m) > 0, 1)), _smoothing)


def log_likelihoods(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, model, n, ll) of every document; `model` is above 0 for those with a trusted doc_id. Written."""
    text = lambda c: F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
    rows, written = in_blocks(docs.select("doc_id", text("lang"), text("text")))
    known = trusted.select(F.col("doc_id").alias("trusted_id"))
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    rows = rows.join(known, F.col("doc_id") == F.col("trusted_id"), "left").withColumn("model", F.when(F.col("trusted_id").isNotNull(), fold + 1).otherwise(0))
    folds = [f"f{k}" for k in range(FOLDS)]

    def values(wanted: DataFrame) -> DataFrame:
        found = kneser_ney(held_out(ngram_counts(rows.filter("model > 0").select((F.col("model") - 1).alias("g"), "text"), folds), folds), wanted)
        out = found.select("code", *[F.log2(m).alias(m) for m in found.columns[1:]])
        out.written_at = found.written_at
        return out

    out = score_rows(rows, ["doc_id", "lang", "model"], values)
    release(written)
    return out


def quality_report(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Rows (doc_id, lang, perplexity, threshold, keep) for every document.

    Trusted text is that of documents labelled quality 1, of repeated rows as often as they occur; each is scored without
    its fold's counts. A language's threshold is the quantile of its trusted documents' perplexities, drawn towards its
    mean plus all languages' quantile of deviations where it has few. A null or empty text has the prior's perplexity; a
    long text is scored as a whole, slice by slice; a null language is one of its own; a language without any trusted
    document gets the threshold of all; ties with the threshold stay. Without trusted text every document stays. An empty
    table gives no rows; other columns are not looked at.
    """
    trusted = sized(labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "trusted")
    scored = log_likelihoods(docs, trusted)
    release(trusted)
    total = scored.filter("model > 0").agg(F.sum("ll").alias("ll"), F.sum("n").alias("n")).first()
    mean = total.ll / total.n if total.n else -8.0
    scored = scored.withColumn("bits", -(F.col("ll") + F.lit(PRIOR * mean)) / (F.col("n") + F.lit(PRIOR)))
    known = scored.filter("model > 0")
    at = lambda x: F.percentile_approx(x, quantile, 10_000)
    by_lang = sized(known.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("docs"), F.avg("bits").alias("middle"), at("bits").alias("own")), "languages")
    same = F.col("lang").eqNullSafe(F.col("l"))
    overall = known.join(by_lang, same).agg(at("bits").alias("t"), at(F.col("bits") - F.col("middle")).alias("spread")).first()
    lit = lambda x: F.lit(x).cast("double")
    own = (F.col("docs") * F.col("own") + SHRUNK * (F.col("middle") + lit(overall.spread))) / (F.col("docs") + SHRUNK)
    limit = F.coalesce(own, lit(overall.t), F.lit(float("inf")))
    out = scored.join(by_lang, same, "left")
    return out.select("doc_id", "lang", F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), limit).alias("threshold"), (F.col("bits") <= limit).alias("keep"))
