"""URL filter: host and path rules, and for the URLs that none fits the ratio of two character models.

The URLs that a rule accepts and those that one rejects train a model each: a variable-order Markov model over bytes
with Witten-Bell smoothing, which leaves a context's share for the next shorter one by how many bytes have followed
it, and everything where it has never been seen. A URL's score is the difference of its two log2 likelihoods, divided
by its length. The threshold is calibrated on the rules' own URLs, each scored without the counts of its fold.

Counts and scores are joined by n-gram, see `ngrams`: one pass gives the difference, since it is a sum over n-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release
from .ngrams import held_out, in_blocks, ngram_counts, probabilities, score_rows

#: (verdict, host, path); one fits its host and all subdomains where the path begins with its path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Folds of the URLs that rules fit, by a hash of the URL.
FOLDS = 3
#: Scores are counted in bins of 1/BINS, up to MOST bits a byte either way.
BINS, MOST = 256, 16


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first `://` up to `/`, `?`, `#` or the end, in lower case; then up to `?` or `#`."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    of = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(of(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), of(2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null; of rules as long the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _witten_bell(table: DataFrame, models: list[str]) -> dict[str, tuple[Column, Column, Column]]:
    out = {}
    for m in models:
        kinds = F.count(F.when(F.col(m) > 0, 1))
        out[m] = (F.col(m).cast("double"), F.when(F.sum(m) > 0, F.sum(m) + kinds), F.try_divide(kinds, F.sum(m) + kinds))
    return out


def likelihood_ratios(counts: DataFrame, wanted: DataFrame, folds: int) -> DataFrame:
    """Rows (code, m0, m1, ...): log2 of the accepting over the rejecting model's probability, of all folds and without each.

    `counts` has columns a0, a1, ... of accepted and r0, r1, ... of rejected URLs by fold.
    """
    sides = {}
    for side in "ar":
        held = held_out(counts, [f"{side}{k}" for k in range(folds)])
        sides[side] = held.select(F.col("code").alias(f"code_{side}"), *[F.col(m).alias(f"{side}_{m}") for m in held.columns[1:]])
    both = sides["a"].join(sides["r"], F.col("code_a") == F.col("code_r")).withColumnRenamed("code_a", "code").drop("code_r")
    found = probabilities(both, wanted, F.sum, _witten_bell)
    out = found.select("code", *[F.log2(F.col(f"a_m{k}") / F.col(f"r_m{k}")).alias(f"m{k}") for k in range(folds + 1)])
    out.written_at = found.written_at
    return out


def calibrated_threshold(known: DataFrame) -> float | None:
    """The score that best tells accepted from rejected rows (score, verdict), both kinds weighing alike; None if one is absent.

    Of scores as good the one nearest to 0 counts. The scores are counted by bin, at most 2 * MOST * BINS of them.
    """
    at = F.floor(F.least(F.greatest(F.col("score") * BINS, F.lit(-MOST * BINS)), F.lit(MOST * BINS))).cast("int")
    bins = known.groupBy(at.alias("at")).agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("a"), F.count(F.when(F.col("verdict") == "block", 1)).alias("r")).orderBy("at").collect()
    accepted, rejected = sum(b.a for b in bins), sum(b.r for b in bins)
    if not accepted or not rejected:
        return None
    best, lost, caught = [], 0, 0
    for k, b in enumerate([None, *bins]):
        if b is not None:
            lost, caught = lost + b.a, caught + b.r
        low = (b.at + 1) / BINS if b is not None else -float(MOST)
        high = bins[k].at / BINS if k < len(bins) else float(MOST)
        best.append((-(caught / rejected - lost / accepted), abs(t := min(max(0.0, low), high)), t))
    return min(best)[2]


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score) of every page.

    The verdict is the rule's where one fits; else `allow` where the score, which is the length-normalised difference
    above the threshold, is at least 0. Rows that repeat a URL count as often as they occur. A null, empty or odd URL has
    the difference 0; a long one is scored as a whole. Where rules accept none or reject none of the URLs nothing can be
    learned: the score is null, and what no rule fits is allowed. Null page_ids and repeated rows stay; an empty table
    gives no rows; other columns are not looked at.
    """
    rows, written = in_blocks(pages.select("page_id", F.col("url").cast("string").alias("url")))
    rule, verdict = rule_for(*url_parts(F.col("url")), rules)
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    rows = rows.withColumns({"text": F.coalesce("url", F.lit("")), "model": F.when(rule.isNotNull(), fold + 1).otherwise(0), "judged": verdict})
    names = [f"{side}{k}" for side in "ar" for k in range(FOLDS)]

    def values(wanted: DataFrame) -> DataFrame:
        group = F.col("model") - 1 + F.when(F.col("judged") == "block", FOLDS).otherwise(0)
        return likelihood_ratios(ngram_counts(rows.filter("model > 0").select(group.alias("g"), "text"), names), wanted, FOLDS)

    scored = score_rows(rows, ["page_id", "url", "judged"], values).withColumn("score", F.coalesce(F.try_divide("ll", "n"), F.lit(0.0)))
    release(written)
    threshold = calibrated_threshold(scored.filter(F.col("judged").isNotNull()).select("score", F.col("judged").alias("verdict")))
    host, path = url_parts(F.col("url"))
    score = F.lit(None).cast("double") if threshold is None else F.col("score") - F.lit(threshold)
    out = scored.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), F.col("judged"), score.alias("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("judged", F.when(F.col("score") < 0, "block").otherwise("allow")).alias("verdict"), "score")
