"""URL filters by a character language-model ratio, with DataFrame functions only.

Rules decide the urls they fit.  From those, two smoothed variable-order Markov models
of characters are counted, one of accepted and one of rejected urls (orders 0 to 3,
interpolated with Witten-Bell weights).  Every url's score is the difference of its two
log-likelihoods over its length; the threshold is calibrated on the urls with a rule.
The models read the whole url string as it is; host and path serve the rules only.

Counts are kept per distinct 4-gram, shorter ones are sums of those, so the url
positions are aggregated once and joined once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import stage

ORDER = 3
#: width of the calibration's bins; scores beyond +-RANGE count in the last bin
BIN, RANGE = 0.01, 20.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"),
         UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """Name of the longest rule that fits, or null (equal lengths: block first)."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def _grams(text: Column) -> Column:
    """The 4-gram that ends at each character of the text and at its end mark."""
    padded = F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, ORDER + 1))


def gram_scores(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, ratio: log P(last character | those before) of the accepted minus that of the rejected model.

    ``counts`` has gram, allow, block (of the training urls), ``wanted`` the 4-grams to score.
    """
    classes = ("allow", "block")
    # order k: grams of k + 1 characters, contexts of k
    grams = [counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias(f"g{k}"))
             .agg(*(F.sum(c).alias(f"{c}_n{k}") for c in classes)) for k in range(ORDER + 1)]
    contexts = [g.groupBy(F.substring(f"g{k}", 1, k).alias(f"h{k}"))
                .agg(*(F.sum(f"{c}_n{k}").alias(f"{c}_h{k}") for c in classes),
                     *(F.sum((F.col(f"{c}_n{k}") > 0).cast("long")).alias(f"{c}_t{k}") for c in classes))
                for k, g in enumerate(grams)]
    out = wanted.select("gram", *(F.substring("gram", ORDER + 1 - k, k + 1).alias(f"g{k}") for k in range(ORDER + 1)),
                        *(F.substring("gram", ORDER + 1 - k, k).alias(f"h{k}") for k in range(ORDER + 1)))
    for k in range(ORDER, -1, -1):
        out = out.join(grams[k], f"g{k}", "left")
        out = out.join(contexts[k], f"h{k}", "left")
    # characters never seen: one more than the distinct ones
    letters = grams[0].count() + 1
    logs = {}
    for c in classes:
        n = [F.coalesce(F.col(f"{c}_n{k}"), F.lit(0)) for k in range(ORDER + 1)]
        h = [F.coalesce(F.col(f"{c}_h{k}"), F.lit(0)) for k in range(ORDER + 1)]
        t = [F.coalesce(F.col(f"{c}_t{k}"), F.lit(0)) for k in range(ORDER + 1)]
        p = (n[0] + 1.0) / (h[0] + float(letters))
        for k in range(1, ORDER + 1):
            p = F.when(h[k] > 0, (n[k] + t[k] * p) / (h[k] + t[k])).otherwise(p)
        logs[c] = F.log(p)
    return out.select("gram", (logs["allow"] - logs["block"]).alias("ratio"))


def calibrated(scores: DataFrame) -> float | None:
    """The threshold with the best balanced accuracy on (score, allow, block) rows; None without both classes.

    Scores are counted in bins, at most 2 * RANGE / BIN of them.  Ties go to the threshold nearest 0.
    """
    at = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(int(-RANGE / BIN))), F.lit(int(RANGE / BIN)))
    bins = sorted((r.at, r.allow, r.block) for r in
                  scores.groupBy(at.alias("at")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).collect())
    allow, block = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not allow or not block:
        return None
    best, rejected, accepted = (-math.inf, 0.0, 0.0), 0, allow
    for k, a, b in [*bins, (bins[-1][0] + 1, 0, 0)]:
        right = accepted / allow + rejected / block  # reject what lies below this bin
        best = max(best, (right, -abs(k * BIN), k * BIN))
        accepted, rejected = accepted - a, rejected + b
    return best[2]


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of ``pages`` (page_id, url).

    The rule's verdict holds where one fits; else urls below the calibrated score are
    blocked.  Without training urls of both kinds nothing is blocked by score.  Null urls
    and urls without `://` have an empty host and path; a null url scores as an empty one.
    Other columns are ignored.
    """
    url = F.col("url").cast("string")
    host, path = url_parts(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce(url, F.lit("")).alias("whole"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.col("rule").isin([r.name for r in rules if r.verdict == "block"])
    rows = rows.withColumn("by_rule", F.when(F.col("rule").isNull(), None).when(blocked, "block").otherwise("allow"))
    # each url once: with how often each verdict was given by a rule
    wholes = rows.groupBy("whole").agg(
        F.sum(F.when(F.col("by_rule") == "allow", 1).otherwise(0)).alias("allow"),
        F.sum(F.when(F.col("by_rule") == "block", 1).otherwise(0)).alias("block"))
    wholes = stage(wholes, "url-whole")
    grams = wholes.select("whole", "allow", "block", F.explode(_grams(F.col("whole"))).alias("gram"))
    counts = stage(grams.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "url-grams")
    ratios = stage(gram_scores(counts.filter("allow + block > 0"), counts.select("gram")), "url-ratios")
    scores = stage(grams.join(ratios, "gram").groupBy("whole")
                   .agg(F.avg("ratio").alias("score"), F.first("allow").alias("allow"), F.first("block").alias("block")), "url-scores")
    threshold = calibrated(scores.filter("allow + block > 0"))
    low = F.lit(False) if threshold is None else F.col("score") < threshold
    return (rows.join(scores.select("whole", "score"), "whole")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("by_rule", F.when(low, "block").otherwise("allow")).alias("verdict"), "score"))
