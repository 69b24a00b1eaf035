"""URL filters by the ratio of two character language models, in DataFrame functions only.

Accepted and rejected URLs each train a Markov model of characters with orders 0 to `order`;
orders are blended by Witten-Bell smoothing, so a long context counts as much as it was seen.
Counts are kept by the n-gram itself, in tables that grow with the input. A character's ratio depends on
its window alone (the character and the `order` before it), so ratios are worked out once a different window
and joined to the windows of each different URL; scores are joined to the rows by URL.
The score is the mean over a URL's characters of the difference of log-likelihoods; its threshold is
calibrated on a fifth of the labelled URLs, which the models don't see, where the two classes' error
rates are closest.

Rules (host, path prefix) come first: a rule fits its host and all subdomains if the path starts with
the rule's; the longest that fits wins. URLs that rules decide are the labelled ones.

Defined results: a null URL, or one without `://`, has empty host and path, fits no rule and scores 0. Where
one of the classes has no URL, the threshold is minus infinity: everything that no rule blocks is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import ascii_lower, stored


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: The rules of the query.
RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = ascii_lower(F.regexp_extract(url, _PARTS, 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = rule.fits(host, path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def spelled(host: Column, path: Column) -> Column:
    """What the models read: host and path, lower case, every digit a 0."""
    return F.translate(F.lower(F.concat(host, path)), "123456789", "000000000")


def _windows(s: Column, order: int) -> Column:
    """For each character of `s` the `order` before it and itself; before the first are \\x01."""
    chars = F.split(F.concat(F.lit("\x01" * order), s), "")
    at = F.sequence(F.lit(0), F.length(s) - 1)
    return F.get(F.transform(F.array(chars), lambda c: F.transform(at, lambda i: F.concat(*(F.get(c, i + j) for j in range(order + 1))))), F.lit(0))


def window_ratios(windows: DataFrame, order: int) -> DataFrame:
    """windows: window (once each), a and r (how often it was seen in accepted and rejected URLs, or 0). Per
    window: ratio, the difference of the log-likelihoods of its last character after those before."""
    # the n-gram of order k is the end of the window, of k + 1 characters
    ends = F.array(*(F.substring("window", order - k + 1, k + 1) for k in range(order + 1)))
    grams = windows.select(F.explode(ends).alias("gram"), "a", "r").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    # a partition has a row for each character that comes after its context: for the empty one, the alphabet
    context = Window.partitionBy(F.expr("substring(gram, 1, length(gram) - 1)"))

    def weights(side: str) -> list[Column]:
        """p = own + rest * p of the order below; a context that was never seen leaves that p as it is."""
        n = F.col(side).cast("double")
        seen, kinds = F.sum(n).over(context), F.count_if(n > 0).over(context)
        total = F.greatest(seen + kinds, F.lit(1.0))
        return [(n / total).alias(f"own_{side}"), F.when(seen > 0, kinds / total).otherwise(F.lit(1.0)).alias(f"rest_{side}")]

    levels = stored(grams.select("gram", *weights("a"), *weights("r")))
    below: DataFrame | None = None
    for k in range(order + 1):
        at = levels.filter(F.length("gram") == k + 1)
        p = {side: F.lit(1 / 64) for side in "ar"}
        if below is not None:
            at = at.join(below, F.substring("gram", 2, k) == F.col("end"))
            p = {side: F.col(f"p_{side}") for side in "ar"}
        below = at.select(F.col("gram").alias("end"), *((F.col(f"own_{side}") + F.col(f"rest_{side}") * p[side]).alias(f"p_{side}") for side in "ar"))
    return below.select(F.col("end").alias("window"), (F.ln("p_a") - F.ln("p_r")).alias("ratio"))


def url_scores(urls: DataFrame, order: int = 3) -> DataFrame:
    """urls: id and s (not empty), once each, a and r (how often the models are to count it as accepted and as
    rejected). `urls` and score: the mean of the ratios over the characters of `s`."""
    at = urls.select("id", "a", "r", F.explode(_windows(F.col("s"), order)).alias("window"))
    windows = at.groupBy("window").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    ratios = stored(window_ratios(windows, order))
    # sums of decimals don't depend on the order of rows
    sums = at.select("id", "window").join(ratios, "window").groupBy("id").agg(F.sum(F.col("ratio").cast("decimal(20,15)")).alias("total"))
    return urls.join(sums, "id").withColumn("score", F.col("total").cast("double") / F.length("s")).drop("total")


def calibrate(scored: DataFrame) -> float:
    """From (accepted, score): the cut where the share of accepted URLs below it and the share of
    rejected URLs not below it are closest."""
    marks = F.array(*(F.lit(i / 200) for i in range(201)))
    found = {r["accepted"]: r["q"] for r in scored.groupBy("accepted").agg(F.percentile_approx("score", marks, F.lit(10_000)).alias("q")).collect()}
    if len(found) < 2:
        return float("-inf")
    accepted, rejected = found[True], found[False]

    def gap(cut: float) -> float:
        return abs(sum(x < cut for x in accepted) - sum(x >= cut for x in rejected))

    values = sorted({*accepted, *rejected})
    cuts = [values[0], *((a + b) / 2 for a, b in zip(values, values[1:], strict=False))]
    least = min(map(gap, cuts))
    best = [c for c in cuts if gap(c) == least]
    return best[len(best) // 2]


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, order: int = 3) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict, score and threshold."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"), spelled(F.col("host"), F.col("path")).alias("s"))
    # the models count every different URL once; what they read may be the same for several
    different = rows.filter("s != ''").select("host", "path", "s", "ruled").distinct()
    held = F.pmod(F.xxhash64(F.lit("fold"), "host", "path"), F.lit(5)) == 0
    allowed, blocked = F.col("ruled") == "allow", F.col("ruled") == "block"
    sums = {"a": allowed & ~held, "r": blocked & ~held, "held_a": allowed & held, "held_r": blocked & held}
    urls = different.groupBy("s").agg(*(F.count_if(c).alias(n) for n, c in sums.items()))
    scored = stored(url_scores(stored(urls.select(F.monotonically_increasing_id().alias("id"), "*")), order))
    # a row for each different URL that is held out
    times = F.concat(*(F.array_repeat(F.lit(side), F.col(n).cast("int")) for n, side in (("held_a", True), ("held_r", False))))
    cut = calibrate(scored.select(F.explode(times).alias("accepted"), "score"))
    out = rows.join(scored.select("s", F.col("score").alias("found")), "s", "left").withColumn("score", F.coalesce("found", F.lit(0.0)))
    method = F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score", F.lit(cut).alias("threshold"))
