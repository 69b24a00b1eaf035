"""Quality classifier: a sparse rule ensemble.

Statistics of each text are Spark columns. On a bounded sample of labelled rows (`fit_rows`, taken
by a hash of the id; the bound is exact) small regression trees are boosted on the logistic loss;
every path from a root to a node is a rule, a conjunction of comparisons. A lasso logistic
regression over the rules (proximal gradient) keeps few of them. The kept rules and weights are
compiled into one Spark expression, so scoring is a scan without shuffle or Python.

Defined results: a null or empty text has all statistics 0 and is scored like any other. Rows are
judged one by one. Without labelled rows, or with one label only, the score is the smoothed share
of label 1. Labels that are null or belong to no document are not used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statistics: name and SQL over t (text, never null), words, lines.
STATISTICS: dict[str, str] = {
    "n_words": "size(words)",
    "word_chars": "length(t) / greatest(size(words), 1)",
    "upper": "regexp_count(t, '\\\\p{Lu}') / greatest(length(t), 1)",
    "digits": "regexp_count(t, '[0-9]') / greatest(length(t), 1)",
    "marks": "regexp_count(t, '[^\\\\p{L}\\\\p{N}\\\\s.,]') / greatest(length(t), 1)",
    "bangs": "(length(t) - length(replace(t, '!', ''))) / greatest(length(t), 1)",
    "bars": "(length(t) - length(replace(t, '|', ''))) / greatest(length(t), 1)",
    "stops": "regexp_count(t, '[.,]') / greatest(size(words), 1)",
    "distinct_words": "size(array_distinct(words)) / greatest(size(words), 1)",
    "n_lines": "size(lines)",
    "line_chars": "length(t) / greatest(size(lines), 1)",
    "distinct_lines": "size(array_distinct(lines)) / greatest(size(lines), 1)",
    "pairs": "size(filter(zip_with(words, slice(words, 2, greatest(size(words), 1)), (a, b) -> a = b), x -> x)) / greatest(size(words), 1)",
}


def with_statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the `carried` columns and the statistics of each row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    base = base.withColumns({"words": F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != ""), "lines": F.split("t", "\n")})
    return base.select("doc_id", *carried, *(F.expr(sql).cast("double").alias(name) for name, sql in STATISTICS.items()))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is above, threshold), all of which must hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, at in self.conditions:
            out &= (x[:, j] > at) == above
        return out

    def column(self, names: list[str]) -> Column:
        out = None
        for j, above, at in self.conditions:
            one = F.col(names[j]) > F.lit(at) if above else F.col(names[j]) <= F.lit(at)
            out = one if out is None else out & one
        return out


@dataclass
class RuleEnsemble:
    names: list[str]
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self) -> Column:
        """The compiled model: a column over the statistics, between 0 and 1."""
        total = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(self.names), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total += w * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], least: int) -> tuple[float, int, float] | None:
    """The best (gain, statistic, threshold) for gradients g and curvatures h."""
    best = None
    whole = g.sum() ** 2 / (h.sum() + 1)
    for j, points in enumerate(cuts):
        if not len(points):
            continue
        at = np.searchsorted(points, x[:, j], side="left")  # x > points[i] for i < at
        size = len(points) + 1
        n, gs, hs = (np.cumsum(np.bincount(at, w, size))[:-1] for w in (None, g, h))
        gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
        gain[(n < least) | (len(x) - n < least)] = -1
        k = int(gain.argmax())
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = float(gain[k]), j, float(points[k])
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int = 5, rate: float = 0.3) -> list[Rule]:
    """Boosts `trees` trees, each on half of the rows, and returns the paths to all their nodes."""
    rng, margin, found = np.random.default_rng(seed), np.zeros(len(x)), {}
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        half = rng.random(len(x)) < 0.5
        use = [c if rng.random() < 0.7 else c[:0] for c in cuts]
        leaves = [((), np.ones(len(x), bool))]
        for _ in range(depth):
            grown = []
            for path, rows in leaves:
                own = rows & half
                best = _split(x[own], g[own], h[own], use, max(5, len(x) // 500)) if own.sum() > 20 else None
                if best is None:
                    grown.append((path, rows))
                    continue
                for above in (False, True):
                    to = (*path, (best[1], above, best[2]))
                    found[Rule(to)] = None
                    grown.append((to, rows & ((x[:, best[1]] > best[2]) == above)))
            leaves = grown
        for _, rows in leaves:
            own = rows & half
            margin[rows] += rate * g[own].sum() / (h[own].sum() + 1)
    return list(found)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise mean logistic loss + penalty * |weights|, by accelerated
    proximal gradient; the bias is not penalised."""
    mean, scale = z.mean(axis=0), z.std(axis=0)
    scale[scale < 1e-9] = 1
    zs = (z - mean) / scale
    step = 4 / (np.linalg.norm(zs, 2) ** 2 / len(y) + 1)
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(zs @ v + c))) - y
        w2 = v - step * zs.T @ r / len(y)
        w2 = np.sign(w2) * np.maximum(0, np.abs(w2) - step * penalty)
        b2 = c - step * float(r.mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b - float((w / scale) @ mean), w / scale


def fit_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, trees: int = 40, depth: int = 3, penalty: float = 1e-3) -> RuleEnsemble:
    """From documents and labels (doc_id, label); learns from all labelled rows it is given, at most
    `fit_rows` of them: repeated labels count once, of documents with one id the last by text is read."""
    names = list(STATISTICS)
    sample = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("label").cast("double").alias("label")).filter("label is not null and label_id is not null")
    sample = sample.distinct().orderBy(F.xxhash64(F.lit("quality"), "label_id"), "label").limit(fit_rows)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    # of documents that share an id, and so a label, one is learned from
    picked = picked.groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    rows = with_statistics(picked, "label").select("doc_id", "label", *names).toPandas().sort_values(["doc_id", "label"])
    y = (rows["label"].to_numpy() > 0.5).astype(float) if len(rows) else np.zeros(0)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 20 or y.min() == y.max():
        return RuleEnsemble(names, float(np.log(share / (1 - share))))
    x = rows[names].to_numpy(float)
    rules = tree_rules(x, y, trees, depth)
    if not rules:
        return RuleEnsemble(names, float(np.log(share / (1 - share))))
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    bias, weights = lasso_logistic(z, y, penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleEnsemble(names, bias, [rules[i] for i in kept], [float(weights[i]) for i in kept])


def score_quality(docs: DataFrame, model: RuleEnsemble, cut: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 if the score is `cut` or more) of every row."""
    scored = with_statistics(docs).select("doc_id", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
