"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to column expressions.

Small trees are boosted on statistics of labelled texts; every path from a root to a node becomes a rule,
a conjunction of comparisons. A lasso logistic regression over the rules keeps few of them, and those are
compiled to one Spark expression, so scoring is a projection.

The fit uses at most ``MOST_FIT`` labelled rows, those with the least hash of their doc_id, out of the
rows that may be learnt from; trees and weights are fitted on the driver from their statistics alone.

Cases: a null text counts as empty and is scored as such; a doc_id labelled twice counts as good if any
label says so; documents that share a doc_id are each scored, and the fit takes one of them; without
labelled rows every score is 0.5, with one class only it is that class's smoothed rate; null doc_ids are
held out; further columns are carried along.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import fresh, held_out, learn_from, table

MOST_FIT = 8_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 40, 3, 32, 0.3, 10
#: Weight of the lasso penalty, and steps of the solver.
LASSO, STEPS = 5e-4, 600
THRESHOLD = 0.3
MARKS = r"!|#$%&*<>{}\[\]/=~^_@+\\"


def statistics(text: str) -> dict[str, Column]:
    """Column expressions that describe a whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    each = F.greatest(n, F.lit(1)).cast("double")
    only = lambda what: F.length(F.regexp_replace(t, f"[^{what}]+", "")) / each
    words, lines = F.split(t, r"\s+"), F.split(t, "\n")
    return {
        "log_chars": F.log1p(n.cast("double")),
        "upper": only(r"\p{Lu}"),
        "digit": only("0-9"),
        "marks": only(MARKS),
        "points": only(".,;:"),
        "space": F.length(F.regexp_replace(t, r"\S+", "")) / each,
        "other": F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "")) / each,
        "word_chars": n / F.greatest(F.size(words), F.lit(1)).cast("double"),
        "new_words": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)).cast("double"),
        "new_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)).cast("double"),
        "line_chars": F.log1p(n / F.greatest(F.size(lines), F.lit(1)).cast("double")),
    }


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold)
Model = tuple[float, list[tuple[Rule, float]]]  # intercept, weighted rules


def _grow(x: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, g: np.ndarray, h: np.ndarray, path: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """Split rows by the best threshold, note each path as a rule, and add the leaves' values to ``out``."""
    best, value = (1e-9, -1, 0), -g[rows].sum() / (h[rows].sum() + 1.0)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST_LEAF:
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f, cuts in enumerate(edges):
            b = x[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, len(cuts) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
            gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
    if best[1] < 0:
        out[rows] += RATE * value
        return
    _, f, k = best
    for above in (False, True):
        step = (*path, (f, above, float(edges[f][k])))
        rules.append(step)
        _grow(x, edges, rows[(x[rows, f] > k) == above], g, h, step, rules, out)


def extract_rules(stats: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees as conjunctions, each once."""
    edges = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(stats.shape[1])]
    x = np.stack([np.searchsorted(e, stats[:, f], side="left") for f, e in enumerate(edges)], 1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    z, rules = np.full(len(y), np.log(rate / (1 - rate))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        _grow(x, edges, np.arange(len(y)), p - y, p * (1 - p), (), rules, z)
    return list(dict.fromkeys(tuple(sorted(r)) for r in rules))


def holds(rule: Rule, stats: np.ndarray) -> np.ndarray:
    ok = np.ones(len(stats), bool)
    for f, above, cut in rule:
        ok &= (stats[:, f] > cut) == above
    return ok


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression, by accelerated proximal steps."""
    r = r.astype(np.float32)  # 0 and 1; half the driver's memory
    w = np.zeros(r.shape[1] + 1)
    v, t = w.copy(), 1.0
    along = lambda u: r @ u[1:].astype(np.float32) + u[0]
    back = lambda e: np.r_[e.sum(), r.T @ e.astype(np.float32)]
    probe = np.ones(len(w))
    for _ in range(30):
        probe = back(along(probe))
        probe /= np.linalg.norm(probe)
    rate = 4 * len(y) / (np.linalg.norm(along(probe)) ** 2 + 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(along(v).astype(np.float64), -30, 30)))
        new = v - rate * back(p - y) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:]


def sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """At most MOST_FIT rows (doc_id, y) to learn from."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(learn_from())
    return known.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_FIT)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text") -> Model:
    """Intercept and weighted rules."""
    chosen = sample(docs, labels, label)
    names = list(statistics(text))
    stats = docs.select("doc_id", F.col(text).alias("_t")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", *[c.alias(k) for k, c in statistics("_t").items()])
    one = stats.groupBy("doc_id", "y").agg(F.min(F.struct(*names)).alias("s"))  # one row an id, whatever its copies
    rows = one.select("y", "s.*").orderBy("doc_id").collect()
    if not rows:
        return 0.0, []
    y, x = np.array([r.y for r in rows], float), np.array([[r[k] for k in names] for r in rows], float)
    if y.min() == y.max():
        rate = float((y.sum() + 1) / (len(y) + 2))
        return float(np.log(rate / (1 - rate))), []
    rules = extract_rules(x, y)
    base, weights = lasso(np.stack([holds(r, x) for r in rules], 1), y) if rules else (float(np.log(y.mean() / (1 - y.mean()))), np.empty(0))
    return base, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w]


def compile_rules(base: float, rules: list[tuple[Rule, float]], names: list[str]) -> Column:
    """1 / (1 + exp(-z)), z the base and the weights of the rules that hold."""
    z = F.lit(base)
    for rule, weight in rules:
        ok = F.lit(True)
        for f, above, cut in rule:
            ok &= (F.col(names[f]) > cut) if above else (F.col(names[f]) <= cut)
        z = z + F.when(ok, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; a column named ``into`` is replaced.

    The statistics come out of a generator, through which nothing is inlined: each is computed once a row, whatever asks
    for the score.
    """
    kept = docs.drop(into)
    told = statistics(text)
    names = fresh(kept, *told)
    wide = kept.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in zip(names, told.values(), strict=True)]))))
    return wide.select(*[F.col(f"`{c}`") for c in kept.columns], compile_rules(*model, names).alias(into))


def keep_good(docs: DataFrame, fit_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold."""
    (score,) = fresh(docs, "score")
    return scored(docs, fit(fit_docs, labels), into=score).where(F.col(score) >= threshold).select(*docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it was held out, its quality score and the prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
