"""Quality by a sparse ensemble of rules (operator 6).

Statistics of the text, all Spark expressions, are cut by small randomised trees, fitted to a bounded sample of labelled
rows. Each path from a root to a node is a rule: a conjunction of comparisons. A logistic model with an L1 penalty gives
most rules no weight; the others become one Spark expression, so that scoring reads each text once and shuffles nothing.

Defined results: a null text scores as an empty one; without rows of both labels, or with too few of one for a split, the
score is their share of label 1, or 0.5 without any; repeated rows get equal scores; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD
from .sampling import held_out, labelled

#: Labelled rows that a fit takes at most.
MAX_ROWS = 8000
#: feature, True for "<=" and False for ">", threshold
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, wherever the optimizer puts the expression and however often body uses it: as
    the only element of a transformed array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def statistics(text: Column) -> dict[str, Callable[[Column], Column]]:
    """Numbers that describe a text, as functions of its words; all 0 for an empty one."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    number = lambda words: F.greatest(F.size(words), F.lit(1)).cast("double")
    return {
        "log_words": lambda w: F.log1p(F.size(w).cast("double")),
        "chars_per_word": lambda w: F.length(text) / number(w),
        "upper_share": lambda w: count(r"\p{Lu}") / chars,
        "digit_share": lambda w: count("[0-9]") / chars,
        "symbols_per_word": lambda w: count("[#*$%&|<>]") / number(w),
        "shouts_per_word": lambda w: count("[!?]") / number(w),
        "stops_per_word": lambda w: count("[.,;:]") / number(w),
        "lines_per_word": lambda w: count("\n") / number(w),
        "long_per_word": lambda w: count(r"[^\x20\x09-\x0D]{25,}") / number(w),
        "distinct_words": lambda w: F.size(F.array_distinct(w)) / number(w),
    }


def summed(terms: list[Column]) -> Column:
    """The sum of terms, by halves: its depth is the logarithm of their number, where Spark recurses over expressions."""
    half = len(terms) // 2
    return terms[0] if len(terms) == 1 else summed(terms[:half]) + summed(terms[half:])


def described(text: Column) -> Column:
    """The statistics as one struct."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return once(words, lambda w: F.struct(*[F.coalesce(f(w), F.lit(0.0)).alias(n) for n, f in statistics(text).items()]))


def grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], depth: int, rng: np.random.Generator, path: Rule = ()) -> list[Rule]:
    """The rules of a tree whose splits lower the Gini impurity most, among a random third of the features or more."""
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return []
    base, best = len(y) * y.mean() * (1 - y.mean()), (1e-9, -1, 0.0)
    for f in rng.choice(x.shape[1], max(2, x.shape[1] // 3 + 1), replace=False):
        for cut in cuts[f]:
            low = x[:, f] <= cut
            n = int(low.sum())
            if 5 <= n <= len(y) - 5:
                a, b = y[low].mean(), y[~low].mean()
                gain = base - n * a * (1 - a) - (len(y) - n) * b * (1 - b)
                if gain > best[0]:
                    best = gain, int(f), float(cut)
    _, f, cut = best
    if f < 0:
        return []
    out: list[Rule] = []
    for low in (True, False):
        rule = (*path, (f, low, cut))
        side = (x[:, f] <= cut) == low
        out += [rule, *grow(x[side], y[side], cuts, depth - 1, rng, rule)]
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] <= cut) == low for f, low, cut in rule])


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean log loss plus penalty times the sum of absolute weights, by accelerated
    proximal gradient steps. The bias isn't penalised."""
    a = np.column_stack([r, np.ones(len(r))])
    step = 4 * len(a) / (np.linalg.norm(a, 2) ** 2)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - step * (a.T @ (p - y)) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (before - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


@dataclass
class RuleModel:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    bias: float

    def score(self, stats: Column) -> Column:
        """The model as an expression over a struct with the fields `names`."""
        return once(stats, self._of)

    def _of(self, stats: Column) -> Column:
        terms = [F.lit(self.bias)]
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for f, low, cut in rule:
                test = test & (stats[self.names[f]] <= cut if low else stats[self.names[f]] > cut)
            terms.append(F.when(test, weight).otherwise(0.0))
        return 1 / (1 + F.exp(-summed(terms)))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, penalty: float = 0.002, seed: int = 5) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        return RuleModel(names, [], [], float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 25))) for c in x.T]
    rules: dict[bytes, Rule] = {}
    for _ in range(trees):
        part = rng.choice(len(y), max(1, len(y) // 2), replace=False)
        for rule in grow(x[part], y[part], cuts, depth, rng):
            on = holds(rule, x)
            key = np.packbits(on).tobytes()
            if 0 < on.sum() < len(y) and (key not in rules or len(rule) < len(rules[key])):
                rules[key] = rule
    kept = list(rules.values())
    if not kept:  # too few rows of a label for a split
        return RuleModel(names, [], [], float(np.log(y.mean() / (1 - y.mean()))))
    weights, bias = lasso_logistic(np.column_stack([holds(r, x) for r in kept]).astype(float), y, penalty)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel(names, [kept[i] for i in used], [float(weights[i]) for i in used], bias)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id") -> RuleModel:
    """Learns from max_rows labelled rows at most; a dozen numbers of each come to the driver."""
    rows = labelled(docs, labels, "quality", max_rows, id_col=id_col)
    names = list(statistics(F.col("_text")))
    got = rows.select("_id", "_label", described(F.col("_text")).alias("s")).select("_id", "_label", "s.*").toPandas().sort_values(["_id", *names])
    return fit_rules(got[names].to_numpy(float), got["_label"].to_numpy(float), names)


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score and predicted of each row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.select("_id", held_out(F.col("_id")).alias("held_out"), model.score(described(F.col("_text"))).alias("score"))
    return rows.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept_rows(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model predicts as label 1, as they are; nothing is shuffled."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.where(model.score(described(text)) >= 0.5)
