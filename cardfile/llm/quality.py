"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on a bounded sample of labelled rows; every path from a root is
a conjunctive rule; a lasso logistic regression weighs the rules and leaves
most out. The model is a Spark column expression over the statistics.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardfile.llm.workers import give_back
from cardfile.sources.store import cut, text_batches

#: Labelled rows that a fit takes at most; the ones with the least hash of their id.
SAMPLE = 20_000
TREES = 24
DEPTH = 3
#: Of the lasso's penalty.
PENALTY = 0.002
THRESHOLD = 0.3
SEED = 7

STATISTICS = (
    "log_words", "word_length", "upper", "digits", "signs", "signs_per_word", "spaces", "non_ascii", "distinct_words", "top_word",
    "lines", "line_words", "repeated_lines", "long_words", "short_words", "marked_words", "stops", "pipes", "distinct_bytes", "entropy",
)
_UPPER, _LOWER, _DIGIT, _SPACE = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32)))
_HIGH = np.arange(256) >= 128
_SIGN = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH) & (np.arange(256) >= 33)
_MARKED = re.compile(rb"[!#$%&*+/<=>@\\^_`|~]{2,}(?=\s|$)")
_STOP = re.compile(rb"[.!?](?=\s|$)")


def statistics(text: bytes | None) -> list[float]:
    """The numbers that STATISTICS names, of one UTF-8 text; null and empty texts give zeros."""
    text = text or b""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    size, n = len(text), max(1, len(words))
    sums = {k: float(counts[m].sum()) for k, m in (("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("space", _SPACE), ("high", _HIGH), ("sign", _SIGN))}
    letters = max(1.0, sums["upper"] + sums["lower"] + sums["high"])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    share = counts[counts > 0] / size
    return [
        math.log1p(len(words)), float(lengths.sum()) / n, sums["upper"] / letters, sums["digit"] / size, sums["sign"] / size, sums["sign"] / n,
        sums["space"] / size, sums["high"] / letters, len(seen) / n, max(seen.values(), default=0) / n,
        len(lines) / n, n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), float((lengths > 14).sum()) / n,
        float((lengths < 3).sum()) / n, len(_MARKED.findall(text)) / n, len(_STOP.findall(text)) / n, float(counts[124]) / n,
        float((counts > 0).sum()), float(-(share * np.log2(share)).sum()),
    ]


def measured_text(text: Column) -> Column:
    """A struct of the statistics of the whole text."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def measured(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([statistics(t) for t in texts], columns=STATISTICS, dtype="float64")
        give_back()
        return found

    return measured(text.cast("binary"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, bound)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for name, above, bound in self.terms:
            value = F.col(f"{stats}.{name}")
            out = out & (value > bound if above else value <= bound)
        return out


@dataclass(frozen=True)
class Model:
    """Rules with weights; `prior` is the score's logit where no rule holds."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    prior: float

    def score(self, stats: str = "stats") -> Column:
        """Probability of label 1, as built-in expressions only."""
        total = F.lit(self.prior)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(stats), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


_LINE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.Ee]+)\)$")


def tree_rules(described: str) -> list[Rule]:
    """Every path below the roots of a forest's printed form, the shortest first."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in described.splitlines():
        if "Tree" in line:
            path = []
        if m := _LINE.match(line):
            indent = len(m[1])
            while path and path[-1][0] >= indent:
                path.pop()
            path.append((indent, (STATISTICS[int(m[3])], m[4] == ">", float(m[5]))))
            tightest: dict[tuple[str, bool], float] = {}
            for _, (name, above, bound) in path:
                old = tightest.get((name, above))
                tightest[name, above] = bound if old is None else (max if above else min)(old, bound)
            found[Rule(tuple(sorted((n, a, b) for (n, a), b in tightest.items())))] = None
    return sorted(found, key=lambda r: (len(r.terms), r.terms))


def sample_ids(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """At most `sample` labelled ids, by the least hash; an id labelled twice counts once, with its greatest label."""
    once = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("label"))
    return once.orderBy(F.xxhash64("_id"), "_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Model:
    """The model of the labelled rows of docs.

    At most `sample` labelled ids are used; an id that docs repeats gives each
    of its texts. Null labels and ids are left out. Without both labels there
    are no rules and the score is the share of label 1, or a half without rows.
    """
    chosen = sample_ids(labels, id_col, label_col, sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = text_batches(rows).select("_id", "label", measured_text(F.col("_text")).alias("stats"))
    # dealt and sorted by id, so that the fit is the same in every run
    rows = cut(rows.repartition(4, F.xxhash64("_id")).sortWithinPartitions("_id", "stats").drop("_id").withColumn("features", array_to_vector(F.array(*[f"stats.{s}" for s in STATISTICS]))), "sample")
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or not 0 < ones < n:
        share = (ones + 0.5) / (n + 1) if n else 0.5
        return Model((), (), math.log(share / (1 - share)))
    rows = rows.persist()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5, seed=SEED).fit(rows)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        rows.unpersist()
        return Model((), (), math.log(ones / (n - ones)))
    held = rows.select("label", array_to_vector(F.array(*[r.column("stats").cast("double") for r in rules])).alias("features")).persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=True).fit(held)
    held.unpersist()
    rows.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return Model(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(lasso.intercept))


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with the score of each whole text, 0 to 1; null and empty texts score like the statistics of no text.

    A column named like the score is replaced, others are kept whatever their names.
    """
    own = text_batches(docs).select(F.struct("*").alias("row"), measured_text(F.col(text_col)).alias("stats"))
    return own.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != into], model.score("stats").alias(into))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the rows whose labels are never learned; null for a null id, which is not learned from either."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **settings) -> DataFrame:
    """The rows of docs, with their own columns, that score at least `threshold`, by a model of the labels not held out.

    Null and empty texts are scored like any, long ones whole, repeated rows
    each; ids are only used to learn. An empty table gives an empty table.
    """
    model = fit(docs, labels.where(~held_out(id_col)), id_col, text_col, **settings)
    own = text_batches(docs).select(F.struct("*").alias("row"), measured_text(F.col(text_col)).alias("stats"))
    return own.where(model.score("stats") >= threshold).select("row.*")
