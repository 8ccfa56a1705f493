"""Quality classifier: a sparse ensemble of rules, compiled into one column expression.

Statistics of a text are built-in column expressions. Trees are grown on a bounded sample of labelled rows; each path
from a root to a node is a rule, a conjunction of comparisons of statistics; logistic regression with an L1 penalty
gives the rules weights, most of them zero; the rest become a sum of CASE expressions that scores every row.

Defined cases: a null text scores as an empty one. Rows without an id, or whose label is null, are not learned from; a
row labelled more than once is learned from each time. Without labels, or with one label only, the score is the share
of label 1 with one of each added. Labels in other columns of the documents are not read; other columns are kept.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

#: Labelled rows learned from at most: those of least hash, so a fixed random sample of all.
SAMPLE = 20_000
TREES = 20
DEPTH = 3
PENALTY = 0.001
REJECT_BELOW = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """What rules compare; each is a share or a mean, so that long and short texts are alike."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    share = lambda kept: F.length(F.regexp_replace(t, kept, "")) / F.greatest(n, F.lit(1))
    words = F.split(F.trim(t), r"[\x20\x09-\x0D]+")
    lines = F.split(t, "\n")
    return {
        "log_length": F.log1p(n),
        "word_length": n / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "line_length": F.log1p(n / F.size(lines)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "capitals": share(r"[^\p{Lu}]+"),
        "letters": share(r"[^\p{L}]+"),
        "digits": share(r"[^0-9]+"),
        "symbols": share(r"[\p{L}\p{N}\s.,;:?'\"()-]+"),
        "sentence_ends": share(r"[^.?]+"),
    }


NAMES = ["log_length", "word_length", "distinct_words", "line_length", "distinct_lines", "capitals", "letters", "digits", "symbols", "sentence_ends"]


def rules_of(tree: str) -> list[tuple[tuple[int, str, float], ...]]:
    """The paths of a printed tree, from the root to each node: (statistic, `<=` or `>`, threshold), ..."""
    out, path = [], []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if m:
            path = [x for x in path if x[0] < len(m[1])] + [(len(m[1]), (int(m[2]), m[3], float(m[4])))]
            out.append(tuple(x for _, x in path))
    return out


def holds(rule) -> Column:
    out = F.lit(True)
    for i, op, at in rule:
        out = out & (F.col(NAMES[i]) <= F.lit(at) if op == "<=" else F.col(NAMES[i]) > F.lit(at))
    return out


class RuleEnsemble:
    """Rules with their weights, and the intercept."""

    def __init__(self, rules: list, intercept: float):
        self.rules, self.intercept = rules, intercept

    def scored(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """`all, score, place`: the row of `docs`, its score, 0 to 1, and a number that is never negative.

        A filter that reads `place` too stays above the statistics; any other would be pushed below them and work each
        of them out anew for each rule that has it.
        """
        place = F.monotonically_increasing_id().alias("place")
        rows = docs.select(F.struct("*").alias("all"), place, *[y.alias(x) for x, y in statistics(F.col(text)).items()])
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return rows.select("all", (1 / (1 + F.exp(-total))).alias("score"), "place")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Learns from `labels` (`doc_id`, label 0 or 1), already without the rows held out, and the texts in `docs`."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    marks = labels.select("doc_id", F.col(label).cast("double").alias("_label")).where("doc_id IS NOT NULL AND _label IN (0, 1)")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample)
    # at most `sample` pairs of numbers, whatever the input
    rows = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(marks), "doc_id")
    stats = [y.cast("double").alias(x) for x, y in statistics(F.col("_text")).items()]
    seen = scratch.table(rows.select(*stats, F.col("_label").alias("label")), "sample")
    counts = {r["label"]: r["count"] for r in seen.groupBy("label").count().collect()}
    if len(counts) < 2:
        one, all_ = counts.get(1.0, 0) + 1, sum(counts.values()) + 2
        return RuleEnsemble([], math.log(one / (all_ - one)))
    train = seen.coalesce(4).withColumn("features", array_to_vector(F.array(*NAMES))).cache()
    try:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", seed=7, maxBins=64).fit(train)
        paths = dict.fromkeys(r for t in forest.trees for r in rules_of(t.toDebugString))
        rules = sorted(paths, key=lambda r: (len(r), r))
        if not rules:
            return RuleEnsemble([], math.log((counts[1.0] + 1) / (counts[0.0] + 1)))
        marked = train.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features")).cache()
        try:
            lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(marked)
        finally:
            marked.unpersist()
    finally:
        train.unpersist()
    return RuleEnsemble([(r, w) for r, w in zip(rules, lasso.coefficients.toArray().tolist(), strict=True) if w], lasso.intercept)


def predicted(score: Column, at: float = REJECT_BELOW) -> Column:
    return (score >= at).cast("int")


def accepted(docs: DataFrame, model: RuleEnsemble, at: float = REJECT_BELOW) -> DataFrame:
    """The rows of `docs` that the model doesn't reject."""
    return model.scored(docs).where((F.col("score") >= at) & (F.col("place") >= 0)).select("all.*")
