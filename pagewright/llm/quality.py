"""Quality classifier: a sparse rule ensemble over text statistics, compiled into one Spark column.

Small random forests are grown on the statistics of labelled texts; every path from a root is a conjunctive rule. A
logistic regression with an L1 penalty on the rules keeps few of them. The kept rules and weights become a plain column
expression, so scoring is one map over the statistics and stays in the JVM.

Training uses labelled rows only, at most ``SAMPLE`` of them (those with the least hash of the id, so the choice is the
same everywhere); the bound keeps the fit alike at every size. Scores use the text alone.

Defined cases: a null or empty text has all statistics 0 and is scored like any other; labels that are null or neither
0 nor 1, and rows whose doc_id is null, take no part in training; of several labels of one id the least counts; without
both labels in training, the share of label 1 (1.0 without labels) is the score of all; repeated rows are scored each;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES, DEPTH = 12, 3
PENALTY = 0.002

_WORDS = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, all of them finite."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n_lines = F.greatest(F.size(lines), F.lit(1))
    share = lambda chars: (n - F.length(F.translate(text, chars, ""))) / n
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_words": n_words / n_lines,
        "letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / n,
        "capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / n,
        "digits": share("0123456789"),
        "symbols": share("#$%&*+<=>@^_{}~\\"),
        "bars": share("|"),
        "exclamations": share("!?"),
        "stops": share("."),
        "commas": share(",;:"),
    }


STATISTICS = tuple(sorted(["log_words", "word_length", "distinct_words", "distinct_lines", "line_words", "letters", "capitals", "digits", "symbols", "bars", "exclamations", "stops", "commas"]))


def with_statistics(docs: DataFrame, name: str = "stats") -> DataFrame:
    found = statistics(F.col("text"))
    return docs.withColumn(name, F.struct(*(found[k].cast("double").alias(k) for k in STATISTICS)))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most or above, bound)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: str = "stats") -> Column:
        """The score as an expression over the struct of statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(_met(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _met(rule: Rule, stats: str = "stats") -> Column:
    out = F.lit(True)
    for k, below, bound in rule:
        value = F.col(f"{stats}.{STATISTICS[k]}")
        out = out & ((value <= bound) if below else (value > bound))
    return out


def _paths(node, so_far: dict) -> list[Rule]:
    """Every path below a node of a fitted tree; bounds on one statistic are joined."""
    found = [tuple(sorted((k, below, bound) for (k, below), bound in so_far.items()))] if so_far else []
    if node.subtreeDepth() == 0:
        return found
    k, bound = node.split().featureIndex(), float(node.split().threshold())
    left, right = dict(so_far), dict(so_far)
    left[k, True] = min(bound, left.get((k, True), bound))
    right[k, False] = max(bound, right.get((k, False), bound))
    return found + _paths(node.leftChild(), left) + _paths(node.rightChild(), right)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Learns from labelled rows that are not held out."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.min("label").alias("label")).where(~held_out(F.col("doc_id")))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = with_statistics(docs.join(F.broadcast(labels), "doc_id"))  # at most ``sample`` labels
    rows = found.select(F.col("label").cast("double").alias("label"), F.array(*(f"stats.{k}" for k in STATISTICS)).alias("x")).persist()
    share = rows.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        import math

        rows.unpersist()
        share = 1.0 if share is None else share
        return RuleModel(40.0 if share == 1.0 else -40.0 if share == 0.0 else math.log(share / (1 - share)), ())
    train = rows.withColumn("features", array_to_vector("x"))
    # each label counts alike while the rules are sought
    train = train.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, weightCol="weight", featureSubsetStrategy="sqrt", maxMemoryInMB=64).fit(train)
    rules = sorted({r for tree in forest._java_obj.trees() for r in _paths(tree.rootNode(), {})}, key=lambda r: (len(r), r))
    stats = F.struct(*(F.col("x")[i].alias(k) for i, k in enumerate(STATISTICS)))
    data = rows.withColumn("stats", stats).select("label", array_to_vector(F.array(*(_met(r).cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, standardization=False, maxIter=80, tol=1e-6).fit(data)
    rows.unpersist()
    return RuleModel(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-9))


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with a column ``score``, which replaces one of that name; all other columns stay, whatever their names."""
    stats = "stats"
    while stats in docs.columns:
        stats += "_"
    return with_statistics(docs, stats).withColumn("score", model.column(stats)).drop(stats)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
