"""Descriptive statistics, histograms, evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import exact_percentiles, place


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear) and max; a group, or a whole table, never meets in one task."""
    by = by or []
    v = F.col(value).cast("double")
    sums = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_percentiles(df, value, [0.25, 0.5, 0.75], by)
    same = [F.equal_null(sums[c], q[c]) for c in by]
    both = sums.join(q, same or F.lit(True), "left")
    return both.select(*(sums[c] for c in by), "n", "mean", "std", "min", *(F.get("q", F.lit(i)).alias(f"p{p}") for i, p in enumerate((25, 50, 75))), "max")


def vigintiles(df: DataFrame, value: str) -> DataFrame:
    """(pct, v): percentiles in steps of 5 from 5 to 95."""
    one = exact_percentiles(df, value, [i / 100 for i in range(5, 100, 5)])
    return one.select(F.posexplode("q").alias("i", "v")).select(((F.col("i") + 1) * 5).cast("int").alias("pct"), "v")


def quantile_histogram(df: DataFrame, value: str, points: list[float]) -> DataFrame:
    """(lo, hi, n): counts in the bins between min, the distinct percentiles and max, open at the left.

    Rows equal to the minimum fall outside. The edges are one row, and each row finds its bin by halves.
    """
    edges = exact_percentiles(df, value, [0.0, *points, 1.0]).select(F.array_sort(F.array_distinct("q")).alias("edges"))
    # a single row
    binned = df.select(F.col(value).cast("double").alias("v")).where("v is not null").crossJoin(F.broadcast(edges))
    counted = binned.withColumn("k", place(F.col("edges"), F.col("v"), len(points) + 2)).where("k > 0").groupBy("k").agg(F.count("*").alias("n"))
    bins = edges.select(F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("k"), "edges").select("k", F.element_at("edges", F.col("k")).alias("lo"), F.element_at("edges", F.col("k") + 1).alias("hi"))
    return bins.join(counted, "k", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The unbiased estimate 1 - prod(1 - k / i) over i in n-c+1..n; 1 if fewer than k failed, 0 if none passed."""
    terms = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1.0 - F.lit(float(k)) / i))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - terms)


def outcome_counts(df: DataFrame, task: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """(task, outcome, n) for every task and listed outcome, 0 where there is none."""
    seen = df.groupBy(task).agg(*[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes])
    return seen.unpivot([task], outcomes, "outcome", "n")


def micro_scores(df: DataFrame, target: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy in percent, a null prediction being a miss; with one label a row and all labels counted, micro precision, recall and F1 equal it."""
    hit = F.avg(F.coalesce(F.col(target) == F.col(predicted), F.lit(False)).cast("double")) * 100
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), hit.alias("accuracy"), hit.alias("precision"), hit.alias("recall"), hit.alias("f1"))


def per_class(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """precision, recall, F1 and the number predicted for each label; 0 where a denominator is."""
    sides = df.select(F.explode(F.array(F.struct(F.col(target).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), (F.col(target) == F.col(predicted)).cast("int").alias("hit"))
    by = sides.groupBy("x.label").agg(F.sum("x.t").alias("actual"), F.sum("x.p").alias("predicted"), F.sum(F.col("hit") * F.col("x.p")).alias("hits"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = by.select("label", "predicted", share("hits", "predicted").alias("precision"), share("hits", "actual").alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def context_sizes(programs: DataFrame, chosen: DataFrame, program: str, text: str, quota: int) -> DataFrame:
    """programs, mean_examples, mean_chars, and how many of ``programs`` are ``without`` a chosen example or ``below_quota``."""
    sizes = chosen.groupBy(program).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))
    all_sizes = programs.join(sizes, program, "left").na.fill(0, ["n", "chars"])
    mean = lambda c: F.round(F.avg(c), 6)
    return all_sizes.agg(F.count("*").alias("programs"), mean("n").alias("mean_examples"), mean("chars").alias("mean_chars"), F.count_if(F.col("n") == 0).alias("without"), F.count_if(F.col("n") < quota).alias("below_quota"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def softmax_percent(scores: Column, digits: int = 4) -> Column:
    """Softmax times 100 of an array, rounded."""
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: F.round(x / total * 100, digits))


def argmax(scores: Column) -> Column:
    """The first place of the largest element, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def ensemble_vote(df: DataFrame, task: str, member: str, scores: str, choices: int) -> DataFrame:
    """(task, choice): the choice that most members prefer.

    Only if all choices have equally many votes, that with the higher mean winning score; otherwise the first of the
    most voted.
    """
    votes = df.select(task, argmax(F.col(scores)).alias("choice"), F.array_max(scores).alias("top"))
    counted = votes.groupBy(task).agg(*[F.count_if(F.col("choice") == c).alias(f"n{c}") for c in range(choices)], *[F.avg(F.when(F.col("choice") == c, F.col("top"))).alias(f"m{c}") for c in range(choices)])
    n, m = F.array(*[f"n{c}" for c in range(choices)]), F.array(*[F.coalesce(f"m{c}", F.lit(float("-inf"))) for c in range(choices)])
    tie = F.array_min(n) == F.array_max(n)
    return counted.select(task, F.when(tie, argmax(m)).otherwise(argmax(n)).alias("choice"))


def syntax_stats(df: DataFrame, task: str, valid: str) -> DataFrame:
    """tasks, the mean over tasks of the percent of valid predictions, and how many tasks have only valid or only invalid ones."""
    each = df.groupBy(task).agg(F.avg(F.coalesce(F.col(valid), F.lit(False)).cast("double")).alias("share"))
    return each.agg(F.count("*").alias("tasks"), (F.avg("share") * 100).alias("valid_syntax_pct_mean"), F.count_if(F.col("share") == 1).alias("all_valid"), F.count_if(F.col("share") == 0).alias("all_invalid"))


def oracle_best(df: DataFrame, task: str, score: Column, key: str) -> DataFrame:
    """Of each task's predictions the one with the highest score, equals by the smaller key, with ``score``; metrics of these are the oracle's."""
    rest = [c for c in df.columns if c != task]
    scored = df.withColumn("__score", score)
    best = scored.groupBy(task).agg(F.min_by(F.struct(*rest, F.col("__score").alias("score")), F.struct(-F.col("__score"), key)).alias("r"))
    return best.select(task, "r.*")


def ratio_report(df: DataFrame, by: str, found: Column) -> DataFrame:
    """(by, found, total, pct): how many of each group's rows were found."""
    return df.groupBy(by).agg(F.count_if(found).alias("found"), F.count("*").alias("total")).withColumn("pct", F.col("found") / F.col("total") * 100)


def log_prob_gain(token_scores: Column, choices: Column, zero_shot: Column) -> Column:
    """For each choice, the sum of the log-probabilities of its tokens (gathered by id, from 0) less its zero-shot score."""
    sums = F.transform(choices, lambda ids: F.aggregate(F.transform(ids, lambda i, k: F.get(F.get(token_scores, k), i)), F.lit(0.0), lambda a, x: a + x))
    return F.zip_with(sums, zero_shot, lambda a, z: a - z)
