"""Experiment matrices: the product of ablation groups and steps over a card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.maps import merged_right


def ablation_product(card: DataFrame, steps: DataFrame, groups: list[DataFrame]) -> DataFrame:
    """(name, step, config): every choice from each group with every step.

    ``card`` has (name, config), ``steps`` (step, config), a group (choice, config); configs are flat maps of
    dotted keys. An ablation wins over its step, and a step over the card. Cards, steps and groups are written by hand, so
    the product is the result itself.
    """
    out = card.select("name", "config").crossJoin(steps.select("step", F.col("config").alias("step_config")))
    out = out.withColumn("config", merged_right(F.col("config"), F.col("step_config"))).drop("step_config")
    for g in groups:
        out = out.crossJoin(g.select("choice", F.col("config").alias("more")))
        out = out.select(F.concat_ws(".", "name", "choice").alias("name"), "step", merged_right(F.col("config"), F.col("more")).alias("config"))
    return out


def conflicts(groups: list[DataFrame]) -> DataFrame:
    """Keys that more than one ablation group sets."""
    keys = None
    for n, g in enumerate(groups):
        own = g.select(F.explode(F.map_keys("config")).alias("key")).distinct().withColumn("g", F.lit(n))
        keys = own if keys is None else keys.union(own)
    return keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def missing_and_repeated(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, problem): names that repeat, wanted ones that are missing, and ones that nobody wants."""
    repeated = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("repeated").alias("problem"))
    missing = wanted.select("name").exceptAll(names.select("name").distinct()).select("name", F.lit("missing").alias("problem"))
    extra = names.select("name").subtract(wanted.select("name")).select("name", F.lit("unknown").alias("problem"))
    return repeated.union(missing).union(extra)
