"""Places among sorted edges, and exact percentiles whose work is spread over ranges of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(edges: Column, value: Column, most: int) -> Column:
    """How many of the sorted ``edges`` (at most ``most``) are less than ``value``, by halves."""
    steps = [1 << k for k in reversed(range(max(1, most).bit_length()))]
    size = F.size(edges)
    step = lambda at, s: F.when((at + s <= size) & (F.get(edges, F.least(at + s, size) - 1) < value), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def exact_percentiles(df: DataFrame, value: str, points: list[float], by: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """(by..., q): an array of the percentiles at ``points``, linear between neighbours, for each group; nulls don't count.

    Approximate percentiles cut each group's values into ranges of about equal size. Ranges are counted with partial sums;
    only those in which a wanted rank falls are looked at again, as distinct values with
    their number. So no task holds more than a range's distinct values, whatever the size of its group.
    """
    by = by or []
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    values = df.select(key.alias("__key"), F.col(value).cast("double").alias("__v")).where("__v is not null")
    groups = values.groupBy("__key").agg(F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("__cuts"), F.count("*").alias("__n"))
    placed = values.join(groups, "__key").select("__key", "__v", place(F.col("__cuts"), F.col("__v"), buckets).alias("__b"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy("__key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy("__key", "__b").agg(F.count("*").alias("__c")).withColumn("__before", before)
    spot = lambda p: F.lit(float(p)) * (F.col("__n") - 1)
    wanted = F.array_distinct(F.array(*(f(spot(p)).cast("long") for p in points for f in (F.floor, F.ceil))))
    targets = groups.select("__key", F.explode(wanted).alias("__rank")).join(counts, "__key").where("__before <= __rank and __rank < __before + __c")
    targets = targets.select("__key", "__b", "__rank", (F.col("__rank") - F.col("__before")).alias("__r"))
    rows = placed.join(targets.select("__key", "__b").distinct(), ["__key", "__b"], "left_semi").groupBy("__key", "__b", "__v").agg(F.count("*").alias("__m"))
    rows = rows.withColumn("__run", F.sum("__m").over(Window.partitionBy("__key", "__b").orderBy("__v")))
    found = rows.join(targets, ["__key", "__b"]).where("__run - __m <= __r and __r < __run")
    maps = found.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))

    def at(p: float) -> Column:
        low, high = (F.element_at("__at", f(spot(p)).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (spot(p) - F.floor(spot(p)))

    return groups.join(maps, "__key").select(*(F.col(f"__key.{c}") for c in by), F.array(*map(at, points)).alias("q"))
