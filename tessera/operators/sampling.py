"""Samples and splits that anyone can draw again.

Rows are ordered by md5(seed:key), the same in every engine, in place of a random stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """A row's place in the shuffled order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A global shuffle, by a distributed sort."""
    return df.orderBy(draw(F.col(key), seed), key)


def first_drawn(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first n rows of the shuffled order (all, if there are fewer), however large n is.

    Draws are even over 65,536 ranges. Ranges are counted; those that n covers are taken whole, and
    only the one in which it ends is ranked, so no task sorts more than a range.
    """
    placed = df.withColumn("__draw", draw(F.col(key), seed)).withColumn("__range", F.substr("__draw", F.lit(1), F.lit(4)))
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most 65,536 short rows
    left = counts.withColumn("__left", F.lit(n) - before).where("__left > 0")
    known = placed.join(F.broadcast(left), "__range")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("__draw", key))
    last = known.where("__n > __left").withColumn("__rank", rank).where("__rank <= __left")
    return known.where("__n <= __left").select(df.columns).union(last.select(df.columns))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows without replacement; ValueError if there are fewer."""
    if (there := df.count()) < n:
        raise ValueError(f"a sample of {n} from {there} rows")
    return first_drawn(df, key, n, seed)


def train_val_split(df: DataFrame, key: str, *, max_val: int, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Adds ``split``: min(max_val, floor(share * rows)) of the keys are "val", the others "train"; rows that repeat a key stay together and count once."""
    keys = df.select(key).distinct()
    n = min(max_val, int(share * keys.count()))
    val = first_drawn(keys, key, n, seed).withColumn("__val", F.lit(True))
    return df.join(val, key, "left").withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__val")


def positional_split(df: DataFrame, order: str, few_shot: int, test: int, train: int) -> DataFrame:
    """Adds ``split`` by place in the order of a unique column: few-shot, test, train, and validation for the rest.

    Only the first rows need places; three bounds found by top-n part all others.
    """
    head = df.select(order).orderBy(order).limit(few_shot + test + train)
    place = head.withColumn("__n", F.row_number().over(Window.orderBy(order)))
    split = F.when(F.col("__n").isNull(), "validation").when(F.col("__n") <= few_shot, "few_shot").when(F.col("__n") <= few_shot + test, "test").otherwise("train")
    return df.join(place, order, "left").withColumn("split", split).drop("__n")


def prefer_one(df: DataFrame, by: str, second: str, key: str, seed: int = 0) -> DataFrame:
    """One row of each ``by``: those whose boolean ``second`` is false first, then by draw."""
    w = Window.partitionBy(by).orderBy(F.col(second), draw(F.col(key), seed), F.col(key))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def resplit(train: DataFrame, val: DataFrame, key: str, n_val: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, val) drawn anew from both, val with n_val rows."""
    both = train.unionByName(val)
    new = sample_n(both, key, n_val, seed)
    return both.join(new.select(key), key, "left_anti"), new


def latest(df: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """The last row of each group by ``order``, equals by the larger key; a partial aggregation, not a sort of groups."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(order, key)).alias("r")).select(by, "r.*")


def longest(df: DataFrame, text: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.length(text).desc(), key).limit(n)


def until_too_long(items: Column, most: int) -> Column:
    """The elements before the first that is longer than ``most``."""
    long = F.transform(items, lambda x: F.length(x) > most)
    at = F.array_position(long, F.lit(True))
    return F.when(at > 0, F.slice(items, F.lit(1), (at - 1).cast("int"))).otherwise(items)


def within_budget(items: Column, most: int) -> Column:
    """The leading elements whose lengths together are at most ``most``."""
    sums = F.transform(items, lambda _, i: F.aggregate(F.slice(items, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)))
    return F.slice(items, F.lit(1), F.size(F.filter(sums, lambda n: n <= most)))


def tap(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The first n rows by key, for a look at what a plan makes."""
    return df.orderBy(key).limit(n)


def batches(items: Column, size: int, drop_short: bool = False) -> Column:
    """An array in blocks of ``size``; the short last one goes if ``drop_short``."""
    n = F.size(items)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.slice(items, i + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))
    return F.filter(blocks, lambda b: F.size(b) == size) if drop_short else blocks


def interleaved(a: Column, b: Column) -> Column:
    """Elements of two arrays in turn; what the longer one has left follows."""
    return F.array_compact(F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y))))
