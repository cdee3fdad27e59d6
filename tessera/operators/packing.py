"""Token sequences packed into blocks of one length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import place
from tessera.operators.sampling import draw


def whitespace_tokens(text: Column) -> Column:
    """The words of a text; none for an empty one."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def with_offsets(df: DataFrame, order: str, size: str) -> DataFrame:
    """Adds ``offset``: the sum of ``size`` over all rows before, in the order of a unique column.

    A two-level prefix sum. Rows are range-partitioned into buckets of order; only the buckets'
    totals meet in one window, and each bucket sums on its own.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10000).alias("cuts"))
    # a single row of at most 4 * shuffle partitions numbers
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("__b", place(F.col("cuts"), F.col(order), n)).drop("cuts")
    totals = placed.groupBy("__b").agg(F.sum(size).alias("__t"))
    before = totals.select("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    own = F.coalesce(F.sum(size).over(Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each bucket
    return placed.withColumn("__own", own).join(F.broadcast(before), "__b").withColumn("offset", (F.col("__base") + F.col("__own")).cast("long")).drop("__b", "__own", "__base")


def packed(df: DataFrame, order: str, tokens: str, length: int) -> DataFrame:
    """(block, tokens): all token arrays one after another, cut into blocks of ``length``; the short tail goes."""
    sized = df.select(order, tokens, F.size(tokens).cast("long").alias("__n"))
    placed = with_offsets(sized.where("__n > 0"), order, "__n")
    first, last = F.col("offset") / length, (F.col("offset") + F.col("__n") - 1) / length
    blocks = F.sequence(F.floor(first).cast("long"), F.floor(last).cast("long"))
    parts = placed.select(F.explode(blocks).alias("block"), "offset", tokens)
    start = F.greatest(F.col("block") * length - F.col("offset"), F.lit(0))
    stop = F.least((F.col("block") + 1) * length - F.col("offset"), F.size(tokens).cast("long"))
    part = parts.select("block", F.struct("offset", F.slice(tokens, (start + 1).cast("int"), (stop - start).cast("int")).alias("t")).alias("p"))
    whole = part.groupBy("block").agg(F.flatten(F.sort_array(F.collect_list("p"))["t"]).alias("tokens"))
    return whole.where(F.size("tokens") == length)


def padded(tokens: Column, length: int, pad: str) -> tuple[Column, Column]:
    """(blocks, masks): an array cut into blocks of ``length``, the last one filled up with ``pad`` and masked by 0."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(length))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.concat(F.slice(tokens, i + 1, F.lit(length)), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - (n - i)))))
    masks = F.transform(starts, lambda i: F.concat(F.array_repeat(F.lit(1), F.least(F.lit(length), n - i)), F.array_repeat(F.lit(0), F.greatest(F.lit(0), length - (n - i)))))
    return blocks, masks


def expected_blocks(tokens: Column, instances: Column, delimiters: int, length: int) -> Column:
    """How many blocks packing gives for so many tokens and instances."""
    return F.floor((tokens + instances * (delimiters + 1)) / length).cast("long")


def rank_shards(df: DataFrame, order: str, batch: int, ranks: int, drop_last: bool = False) -> DataFrame:
    """(rank, batch, place, order): rows dealt out in batches to ranks in turn.

    A last round that is short is filled up from the first rows, or dropped.
    """
    placed = with_offsets(df.select(order).withColumn("__one", F.lit(1)), order, "__one").drop("__one")
    total, round_ = df.count(), batch * ranks
    if drop_last:
        placed = placed.where(F.col("offset") < total // round_ * round_)
    elif total % round_ and total:
        missing = round_ - total % round_
        again = placed.where(F.col("offset") < missing % total if missing > total else F.col("offset") < missing).withColumn("offset", F.col("offset") + total)
        placed = placed.union(again)
    turn = F.floor(F.col("offset") / batch)
    return placed.select((turn % ranks).cast("int").alias("rank"), F.floor(turn / ranks).cast("long").alias("batch"), (F.col("offset") % batch).cast("int").alias("place"), order)


def block_shuffled(df: DataFrame, order: str, block: int, seed: int = 0) -> DataFrame:
    """Adds ``place``: rows in order of a unique column, shuffled within blocks of ``block`` rows by draw."""
    placed = with_offsets(df.withColumn("__one", F.lit(1)), order, "__one").drop("__one")
    mine = Window.partitionBy("__block").orderBy(draw(F.col(order), seed), order)
    placed = placed.withColumn("__block", F.floor(F.col("offset") / block))
    return placed.withColumn("place", (F.col("__block") * block + F.row_number().over(mine) - 1).cast("long")).drop("__block", "offset")


def packed_shuffled(df: DataFrame, order: str, tokens: str, length: int, block: int, seed: int = 0) -> DataFrame:
    """As ``packed``, of rows shuffled within blocks."""
    return packed(block_shuffled(df.select(order, tokens), order, block, seed), "place", tokens, length)


def worker_slices(df: DataFrame, order: str, buffer: int, workers: int) -> DataFrame:
    """Adds ``worker``: each buffer of rows, in order of a unique column, is cut into equal slices, one a worker; what is left over is the last one's."""
    placed = with_offsets(df.withColumn("__one", F.lit(1)), order, "__one").drop("__one")
    slice_ = max(1, buffer // workers)
    return placed.withColumn("worker", F.least(F.floor(F.col("offset") % buffer / slice_), F.lit(workers - 1)).cast("int")).drop("offset")


def side_by_side(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows of two tables joined by their place in the order of a unique column each; the longer one's rest has nulls."""
    one = lambda d, order: with_offsets(d.withColumn("__one", F.lit(1)), order, "__one").drop("__one").withColumnRenamed("offset", "__place")
    return one(left, left_order).join(one(right, right_order), "__place", "full").drop("__place")


def token_totals(df: DataFrame, *columns: str) -> DataFrame:
    """The sums of tokens of some text columns, the number of rows, and the grand total."""
    sums = [F.sum(F.size(whitespace_tokens(F.col(c)))).cast("long").alias(f"{c}_tokens") for c in columns]
    out = df.agg(*sums, F.count("*").alias("instances"))
    return out.withColumn("total", sum((F.col(f"{c}_tokens") for c in columns), F.lit(0)).cast("long"))
