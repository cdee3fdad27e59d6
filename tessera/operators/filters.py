"""Row filters: block-lists, allow-lists, thresholds, first matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_listed(df: DataFrame, blocked: DataFrame, key: str, blocked_key: str | None = None) -> DataFrame:
    """Rows whose key is not in the block-list."""
    return df.join(blocked, df[key] == blocked[blocked_key or key], "left_anti")


def drop_tagged(df: DataFrame, blocked: list[str], tags: str = "tags") -> DataFrame:
    """Rows of which no tag is listed; case matters."""
    return df.where(~F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, blocked))), F.lit(False)))


def keep_tagged(df: DataFrame, allowed: list[str], tags: str = "tags") -> DataFrame:
    """Rows of which some tag is listed, in any case; rows without tags go."""
    low = F.transform(tags, F.lower)
    return df.where(F.coalesce(F.arrays_overlap(low, F.array(*[F.lit(a.lower()) for a in allowed])), F.lit(False)))


def at_least(df: DataFrame, **least: float) -> DataFrame:
    """Rows that reach every threshold."""
    for name, value in least.items():
        df = df.where(F.col(name) >= value)
    return df


def first_match(df: DataFrame, wanted: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows with a wanted key, the first of each key by ``order``; keys that are never found have none."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.join(wanted.select(key).distinct(), key, "left_semi").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_keys(df: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """(rows that have all of the columns, rows that lack one)."""
    has = F.lit(True)
    for n in names:
        has = has & F.col(n).isNotNull()
    return df.where(has), df.where(~has)


def stash(df: DataFrame, key: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the frame without some columns, those columns by key), to be joined again later."""
    return df.drop(*names), df.select(key, *names)


def renamed_subset(df: DataFrame, names: dict[str, str], column: str) -> DataFrame:
    """Rows whose value is a key of ``names``, with the name that it maps to as ``display``."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn("display", F.try_element_at(pairs, F.col(column))).where("display is not null")


def rows_between(df: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` (exclusive, from 0) of the total order ``order``.

    Top-k with an offset, so no single task sorts the whole input.
    """
    return df.orderBy(*order).limit(stop).offset(start)


def where_any(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which some condition holds."""
    some = F.lit(False)
    for c in conditions:
        some = some | F.coalesce(c, F.lit(False))
    return df.where(some)


def skip_listed(df: DataFrame, column: str, *values: str) -> DataFrame:
    """Rows whose value is none of some listed ones; null is none of them."""
    return df.where(~F.coalesce(F.col(column).isin(*values), F.lit(False))) if values else df


def without_mark(df: DataFrame, column: str, mark: str = "OLD_") -> DataFrame:
    """Rows whose text doesn't hold ``mark``."""
    return df.where(~F.contains(F.coalesce(F.col(column), F.lit("")), F.lit(mark)))


def join_as_text(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """An inner join on keys of any types, compared as text; the right key goes."""
    other = right.withColumn("__key", F.col(right_key).cast("string")).drop(right_key)
    return left.join(other, F.col(left_key).cast("string") == F.col("__key")).drop("__key")


def join_unique(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``df`` joined to ``names`` by key; a key that ``names`` has twice fails the job.

    Rows are counted before they are brought together by key, so that a repeated key shows.
    """
    rest = [c for c in names.columns if c != key]
    one = names.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*rest)).alias("__r"))
    checked = F.when(F.col("__n") == 1, F.col("__r")).otherwise(F.raise_error(F.concat(F.lit("repeated: "), F.col(key).cast("string"))))
    return df.join(one.withColumn("__r", checked), key).select(*df.columns, "__r.*")


def where_each(df: DataFrame, keep: Callable[[dict], bool]) -> DataFrame:
    """Rows for which a Python function of the row, as a dict, is true; batch by batch, for what columns can't say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(keep(row)) for row in batch.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
