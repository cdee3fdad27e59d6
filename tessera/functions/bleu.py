"""BLEU-4 from counts of n-grams, as published: clipped precisions, geometric mean, brevity penalty."""

from __future__ import annotations

from collections import Counter
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectorised import vectorised

COUNTS = "struct<m1:long,t1:long,m2:long,t2:long,m3:long,t3:long,m4:long,t4:long,c:long,r:long>"


def ngram_counts(prediction: str | None, target: str | None) -> dict[str, int]:
    """Matched and total n-grams for n of 1 to 4, and the lengths of both."""
    p, t = (prediction or "").split(), (target or "").split()
    out = {"c": len(p), "r": len(t)}
    for n in range(1, 5):
        have = Counter(zip(*(p[i:] for i in range(n)), strict=False))
        want = Counter(zip(*(t[i:] for i in range(n)), strict=False))
        out[f"m{n}"], out[f"t{n}"] = sum((have & want).values()), sum(have.values())
    return out


def bleu(counts: dict[str, int]) -> float:
    if not all(counts[f"m{n}"] for n in range(1, 5)):
        return 0.0
    mean = sum(log(counts[f"m{n}"] / counts[f"t{n}"]) for n in range(1, 5)) / 4
    return 100 * exp(mean + min(0.0, 1 - counts["r"] / counts["c"]))


@vectorised(COUNTS)
def _counts(prediction: pd.Series, target: pd.Series) -> pd.DataFrame:
    names = [f"{k}{n}" for n in range(1, 5) for k in "mt"] + ["c", "r"]
    return pd.DataFrame([ngram_counts(p, t) for p, t in zip(prediction, target, strict=True)], columns=names, index=prediction.index)


def corpus_bleu(df: DataFrame, prediction: str, target: str, by: list[str] | None = None) -> DataFrame:
    """Corpus BLEU of each group: rows give counts, their sums are aggregated in Spark."""
    sums = df.select(*(by or []), _counts(prediction, target).alias("k")).groupBy(*(by or [])).agg(*[F.sum(f"k.{x}{n}").alias(f"{x}{n}") for n in range(1, 5) for x in "mt"], F.sum("k.c").alias("c"), F.sum("k.r").alias("r"))
    some = F.least(*[F.col(f"m{n}") for n in range(1, 5)]) > 0
    mean = sum((F.log(F.try_divide(F.col(f"m{n}"), F.col(f"t{n}"))) for n in range(1, 5)), F.lit(0.0)) / 4
    score = F.when(some, 100 * F.exp(mean + F.least(F.lit(0.0), 1 - F.try_divide("r", "c")))).otherwise(0.0)
    return sums.select(*(by or []), score.alias("bleu"), F.col("c").alias("words"))
