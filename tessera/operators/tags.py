"""Tags: counts, the co-occurrence graph, roll-ups, synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import exact_percentiles


def tag_counts(df: DataFrame, tags: str = "tags") -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def top_tags(df: DataFrame, n: int = 25, tag: str = "tag_to_use") -> DataFrame:
    """The n most frequent values; equals by name."""
    return df.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def edges(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Ordered pairs of tags, the earlier one first, with their number; a repeated tag makes a self-edge.

    Pairs are made within the row's own array, without a join.
    """
    pairs = F.flatten(F.transform(tags, lambda a, i: F.transform(F.slice(F.col(tags), i + 2, F.greatest(F.size(tags), F.lit(1))), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return df.select(F.explode(pairs).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("n"))


def adjacency(edge: DataFrame) -> DataFrame:
    """Each tag's neighbours in both directions, sorted."""
    both = edge.select(F.col("src").alias("tag"), F.col("dst").alias("other")).union(edge.select("dst", "src"))
    return both.groupBy("tag").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))


def first_tag_graph(df: DataFrame, tags: str = "tags") -> DataFrame:
    """For each first tag, how often each other tag follows it."""
    own = df.where(F.size(tags) > 0).select(F.element_at(tags, 1).alias("first"), F.slice(tags, 2, F.greatest(F.size(tags), F.lit(1))).alias("rest"))
    return own.select("first", F.explode("rest").alias("other")).groupBy("first", "other").agg(F.count("*").alias("n"))


def by_global_count(df: DataFrame, key: str, tags: str = "tags") -> DataFrame:
    """``df`` with its tags in order of their count over all rows, the largest first and equals in place."""
    each = df.select(key, F.posexplode(tags).alias("pos", "tag"))
    ranked = each.join(tag_counts(df, tags), "tag")
    ordered = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("c"), "pos", "tag")))["tag"].alias("ordered"))
    return df.join(ordered, key, "left").withColumn(tags, F.coalesce("ordered", tags)).drop("ordered")


def prefix_rollup(df: DataFrame, value: str, tags: str = "tags") -> DataFrame:
    """mean, median, population std and count of a value for every prefix of the tags, and for "all", which meets in no task."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(tags)), lambda i: F.array_join(F.slice(F.col(tags), F.lit(1), i), ","))
    levels = F.when(F.size(tags) > 0, F.concat(F.array(F.lit("all")), prefixes)).otherwise(F.array(F.lit("all")))
    each = df.select(F.explode(levels).alias("level"), F.col(value).cast("double").alias("v"))
    sums = each.groupBy("level").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("n"))
    medians = exact_percentiles(each, "v", [0.5], ["level"]).select("level", F.get("q", F.lit(0)).alias("median"))
    return sums.join(medians, "level", "left").select("level", "mean", "median", "std", "n")


def canonical(tags: Column, synonyms: Column) -> Column:
    """Each tag replaced by what the map ``synonyms`` has for it."""
    return F.transform(tags, lambda t: F.coalesce(F.try_element_at(synonyms, t), t))


def canonical_by_join(df: DataFrame, synonyms: DataFrame, key: str, tags: str = "tags") -> DataFrame:
    """The same for a synonym table (source, target) of any size."""
    each = df.select(key, F.posexplode(tags).alias("pos", "tag")).join(synonyms, F.col("tag") == synonyms["source"], "left")
    back = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("target", "tag").alias("tag"))))["tag"].alias("canonical"))
    return df.join(back, key, "left").withColumn(tags, F.coalesce("canonical", tags)).drop("canonical")


def tag_dimension(tags: DataFrame, excerpts: DataFrame, wikis: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Tags (tag, count, id, excerpt_id, wiki_id) with their excerpt, wiki and synonyms; the wiki's date fills wiki_date."""
    excerpt = excerpts.select(F.col("id").alias("excerpt_id"), F.col("body").alias("excerpt_body"), F.col("date").alias("excerpt_date"))
    wiki = wikis.select(F.col("id").alias("wiki_id"), F.col("body").alias("wiki_body"), F.col("date").alias("wiki_date"))
    named = synonyms.groupBy(F.col("target").alias("tag")).agg(F.sort_array(F.collect_set("source")).alias("synonyms"))
    out = tags.join(excerpt, "excerpt_id", "left").join(wiki, "wiki_id", "left").join(named, "tag", "left")
    return out.withColumn("synonyms", F.coalesce("synonyms", F.array().cast("array<string>")))


def merged_counts(left: DataFrame, right: DataFrame, key: str = "tag") -> tuple[DataFrame, DataFrame]:
    """(counts of ``left`` with those of ``right`` added, rows of ``right`` whose key ``left`` lacks)."""
    more = right.select(key, F.col("n").alias("__more"))
    return left.join(more, key, "left").withColumn("n", F.col("n") + F.coalesce("__more", F.lit(0))).drop("__more"), right.join(left, key, "left_anti")
