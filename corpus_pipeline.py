"""The corpus pipeline: stages that call the operators of ``tessera.llm``, one after another.

Each stage takes documents (doc_id, text, lang, source, n_chars) and maybe other columns, under whatever names, and returns the
rows that it keeps with all their columns; the last one returns token ids. Repeated rows and rows without doc_id are
rows of their own, an empty table gives an empty one, and texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import classifier, decontaminate, linededup, minhash, spm
from tessera.llm.common import Tables, free_names, table
from tessera.llm.queries import TOKENIZER, quality_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A document stays if the probability of the highest grade is ACCEPT or more. A null or empty text, which has no features, is judged by the
    thresholds alone, so all of them stay or all go. Ties and repeats don't matter, as each row is judged alone.
    """
    return classifier.select(docs, quality_model(spark, docs, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks of lines go from later documents, and documents of which nothing is left.

    The first document by doc_id that holds a block keeps it. Null and empty texts and rows without doc_id stay as they
    are; rows that repeat a doc_id lose nothing to each other. n_chars is counted anew where lines went.
    """
    lines, deleted = free_names(docs.columns, "lines", "deleted")
    out = linededup.without_common_lines(docs, counted=(lines, deleted))
    left = out.where((F.col(deleted) == 0) | (F.col(deleted) < F.col(lines)))
    return left.withColumn("n_chars", F.when(F.col(deleted) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least doc_id.

    Groups are the connected components of links at a similarity of 0.8 of five-word shingles. Null and empty texts link with nothing and
    stay, as do rows without doc_id; rows that repeat a doc_id stay or go together.
    """
    copies = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs, within 8 % of its length in edits, go.

    Null and empty texts stay. Rows that repeat a doc_id go if one of them holds an item; rows without doc_id
    stay, as nothing names them.
    """
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip): the token ids of every document, a row for each; a null or empty text has none."""
    return spm.encode(docs, spm.model_bytes(spark, f"file://{TOKENIZER}"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    tables, docs, before = Tables(spark), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            tables.drop(before)
        before = f"stage-{name}"
    return docs
