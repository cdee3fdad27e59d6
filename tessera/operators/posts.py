"""Posts: their status, their overview, and answers aligned with questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUESTION, ANSWER = 1, 2
VALID_TYPES = (1, 2, 3, 4, 5)


def post_status(parsed: Column, kind: Column, body: Column, title: Column) -> Column:
    """The first check that fails: PARSE_FAIL, NOT_VALID_TYPE, NO_BODY, NO_TITLE; else PASS.

    ``parsed`` says whether the line was well formed. A null type counts as PARSE_FAIL, a null body as NO_BODY.
    """
    return (
        F.when(~F.coalesce(parsed, F.lit(False)) | kind.isNull(), "PARSE_FAIL")
        .when(~kind.isin(*VALID_TYPES), "NOT_VALID_TYPE")
        .when(F.coalesce(body, F.lit("")) == "", "NO_BODY")
        .when((kind == QUESTION) & (F.coalesce(title, F.lit("")) == ""), "NO_TITLE")
        .otherwise("PASS")
    )


def overview(questions: DataFrame) -> DataFrame:
    """What later steps need of a question; tag_to_use is its first tag or NO_TAG."""
    return questions.select("id", "tags", "score", "views", "answer_count", "accepted_answer", F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("NO_TAG")).alias("tag_to_use"))


def align_answers(questions: DataFrame, answers: DataFrame, *, order: str = "line") -> DataFrame:
    """Questions with an array ``answers`` of structs, one for each answer id (the last by ``order`` wins); empty if there is none.

    Answers are brought together by question once; both aggregations and the join use that exchange.
    """
    others = [c for c in answers.columns if c != "parent_id"]
    last = answers.repartition("parent_id").groupBy("parent_id", "id").agg(F.max_by(F.struct(*others), F.col(order)).alias("a"))
    nested = last.groupBy("parent_id").agg(F.sort_array(F.collect_list("a")).alias("answers"))
    joined = questions.join(nested, questions["id"] == nested["parent_id"], "left").drop("parent_id")
    kind = nested.schema["answers"].dataType
    return joined.withColumn("answers", F.coalesce("answers", F.array().cast(kind)))


def tagged_answers(answers: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers with the tag_to_use of their question, the number that failed for each reason).

    ``questions`` is an overview, with an id once; an answer without parent_id or whose question is missing fails and is dropped.
    """
    known = questions.select(F.col("id").alias("parent_id"), "tag_to_use", F.lit(True).alias("__known"))
    both = answers.join(known, "parent_id", "left")
    reason = F.when(F.col("parent_id").isNull(), "NO_PARENT").otherwise("NO_QUESTION")
    failed = both.where("__known is null").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    return both.where("__known").drop("__known"), failed


def passed(posts: DataFrame) -> DataFrame:
    """Questions and answers that passed all checks."""
    return posts.where((F.col("result") == "PASS") & F.col("type").isin(QUESTION, ANSWER))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents, children[child_key] == parents[parent_key], "left_anti")


def rank_answers(answers: DataFrame, *, question: str = "question_id", score: str = "score", position: str = "pos", accepted: str | None = None, ascending: bool = False) -> DataFrame:
    """Adds ``rank`` (from 1), ``is_best`` and ``is_worst`` within a question.

    Ties keep the order of ``position``. The accepted answer, if that column is given, comes first. Best and worst
    are by score, the first in position of equals.
    """
    by = F.col(score).asc() if ascending else F.col(score).desc()
    order = ([F.col(accepted).desc()] if accepted else []) + [by, F.col(position)]
    w = Window.partitionBy(question)
    return answers.withColumns(
        {
            "rank": F.row_number().over(w.orderBy(*order)),
            "is_best": F.row_number().over(w.orderBy(F.col(score).desc(), position)) == 1,
            "is_worst": F.row_number().over(w.orderBy(F.col(score).asc(), position)) == 1,
        }
    )


def quality_label(score: Column, is_best: Column, *, great: int = 12, good: int = 3, bad: int = -1) -> Column:
    """BEST, or by score GREAT, GOOD, OK, BAD."""
    return F.when(is_best, "BEST").when(score >= great, "GREAT").when(score >= good, "GOOD").when(score <= bad, "BAD").otherwise("OK")


def keep_first(ranked: DataFrame, n: int, body: str = "body") -> DataFrame:
    """Answers of rank 1..n that have a body; an empty one still uses up its rank."""
    return ranked.where((F.col("rank") <= n) & (F.length(F.trim(F.coalesce(F.col(body), F.lit("")))) > 0))
