"""Post and tag dumps: XML with one row element on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.strings import tag_list
from tessera.operators.posts import ANSWER, QUESTION, post_status

ROW = (
    "_Id string, _PostTypeId int, _AcceptedAnswerId string, _ParentId string, _CreationDate string, _Score long, _ViewCount long, "
    "_Body string, _Title string, _Tags string, _AnswerCount long, _CommentCount long, _corrupt_record string"
)
TAG = "_Id string, _TagName string, _Count long, _ExcerptPostId string, _WikiPostId string, _corrupt_record string"


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line parsed on its own; r is null, or its _corrupt_record is not, where that fails."""
    options = {"mode": "PERMISSIVE", "rowTag": "row", "columnNameOfCorruptRecord": "_corrupt_record"}
    is_row = F.col("value").rlike(r"^\s*<row\s.*/>\s*$")
    return spark.read.text(path).withColumn("r", F.when(is_row, F.from_xml(F.col("value"), schema, options)))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts with ``result``, the check that each line failed or PASS; prolog and root lines are PARSE_FAIL too.

    ``line`` orders rows by file and place in it. Bytes that aren't UTF-8 are replaced.
    """
    rows = _lines(spark, path, ROW).withColumn("line", F.monotonically_increasing_id())
    r = F.col("r")
    parsed = r.isNotNull() & r["_corrupt_record"].isNull()
    kind = r["_PostTypeId"]
    question, answer = kind == QUESTION, kind == ANSWER
    return rows.select(
        "line",
        post_status(parsed, kind, r["_Body"], r["_Title"]).alias("result"),
        kind.alias("type"),
        r["_Id"].alias("id"),
        r["_CreationDate"].alias("date"),
        r["_Score"].alias("score"),
        F.coalesce(r["_CommentCount"], F.lit(0)).alias("comment_count"),
        r["_Body"].alias("body"),
        F.when(question, r["_Title"]).alias("title"),
        F.when(question, tag_list(r["_Tags"])).alias("tags"),
        F.when(question, F.coalesce(r["_AnswerCount"], F.lit(0))).alias("answer_count"),
        F.when(question, F.coalesce(r["_ViewCount"], F.lit(0))).alias("views"),
        F.when(question, r["_AcceptedAnswerId"]).alias("accepted_answer"),
        F.when(answer, r["_ParentId"]).alias("parent_id"),
    )


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(tag, count, id, excerpt_id, wiki_id); lines that can't be parsed are skipped."""
    r = F.col("r")
    rows = _lines(spark, path, TAG).where("r is not null and r._corrupt_record is null and r._TagName is not null")
    return rows.select(r["_TagName"].alias("tag"), r["_Count"].alias("count"), r["_Id"].alias("id"), r["_ExcerptPostId"].alias("excerpt_id"), r["_WikiPostId"].alias("wiki_id"))
