"""Training samples of questions with their answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.strings import ordinal
from tessera.operators.posts import quality_label


@dataclass(frozen=True)
class SampleRules:
    """How samples are made; the defaults put the accepted answer first and give one sample for each answer."""

    sorting: str = "accepted"  # or "descending", "ascending"
    answers_per_sample: int = -1
    repeat_prompt: bool = True  # a sample for each answer, or one for all
    repeat_body: bool = False
    relative: bool = False
    highest_is_best: bool = False
    worst_is_best: bool = False
    allow_negative_best: bool = False
    allow_no_answer: bool = False
    no_answer: str = "There is not an answer"
    great: int = 12
    good: int = 3
    bad: int = -1


def relative_label(place: Column, is_best: Column) -> Column:
    """BEST, or the place, from 1, as an ordinal in capitals."""
    return F.when(is_best, "BEST").otherwise(F.upper(ordinal(place)))


def _extreme(answers: Column, highest: bool) -> Column:
    """The id of the first in position of the answers with the highest (lowest) score."""
    keyed = F.transform(answers, lambda a, i: F.struct((-a["score"] if highest else a["score"]).alias("s"), i.alias("i"), a["id"].alias("id")))
    return F.array_min(keyed)["id"]


def training_samples(questions: DataFrame, prompt: Callable[[dict[str, Column]], Column], rules: SampleRules = SampleRules()) -> DataFrame:
    """(id, part, input, labels): the training samples of each question, parts counted from 0.

    ``questions`` has id, body, accepted_answer and an array ``answers`` of structs with id, body, score and date; all work
    is on the row, without an exchange. ``prompt`` makes the input from the columns by name, with
    context (the body, null where it isn't repeated), quality and answer_date among them.

    A question without body gives nothing. Answers are ranked by score, equals in place, the accepted one first if sorting
    is "accepted". An empty answer uses up its rank. A question without answers gives nothing, or, with
    allow_no_answer, one sample with the text ``no_answer``, which then stands for empty answers too. Unless the prompt is repeated, the
    answers of a question are the lines of one sample.
    """
    r = rules
    accepted = F.when(F.coalesce("accepted_answer", F.lit("")).cast("string") == "", "-1").otherwise(F.col("accepted_answer").cast("string"))
    own = questions.where(F.length(F.trim(F.coalesce("body", F.lit("")))) > 0).withColumn("accepted_answer", accepted)
    answers = F.coalesce("answers", F.array().cast(questions.schema["answers"].dataType))
    own = own.withColumn("answers", F.transform(answers, lambda a, i: F.struct(a["id"].cast("string").alias("id"), F.coalesce(a["body"], F.lit("")).alias("body"), a["score"].cast("long").alias("score"), a["date"].alias("date"), i.alias("pos"))))
    own = own.withColumns({"__high": _extreme(F.col("answers"), True), "__low": _extreme(F.col("answers"), False)})

    leads = lambda a: (a["id"] == F.col("accepted_answer")) & (r.sorting == "accepted")
    sign = 1 if r.sorting == "ascending" else -1
    ranked = F.array_sort(F.transform("answers", lambda a: F.struct((~leads(a)).alias("later"), (a["score"] * sign).alias("by"), a["pos"].alias("pos"), a.alias("a"))))
    ranked = F.transform(ranked, lambda x, i: F.struct(x["a"].alias("a"), (i + 1).alias("place")))
    if r.answers_per_sample != -1:
        ranked = F.slice(ranked, 1, r.answers_per_sample)
    full = lambda a: F.trim(a["body"]) != ""
    ranked = ranked if r.allow_no_answer else F.filter(ranked, lambda x: full(x["a"]))

    def is_best(a: Column) -> Column:
        if r.worst_is_best:
            return a["id"] == F.col("__low")
        may = F.lit(True) if r.allow_negative_best else a["score"] >= 0
        highest = (a["id"] == F.col("__high")) & may & (F.lit(True) if r.highest_is_best else F.col("accepted_answer") == "-1")
        return highest if r.highest_is_best else (a["id"] == F.col("accepted_answer")) | highest

    def label(x: Column) -> Column:
        a = x["a"]
        return relative_label(x["place"], is_best(a)) if r.relative else quality_label(a["score"], is_best(a), great=r.great, good=r.good, bad=r.bad)

    made = F.transform(ranked, lambda x: F.struct(F.when(full(x["a"]), x["a"]["body"]).otherwise(F.lit(r.no_answer)).alias("labels"), label(x).alias("quality"), x["a"]["date"].cast("string").alias("answer_date")))
    plain = "NONE" if r.repeat_prompt else "BEST"
    none = F.struct(F.lit(r.no_answer).alias("labels"), F.lit(plain).alias("quality"), F.lit(None).cast("string").alias("answer_date"))
    own = own.withColumn("__made", made)
    if not r.repeat_prompt:
        joined = F.array_join(F.transform("__made", lambda x: x["labels"]), "\n")
        one = F.struct(joined.alias("labels"), F.lit(plain).alias("quality"), F.lit(None).cast("string").alias("answer_date"))
        own = own.withColumn("__made", F.when(F.size("__made") > 0, F.array(one)).otherwise(F.array().cast("array<struct<labels:string,quality:string,answer_date:string>>")))
    if r.allow_no_answer:
        own = own.withColumn("__made", F.when(F.size("__made") > 0, F.col("__made")).otherwise(F.array(none)))
    parts = own.select("*", F.posexplode("__made").alias("part", "__one")).withColumns({"quality": F.col("__one.quality"), "answer_date": F.col("__one.answer_date"), "labels": F.col("__one.labels")})
    context = F.col("body") if r.repeat_body else F.when(F.col("part") == 0, F.col("body"))
    parts = parts.withColumn("context", context)
    given = {c: F.col(f"`{c}`") for c in parts.columns if not c.startswith("__")}
    return parts.select("id", F.col("part").cast("int").alias("part"), F.regexp_replace(prompt(given), r"^\s+|\s+$", "").alias("input"), "labels")
