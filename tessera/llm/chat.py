"""Multi-party dialogues from every participant's point of view.

For each participant the dialogue is rendered with that speaker as the assistant and
all others as users who bear their names; only the assistant's words count in the loss.
All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>\n"
PART = 256


def _header(speaker: Column, perspective: Column) -> Column:
    role = F.when(speaker == SYSTEM, F.lit(SYSTEM)).when(speaker == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(START), role, F.lit("\n"))


def perspectives(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_assistant, text, mask): dialogues rendered for every participant.

    Participants are the distinct speakers of a conversation but "system", whose turns
    stay system messages for all. Turns follow each other by number, those of one
    number by speaker and then text; a null number comes first. A dialogue is
    rendered in parts of ``part`` consecutive turn numbers (part 0, 1, ...), so no row
    grows with a conversation; joined in order the parts are the whole dialogue.
    ``mask`` holds the (start, end) character spans of ``text`` that the loss counts: each
    assistant turn's text and its end mark. Turns without conversation or speaker take
    no part, for nobody could be shown as saying them; a null text is empty, and the
    marks' opening "<|" within names and texts is written "< |" so that it can't pose as one.
    Rows that share a turn number are never parted, however many they are.
    Repeated rows are turns of their own. Other columns are not read.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    own = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        safe(F.regexp_replace(F.col(f"`{speaker_col}`").cast("string"), "[\\r\\n]+", " ")).alias("speaker"),
        safe(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("text"),
    ).where("conv_id is not null and speaker is not null")
    said = own.withColumn("part", F.coalesce(F.expr(f"cast(floor(turn / {part}) as bigint)"), F.lit(-1).cast("long")))
    blocks = said.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    # short rows, one for each part; the texts stay where their part is
    numbers = said.select("conv_id", "part").distinct().withColumn("number", (F.row_number().over(Window.partitionBy("conv_id").orderBy("part")) - 1).cast("long"))
    blocks = blocks.join(numbers, ["conv_id", "part"])
    people = own.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    seen = blocks.join(people, "conv_id")
    header = lambda t: _header(t["speaker"], F.col("perspective"))
    rendered = F.transform("turns", lambda t: F.concat(header(t), t["text"], F.lit(END)))
    sizes = F.transform("turns", lambda t: F.struct((t["speaker"] == F.col("perspective")).alias("own"), F.length(header(t)).alias("before"), (F.length(t["text"]) + F.lit(len(END))).alias("size")))
    empty = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))")
    step = lambda acc, t: F.struct(
        (acc["at"] + t["before"] + t["size"]).alias("at"),
        F.when(t["own"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["before"]).alias("start"), (acc["at"] + t["before"] + t["size"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    spans = F.aggregate("sizes", empty, step)["spans"]
    out = seen.withColumns({"sizes": sizes, "text": F.array_join(rendered, "")})
    return out.select(
        "conv_id", "perspective", F.col("number").alias("part"), F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("sizes", lambda t: t["own"])).cast("long").alias("n_assistant"), "text", spans.alias("mask")
    )
