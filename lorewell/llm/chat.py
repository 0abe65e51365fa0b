"""Chat formatting by multi-party perspective rotation.

A dialogue is rendered once for every participant: that speaker's turns become
the assistant's and carry the training mask, every other participant's turns
become those of a user with a name, and a narrator's turns (system) stay as
they are in every perspective and are never trained on. Column functions only.

Turns get their rank by a range partitioning of (conversation, turn) whose last
key is the row itself, so one conversation with a third of all rows, or one
turn repeated without end, is spread over many tasks; a rendering comes in
parts of at most PART turns, and the parts in order are the whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorewell.scratch import materialize

#: Turns in one part.
PART = 64
#: Fixed markers of the rendering; inside texts they are broken up by a backslash.
OPEN, CLOSE, MARK, BROKEN = "<|start|>", "<|end|>\n", "<|", "<\\|"


def ranked(turns: DataFrame) -> DataFrame:
    """conv_id, rank (from 0), role, text, in the order of turn (null first), role, text, input."""
    uid = F.monotonically_increasing_id().alias("uid")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), uid)
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = ["conv_id", "turn", "role", "h", "uid"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(
        spread.select("conv_id", "role", "text", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("place")), "turns"
    )
    counts = placed.groupBy("conv_id", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("conv_id", "pid").orderBy("place")) - 1
    numbered, offsets = placed.withColumn("local", local).alias("a"), offsets.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.pid") == F.col("b.pid"))
    return numbered.join(offsets, same).select("a.conv_id", (F.col("local") + F.col("offset")).cast("long").alias("rank"), "role", "text")


def _clean(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(BROKEN))


def rotate(turns: DataFrame, narrator: str = "system") -> DataFrame:
    """conv_id, speaker, part, n_turns, n_masked, text, mask; a row for each participant and part.

    ``mask`` lists the spans of ``text`` to train on as "start:end" in code
    points, joined by ";": the speaker's own words with the closing marker.
    A null role is the participant "" and a null text is empty. Rows that repeat
    a turn are all rendered, in the order of ``ranked``. Rows without a conv_id
    form one conversation. A conversation of the narrator alone has no
    participant and no rendering; an empty table gives an empty result. Other
    columns aren't read.
    """
    rows = materialize(ranked(turns), "ranked")
    parts = rows.groupBy("conv_id", F.floor(F.col("rank") / PART).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("turns")
    )
    speakers = rows.where(F.col("role") != narrator).select("conv_id", F.col("role").alias("speaker")).distinct()
    parts, speakers = parts.alias("p"), speakers.alias("s")
    each = parts.join(speakers, F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")))

    def render(t: Column) -> Column:
        own = t["role"] == F.col("speaker")
        who = F.when(t["role"] == narrator, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), _clean(t["role"])))
        return F.struct(F.concat(F.lit(OPEN), who, F.lit("\n")).alias("head"), F.concat(_clean(t["text"]), F.lit(CLOSE)).alias("body"), own.alias("own"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    shown = each.select("p.conv_id", "speaker", "part", F.transform("turns", render).alias("r"))
    shown = shown.select("*", F.aggregate("r", start, add)["spans"].alias("spans"))
    return shown.select(
        "conv_id", "speaker", "part", F.size("r").cast("long").alias("n_turns"), F.size("spans").cast("long").alias("n_masked"),
        F.array_join(F.transform("r", lambda x: F.concat(x["head"], x["body"])), "").alias("text"), F.array_join("spans", ";").alias("mask"),
    )
