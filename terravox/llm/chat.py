"""Chat formatting by perspective rotation.

For every participant of a dialogue the whole dialogue is rendered once with that speaker as the assistant and all
others as named users. The rendering comes as one row per turn with its place in the whole, so a dialogue of any length
is spread over tasks; the places come from sums of blocks of turns. ``dialogues`` puts rows together where dialogues
are known to be short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravox.plans.storage import cut

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Speakers who set the scene: they are rendered under their own name and are nobody's perspective.
NARRATORS = ("system",)
#: Name of a speaker who has none.
UNKNOWN = "unknown"
#: Turn numbers in one block.
BLOCK = 1024


def _plain(text: Column) -> Column:
    """Text in which nothing can pass for a marker."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """One row for each perspective and turn: ``conv_id``, ``perspective``, ``turn``, ``role`` (assistant, user or the
    narrator's), ``name`` (of a user, else null), ``start`` and ``end`` (code points in the whole rendering),
    ``rendered``, ``mask_start`` and ``mask_end`` (what the perspective is trained on: its words and the end marker; an
    empty span at ``end`` for the turns of others).

    Turns follow ``order`` (null last; turns of one number by speaker, then text). Null texts are empty, null speakers
    are named "unknown", null conversations form one dialogue. Markers inside texts and names are broken up, line breaks
    in names become spaces. A dialogue of narrators only has no perspective and no rows. Repeated rows are repeated
    turns; a text of any length is one turn; an empty table gives no rows. Other columns, whatever their names, are
    ignored. Turns of one number, or without one, are ordered by one task.

    Texts move once to be ordered, and once more to meet their perspectives; what differs between perspectives, the
    places of each speaker's own turns, is joined in as numbers.
    """
    name = F.regexp_replace(_plain(F.coalesce(F.col(f"`{speaker}`").cast("string"), F.lit(UNKNOWN))), "[\\r\\n]+", " ")
    t = turns.select(F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{order}`").alias("turn"), name.alias("speaker"), _plain(F.col(f"`{text}`")).alias("text"))
    narrates = F.col("speaker").isin(*NARRATORS)
    of_other = F.concat(F.lit(BEGIN), F.when(narrates, F.col("speaker")).otherwise(F.concat(F.lit("user name="), F.col("speaker"))), F.lit("\n"))
    of_own = F.lit(BEGIN + "assistant\n")
    t = t.withColumn("n", (F.length(of_other) + F.length("text") + len(END) + 1).cast("long"))  # as everyone else's perspective has it
    t = t.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(1 << 53)) / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_last("turn"), "speaker", "text")
    earlier = F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = cut(t.withColumn("nth", F.row_number().over(inside)).withColumn("inside", earlier))

    before = lambda w: w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("conv_id", "block").agg(F.sum("n").alias("size"))
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("size").over(before(Window.partitionBy("conv_id"))), F.lit(0)).alias("before"))
    own = t.where(~narrates).groupBy(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective"), F.col("block").alias("b")).agg(F.sort_array(F.collect_list("nth")).alias("nths"))
    people = own.select(F.col("c").alias("d"), F.col("perspective").alias("p")).distinct()
    each = blocks.join(people, blocks.conv_id.eqNullSafe(people.d)).drop("d")
    each = each.join(own, each.conv_id.eqNullSafe(own.c) & (each.block == own.b) & (each.p == own.perspective), "left").drop("c", "b", "perspective")
    count = F.coalesce(F.size("nths"), F.lit(0))
    spoken = F.coalesce(F.sum(F.when(F.col("nths").isNotNull(), count).otherwise(0)).over(before(Window.partitionBy("conv_id", "p"))), F.lit(0))
    each = each.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("p").alias("perspective"), "before", spoken.alias("spoken"), "nths")

    r = t.join(each, t.conv_id.eqNullSafe(each.c) & (t.block == each.b)).drop("c", "b")
    mine = F.col("speaker") == F.col("perspective")
    # What each own turn before this one adds to its place.
    gain = F.length(F.lit("assistant")) - F.length(F.concat(F.lit("user name="), F.col("perspective")))
    nth = F.col("nth")
    turns_before = F.col("spoken") + F.coalesce(F.size(F.filter("nths", lambda x: x < nth)), F.lit(0))
    r = r.withColumn("start", F.col("before") + F.col("inside") + gain * F.when(F.col("nths").isNull(), F.col("spoken")).otherwise(turns_before))
    r = r.withColumn("end", F.col("start") + F.col("n") + F.when(mine, gain).otherwise(0))
    first = F.col("start") + F.length(of_own)
    return r.select(
        "conv_id", "perspective", "turn",
        F.when(mine, "assistant").when(narrates, F.col("speaker")).otherwise("user").alias("role"),
        F.when(~mine & ~narrates, F.col("speaker")).alias("name"),
        "start", "end", F.concat(F.when(mine, of_own).otherwise(of_other), F.col("text"), F.lit(END + "\n")).alias("rendered"),
        F.when(mine, first).otherwise(F.col("end")).alias("mask_start"), F.when(mine, first + F.length("text") + len(END)).otherwise(F.col("end")).alias("mask_end"),
    )


def dialogues(rotated: DataFrame) -> DataFrame:
    """Whole renderings of short dialogues: ``conv_id``, ``perspective``, ``text`` and ``masks`` (spans of code points)."""
    parts = F.sort_array(F.collect_list(F.struct("start", "rendered", "mask_start", "mask_end")))
    whole = rotated.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    masks = F.transform(F.filter("parts", lambda p: p["mask_start"] < p["mask_end"]), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end")))
    return whole.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("text"), masks.alias("masks"))
