"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation the whole dialogue is rendered with that speaker as assistant and
all others as named users; system turns stay system turns and are nobody's perspective. A segment is

    <|im_start|>assistant\\n{text}<|im_end|>\\n             the perspective's own turns
    <|im_start|>user name={speaker}\\n{text}<|im_end|>\\n   everyone else's
    <|im_start|>system\\n{text}<|im_end|>\\n                system turns

and its mask covers text and closing mark of the perspective's own turns, nothing else.

Turns are put in order by (turn, speaker, MD5 of the text). A dialogue comes in parts of ``turns_per_part`` turn
numbers, each with its character offset in the dialogue, so that a conversation of any length is never in
one task: parts joined in order are the dialogue. Conversations of ordinary length are one part. Texts
cross the network once, by (conversation, part); offsets come from counts and lengths, summed in two
levels, so that no window holds more than ``parts_per_block`` parts or one row for each block of parts.

A part with more than ``rows_per_part`` rows (many rows may share a turn number, have none, or be repeated) is cut
into pieces that follow that order: one for each turn and speaker, by leading digits of the MD5 where one speaker
has more rows in a turn, and by number where a row is repeated more often. Repeats are counted before they move. So no task
holds more texts than about a piece, whatever the ids; ``piece`` is 0 in all other parts.

Null conversation ids are one conversation; null turns come first, in a part of their own (-1); a null
speaker is the speaker ""; a null text is empty; repeated rows are repeated turns. Conversations with
system turns only have no participant and no rows. Control strings inside a text or a speaker's name are rendered as
they stand; the masks, which are offsets, don't depend on them. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
OWN, OTHER, SYSTEM = OPEN + "assistant\n", OPEN + "user name=", OPEN + "system\n"


def _pieces(t: DataFrame, rows_per_part: int) -> DataFrame:
    """Rows with their repeats ``n`` and the ``piece`` of their part; (turn, speaker, md5, text) order runs through the pieces."""
    large = t.groupBy("conv", "part").agg(F.count("*").alias("n")).where(F.col("n") > rows_per_part).select("conv", "part")
    n_large = large.count()
    if not n_large:
        return t.withColumns({"piece": F.lit(0).cast("long"), "n": F.lit(1).cast("long")})
    large = F.broadcast(large) if n_large <= 100_000 else large
    rest = t.join(large, ["conv", "part"], "left_anti").withColumns({"piece": F.lit(0).cast("long"), "n": F.lit(1).cast("long")})
    rows = t.join(large, ["conv", "part"], "left_semi").groupBy("conv", "part", "at", "speaker", "md5", "text").agg(F.count("*").alias("n"))
    cell = ["conv", "part", "at", "speaker"]
    cells = rows.groupBy(*cell).agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
    digits = F.when(F.col("most") > rows_per_part, 32).when(F.col("rows") > rows_per_part, F.ceil(F.log(F.col("rows") / rows_per_part) / F.log(F.lit(16.0))) + 1).otherwise(0).cast("int")
    sized = rows.join(cells.select(*cell, digits.alias("digits")), cell)
    cut = sized.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / rows_per_part)), lambda k: F.least(F.lit(rows_per_part).cast("long"), F.col("n") - k * rows_per_part))).alias("again", "few"))
    slot = F.struct("at", "speaker", F.expr("left(md5, digits)").alias("md5"), "again")
    cut = cut.withColumn("slot", slot)
    slots = cut.select("conv", "part", "slot").distinct()
    numbered = slots.withColumn("piece", F.row_number().over(Window.partitionBy("conv", "part").orderBy("slot")).cast("long") - 1)
    named = cut.join(numbered, ["conv", "part", "slot"]).select("conv", "at", "speaker", "text", "part", "md5", "piece", F.col("few").alias("n"))
    return rest.unionByName(named)


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system", turns_per_part: int = 64, parts_per_block: int = 1024, rows_per_part: int = 4096) -> DataFrame:
    """Rows: conversation, perspective, part, piece, char_start, n_turns, rendered, masks.

    ``masks``: "start:end" of each trained span in characters of the whole dialogue, comma-joined.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = turns.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"),  # structs, so that null ids and null turns meet
        F.struct(F.col(turn_col).alias("turn")).alias("at"),
        F.coalesce(F.col(speaker_col), F.lit("")).alias("speaker"),
        text.alias("text"),
        F.coalesce(F.floor(F.col(turn_col) / turns_per_part), F.lit(-1)).cast("long").alias("part"),
        F.md5(F.encode(text, "UTF-8")).alias("md5"),
    )
    t = _pieces(t, rows_per_part)
    is_system = F.col("speaker") == system
    # lengths as everyone sees them but the speaker, and each speaker's turns, by piece
    as_other = F.length("text") + len(CLOSE) + 1 + F.when(is_system, len(SYSTEM)).otherwise(len(OTHER) + F.length("speaker") + 1)
    by_speaker = t.groupBy("conv", "part", "piece", "speaker").agg(F.sum(as_other * F.col("n")).alias("n"), F.sum("n").alias("turns"))
    by_piece = by_speaker.groupBy("conv", "part", "piece").agg(F.sum("n").alias("n"))
    people = by_speaker.where(~is_system).select("conv", F.col("speaker").alias("perspective")).distinct()
    key = ["conv", "part", "piece", "perspective"]
    # what a speaker's own turns are shorter or longer by, in the pieces that have any
    own = by_speaker.where(~is_system).select("conv", "part", "piece", F.col("speaker").alias("perspective"), (F.col("turns") * (len(OWN) - len(OTHER) - 1 - F.length("speaker"))).alias("own"))
    seen = by_piece.join(people, "conv").join(own, key, "left").select(*key, F.floor(F.col("part") / parts_per_block).alias("block"), (F.col("n") + F.coalesce("own", F.lit(0))).alias("n"))
    blocks = seen.groupBy("conv", "perspective", "block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    within = Window.partitionBy("conv", "perspective", "block").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, 0)
    block_start = blocks.select("conv", "perspective", "block", (F.sum("n").over(before) - F.col("n")).alias("block_start"))
    starts = seen.withColumn("in_block", F.sum("n").over(within) - F.col("n")).join(block_start, ["conv", "perspective", "block"])
    starts = starts.select(*key, (F.col("block_start") + F.col("in_block")).alias("char_start"))

    turn = F.struct("at", "speaker", "md5", "text")
    repeated = F.flatten(F.array_sort(F.collect_list(F.struct(turn.alias("turn"), F.array_repeat(turn, F.col("n").cast("int")).alias("all"))))["all"])
    parts = t.groupBy("conv", "part", "piece").agg(repeated.alias("turns"))
    mine = lambda x: x["speaker"] == F.col("perspective")
    head = lambda x: F.when(x["speaker"] == system, F.lit(SYSTEM)).when(mine(x), F.lit(OWN)).otherwise(F.concat(F.lit(OTHER), x["speaker"], F.lit("\n")))
    segments = F.transform("turns", lambda x: F.struct(F.concat(head(x), x["text"], F.lit(CLOSE + "\n")).alias("s"), mine(x).alias("mine")))
    each = parts.join(starts, ["conv", "part", "piece"]).select(*key, "char_start", segments.alias("seg"))
    masks = F.aggregate(
        "seg",
        F.struct(F.col("char_start").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["s"])).alias("at"),
            F.when(x["mine"], F.concat(a["spans"], F.array(F.concat_ws(":", a["at"] + len(OWN), a["at"] + F.length(x["s"]) - 1)))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: F.array_join(a["spans"], ","),
    )
    return each.select(F.col("conv.id").alias(conv_col), "perspective", "part", "piece", "char_start", F.size("seg").cast("long").alias("n_turns"), F.array_join(F.transform("seg", lambda x: x["s"]), "").alias("rendered"), masks.alias("masks"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read(spark, sf_dir, "conversations"))


#: Of tables in which no part has more rows than ``rows_per_part``.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS text, CAST(coalesce(floor(turn / 64), -1) AS BIGINT) AS part FROM conversations
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (
  SELECT t.*, perspective, (CASE WHEN speaker = 'system' THEN '<|im_start|>system' WHEN speaker = perspective THEN '<|im_start|>assistant' ELSE '<|im_start|>user name=' || speaker END)
    || chr(10) || text || '<|im_end|>' || chr(10) AS seg
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, sum(length(seg)) OVER (PARTITION BY conv_id, perspective ORDER BY part, turn NULLS FIRST, speaker, md5(text) ROWS UNBOUNDED PRECEDING) - length(seg) AS pos FROM s
)
SELECT conv_id, perspective, part, CAST(0 AS BIGINT) AS piece, CAST(min(pos) AS BIGINT) AS char_start, count(*) AS n_turns, string_agg(seg, '' ORDER BY pos) AS rendered,
  coalesce(string_agg(CAST(CAST(pos + 22 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(seg) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (speaker = perspective), '') AS masks
FROM o GROUP BY conv_id, perspective, part
"""
