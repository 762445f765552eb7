"""Chat formatting with cumulative-snapshot collapse, with DataFrame functions only.

A service that logs every state of a dialogue leaves conversations which are
prefixes of longer ones. Each conversation gets a rolling hash after every turn;
one whose full hash equals a longer one's hash at the same turn is dropped by
an anti-join, and of identical conversations the smallest conv_id stays. Only
then are conversations rendered.

The rolling hash is the running exclusive-or of hashes of the turns with their
numbers, two of 64 bits each, so it takes one pass in the number of turns.
Prefixes count as equal by these 128 bits and the number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.llm.common import cut

#: Turn markers of the rendered form.
TURN_OPEN, TURN_MIDDLE, TURN_CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_OPEN), role, F.lit(TURN_MIDDLE), text, F.lit(TURN_CLOSE))


def render_text(role: str, text: str) -> str:
    """``render_turn`` for strings."""
    return f"{TURN_OPEN}{role}{TURN_MIDDLE}{text}{TURN_CLOSE}"


def ordered_turns(df: DataFrame) -> DataFrame:
    """One row per conversation with its turns in order, and each turn's hashes with its number."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # A set on either side of the shuffle, so repeated rows are moved at most once for each task.
    listed = df.groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))

    def hashes(turn: Column, at: Column) -> Column:
        a = F.xxhash64(at, turn["role"], turn["text"])
        return F.struct(a.alias("a"), F.xxhash64(turn["text"], turn["role"], at, F.lit(7)).alias("b"))

    return listed.withColumn("hashes", F.transform("turns", hashes)).withColumn("n_turns", F.size("turns"))


def _whole(half: str) -> Column:
    return F.aggregate(f"hashes.{half}", F.lit(0).cast("long"), lambda done, h: done.bitwiseXOR(h))


def maximal_conversations(df: DataFrame) -> DataFrame:
    """conv_id, turns and n_copies of every conversation that prefixes no longer one.

    Turns are ordered by turn number, then role, then text (nulls first; null
    role or text counts as empty). Rows repeated in all four columns count once.
    A null conv_id is a conversation like any other. Columns beside the four are
    ignored. An empty table gives an empty result.
    """
    folded = cut(ordered_turns(df).withColumn("a", _whole("a")).withColumn("b", _whole("b")))
    whole = ["n_turns", "a", "b"]
    first = folded.groupBy(*whole).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    each = folded.where("n_turns > 1").select("conv_id", "n_turns", F.posexplode("hashes").alias("at", "h"))
    running = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = each.select("n_turns", (F.col("at") + 1).alias("after"), F.bit_xor("h.a").over(running).alias("a"), F.bit_xor("h.b").over(running).alias("b"))
    proper = rolled.where("after < n_turns").select(F.col("after").alias("n_turns"), "a", "b").distinct()
    kept = first.join(proper, whole, "left_anti").select(F.col("conv_id").alias("__keep"), "n_copies")
    joined = folded.join(kept, F.col("conv_id").eqNullSafe(F.col("__keep")))
    return joined.select("conv_id", "turns", F.col("n_turns").cast("int").alias("n_turns"), "n_copies")


def format_chats(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (identical conversations) and the rendered text of maximal conversations."""
    pieces = F.transform("turns", lambda t: render_turn(t["role"], t["text"]))
    return maximal_conversations(df).select("conv_id", "n_turns", "n_copies", F.array_join(pieces, "").alias("rendered"))
