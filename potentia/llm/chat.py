"""Chat formatting after cumulative-snapshot collapse.

A chat service that logs the whole conversation at every turn leaves a row set per snapshot;
only the longest one is wanted. Each turn is hashed with its position, and the XOR of a
conversation's first k turn hashes (two independent 64-bit hashes) names its prefix of k turns.
XOR is associative, so the rolling value is built from blocks of turns: one hash per block by
an aggregate with map-side combining, a small window over a conversation's blocks, a window
inside each block. A conversation that is one of another's shorter prefixes goes by an anti
join on (length, hashes), equal conversations leave the smallest conv_id, and the rest are
rendered. No task holds a whole conversation: windows and rendered parts end at
``block`` positions.

Defined results: turns are ordered by (turn, role, text), nulls first; a row repeated inside a
conversation counts once; null role and text render as empty but hash apart from an empty
string; a null conv_id is one conversation; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from potentia.llm.textio import stage

TURN = ("<|im_start|>", "\n", "<|im_end|>\n")


def _hashes(*cols: Column) -> list[Column]:
    # xxhash64 skips nulls, so each column carries a mark of its being null
    marked = [x for c in cols for x in (c, c.isNull())]
    return [F.xxhash64(F.lit(salt), *marked) for salt in ("turn", "prefix")]


def positioned(conversations: DataFrame, block: int = 256) -> DataFrame:
    """(conv_id, pos from 1, role, text, h1, h2, n): rolling prefix hashes and length per turn."""
    t = conversations.select("conv_id", "turn", "role", "text")
    # one row of each repeated turn row: the hash groups, the values ride along
    same = _hashes(F.col("role"), F.col("text"))
    t = (t.withColumn("_a", same[0]).withColumn("_b", same[1]).groupBy("conv_id", "turn", "_a", "_b")
         .agg(F.min("role").alias("role"), F.min("text").alias("text")).drop("_a", "_b"))
    t = stage(t.withColumn("_block", F.floor(F.col("turn") / F.lit(block))), "chat-turns")
    counts = t.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("conv_id").orderBy(F.col("_block").asc_nulls_first()))
    counts = counts.withColumn("_before", before - F.col("_c")).withColumnRenamed("conv_id", "_conv").withColumnRenamed("_block", "_blk").drop("_c")
    inside = Window.partitionBy("conv_id", "_block").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    t = (t.withColumn("_no", F.row_number().over(inside))
         .join(counts, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_block").eqNullSafe(F.col("_blk")))
         .select("conv_id", (F.col("_before") + F.col("_no")).alias("pos"), "role", "text"))
    h = _hashes(F.col("pos"), F.col("role"), F.col("text"))
    t = stage(t.withColumn("_h1", h[0]).withColumn("_h2", h[1])
              .withColumn("_part", F.floor((F.col("pos") - 1) / F.lit(block))), "chat-positions")
    parts = t.groupBy("conv_id", "_part").agg(F.bit_xor("_h1").alias("_x1"), F.bit_xor("_h2").alias("_x2"),
                                              F.count(F.lit(1)).alias("_c"))
    over = Window.partitionBy("conv_id").orderBy("_part")
    parts = parts.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_prt"),
                         F.bit_xor("_x1").over(over).bitwiseXOR(F.col("_x1")).alias("_p1"),
                         F.bit_xor("_x2").over(over).bitwiseXOR(F.col("_x2")).alias("_p2"),
                         F.sum("_c").over(Window.partitionBy("conv_id")).alias("n"))
    run = Window.partitionBy("conv_id", "_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (t.withColumn("_r1", F.bit_xor("_h1").over(run)).withColumn("_r2", F.bit_xor("_h2").over(run))
            .join(parts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_prt")))
            .select("conv_id", "pos", "role", "text", "n", F.col("_r1").bitwiseXOR(F.col("_p1")).alias("h1"),
                    F.col("_r2").bitwiseXOR(F.col("_p2")).alias("h2")))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that prefix no longer one, one of each kind."""
    whole = turns.where(F.col("pos") == F.col("n")).select("conv_id", "n", "h1", "h2")
    whole = whole.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = turns.where(F.col("pos") < F.col("n")).select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame, template: tuple[str, str, str] = TURN, block: int = 256) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text): the maximal conversations, rendered.

    A conversation of up to ``block`` turns has one part; a longer one has a part for each
    ``block`` turns, and its text is its parts in order."""
    turns = stage(positioned(conversations, block), "chat-rolling")
    kept = maximal(turns).withColumnRenamed("conv_id", "_conv")
    head, middle, tail = (F.lit(x) for x in template)
    blank = F.lit("")
    piece = F.concat(head, F.coalesce("role", blank), middle, F.coalesce("text", blank), tail)
    rows = turns.select("conv_id", "pos", piece.alias("_piece")).join(kept, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return (rows.groupBy("conv_id", F.floor((F.col("pos") - 1) / F.lit(block)).alias("part"))
            .agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"),
                 F.sort_array(F.collect_list(F.struct("pos", "_piece"))).alias("_p"))
            .select("conv_id", "part", "n_turns", "n_copies",
                    F.array_join(F.transform("_p", lambda x: x["_piece"]), "").alias("text")))
