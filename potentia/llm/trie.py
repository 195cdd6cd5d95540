"""Conversation prefix trie with subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns. Sequences are named by the XOR of position-salted
turn hashes (two 64-bit hashes), which is associative: a window inside blocks of turns and one
over a conversation's blocks give every prefix, and texts are read once, never shuffled after
the turns are numbered. A node's key is its smallest member and its depth.

Each node has an enter and an exit arc. ``enter`` leads to the first child's ``enter``, or to the
own ``exit``; ``exit`` leads to the next sibling's ``enter``, or to the parent's ``exit``. Children
are ordered by smallest member, so a conversation's own chain of nodes is contiguous on the tour;
the arcs are range-sorted by (member, depth), and each task folds the arcs that follow each other
into runs. The runs are ranked by contraction: in each round every element draws a coin, and one
that drew 1 absorbs its successor that drew 0, so a quarter goes; below ``finish`` elements
(a fixed bound) one task ranks the rest, and the rounds are undone in reverse. A run's rank plus the
offset inside it is an arc's position. Leaves and savings of a subtree are differences of prefix
sums between a node's two positions, the sums being taken in blocks of positions.

Skew: numbering and sibling order are range sorts over the whole row key, joins carry at most eight
turns of a shared conversation, equal prefixes meet in aggregates with map-side combining, and
the ids that end at one node are joined to strings in many tasks before one task digests them in
order (SHA-256 is sequential; it streams).

Defined results: turns are ordered by (turn, role, text), a null turn first; null role and text are
empty; repeated rows are turns of their own; rows without conv_id belong to no conversation and
are left out; texts of any length are read once and only their length and hash are kept; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from potentia.llm.textio import stage
from potentia.operators.ranking import rank_in_groups

_ARC = ["c", "e"]  # an arc: member, 2 * depth + (0 enter, 1 exit)


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, h1, h2, bytes) of each turn: its place, hashes and length of its text."""
    t = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    here = F.spark_partition_id().cast("long")
    t = t.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv_id", F.xxhash64(F.lit("turn"), "role", "text").alias("h1"), F.xxhash64(F.lit("again"), "role", "text").alias("h2"),
        F.octet_length("text").cast("long").alias("bytes"), here.alias("_part"),
        (F.monotonically_increasing_id() - F.shiftleft(here, 33)).alias("_no"))
    t = stage(t, "trie-turns")
    # a conversation is contiguous: rows before it in its own partition, rows in earlier partitions
    first = t.groupBy("conv_id", "_part").agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("_c"))
    earlier = F.sum("_c").over(Window.partitionBy("conv_id").orderBy("_part")) - F.col("_c")
    first = first.select("conv_id", "_part", (earlier - F.col("_first") + 1).alias("_shift"))
    return t.join(first, ["conv_id", "_part"]).select("conv_id", (F.col("_no") + F.col("_shift")).alias("pos"), "h1", "h2", "bytes")


def shared_turns(conv: str = "conv_id") -> Column:
    """Turns that a conversation takes from its host: unsigned crc32 of the decimal id modulo 9."""
    return (F.crc32(F.col(conv).cast("string")) % 9).cast("long")


def rebuild(turns: DataFrame, every: int = 5, take: Callable[[str], Column] = shared_turns, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversation c starts with the first ``take(c)`` (at most ``most``) turns of conversation c - c % every and
    goes on with its own later ones: (conv_id, depth, h1, h2, bytes) and (conv_id, n) with turnless ones."""
    sizes = stage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_own")), "trie-sizes")
    host = F.col("conv_id") - F.col("conv_id") % every
    plan = (sizes.select("conv_id", "_own", host.alias("_host"), take("conv_id").alias("_h"))
            .join(sizes.select(F.col("conv_id").alias("_host"), F.col("_own").alias("_theirs")), "_host", "left")
            .select("conv_id", "_host", "_h", F.least("_h", F.coalesce("_theirs", F.lit(0))).alias("_k"), "_own"))
    plan = stage(plan, "trie-plan")
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "_host")
    given = (plan.where("_host != conv_id AND _k > 0").select("conv_id", "_host", "_k").join(heads, "_host")
             .where("pos <= _k").select("conv_id", F.col("pos").alias("depth"), "h1", "h2", "bytes"))
    whole = turns.where(host == F.col("conv_id")).withColumnRenamed("pos", "depth")
    rest = (turns.where((host != F.col("conv_id")) & (F.col("pos") > take("conv_id")))
            .join(plan.select("conv_id", "_k", "_h"), "conv_id")
            .select("conv_id", (F.col("pos") - F.col("_h") + F.col("_k")).alias("depth"), "h1", "h2", "bytes"))
    length = F.when(F.col("_host") == F.col("conv_id"), F.col("_own")).otherwise(F.col("_k") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0)))
    return whole.unionByName(given).unionByName(rest), plan.select("conv_id", length.alias("n"))


def prefixes(turns: DataFrame, block: int = 256) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, bytes): hashes of the first ``depth`` turns and of one turn less."""
    t = turns.select("conv_id", "depth", "bytes", F.xxhash64("depth", "h1", "h2").alias("_t1"),
                     F.xxhash64(F.lit("second"), "depth", "h2", "h1").alias("_t2"),
                     F.floor((F.col("depth") - 1) / F.lit(block)).alias("_block"))
    t = stage(t, "trie-rebuilt")
    over = Window.partitionBy("conv_id").orderBy("_block")
    before = (t.groupBy("conv_id", "_block").agg(F.bit_xor("_t1").alias("_x1"), F.bit_xor("_t2").alias("_x2"))
              .select("conv_id", "_block", F.bit_xor("_x1").over(over).bitwiseXOR(F.col("_x1")).alias("_b1"),
                      F.bit_xor("_x2").over(over).bitwiseXOR(F.col("_x2")).alias("_b2"))
              .where("_block > 0"))
    run = Window.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    t = (t.withColumn("_r1", F.bit_xor("_t1").over(run)).withColumn("_r2", F.bit_xor("_t2").over(run))
         .join(before, ["conv_id", "_block"], "left")
         .select("conv_id", "depth", "bytes", "_t1", "_t2", F.col("_r1").bitwiseXOR(F.coalesce("_b1", zero)).alias("p1"),
                 F.col("_r2").bitwiseXOR(F.coalesce("_b2", zero)).alias("p2")))
    return t.select("conv_id", "depth", "bytes", "p1", "p2", F.col("p1").bitwiseXOR(F.col("_t1")).alias("q1"),
                    F.col("p2").bitwiseXOR(F.col("_t2")).alias("q2"))


def trie_nodes(chains: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, p1, p2, n_convs, saved): the nodes, root included, staged."""
    found = stage(chains.groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"),
        F.first("q1").alias("q1"), F.first("q2").alias("q2")), "trie-prefixes")
    whole = lengths.agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n")).first()
    root = found.sparkSession.createDataFrame(
        [(whole["c"], 0, None, 0, 0, whole["n"], 0)] if whole["n"] else [],
        "conv_id long, depth long, parent_conv_id long, p1 long, p2 long, n_convs long, saved long")
    saved = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    top = found.where("depth = 1").withColumn("parent_conv_id", F.lit(whole["c"]).cast("long"))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    cols = ["conv_id", "depth", "parent_conv_id", "p1", "p2", "n_convs", saved]
    nodes = top.select(*cols).unionByName(found.where("depth > 1").join(above, ["depth", "q1", "q2"]).select(*cols)).unionByName(root)
    return stage(nodes, "trie-nodes")


def arcs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, e, nc, ne, leaf, saved): both arcs of each node, their successors and the weights that the
    enter arc carries; and (conv_id, depth, n_children) of the nodes with children."""
    kids = stage(nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
                 .agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("first")), "trie-children")
    # the order of siblings: only nodes that have any
    several = kids.where("n_children > 1").select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    ranked = rank_in_groups(nodes.select("conv_id", "depth", "parent_conv_id").join(several, ["parent_conv_id", "depth"]),
                            ["conv_id"], ["parent_conv_id", "depth"])
    ranked = ranked.select("conv_id", "depth", "parent_conv_id", "_rank")
    after = ranked.select("parent_conv_id", "depth", (F.col("_rank") - 1).alias("_rank"), F.col("conv_id").alias("_next"))
    sibling = ranked.join(after, ["parent_conv_id", "depth", "_rank"]).select("conv_id", "depth", "_next")
    n = (nodes.join(kids, ["conv_id", "depth"], "left").join(sibling, ["conv_id", "depth"], "left"))
    enter = F.struct(F.col("conv_id").alias("c"), (F.col("depth") * 2).alias("e"),
                     F.coalesce("first", "conv_id").alias("nc"),
                     F.when(F.col("first").isNull(), F.col("depth") * 2 + 1).otherwise(F.col("depth") * 2 + 2).alias("ne"),
                     F.col("first").isNull().cast("long").alias("leaf"), F.col("saved").alias("saved"))
    leave = F.struct(F.col("conv_id").alias("c"), (F.col("depth") * 2 + 1).alias("e"),
                     F.coalesce("_next", "parent_conv_id").alias("nc"),
                     F.when(F.col("_next").isNotNull(), F.col("depth") * 2).when(F.col("depth") > 0, F.col("depth") * 2 - 1).alias("ne"),
                     F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    return n.select(F.inline(F.array(enter, leave))), kids.select("conv_id", "depth", "n_children")


_RUN = "c long, e long, nc long, ne long, leaf long, saved long, hc long, he long, off long"


def _fold(batches):
    """Arcs in (member, enters down, exits up) order: adds the head of the run each arc lies in and its place there."""
    tail = None  # (next member, next arc, head member, head arc, offset) of the row before
    for batch in batches:
        if not batch.num_rows:
            continue
        c, e = (batch.column(x).to_numpy(zero_copy_only=False) for x in _ARC)
        follow = [batch.column(x) for x in ("nc", "ne")]
        known = follow[0].is_valid().to_numpy(zero_copy_only=False)
        nc, ne = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in follow)
        n = len(c)
        joined = np.zeros(n, bool)
        joined[1:] = known[:-1] & (nc[:-1] == c[1:]) & (ne[:-1] == e[1:])
        if tail is not None:
            joined[0] = tail[0] == c[0] and tail[1] == e[0]
        start = np.maximum.accumulate(np.where(joined, -1, np.arange(n)))
        inside = start >= 0
        at = np.maximum(start, 0)
        hc, he, off = c[at].copy(), e[at].copy(), np.arange(n) - at
        if not inside[0]:
            k = int(np.argmax(inside)) if inside.any() else n
            hc[:k], he[:k], off[:k] = tail[2], tail[3], tail[4] + 1 + np.arange(k)
        tail = (nc[-1], ne[-1], hc[-1], he[-1], off[-1]) if known[-1] else None
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("c", "e", "nc", "ne", "leaf", "saved")),
                                          pa.array(hc), pa.array(he), pa.array(off)],
                                         ["c", "e", "nc", "ne", "leaf", "saved", "hc", "he", "off"])


def _rank_here(batches):
    """Positions in a short list by pointer jumping in memory."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    c, e, w = (t[x].to_numpy() for x in ("c", "e", "w"))
    at = {k: i for i, k in enumerate(zip(c.tolist(), e.tolist()))}
    n = len(c)
    step = np.array([n if x is None else at[x, y] for x, y in zip(t["nc"].to_pylist(), t["ne"].to_pylist())] + [n])
    after = np.append(w, 0)  # weight from an element to the end of its jump
    while (step != n).any():
        after = after + after[step]
        step = step[step]
    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(e), pa.array(after.max() - after[:n])], ["c", "e", "pos"])


def list_rank(elements: DataFrame, finish: int = 1 << 14) -> DataFrame:
    """(c, e, pos): summed weights before each element of the list ``elements(c, e, nc, ne, w)``."""
    now, absorbed, turn = stage(elements.select("c", "e", "nc", "ne", "w"), "trie-list"), [], 0
    while now.count() > finish:
        coin = F.xxhash64("c", "e", F.lit(turn)).bitwiseAND(F.lit(1))
        keep = now.where(coin == 1)
        gone = now.where(coin == 0).select(*[F.col(x).alias(f"_{x}") for x in now.columns])
        pair = stage(keep.join(gone, (F.col("nc") == F.col("_c")) & (F.col("ne") == F.col("_e")), "full"), "trie-round")
        both, alone = F.col("c").isNotNull() & F.col("_c").isNotNull(), F.col("c").isNull()
        absorbed.append(pair.where(both).select("c", "e", F.col("w").alias("_w"), "_c", "_e"))
        now = pair.select(F.coalesce("c", "_c").alias("c"), F.coalesce("e", "_e").alias("e"),
                          F.when(both | alone, F.col("_nc")).otherwise(F.col("nc")).alias("nc"),
                          F.when(both | alone, F.col("_ne")).otherwise(F.col("ne")).alias("ne"),
                          (F.coalesce("w", F.lit(0)) + F.coalesce("_w", F.lit(0))).alias("w"))
        turn += 1
    ranks = stage(now.repartition(1).mapInArrow(_rank_here, "c long, e long, pos long"), "trie-ranks")
    for pair in reversed(absorbed):
        same = F.struct("c", "e", "pos")
        other = F.struct(F.col("_c").alias("c"), F.col("_e").alias("e"), (F.col("pos") + F.col("_w")).alias("pos"))
        ranks = stage(ranks.join(pair, _ARC, "left").select(
            F.inline(F.when(F.col("_c").isNull(), F.array(same)).otherwise(F.array(same, other)))), "trie-ranks")
    return ranks


def tour(arc_table: DataFrame, finish: int = 1 << 14) -> DataFrame:
    """(c, e, leaf, saved, pos): the position of each arc on the Euler tour."""
    along = F.when(F.col("e") % 2 == 0, F.col("e")).otherwise(-F.col("e"))
    order = [F.col("c"), F.col("e") % 2, along]
    folded = stage(arc_table.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_fold, _RUN), "trie-runs")
    runs = folded.groupBy("hc", "he").agg(F.max(F.struct("off", "nc", "ne")).alias("_last")).select(
        F.col("hc").alias("c"), F.col("he").alias("e"), F.col("_last.nc").alias("nc"), F.col("_last.ne").alias("ne"),
        (F.col("_last.off") + 1).alias("w"))
    ranks = list_rank(runs, finish).select(F.col("c").alias("hc"), F.col("e").alias("he"), "pos")
    return folded.join(ranks, ["hc", "he"]).select("c", "e", "leaf", "saved", (F.col("pos") + F.col("off")).alias("pos"))


def subtree_sums(placed: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) from prefix sums over the tour's positions."""
    t = placed.withColumn("_b", F.floor(F.col("pos") / F.lit(block)))
    t = stage(t, "trie-tour")
    over = Window.orderBy("_b")  # one row a block of positions
    before = t.groupBy("_b").agg(F.sum("leaf").alias("_l"), F.sum("saved").alias("_s")).select(
        "_b", (F.sum("_l").over(over) - F.col("_l")).alias("_l"), (F.sum("_s").over(over) - F.col("_s")).alias("_s"))
    run = Window.partitionBy("_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = (t.withColumn("_rl", F.sum("leaf").over(run)).withColumn("_rs", F.sum("saved").over(run)).join(before, "_b")
         .select(F.col("c").alias("conv_id"), F.floor(F.col("e") / 2).alias("depth"), "leaf", "saved",
                 (F.col("_rl") + F.col("_l")).alias("_pl"), (F.col("_rs") + F.col("_s")).alias("_ps"),
                 F.when(F.col("e") % 2 == 1, 1).otherwise(-1).alias("_sign")))
    # up to and with the exit arc, less what lay before the enter arc
    return t.groupBy("conv_id", "depth").agg(F.sum(F.col("_sign") * F.col("_pl") + F.col("leaf")).alias("n_leaves"),
                                             F.sum(F.col("_sign") * F.col("_ps") + F.col("saved")).alias("saved_tokens"))


def _join_ids(batches):
    """Runs of ids with one node, as comma-joined strings of up to a batch: (c, depth, first, ids)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        c, d, ids = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "depth", "conv_id"))
        cut = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (d[1:] != d[:-1])))
        ends = np.append(cut[1:], len(c))
        yield pa.RecordBatch.from_arrays([pa.array(c[cut]), pa.array(d[cut]), pa.array(ids[cut]),
                                          pa.array([",".join(map(str, ids[s:t].tolist())) for s, t in zip(cut, ends)])],
                                         ["c", "depth", "first", "ids"])


def _digest_ids(batches):
    """SHA-256 of each node's id strings in order, streamed."""
    now, state = None, None
    for batch in batches:
        keys = zip(batch.column("c").to_pylist(), batch.column("depth").to_pylist())
        done = []
        for key, piece in zip(keys, batch.column("ids").to_pylist()):
            if key == now:
                state.update(b"," + piece.encode())
                continue
            if now is not None:
                done.append((*now, state.hexdigest()))
            now, state = key, hashlib.sha256(piece.encode())
        if done:
            yield _digest_rows(done)
    if now is not None:
        yield _digest_rows([(*now, state.hexdigest())])


def _digest_rows(rows):
    c, d, h = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(h, pa.string())],
                                      ["c", "depth", "ends_sha256"])


def ends(chains: DataFrame, lengths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes at which conversations end."""
    last = chains.join(lengths.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"]).select("conv_id", "depth", "p1", "p2")
    none = lengths.where("n = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"))
    found = last.unionByName(none).join(nodes.select(F.col("conv_id").alias("c"), "depth", "p1", "p2"), ["depth", "p1", "p2"])
    found = found.select("c", "depth", "conv_id").repartitionByRange("c", "depth", "conv_id").sortWithinPartitions("c", "depth", "conv_id")
    pieces = found.mapInArrow(_join_ids, "c long, depth long, first long, ids string")
    return (pieces.repartition("c", "depth").sortWithinPartitions("c", "depth", "first")
            .mapInArrow(_digest_ids, "c long, depth long, ends_sha256 string").withColumnRenamed("c", "conv_id"))


def conversation_trie(conversations: DataFrame, block: int = 256, finish: int = 1 << 14) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = rebuild(stage(numbered(conversations), "trie-numbered"))
    lengths = stage(lengths, "trie-lengths")
    chains = stage(prefixes(turns, block), "trie-chains")
    nodes = trie_nodes(chains, lengths)
    arc_table, kids = arcs(nodes)
    sums = subtree_sums(tour(arc_table, finish))
    key = ["conv_id", "depth"]
    out = (nodes.select(*key, "parent_conv_id", "n_convs").join(sums, key).join(kids, key, "left")
           .join(ends(chains, lengths, nodes), key, "left"))
    return out.select(*key, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                      "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
