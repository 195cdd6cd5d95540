"""Conversation trie against a recursive brute force, on odd rows and in many contraction rounds."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from potentia.llm import trie

COLS = "conv_id long, turn long, role string, text string, depth int, c string, pos int"


def brute(rows):
    """The contract in plain Python over (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        host = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = own.get(host, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for seq, who in members.items():
        below = [s for s in members if s[:len(seq)] == seq]
        kids = [s for s in below if len(s) == len(seq) + 1]
        leaves = [s for s in below if not any(len(x) == len(s) + 1 and x[:len(s)] == s for x in below)]
        saved = sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in below if s)
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(seq))
        out[min(who), len(seq)] = (min(members[seq[:-1]]) if seq else None, len(who), len(kids), len(leaves), saved,
                                   hashlib.sha256(ends.encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def odd(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-6, 45), 1 << 60, (1 << 60) + 3]:
        for k in range(rng.choice([1, 2, 3, 5, 12])):
            turn = rng.choice([k, k, k, None, 2])
            rows.append((c, turn, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "é", "", None, "hi there", "x" * 50_000])))
    rows += rows[:20]  # repeated rows
    rows += [(None, 0, "user", "lost"), (7, None, None, None)]
    rows += [(50, k, "user", str(k % 3)) for k in range(300)]  # a long conversation, its copy and a shorter one
    rows += [(55, k, "user", str(k % 3)) for k in range(300)] + [(60, k, "user", str(k % 3)) for k in range(130)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], COLS)


def test_trie_equals_brute_force(spark):
    rows = odd()
    got = result(trie.conversation_trie(frame(spark, rows)))
    assert got == brute(rows)


def test_trie_in_many_rounds_and_partitions(spark):
    rows = odd(5)[:120]
    want = brute(rows)
    df = frame(spark, rows)
    assert result(trie.conversation_trie(df.repartition(13), block=2, finish=6)) == want
    assert result(trie.conversation_trie(df.coalesce(1), block=300, finish=1)) == want


def test_trie_of_nothing(spark):
    assert trie.conversation_trie(frame(spark, [])).count() == 0
    assert trie.conversation_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_list_rank(spark):
    order = random.Random(1).sample(range(500), 500)
    rows = [(x, 0, order[i + 1] if i < 499 else None, 0 if i < 499 else None, x % 4) for i, x in enumerate(order)]
    df = spark.createDataFrame(rows, "c long, e long, nc long, ne long, w long")
    got = {r.c: r.pos for r in trie.list_rank(df, finish=20).collect()}
    want, total = {}, 0
    for x in order:
        want[x], total = total, total + x % 4
    assert got == want


def test_subtree_sums_across_blocks(spark):
    # root with a child that has two leaves: positions 0..7
    rows = [(0, 0, 0, 0, 0), (0, 2, 0, 5, 1), (0, 4, 1, 7, 2), (0, 5, 0, 0, 3), (9, 4, 1, 1, 4), (9, 5, 0, 0, 5), (0, 3, 0, 0, 6), (0, 1, 0, 0, 7)]
    df = spark.createDataFrame(rows, "c long, e long, leaf long, saved long, pos long")
    got = {(r.conv_id, r.depth): (r.n_leaves, r.saved_tokens) for r in trie.subtree_sums(df, block=3).collect()}
    assert got == {(0, 0): (2, 13), (0, 1): (2, 13), (0, 2): (1, 7), (9, 2): (1, 1)}
    assert trie.subtree_sums(df.where(F.lit(False))).count() == 0
