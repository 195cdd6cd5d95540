"""Language model, mixing, chats and the pipeline against brute force and on odd rows."""

import collections
import math
import os
import re
import sys

import numpy as np
import pytest

import corpus_pipeline
from potentia.llm import chat, knlm, langid, mixing, secrets, simhash
from potentia.llm import queries as Q
from potentia.llm.textio import count_words, utf8_buffer, word_hashes

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_check import digest  # noqa: E402

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


# --- language model

def plain_model(train):
    """log10 P(word | context) by dictionaries."""
    uni, bi = collections.Counter(), collections.Counter()
    for t in train:
        x = words(t) + ["</s>"]
        uni.update(x)
        bi.update(zip(["<s>", *x[:-1]], x))
    n, v = sum(uni.values()), len(uni)
    seen = collections.Counter(bi.values())
    d = [0, *knlm._discounts(np.array([seen[k] for k in (1, 2, 3, 4)]))]
    before = collections.Counter(w for _, w in bi)
    seen = collections.Counter(before.values())
    e = [0, *knlm._discounts(np.array([seen[k] for k in (1, 2, 3, 4)]))]
    follow = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), c in bi.items():
        follow[u][min(c, 3)] += 1
    spare = sum(e[min(b, 3)] for b in before.values()) / len(bi)

    def p(u, w):
        b, total = before.get(w, 0), len(train) if u == "<s>" else uni.get(u, 0)
        lower = max(b - e[min(b, 3)], 0) / len(bi) + spare / (v + 1)
        if not total:
            return lower
        c = bi.get((u, w), 0)
        return max(c - d[min(c, 3)], 0) / total + sum(d[k] * follow[u][k] for k in (1, 2, 3)) / total * lower

    return uni, n, v, p


def lm_rows():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "It's", "the"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t"), (203, "the of " * 400), (203, "the of " * 400), (None, "unseen words w1")]
    return rows


def test_model_equals_dictionaries(spark):
    rows = lm_rows()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(4)
    train = [t for i, t in rows if i is not None and i % 3]
    model = knlm.train(df.where("doc_id % 3 != 0"), ranges=5)
    uni, n, v, p = plain_model(train)
    assert (model.tokens, model.words) == (n, v) and len(model.bounds) >= 3
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in knlm.score(df, model).collect():
        x = words(texts[r.doc_id][0]) + ["</s>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(w in uni for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((uni.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *x[:-1]], x)), rel_tol=1e-9)
    assert math.isclose(sum(p("the", w) for w in uni) + p("the", "never"), 1.0, rel_tol=1e-9)


def plain_trigrams(train):
    """log10 P(word | two words) by dictionaries; a first word has the start alone as context."""
    uni, bi, tri = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        x = ["<s>", *words(t), "</s>"]
        uni.update(x[1:])
        bi.update(zip(x, x[1:]))
        tri.update(zip(x, x[1:], x[2:]))
    before = collections.Counter((u, w) for _, u, w in tri)
    adjusted = {(u, w): c if u == "<s>" else before[u, w] for (u, w), c in bi.items()}
    counts = [collections.Counter(w for _, w in bi), adjusted, tri]
    d = []
    for c in counts:
        seen = collections.Counter(c.values())
        d.append([0, *knlm._discounts(np.array([seen[k] for k in (1, 2, 3, 4)]))])
    spare = sum(d[0][min(b, 3)] for b in counts[0].values()) / len(bi)
    sums = {}
    for order in (1, 2):
        for key, c in counts[order].items():
            s = sums.setdefault(key[:-1], [0, 0.0])
            s[0] += c
            s[1] += d[order][min(c, 3)]

    def p(context, w):
        if not context:
            b = counts[0].get(w, 0)
            return max(b - d[0][min(b, 3)], 0) / len(bi) + spare / (len(uni) + 1)
        lower, k = p(context[1:], w), len(context)
        if context not in sums:
            return lower
        c, (total, left) = counts[k].get((*context, w), 0), sums[context]
        return max(c - d[k][min(c, 3)], 0) / total + left / total * lower

    return uni, p


def test_order_3_equals_dictionaries(spark):
    rows = lm_rows() + [(i, " ".join(["hot", "pair", f"x{i * 7 % 300}"] * 3)) for i in range(300, 700)] + [(901, "rare once"), (902, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = knlm.train(df.where("doc_id % 3 != 0"), ranges=9, order=3)
    uni, p = plain_trigrams([t for i, t in rows if i is not None and i % 3])
    width = model.words + 1
    assert any(b % width for b in model.trigram_bounds)  # a common pair is cut
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in knlm.score(df, model).collect():
        x = ["<s>", *words(texts[r.doc_id][0]), "</s>"]
        want = sum(math.log10(p(tuple(x[max(0, i - 2):i]), x[i])) for i in range(1, len(x)))
        assert math.isclose(r.score, want, rel_tol=1e-9)
    for context in (("w1", "w2"), ("hot", "pair"), ("<s>", "hot"), ("never", "w1"), ("<s>",)):
        assert math.isclose(sum(p(context, w) for w in uni) + p(context, "never"), 1.0, rel_tol=1e-9)
    short = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "doc_id long, text string")
    for rows_ in (short.limit(0), short.where("doc_id > 1"), short):
        small, (_, q) = knlm.train(rows_, ranges=2, order=3), plain_trigrams([r.text for r in rows_.collect()] or [""])
        for r in knlm.score(short, small).collect():
            x = ["<s>", *words({1: "a"}.get(r.doc_id, "")), "</s>"]
            want = sum(math.log10(q(tuple(x[max(0, i - 2):i]), x[i])) for i in range(1, len(x))) if small.words else 0.0
            assert math.isclose(r.score, want, rel_tol=1e-9)
    with pytest.raises(ValueError, match="order"):
        knlm.train(df, order=4)


def test_registered_language_model_sees_two_words(spark, monkeypatch):
    orders, plain = [], knlm.train
    monkeypatch.setattr(knlm, "train", lambda *a, **b: orders.append((m := plain(*a, **b)).order) or m)
    assert Q.op6_lm_score(spark, SF).count() and orders == [3]


def test_model_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = knlm.train(df.limit(0))
    assert model.tokens == 0
    assert {(r.doc_id, r.n_tokens, r.n_known, r.score) for r in knlm.score(df, model).collect()} == {(1, 3, 0, 0.0), (2, 1, 0, 0.0)}
    full = knlm.train(df, ranges=2)
    assert knlm.score(df.limit(0), full).count() == 0


def test_words_of_buffers():
    import pyarrow as pa
    texts = ["A b\tc", None, "", "x\x85y \x1cz w", "a", "b  a\n"]
    for column in (pa.array(texts), pa.array(["pad", *texts]).slice(1)):
        raw, offsets = utf8_buffer(column)
        assert count_words(raw, offsets).tolist() == [len(words(t)) for t in texts]
        h, per_row = word_hashes(raw, offsets)
        flat = [w for t in texts for w in words(t)]
        assert per_row.tolist() == [len(words(t)) for t in texts]
        assert {(a == b) == (x == y) for a, x in zip(flat, h) for b, y in zip(flat, h)} == {True}


# --- mixing

def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return {**target, **{s: level * w[s] for s in open_}}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(13)).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()
    sizes = got.groupby("source")["size"].sum().to_dict()
    want = plain_targets(sizes)
    for s, g in got.groupby("source"):
        assert math.isclose(g.target.iloc[0], want[s], rel_tol=1e-9) and (g.source_size == sizes[s]).all()
        assert abs(g.taken.sum() - want[s]) <= g["size"].max() + 1e-6
    assert (got.taken <= 2 * got["size"]).all() and (got.taken == got["size"] * got.copies).all()


def test_mix_tree_of_small_groups(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "w " * (1 + i * 7 % 40)) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), fan=8).toPandas()
    want = plain_targets(got.groupby("source")["size"].sum().to_dict())
    for s, g in got.groupby("source"):
        assert abs(g.taken.sum() - want[s]) <= g["size"].max() + 1e-6
    assert len(got) == 600


def test_pivot_is_unbiased():
    rng = np.random.default_rng(8)
    size, p = rng.integers(1, 9, 12).astype(float), np.full(12, 0.4)
    out = np.array([mixing._pivot(size, p, rng.random(12)) for _ in range(6000)])
    assert np.abs(out.mean(axis=0) - 0.4).max() < 0.03
    assert np.allclose((out * size).sum(axis=1), 0.4 * size.sum())
    assert (((out > 0) & (out < 1)).sum(axis=1) <= 1).all()


def test_mix_odd_rows(spark):
    rows = [(1, "b", "x y z"), (1, "b", "x y z"), (2, None, "one two"), (3, "a", None), (4, "a", ""), (None, "c", "q")]
    df = spark.createDataFrame([(*r, 5, 1.0) for r in rows], "doc_id long, source string, text string, size int, target double")
    got = mixing.mix(df).collect()
    assert len(got) == 6
    want = plain_targets({"a": 0, "b": 6, "c": 1, None: 2})
    assert all(math.isclose(r.target, want[r.source]) and r.taken <= 2 * r.size for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    corpus = mixing.mixed_corpus(df)
    assert corpus.columns == df.columns
    taken = collections.Counter()
    for r in corpus.collect():
        taken[r.source] += len(words(r.text))
    assert all(abs(taken[s] - want[s]) <= 3 for s in want) and taken["a"] == 0
    assert mixing.mixed_corpus(df.limit(0)).count() == 0


# --- chats

def plain_chats(rows, block):
    convs = collections.defaultdict(set)
    for c, t, r, x in rows:
        convs[c].add((t, r, x))
    order = lambda v: [(x is not None, x if x is not None else 0) for x in v]
    seq = {c: [(r, x) for _, r, x in sorted(v, key=order)] for c, v in convs.items()}
    out = []
    for c, s in seq.items():
        if any(len(o) > len(s) and o[:len(s)] == s for o in seq.values()):
            continue
        same = sorted((k for k, o in seq.items() if o == s), key=lambda k: (k is None, k))
        if c != same[0]:
            continue
        for k in range(0, len(s), block):
            text = "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in s[k:k + block])
            out.append((c, k // block, len(s), len(same), text))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2, 256])
def test_chats_equal_brute_force(spark, block):
    base = [("user", "hi"), ("assistant", "yes"), ("user", "and"), ("assistant", "no"), ("user", "bye")]
    rows = [(c, t, *base[t]) for c, n in ((1, 2), (2, 5), (3, 4), (4, 5), (5, 1)) for t in range(n)]
    rows += [(6, 10, "user", "hi"), (6, 20, "assistant", "other")]            # turns need not be dense
    rows += [(7, 0, "user", None), (8, 0, "user", ""), (9, 0, None, "hi")]   # nulls differ from empty
    rows += [(10, None, "user", "first"), (10, 0, "user", "then"), (2, 0, "user", "hi")]  # a repeated row
    rows += [(11, 3, "b", "tie"), (11, 3, "a", "tie"), (12, 0, "user", "hi " * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    got = sorted((tuple(r) for r in chat.format_chats(df, block=block).collect()), key=str)
    assert got == plain_chats(rows, block)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_oracle(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cur = con.execute(Q.ORACLES["op10_chat_format"])
    df = Q.op10_chat_format(spark, SF)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest([d[0] for d in cur.description], cur.fetchall())[0]


# --- pipeline

def test_pipeline_stage_by_stage(spark):
    """Every stage against its brute force on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == columns and kept.count() >= 0.99 * docs.count()
    rows = kept.toPandas()
    one = stages["simhash_dedup"](spark, spark.createDataFrame(rows, kept.schema), SF)
    fp = np.array([simhash.fingerprint(t) for t in rows.text], np.uint64)
    root = np.arange(len(fp))
    from potentia.llm.components import unite
    unite(root, *np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4))
    want = {min(rows.doc_id[root == g]) for g in set(root.tolist())}
    unique = one.toPandas()
    assert one.columns == columns and set(unique.doc_id) == want and len(unique) == len(want)
    clean = stages["secret_redaction"](spark, spark.createDataFrame(unique, kept.schema), SF).toPandas()
    assert len(clean) == len(unique)
    for a, b in zip(unique.sort_values("doc_id").itertuples(), clean.sort_values("doc_id").itertuples()):
        found = [m for r in secrets.RULES for m in re.finditer(r.pattern, a.text, re.ASCII | (re.I if r.ignore_case else 0))
                 if len(m[r.group]) >= r.least]
        assert (a.text == b.text) == (not found) and b.n_chars == (len(b.text) if found else a.n_chars)
        assert all(m[0] not in b.text for m in found)
    mixed = stages["source_mix"](spark, spark.createDataFrame(clean, kept.schema), SF).toPandas()
    targets = plain_targets({s: sum(len(words(t)) for t in g.text) for s, g in clean.groupby("source")})
    for s, g in clean.groupby("source"):
        taken = sum(len(words(t)) for t in mixed[mixed.source == s].text)
        assert abs(taken - targets[s]) <= max(len(words(t)) for t in g.text) + 1e-6
    last = stages["byte_bpe"](spark, spark.createDataFrame(mixed, kept.schema), SF).toPandas()
    import hashlib
    assert sorted(zip(last.doc_id, last.decoded_sha256)) == sorted(
        (d, hashlib.sha256(t.encode()).hexdigest()) for d, t in zip(mixed.doc_id, mixed.text))
    assert (last.ids.map(len) == last.n_tokens).all()


def test_pipeline_on_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the of and to", "en", "a", 13), (3, "the of and to", "en", "a", 13),
            (None, "le la les des", "fr", None, 13)]
    df = spark.createDataFrame(rows, schema)
    for start in (df, df.limit(0)):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert {r.doc_id for r in docs.collect()} <= {3, None}
