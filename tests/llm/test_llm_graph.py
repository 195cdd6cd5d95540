"""Components, SimHash, cap filters and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
import xxhash

from potentia.llm import ann, capdedup, simhash
from potentia.llm.components import connected_components, unite
from potentia.llm import queries as Q

SF = "/root/testdata/sf0.01"


def brute_components(n, pairs):
    root = np.arange(n)
    if pairs:
        unite(root, *np.array(pairs).T)
    return root


def test_components_random_and_hub(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(500, i) for i in range(501, 700)]
    edges += [(i, i + 1) for i in range(900, 960)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = brute_components(1000, edges)
    assert all(got[x] == root[x] for e in edges for x in e if x in got)
    assert {x for e in edges if e[0] != e[1] for x in e} == set(got)


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text, k=4):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(spark):
    for t in [None, "", " \n", "One", "one two THREE", "a b c d", "É a É b É c É d é", "x\x85y z w v", "a " * 5000]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_shingle_hash_is_sparks(spark):
    from pyspark.sql import functions as F
    got = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first().h
    assert np.uint64(np.int64(got)) == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("shard_rows", [8, 64, 1 << 14])
def test_links_lose_no_pair(spark, shard_rows):
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    near = []
    for x in fp[:80]:
        for _ in range(3):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            near.append(x ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)))
    fp = np.unique(np.append(fp, near))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    want = np.arange(len(fp))
    unite(want, i, j)
    place = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    got = np.arange(len(fp))
    e = simhash.links(df, 4, shard_rows=shard_rows).collect()
    unite(got, np.array([place[r.u] for r in e]), np.array([place[r.v] for r in e]))
    assert np.array_equal(got, want)


def test_classes_equal_brute_force(spark):
    got = Q.op5_simhash_dedup(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    fp = np.array([simhash.fingerprint(t) for t in docs.text], np.uint64)
    u, inv = np.unique(fp, return_inverse=True)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    root = np.arange(len(u))
    unite(root, i, j)
    least = {}
    for g, d in zip(root[inv], docs.doc_id):
        least[g] = min(least.get(g, d), d)
    want = {d: (f"{f:016x}", least[g]) for d, f, g in zip(docs.doc_id, fp.tolist(), root[inv])}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == want


def test_simhash_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text, "g"), (1, text, "g"), (1, text, "g"), (None, text, "h"), (9, None, "g"), (8, "", "g"), (None, "lonely words here now", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `group` string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.classes(df).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (1, 1), (None, 1), (9, 8), (8, 8), (None, None)], key=str)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(1, text, "g"), (8, "", "g"), (None, "lonely words here now", "g")], key=str)
    assert simhash.classes(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0


# --- vectors

def vectors(spark, seed=1, n=400, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[:n // 4].repeat(3, axis=0) + rng.normal(size=(3 * (n // 4), dim)) * 0.2
    x = np.vstack([base, near])
    labels = np.append(np.arange(n) % 3, np.repeat(np.arange(n // 4) % 3, 3))
    rows = [(int(i), [float(v) for v in r], int(lab)) for i, (r, lab) in enumerate(zip(x, labels))]
    bad = [(5000, None, 1), (5001, [0.0] * dim, 1), (5002, [float("nan")] * dim, 1), (5003, [None] + [1.0] * (dim - 1), 1),
           (5004, [float("inf")] * dim, 1), (5005, rows[0][1], None), (5006, [1.0, 2.0], 1), (5007, [], 1)]
    return rows, spark.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<double>, label int"), bad


@pytest.mark.parametrize("filter_rows", [4096, 8])
def test_cap_filters_equal_brute_force(spark, filter_rows):
    rows, df, bad = vectors(spark)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    m = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :]) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    unite(root, *np.nonzero(m))
    out = capdedup.near_duplicates(df.withColumn("n_links", df.label), 0.93, filter_rows=filter_rows).collect()
    got = {r.vec_id: r for r in out}
    assert len(out) == len(rows) + len(bad) + 2
    found = sum(got[i].n_links for i in range(len(x)))
    assert m.sum() > 300 and found >= 0.99 * m.sum()
    assert all(got[i].n_links <= m[i].sum() for i in range(len(x)))
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) >= 0.99
    assert all(got[b[0]].n_links == 0 and got[b[0]].component_id == b[0] and got[b[0]].kept for b in bad)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_product_code_decodes_every_exceeding_direction():
    code = capdedup.ProductCode(10, 16, 20)
    x = np.random.default_rng(0).normal(size=(50, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, found = code.decode(x)
    t = x @ code.turn
    whole = (t[:, :5] @ code.first)[:, :, None] + (t[:, 5:] @ code.second)[:, None, :]
    want = {(i, a * 16 + b) for i, a, b in zip(*np.nonzero(whole / np.sqrt(2) >= code.least))}
    have = set(zip(row.tolist(), found.tolist()))
    assert want <= have and all(sum(r == i for r, _ in have) >= 1 for i in range(50))


def test_cap_filters_on_no_rows(spark):
    _, df, _ = vectors(spark)
    assert capdedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_links_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in Q.op9_embedding_dedup(spark, SF).collect()}
    p = df.toPandas()
    x = np.stack(p.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = (x @ x.T >= 0.93) & (p.label.to_numpy()[:, None] == p.label.to_numpy()[None, :])
    assert sum(got.values()) >= 0.9 * (m.sum() - len(x))


def planted(spark, seed=6):
    """The given embeddings with near copies, a large group of near copies and one of equal vectors."""
    p = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    rng = np.random.default_rng(seed)
    base = np.stack(p.embedding).astype(float)
    turns = lambda x, amount: x + rng.normal(size=x.shape) * amount * np.linalg.norm(x, axis=-1, keepdims=True) / 8
    near = turns(base[:200], rng.uniform(0.1, 0.5, (200, 1)))
    group = turns(np.repeat(base[300:301], 250, axis=0), 0.22)
    same = np.repeat(base[301:302], 120, axis=0)
    x = np.concatenate([base, near, group, same]).astype(np.float32)
    label = np.concatenate([p.label, p.label[:200], np.repeat(p.label[300], 250), np.repeat(p.label[301], 120)])
    rows = [(int(i), v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x, label))]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("parts, filter_rows", [(1, 4096), (7, 60)])
def test_planted_links_recall(spark, parts, filter_rows):
    rows, df = planted(spark)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    m = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(m, False)
    want = np.arange(len(rows))
    unite(want, *np.nonzero(m))
    got = {r.vec_id: r for r in capdedup.near_duplicates(df.repartition(parts), 0.93, filter_rows=filter_rows).collect()}
    n = np.array([got[i].n_links for i in range(len(rows))])
    assert m.sum() > 40_000 and n.sum() >= 0.99 * m.sum() and (n <= m.sum(axis=1)).all()
    same = np.flatnonzero((x == x[-1]).all(axis=1))
    assert len(same) == 121 and len({got[i].component_id for i in same}) == 1
    assert np.mean([got[i].component_id == want[i] for i in range(len(rows))]) >= 0.995


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (5, [1.0, 0.0], 1)]
    out = capdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(1, 1, 1), (2, 3, 1), (2, 3, 1), (3, 2, 1), (4, 2, 1), (5, 0, 5)]


def test_neighbours_recall_and_exact_scores(spark):
    got = Q.op8_nearest_neighbours(spark, SF).toPandas()
    p = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    hits = 0
    queries = np.flatnonzero(ids % 100 == 0)
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and mine.score.is_monotonic_increasing
        assert np.allclose(mine.score, [d[ids == v][0] for v in mine.vec_id], rtol=1e-14)
        hits += len(set(mine.vec_id) & set(ids[np.lexsort((ids, d))[:10]]))
    assert hits >= 0.9 * 10 * len(queries)


@pytest.mark.parametrize("chunks", [{}, {"chunk_rows": 16, "chunk_queries": 2}])
def test_neighbours_of_odd_rows(spark, chunks):
    from pyspark.sql import functions as F
    rows, df, _ = vectors(spark, n=60)
    out = ann.search(df.withColumn("rank", F.lit(1)), F.col("vec_id") % 10 == 0, k=5, **chunks).collect()
    x = np.array([r[1] for r in rows])
    hits = 0
    for q in range(0, len(rows), 10):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        mine = sorted((r.rank, r.vec_id) for r in out if r.query_id == q)
        assert [r for r, _ in mine] == [1, 2, 3, 4, 5]
        hits += len({v for _, v in mine} & set(np.argsort(d)[:5].tolist()))
    assert hits >= 0.9 * 5 * len(range(0, len(rows), 10))
    assert {r.query_id for r in out} == set(range(0, len(rows), 10))


def test_neighbours_fewer_than_k_and_ties(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (7, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") == 0, k=10).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1.0), (3, 1.0), (7, 1.0)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(df, F.lit(False)).count() == 0


def test_neighbours_of_each_length(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8 if i < 40 else 5 if i < 60 else 3).tolist()) for i in range(61)] + [(2, rng.normal(size=5).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id").isin(2, 45, 60), k=4)
    near = {}
    for q, x in rows:
        if q in (2, 45, 60):
            near.setdefault(q, []).extend((float(np.sqrt(((np.array(x) - y) ** 2).sum())), v) for v, y in rows if v != q and len(y) == len(x))
    for q in (2, 45, 60):  # 60 is alone with its length
        want = sorted(near[q])[:4]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got.collect() if r.query_id == q)
        assert [m[1] for m in mine] == [w[1] for w in want] and np.allclose([m[2] for m in mine], [w[0] for w in want])
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
