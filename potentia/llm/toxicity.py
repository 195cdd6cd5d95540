"""Toxicity by maximum-scoring segments.

Training: token weights are log-odds between toxic and clean texts under an informative
Dirichlet prior (the corpus' own token distribution, worth ``prior`` of all tokens), for whole
words and for word stems (the first 4 to 8 bytes), counted once a text. Weights whose z-score
exceeds ``least_z`` form the lexicon; any other token costs ``drift``. A token takes the most
significant of its word and stems.

Scoring: one linear pass finds all maximal scoring segments of a text (those that no extension
improves). Segment scores over clean text follow an extreme-value law with the rate lambda that
solves E[exp(lambda * score)] = 1; K is set by the clean training texts. A segment with an
expected number of chance occurrences K n exp(-lambda S) below ``significant`` is a toxic
passage. A document's statistic is the sum of its significant segments' normalised scores
lambda S - log(K n) (its best segment's, if none is); the score is the label's probability by a
logistic curve over that statistic, fitted on the training texts' histogram, so 0.7 means odds
of 7 to 3.

The lexicon is fitted on a bounded sample of labelled rows: at most ``per_class`` texts of each
label, near copies (equal minimum of the four-word shingle hashes) counted once. Scoring covers
every whole text.

Defined results: a null or empty text, or one without words, scores the same as a text without
lexicon tokens; labels null or absent teach nothing; a document labelled more than once counts
as toxic if any label is; without training rows of
both labels every score is the share of toxic ones; repeated rows give
repeated results, an empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potentia.llm.textio import mixed, per_slice, utf8_buffer, word_hashes

STEMS = (4, 5, 6, 7, 8)
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of letters."""
    return (text or "").lower().encode().translate(_KEEP).split()


@dataclass(frozen=True)
class Lexicon:
    weights: dict[bytes, float]   # a stem ends in *
    drift: float
    rate: float                   # lambda
    k: float
    slope: float = 0.0            # of the logistic curve over the statistic
    level: float = 0.0

    def scorer(self):
        stems = {n: {w[:-1]: s for w, s in self.weights.items() if w.endswith(b"*") and len(w) == n + 1} for n in STEMS}
        words = {w: s for w, s in self.weights.items() if not w.endswith(b"*")}
        opening = {w.rstrip(b"*")[:STEMS[0]] for w in self.weights}

        def hits(text: str | None) -> tuple[list[tuple[int, float]], int]:
            found, t = [], tokens(text)
            for i in [i for i, w in enumerate(t) if w[:4] in opening]:
                w = t[i]
                s = max(words.get(w, 0.0), *[stems[n].get(w[:n], 0.0) for n in STEMS])
                if s > self.drift:
                    found.append((i, s - self.drift))
            return found, len(t)

        return hits


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in linear time (Ruzzo and Tompa).

    ``hits`` are the positions with a positive score; any other position scores ``-drift``."""
    held: list[list] = []  # start, end, sum before the segment, sum at its end
    total, last = 0.0, -1
    for i, s in hits:
        total -= drift * (i - last - 1)
        segment = [i, i + 1, total, total + s]
        total, last = total + s, i
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= segment[2]:
                j -= 1
            if j < 0 or held[j][3] >= segment[3]:
                held.append(segment)
                break
            segment = [held[j][0], segment[1], held[j][2], segment[3]]
            del held[j:]
    return [(a, b, high - low) for a, b, low, high in held]


def _rate(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum(p exp(x s)) = 1 for scores of negative mean."""
    low, high = 0.0, 1.0
    while (p * np.exp(high * s)).sum() < 1.0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1.0 else (low, mid)
    return high


def _statistic(lex: Lexicon, segments, n: int, significant: float) -> tuple[float, list]:
    """(statistic, significant segments): -log of the expected chance occurrences, added up."""
    normal = [(a, b, lex.rate * s - math.log(lex.k * max(1, n))) for a, b, s in segments]
    passages = [x for x in normal if x[2] > -math.log(significant)]
    if passages:
        return sum(x[2] for x in passages), passages
    return max((x[2] for x in normal), default=-math.inf), []


_LOW, _HIGH = -2.0, 40.0  # the statistic is cut off here for the curve


def _posterior(lex: Lexicon, t: float) -> float:
    return 1.0 / (1.0 + math.exp(-(lex.slope * min(max(t, _LOW), _HIGH) + lex.level)))


def _logistic(x: np.ndarray, clean: np.ndarray, toxic: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, level) of the logistic curve through weighted points, by Newton's method."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w, n = np.zeros(2), clean + toxic
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (toxic - n * p) - ridge * w)
        w = w + np.clip(step, -1.0, 1.0)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 20_000, prior: float = 0.05, least_z: float = 3.0,
          drift: float = 0.1, max_weights: int = 50_000, significant: float = 0.05) -> Lexicon:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``; see the module's text.

    The sample bounds the texts read a second time (2 x ``per_class``) and, with ``max_weights``,
    the lexicon that scoring broadcasts."""
    spark = docs.sparkSession
    src = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")

    def sketch(piece):
        h, per_row = word_hashes(*utf8_buffer(piece.column("text")))
        least = np.zeros(len(per_row), np.uint64)
        has = np.flatnonzero(per_row)
        if len(has):
            row = np.repeat(np.arange(len(per_row)), per_row)
            s = h.copy()
            for k in (1, 2, 3):  # shingles stop at the row's end
                step = np.zeros_like(h)
                step[:-k or None] = np.where(row[k:] == row[:-k], h[k:], 0) if len(h) > k else 0
                s = mixed(s * np.uint64(31) + step)
            least[has] = np.minimum.reduceat(s, (np.cumsum(per_row) - per_row)[has])
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(least.view(np.int64))], ["doc_id", "sketch"])

    kind = src.schema["doc_id"].dataType.simpleString()
    marks = src.mapInArrow(per_slice(sketch), f"doc_id {kind}, sketch long")
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    distinct = marks.join(known, "doc_id").groupBy("toxic", "sketch").agg(F.min("doc_id").alias("doc_id")).cache()
    sizes = {r["toxic"]: r["count"] for r in distinct.groupBy("toxic").count().collect()}
    chosen = {y: distinct.where(F.col("toxic") == y).orderBy(F.xxhash64("sketch"), "sketch").limit(per_class)
              for y in (0, 1)}
    picked = chosen[0].unionByName(chosen[1]).select("doc_id", "toxic")
    sample = src.join(F.broadcast(picked), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")).cache()

    def count(batches):
        counts = (Counter(), Counter())

        def rows():
            for y in (0, 1):
                if counts[y]:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts[y]), pa.binary()),
                                                      pa.array(np.full(len(counts[y]), y, np.int32)),
                                                      pa.array(list(counts[y].values()), pa.int64())], ["token", "toxic", "n"])
                    counts[y].clear()

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set(tokens(text))
                counts[y].update(words)
                for n in STEMS:
                    counts[y].update({w[:n] + b"*" for w in words if len(w) > n})
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield from rows()
        yield from rows()

    table = (sample.mapInArrow(count, "token binary, toxic int, n long").groupBy("token")
             .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
                  F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))).cache()
    all_t, all_c = table.where(~F.col("token").cast("string").endswith("*")).agg(F.sum("t"), F.sum("c")).first()
    share = sizes.get(1, 0) / max(1, sizes.get(0, 0) + sizes.get(1, 0))
    if not all_t or not all_c:
        for x in (distinct, sample, table):
            x.unpersist()
        return Lexicon({}, drift, 1.0, 1.0, 0.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    a0 = prior * (all_t + all_c)
    a = F.lit(prior) * (F.col("t") + F.col("c"))
    odds = (F.log((F.col("t") + a) / (all_t + a0 - F.col("t") - a)) - F.log((F.col("c") + a) / (all_c + a0 - F.col("c") - a)))
    z = odds / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    best = (table.select("token", "c", odds.alias("s"), z.alias("z")).where((F.col("z") >= least_z) & (F.col("s") > 2 * drift))
            .orderBy(F.desc("z"), "token").limit(max_weights).collect())
    weights = {bytes(r["token"]): float(r["s"]) for r in best}
    lex = Lexicon(weights, drift, 1.0, 1.0)

    def clean(batches):
        hits = lex.scorer()
        for batch in batches:
            found, words = Counter(), 0
            for text in batch.column("text").to_pylist():
                h, n = hits(text)
                words += n
                found.update(round(s, 3) for _, s in h)
            found[-drift] += words - sum(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.float64()), pa.array(list(found.values()), pa.int64())],
                                             ["s", "n"])

    seen = sample.where("toxic = 0").mapInArrow(clean, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    # half a chance hit of each weight's size keeps the rate finite where clean text has none
    levels = Counter({round(s - drift, 3): 0.5 for s in weights.values()})
    for r in seen:
        levels[r["s"]] += r["n"]
    s = np.array(sorted(levels))
    p = np.array([levels[x] for x in s.tolist()])
    p /= p.sum()
    rate = _rate(p, s)
    lex = Lexicon(weights, drift, rate, 1.0)

    def chances(batches):
        hits = lex.scorer()
        for batch in batches:
            found, words = 0, 0
            for text in batch.column("text").to_pylist():
                h, n = hits(text)
                words += n
                found += sum(1 for x in maximal_segments(h, drift) if rate * x[2] >= 1.0)
            yield pa.RecordBatch.from_arrays([pa.array([found]), pa.array([words])], ["found", "words"])

    f, n = sample.where("toxic = 0").mapInArrow(chances, "found long, words long").agg(F.sum("found"), F.sum("words")).first()
    # K n exp(-1) segments of normalised score 1 or more are expected in n clean words
    lex = Lexicon(weights, drift, rate, (f + 0.5) / (max(1, n) * math.exp(-1.0)))

    def histogram(batches):
        hits = lex.scorer()
        for batch in batches:
            found = Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                h, words = hits(text)
                t, _ = _statistic(lex, maximal_segments(h, drift), words, significant)
                found[(round(min(max(t, _LOW), _HIGH), 1), y)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.float64()),
                                              pa.array([k[1] for k in found], pa.int32()),
                                              pa.array(list(found.values()), pa.int64())], ["t", "toxic", "n"])

    points = (sample.mapInArrow(histogram, "t double, toxic int, n long").groupBy("t")
              .agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"),
                   F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("y")).orderBy("t").collect())
    x, c, y = (np.array([float(r[k]) for r in points]) for k in ("t", "c", "y"))
    # the sample is balanced by its bound only; the classes weigh as in the corpus
    c, y = c * sizes.get(0, 0) / c.sum(), y * sizes.get(1, 0) / y.sum()
    slope, level = _logistic(x, c, y)
    for d in (distinct, sample, table):
        d.unpersist()
    return Lexicon(weights, drift, rate, lex.k, slope, level)


PASSAGES = "array<struct<start:long,end:long,evidence:double>>"


def score(docs: DataFrame, lexicon: Lexicon, significant: float = 0.05) -> DataFrame:
    """(doc_id, score, passages): posterior of the toxic label and the significant passages, as
    word positions with the end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    src = docs.select("doc_id", "text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))

    def run(batches):
        lex = shared.value
        hits = lex.scorer()

        def one(piece):
            scores, spans = [], []
            for text in piece.column("text").to_pylist():
                h, n = hits(text)
                t, passages = _statistic(lex, maximal_segments(h, lex.drift), n, significant)
                scores.append(_posterior(lex, t))
                spans.append([{"start": a, "end": b, "evidence": e} for a, b, e in passages])
            return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                                              ["doc_id", "score", "passages"])
        yield from per_slice(one)(batches)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double, passages {PASSAGES}")
