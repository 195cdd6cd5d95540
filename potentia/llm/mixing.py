"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document of it is then wanted
``target / source_size`` times. The whole part is certain; the fractional parts are rounded by
the pivotal method: two documents of the source meet, words move at random from one to the
other (either way with the odds that keep both expectations) until one of them is integral, and
the other meets the next. A pair's words are conserved, so a source ends at its target but for
one last document.

Documents are numbered inside their source with a distributed ranking, and consecutive runs of
``fan`` meet in one group, so a hot source is spread evenly. Each group leaves at most one
fractional document; these residuals meet again, ``fan`` groups at a time, until each source has
one group: a reduction tree of log_fan(documents) levels, the first of which does the bulk.

All draws come from md5 of the document and the seed: reruns agree on any cluster.

Defined results: a null text has size 0; null is a source of its own (last); documents of size 0
are taken 0 words, as are sources without words; repeated rows are separate documents; an empty
table gives an empty result; extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potentia.functions.rand import uniform
from potentia.llm.textio import count_words, per_slice, stage, utf8_buffer
from potentia.operators.ranking import rank_in_groups

WEIGHTS = (3.0, 1.0, 2.0)
_TINY = 1e-9


def word_sizes(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, source and size: words of the text, split at space and \\t to \\r."""
    src = docs.select(*keep, "source", "text")

    def one(piece):
        size = count_words(*utf8_buffer(piece.column("text")))
        return pa.RecordBatch.from_arrays([*[piece.column(c) for c in (*keep, "source")], pa.array(size)],
                                          [*keep, "source", "size"])
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in (*keep, "source"))
    return src.mapInArrow(per_slice(one), f"{kinds}, size long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """(source, source_no, n_docs, source_size, target), one row per source.

    Sources in code point order (null last) take the weights in turn and share ``share`` of all
    words; a target stops at ``cap`` times its source and the excess is shared again by weight.
    The water level rises by one small aggregate a round until no further source stops."""
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = rank_in_groups(totals.withColumn("_last", F.col("source").isNull()), ["_last", "source"],
                            rank_col="source_no", size_col="_sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("source_no") % len(weights) + 1).cast("int"))
    t = stage(ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
              .drop("_last", "_sources"), "mix-sources")
    goal = share * (t.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level, stopped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.col("_w") * F.lit(level)
        r = t.agg(F.sum(F.when(full, F.col("_cap"))).alias("full"), F.sum(F.when(~full, F.col("_w"))).alias("w"),
                  F.count(F.when(full, 1)).alias("n")).first()
        if r["n"] == stopped or not r["w"]:
            break
        stopped, level = r["n"], (goal - (r["full"] or 0.0)) / r["w"]
    return t.select("source", "source_no", "n_docs", "source_size",
                    F.least("_cap", F.col("_w") * F.lit(level)).alias("target"))


def _pivot(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round ``p`` so that sum(size * p) stays and all but at most one entry are 0 or 1."""
    p, held = p.copy(), -1
    for i in range(len(p)):
        if p[i] <= _TINY or p[i] >= 1 - _TINY:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up = min((1 - p[held]) * a, p[i] * b)      # words that can move to the held document
        down = min(p[held] * a, (1 - p[i]) * b)    # and from it
        moved = up if draw[i] * (up + down) < down else -down
        p[held] += moved / a
        p[i] -= moved / b
        for j in (held, i):
            if p[j] <= _TINY or p[j] >= 1 - _TINY:
                p[j] = round(p[j])
        held = held if 0 < p[held] < 1 else (i if 0 < p[i] < 1 else -1)
    return p


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0,
        seed: int = 17, fan: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, source, size, source_size, target, copies and taken for every row of
    ``docs``; the draws depend on the ``keep`` columns and the size."""
    sizes = stage(word_sizes(docs, keep), "mix-sizes")
    sources = source_targets(sizes, weights, share, cap)
    largest = sources.agg(F.max("n_docs").alias("n")).first()["n"] or 0
    s = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (sizes.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("_want", F.when(F.col("size") > 0, want).otherwise(F.lit(0.0)))
            .withColumn("_whole", F.floor(F.col("_want") + F.lit(_TINY)))
            .withColumn("_p", F.greatest(F.col("_want") - F.col("_whole"), F.lit(0.0)))
            .withColumn("_draw", uniform(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keep],
                                                     "size"), seed)))
    # the draw comes first in the order, so that groups mix large and small documents
    rows = rank_in_groups(rows, ["_draw", *keep, "size"], ["source_no"], rank_col="_rank", size_col="_n").drop("_n")
    kinds = rows.schema

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_rank"], kind="stable")
        pdf["_p"] = _pivot(pdf["size"].to_numpy(float), pdf["_p"].to_numpy(float), pdf["_draw"].to_numpy(float))
        return pdf

    groups, width, done, left = math.ceil(largest / fan), fan, [], rows
    open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
    while largest:
        met = stage(left.groupBy("source_no", F.floor(F.col("_rank") / F.lit(width)).alias("_group"))
                    .applyInPandas(meet, kinds), "mix-level")
        if groups <= 1:
            # the last document of a source is rounded by its own draw
            done.append(met.withColumn("_p", F.when(open_, (F.col("_draw") < F.col("_p")).cast("double"))
                                       .otherwise(F.col("_p"))))
            break
        done.append(met.where(~open_))
        left, width, groups = met.where(open_), width * fan, math.ceil(groups / fan)
    out = done[0] if done else rows
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("_whole") + F.col("_p")).cast("long")
    return out.select(*keep, "source", "size", "source_size", F.col("target").cast("double").alias("target"),
                      copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, columns unchanged, each as often as the mix takes it."""
    named = docs.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    # rows that are equal as a whole are drawn one by one and expanded together
    copies = (mix(named, keep=("doc_id", "__row"), **options).groupBy("doc_id", "__row").agg(F.sum("copies").alias("__copies"))
              .where("__copies > 0").withColumnRenamed("doc_id", "__id").withColumnRenamed("__row", "__key"))
    rows = (named.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key")))
            .dropDuplicates(["doc_id", "__row"]))
    return (rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
