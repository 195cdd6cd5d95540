"""Language identification by mixture inference.

A language model per learned language is a smoothed distribution over hashed byte trigrams,
counted over every labelled training text. A document is a bag of words whose language is
hidden: a word's likelihood under a language is the product of its trigram probabilities,
and expectation-maximisation over the words gives the document's language proportions. The
language set is chosen by penalised likelihood: languages enter in the order of their
proportions under the full mixture, and a set is kept when its log-likelihood gains more
than the penalty times log(words) / 2 for each further language.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to the
language that sorts first; without any labelled row every document is ``und``; repeated rows
give repeated results, an empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potentia.llm.textio import per_slice

BUCKETS = 1 << 16
UND = "und"

_LETTER = regex.compile(r"\p{L}")
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_IS_LETTER[128:] = True


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket per letter byte, first position of each word in it, row of each word)."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    row_start = np.cumsum([1] + [len(p) + 1 for p in parts[:-1]])
    solid = _IS_LETTER[raw]
    low = np.where(solid, raw, 0).astype(np.uint32)
    at = np.flatnonzero(solid)
    code = (low[at - 1] << 16) | (low[at] << 8) | low[at + 1]
    code = (code * np.uint32(2654435761)) >> np.uint32(16)
    first = np.flatnonzero(~solid[at - 1])
    row = np.searchsorted(row_start, at[first], "right") - 1
    return code, first, row


def train(docs: DataFrame, max_languages: int = 256) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities float32 [languages, BUCKETS]) from ``docs(lang, text)``.

    Every row with a language and a text counts. The model has languages x BUCKETS cells; more
    than ``max_languages`` distinct languages is an error, so the broadcast stays below
    ``max_languages`` x 256 KB."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches):
        counts: dict[str, np.ndarray] = {}

        def add(piece):
            langs, texts = np.array(piece.column("lang").to_pylist(), object), piece.column("text").to_pylist()
            code, first, row = _words(texts)
            of_word = langs[row] if len(row) else langs[:0]
            sizes = np.diff(np.append(first, len(code)))
            of_code = np.repeat(of_word, sizes)
            for lang in set(langs.tolist()):
                total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total += np.bincount(code[of_code == lang], minlength=BUCKETS)

        for _ in per_slice(add)(batches):
            pass
        for lang, total in counts.items():
            b = np.flatnonzero(total)
            # the row with bucket -1 keeps a language whose texts have no letters
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(b) + 1), pa.string()),
                                              pa.array(np.append(b, -1).astype(np.int32)),
                                              pa.array(np.append(total[b], 0))], ["lang", "bucket", "n"])

    grams = (rows.mapInArrow(count, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    packed = (grams.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
              .limit(max_languages + 1).collect())
    if len(packed) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages if that is meant")
    packed.sort(key=lambda r: r["lang"])
    model = np.zeros((len(packed), BUCKETS))
    for k, r in enumerate(packed):
        b = np.array(r["b"])
        model[k, b[b >= 0]] = np.array(r["n"])[b >= 0]
    model += 0.5
    model = np.log(model / model.sum(axis=1, keepdims=True)) if len(packed) else model
    return [r["lang"] for r in packed], model.astype(np.float32)


def _em(lik: np.ndarray, start: np.ndarray, size: np.ndarray, pi: np.ndarray, rounds: int, tol: float):
    """Proportions and log-likelihood of each document; ``lik`` [words, languages] row-scaled. A document
    stops by its own change, so it does not matter which others it is with."""
    whole, out, here, live = lik, pi.copy(), np.arange(len(size)), np.ones(len(size), bool)
    n, at = size, start
    for _ in range(rounds):
        r = lik * pi[np.repeat(np.arange(len(n)), n)]
        r /= r.sum(axis=1, keepdims=True)
        new = np.add.reduceat(r, at, axis=0) / n[:, None]
        change = np.abs(new - pi).max(axis=1)
        out[here[live]] = new[live]
        live &= change >= tol
        if not live.any():
            break
        pi = new
        if 2 * live.sum() < len(live):  # go on with the rest alone
            lik, pi, here, n = lik[np.repeat(live, n)], new[live], here[live], n[live]
            at = np.append(0, np.cumsum(n)[:-1])
            live = np.ones(len(n), bool)
    of = np.repeat(np.arange(len(size)), size)
    return out, np.add.reduceat(np.log((whole * out[of]).sum(axis=1)), start)


def infer(texts: list[str | None], model: np.ndarray, rounds: int = 12, tol: float = 2e-3,
          penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with words, their proportions [rows, languages] within the chosen set, words)."""
    code, first, row = _words(texts)
    if not len(first) or not len(model):
        return np.zeros(0, int), np.zeros((0, len(model))), np.zeros(0, int)
    logs = np.stack([np.add.reduceat(m[code], first) for m in model], axis=1)
    logs -= logs.max(axis=1, keepdims=True)
    lik = np.exp(np.maximum(logs, -60.0))
    rows, start = np.unique(row, return_index=True)
    size = np.diff(np.append(start, len(row)))
    k = lik.shape[1]
    full, top = _em(lik, start, size, np.full((len(rows), k), 1.0 / k, np.float32), rounds, tol)
    single = np.add.reduceat(np.maximum(logs, -60.0), start, axis=0)
    best = single.argmax(axis=1)
    cost = penalty * 0.5 * np.log(size + 1.0)
    pi = np.zeros((len(rows), k))
    pi[np.arange(len(rows)), best] = 1.0
    value = single.max(axis=1).astype(np.float64)
    # a set of languages gains at most what the full mixture gains over the best single one
    left = np.flatnonzero(top - value > cost)
    order = np.argsort(-full, axis=1, kind="stable")
    for m in range(2, k + 1):
        if not len(left):
            break
        words = np.concatenate([np.arange(start[i], start[i] + size[i]) for i in left])
        some = np.zeros((len(left), k), np.float32)
        np.put_along_axis(some, order[left, :m], 1.0 / m, axis=1)
        sub, got = _em(lik[words] + 1e-30, np.append(0, np.cumsum(size[left])[:-1]), size[left], some, rounds, tol)
        gain = got - cost[left] * (m - 1) > value[left]
        value[left[gain]] = (got - cost[left] * (m - 1))[gain]
        pi[left[gain]] = sub[gain]
        left = left[gain]
    return rows, pi, size


def _identify(texts: list[str | None], languages: list[str], model: np.ndarray, smooth: float):
    """(language, score, size of the language set, unsmoothed share of the words) of each text."""
    pred, score, sets = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int32)
    plain = np.zeros(len(texts))
    rows, pi, size = infer(texts, model)
    if len(rows):
        top = pi.argmax(axis=1)
        share = np.minimum((pi.max(axis=1) * size + smooth) / (size + smooth * len(languages)), 1.0)
        for i, r in enumerate(rows.tolist()):
            if _LETTER.search(texts[r]):
                pred[r], score[r], sets[r] = languages[top[i]], share[i], (pi[i] > 0).sum()
                plain[r] = pi[i].max()
    return pred, score, sets, plain


def predict(docs: DataFrame, languages: list[str], model: np.ndarray, smooth: float = 0.25) -> DataFrame:
    """(doc_id, lang_pred, score, n_langs): the language, the smoothed share of the words in it and
    the size of the chosen language set. Reads the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select("doc_id", "text")

    def run(batches):
        table = shared.value

        def one(piece):
            pred, score, sets, _ = _identify(piece.column("text").to_pylist(), languages, table, smooth)
            return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(sets)],
                                              ["doc_id", "lang_pred", "score", "n_langs"])
        yield from per_slice(one)(batches)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_langs int")


def keep_identified(docs: DataFrame, training: Column, least: float = 1 / 3, smooth: float = 0.25) -> DataFrame:
    """Rows of which an identified language has at least the share ``least`` of the words, not
    smoothed, so that it does not depend on how many languages there are; columns unchanged.

    ``training`` says which rows teach the model."""
    languages, model = train(docs.where(training))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = shared.value

        def one(piece):
            pred, _, _, plain = _identify(piece.column("text").to_pylist(), languages, table, smooth)
            # the EM stops within 2e-3 of a proportion
            return piece.filter(pa.array([p != UND and s >= least - 2e-3 for p, s in zip(pred, plain.tolist())], pa.bool_()))
        yield from per_slice(one)(batches)

    return docs.mapInArrow(run, docs.schema)
