"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark, memory-mapped by workers.

Counting takes two shuffles of packed arrays at order 2, four at order 3. Blocks of training tokens are hashed (64 bits a
word), counted, cut into ranges of the hash and merged per range: the vocabulary, a sorted hash
array with counts, where a word's id is its place. Then blocks of token pairs (context id, word
id) are counted, cut into ranges of the pair and merged per range: sorted arrays of contexts,
words and counts, one file a range. Range boundaries lie at equal numbers of tokens, so a
frequent context is split over several ranges. Merging a range also yields how many words
follow each context once, twice and more often, and how many contexts precede each word; a last
small shuffle adds these up by id.

Order 3 counts trigrams as (place of the pair of context words among all pairs, word id), cut into
ranges at the bounds of the pair ranges and, inside a pair that alone has a range's share of tokens,
at words. Merging a range yields the counts, how many words follow each pair once, twice and more
often, and the pair (u, w) that each distinct trigram (t, u, w) ends with; another shuffle adds
these up by pair to the number of words before it, which replaces the pair's count.

The arrays lie in the shared folder of ``spark.checkpoint.dir`` (or ``folder``), which the
executors must see as files; workers map them and page in what they look up. A repeated task
writes the same files again, so lost executors do no harm. What reaches the driver is a few
numbers for each range.

The model of order 2: P(w | u) = max(c(uw) - D(c), 0) / c(u) + g(u) P1(w), with P1 built likewise from the
number of distinct contexts before w and a uniform share over the vocabulary and one unknown
word; discounts D1, D2, D3+ come from the counts of counts. A text is its words and one end
token; its first word follows a start context. Order 3: P(w | t u) = max(c(tuw) - D(c), 0) / c(tu) +
g(tu) P(w | u), where P(w | u) is built from the numbers of distinct words before uw instead of c(uw);
pairs at the start of a text have nothing before them and keep their counts, and the first word has
the start alone as context.

Defined results: a null or empty text has one token, the end; an empty training set gives the
uniform model over the unknown word (log10 1 = 0 a token); repeated rows give repeated results, an
empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potentia.llm.textio import slices, stage, utf8_buffer, word_hashes
from potentia.session import checkpoint_dir

END = np.uint64(0x5EED0E0D0E0D5EED)
BLOCK_TOKENS = 2 << 20
TRIGRAM_BLOCK_TOKENS = 1 << 20  # more arrays a token
_OVER = 255  # pair counts from here on are kept apart


def shared_folder(df: DataFrame, label: str) -> str:
    """A new folder under the checkpoint folder, as a path that every worker can open."""
    url = urlparse(checkpoint_dir(df.sparkSession))
    if url.scheme not in ("", "file"):
        raise ValueError("the model's arrays are memory-mapped: give a folder that is mounted on every worker")
    path = os.path.join(url.path, f"{label}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _pack(a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _steps(sorted_: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, which compress better."""
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


def _token_blocks(batches, text: str = "text", tokens: int = BLOCK_TOKENS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token hashes with an end token after each row, tokens per row), by blocks."""
    held, rows, n = [], [], 0
    for piece in slices(batches, text):
        h, per_row = word_hashes(*utf8_buffer(piece.column(text)))
        held.append(np.insert(h, np.cumsum(per_row), END))
        rows.append(per_row + 1)
        n += len(held[-1])
        if n >= tokens:
            yield np.concatenate(held), np.concatenate(rows)
            held, rows, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(rows)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys and the sums of the values over each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return (keys[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values])


def _write(path: str, a: np.ndarray) -> None:
    """A whole file at once; a repeated task replaces it by the same bytes."""
    part = f"{path}.{uuid.uuid4().hex}"
    a.tofile(part)
    os.replace(part, path)


def _write_all(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after another in one file, each padded to 8 bytes; their lengths stand before them."""
    parts = [np.array([len(a) for a in arrays], "<i8").tobytes()]
    for a in arrays:
        parts += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
    _write(path, np.frombuffer(b"".join(parts), np.uint8))


def _read_all(path: str, dtypes: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of ``_write_all``, mapped without a file that stays open."""
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    at, out = 8 * len(dtypes), []
    for n, dtype in zip(np.frombuffer(data, "<i8", len(dtypes)).tolist(), dtypes):
        out.append(np.frombuffer(data, dtype, n, at))
        at += -(-n * np.dtype(dtype).itemsize // 8) * 8
    return out


_SMALL = ("u1", "<i8", "<i8")


def _small(a: np.ndarray) -> list[np.ndarray]:
    """Counts in a byte each, the places of large ones and these."""
    large = np.flatnonzero(a >= _OVER)
    return [np.minimum(a, _OVER).astype("u1"), large.astype("<i8"), a[large].astype("<i8")]


def _large(count: np.ndarray, large_at: np.ndarray, large: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The counts at places of arrays made by ``_small``."""
    n = count[at].astype(np.int64)
    if len(large_at):
        over = np.flatnonzero(n == _OVER)
        n[over] = large[np.searchsorted(large_at, at[over])]
    return n


def _bisect(word: np.ndarray, low: np.ndarray, high: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``w`` lie in ``word[low:high]``, sorted there, and where; changes ``low`` and ``high``."""
    end = high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):  # first place in [low, end) whose word is not below w
        mid = (low[open_] + high[open_]) >> 1
        below = word[mid] < w[open_]
        low[open_[below]], high[open_[~below]] = mid[below] + 1, mid[~below]
        open_ = open_[low[open_] < high[open_]]
    found = np.flatnonzero(low < end)
    found = found[word[low[found]] == w[found]]
    return found, low[found]


def _region(path: str, dtype, at: int, a: np.ndarray) -> None:
    if len(a):
        m = np.memmap(path, dtype, "r+", offset=at * np.dtype(dtype).itemsize, shape=(len(a),))
        m[:] = a
        m.flush()


def _discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the numbers of entries counted once to four times, kept within (0, k)."""
    n1, n2, n3, n4 = (max(float(x), 0.5) for x in n)
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.95, 1.95, 2.95])


@dataclass
class Model:
    """Where the arrays lie and the numbers that hold for all of them; small enough to ship."""
    folder: str
    words: int = 0                       # distinct tokens V, the end included
    tokens: int = 0                      # N
    texts: int = 0
    bounds: list[int] = field(default_factory=list)    # first pair of each range but the first
    sizes: list[tuple[int, int, int]] = field(default_factory=list)  # contexts, pairs, large counts
    pair_discounts: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])
    word_discounts: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])
    pairs: int = 0                       # distinct pairs
    spare: float = 1.0                   # share of P1 that the uniform distribution gets
    order: int = 2
    trigram_bounds: list[int] = field(default_factory=list)  # first trigram of each range but the first
    trigram_ranges: list[bool] = field(default_factory=list)  # which ranges have any
    trigram_discounts: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])

    def _map(self, name: str, dtype, n: int) -> np.ndarray:
        return np.memmap(os.path.join(self.folder, name), dtype, "r", shape=(n,)) if n else np.zeros(0, dtype)

    def open(self) -> Arrays:
        return Arrays(self)


class Arrays:
    """The mapped arrays of a model and the lookups in them."""

    def __init__(self, model: Model):
        self.model, v = model, model.words
        self.hash, self.count = model._map("word.hash", "<u8", v), model._map("word.count", "<i8", v)
        ready = bool(model.sizes)
        self.before = model._map("word.before", "<i8", v) if ready else None
        self.share = model._map("context.share", "<f8", v + 1) if ready else None
        self.ranges = []
        for k, (contexts, pairs, large) in enumerate(model.sizes):
            self.ranges.append((model._map(f"pair.{k}.context", "<u4", contexts), model._map(f"pair.{k}.start", "<i8", contexts + (contexts > 0)),
                                model._map(f"pair.{k}.word", "<u4", pairs), model._map(f"pair.{k}.count", "u1", pairs),
                                model._map(f"pair.{k}.large_at", "<i8", large), model._map(f"pair.{k}.large", "<i8", large)))
        self.offsets = np.cumsum([0] + [s[1] for s in model.sizes])
        self.adjusted, self.trigrams = None, None
        if model.order == 3 and model.trigram_ranges:
            self.total = model._map("context.total", "<i8", v + 1)
            self.adjusted = [_read_all(os.path.join(model.folder, f"adjusted.{k}"), _SMALL) for k in range(len(model.sizes))]
            self.trigrams = [_read_all(os.path.join(model.folder, f"trigram.{k}"), ("<i8", "<u4", "<u4", *_SMALL * 4)) if some else None
                             for k, some in enumerate(model.trigram_ranges)]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary; V + 1 for unknown words (V is the start context)."""
        if not self.model.words:
            return np.full(len(hashes), 1, np.int64)
        distinct, back = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, distinct), self.model.words - 1)
        return np.where(self.hash[at] == distinct, at, self.model.words + 1)[back]

    def _pairs(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(range, which of the sorted (context << 32 | word) keys it has, their places in it)."""
        cuts = np.append(np.append(0, np.searchsorted(keys, np.array(self.model.bounds, np.uint64))), len(keys))
        for k, ((context, start, word, *_), a, b) in enumerate(zip(self.ranges, cuts[:-1], cuts[1:])):
            if a == b or not len(context):
                continue
            u, w = (keys[a:b] >> np.uint64(32)).astype(np.uint32), (keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            c = np.minimum(np.searchsorted(context, u), len(context) - 1)
            known = context[c] == u
            found, at = _bisect(word, np.where(known, start[c], 0), np.where(known, start[c + 1], 0), w)
            yield k, found + a, at

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Training counts of sorted (context << 32 | word) keys."""
        out = np.zeros(len(keys), np.int64)
        for k, found, at in self._pairs(keys):
            out[found] = _large(*self.ranges[k][3:], at)
        return out

    def pair_places(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted (context << 32 | word) keys among all pairs, -1 if not counted."""
        out = np.full(len(keys), -1, np.int64)
        for k, found, at in self._pairs(keys):
            out[found] = at + self.offsets[k]
        return out

    def trigram_counts(self, keys: np.ndarray) -> np.ndarray:
        """Training counts of sorted (place of a pair x (V + 1) + word) keys."""
        out, width = np.zeros(len(keys), np.int64), np.uint64(self.model.words + 1)
        cuts = np.append(np.append(0, np.searchsorted(keys, np.array(self.model.trigram_bounds, np.uint64))), len(keys))
        for arrays, a, b in zip(self.trigrams, cuts[:-1], cuts[1:]):
            if a == b or arrays is None:
                continue
            first, start, word, *counts = arrays
            place = keys[a:b] // width
            w = (keys[a:b] - place * width).astype(np.uint32)
            at = place.astype(np.int64) - first[0]
            inside = (at >= 0) & (at < len(start) - 1)
            at = np.where(inside, at, 0)
            found, at = _bisect(word, np.where(inside, start[at], 0).astype(np.int64), np.where(inside, start[at + 1], 0).astype(np.int64), w)
            out[found + a] = _large(*counts[:3], at)
        return out

    def followers(self, places: np.ndarray) -> np.ndarray:
        """How many words follow each of the pairs at sorted places once, twice and more often."""
        out = np.zeros((3, len(places)), np.int64)
        for arrays in self.trigrams:  # a pair may lie in several ranges
            if arrays is not None:
                first, start, _, *counts = arrays
                a, b = np.searchsorted(places, [first[0], first[0] + len(start) - 1])
                for i in range(3 if a < b else 0):
                    out[i, a:b] += _large(*counts[3 * i + 3:3 * i + 6], places[a:b] - first[0])
        return out

    def log10_of_order_3(self, ids: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        """log10 probability of each token after the two before it in its row."""
        m, v = self.model, self.model.words
        if self.trigrams is None:
            return self.log10_probabilities(_contexts(ids, per_row, v), ids)
        known = ids < v
        before = np.where(known, self.before[np.minimum(ids, v - 1)], 0)
        d = np.array([0.0, *m.word_discounts])
        p = np.maximum(before - d[np.minimum(before, 3)], 0.0) / max(1, m.pairs) + m.spare / (v + 1)
        # pairs
        context = _contexts(ids, per_row, v)
        keys = np.where(known & (context <= v), (context.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64),
                        np.uint64((1 << 64) - 1))
        distinct, back = np.unique(keys, return_inverse=True)
        place, raw, n = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        for k, found, at in self._pairs(distinct):
            place[found], raw[found], n[found] = at + self.offsets[k], _large(*self.ranges[k][3:], at), _large(*self.adjusted[k], at)
        n = n[back]
        total = np.where(context <= v, self.total[np.minimum(context, v)], 0)
        d = np.array([0.0, *m.pair_discounts])
        p *= np.where(total > 0, self.share[np.minimum(context, v)], 1.0)
        p += np.maximum(n - d[np.minimum(n, 3)], 0.0) / np.maximum(total, 1)
        # trigrams: the pair before a token is its context
        d = np.array([0.0, *m.trigram_discounts])
        follow = np.zeros((3, len(distinct)), np.int64)
        counted = np.flatnonzero(place >= 0)  # in the order of places, as the keys are
        follow[:, counted] = self.followers(place[counted])
        share = np.where(follow.any(axis=0), (d[1:] @ follow) / np.maximum(raw, 1), 1.0)
        raw[~follow.any(axis=0)] = 0
        pair = np.full(len(ids), -1, np.int64)
        pair[1:] = back[:-1]
        pair[np.cumsum(per_row) - per_row] = -1
        after = np.flatnonzero((pair >= 0) & (raw[pair] > 0))
        pair = pair[after]
        at, w = place[pair].astype(np.uint64), ids[after]
        keys, back = np.unique(np.where(w < v, at * np.uint64(v + 1) + np.minimum(w, v).astype(np.uint64), np.uint64((1 << 64) - 1)),
                               return_inverse=True)
        n = self.trigram_counts(keys)[back]
        p[after] = np.maximum(n - d[np.minimum(n, 3)], 0.0) / raw[pair] + share[pair] * p[after]
        return np.log10(p)

    def log10_probabilities(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        m, v = self.model, self.model.words
        if not v:
            return np.zeros(len(word))
        known = word < v
        before = np.where(known, self.before[np.minimum(word, v - 1)], 0)
        d = np.array([0.0, *m.word_discounts])
        lower = np.maximum(before - d[np.minimum(before, 3)], 0.0) / max(1, m.pairs) + m.spare / (v + 1)
        total = np.where(context < v, self.count[np.minimum(context, v - 1)], np.where(context == v, m.texts, 0))
        keys = np.where(known & (context <= v), (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64),
                        np.uint64((1 << 64) - 1))
        distinct, back = np.unique(keys, return_inverse=True)
        c = self.pair_counts(distinct)[back]
        d = np.array([0.0, *m.pair_discounts])
        share = np.where(total > 0, self.share[np.minimum(context, v)], 1.0)
        higher = np.maximum(c - d[np.minimum(c, 3)], 0.0) / np.maximum(total, 1)
        return np.log10(higher + share * lower)


def _contexts(ids: np.ndarray, per_row: np.ndarray, start: int) -> np.ndarray:
    """The token before each token, ``start`` before a row's first."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[(np.cumsum(per_row) - per_row)] = start
    return out


def train(docs: DataFrame, ranges: int | None = None, folder: str | None = None, order: int = 2) -> Model:
    """Count ``docs(text)`` and write the model's arrays; ``order`` is 2 or 3.

    ``ranges`` (default: the session's shuffle partitions) must grow with the corpus so that one
    range of pairs or trigrams fits a task."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(folder or shared_folder(docs, "ngrams"), order=order)
    text = docs.select("text")

    # --- vocabulary: ranges of the hash
    def count_words(batches):
        edge = (np.arange(1, ranges, dtype=np.float64) * (2.0 ** 64 / ranges)).astype(np.uint64)
        for h, _ in _token_blocks(batches):
            keys, n = np.unique(h, return_counts=True)
            cuts = np.append(np.append(0, np.searchsorted(keys, edge)), len(keys))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b:
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([_pack(_steps(keys[a:b]))], pa.binary()),
                                                      pa.array([_pack(n[a:b].astype("<i8"))], pa.binary())], ["r", "keys", "n"])

    def merge_words(t: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_unpack(x, "<u8"), dtype=np.uint64) for x in t.column("keys").to_pylist()])
        keys, n = _sum_by(keys, np.concatenate([_unpack(x, "<i8") for x in t.column("n").to_pylist()]))
        return pa.table({"r": t.column("r").slice(0, 1), "words": [len(keys)], "tokens": [int(n.sum())],
                         "keys": pa.array([_pack(_steps(keys))], pa.binary()), "n": pa.array([_pack(n)], pa.binary())})

    words = stage(text.mapInArrow(count_words, "r long, keys binary, n binary").groupBy("r")
                  .applyInArrow(merge_words, "r long, words long, tokens long, keys binary, n binary"), "bigram-words")
    sizes = sorted(words.select("r", "words", "tokens").collect())
    model.words, model.tokens = sum(s[1] for s in sizes), sum(s[2] for s in sizes)
    if not model.words:
        return model
    at, mass, places = 0, 0, {}
    for r, n, tokens in sizes:
        places[r] = (at, mass)
        at, mass = at + n, mass + tokens
    v, per_range = model.words, -(-model.tokens // ranges)
    for name, n in (("word.hash", v), ("word.count", v), ("word.before", v), ("context.share", v + 1),
                    *[("context.total", v + 1)] * (order == 3)):
        with open(os.path.join(model.folder, name), "wb") as f:
            f.truncate(n * 8)
    where = model.folder

    def write_words(batches):
        for batch in batches:
            for r, keys, n in zip(*[batch.column(c).to_pylist() for c in ("r", "keys", "n")]):
                at, mass = places[r]
                keys, n = np.cumsum(_unpack(keys, "<u8"), dtype=np.uint64), _unpack(n, "<i8")
                _region(os.path.join(where, "word.hash"), "<u8", at, keys)
                _region(os.path.join(where, "word.count"), "<i8", at, n)
                # the pairs at each multiple of per_range tokens, taken as even within a context
                ends = np.cumsum(n) + mass
                marks = np.arange(mass // per_range + 1, ends[-1] // per_range + 1) * per_range
                i = np.minimum(np.searchsorted(ends, marks), len(n) - 1)
                inside = ((marks - (ends[i] - n[i])) / n[i] * v).astype(np.uint64)
                end = np.flatnonzero(keys == END)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(n[end[0]]) if len(end) else 0]),
                     pa.array([((i + at).astype(np.uint64) << np.uint64(32) | np.minimum(inside, np.uint64(v))).tolist()],
                              pa.list_(pa.int64()))], ["texts", "bounds"])

    done = words.mapInArrow(write_words, "texts long, bounds array<long>").collect()
    model.texts = sum(d["texts"] for d in done)
    model.bounds = sorted({b for d in done for b in d["bounds"]})[:ranges - 1]
    vocabulary = Model(model.folder, model.words)
    bounds = np.array(model.bounds, np.uint64)

    # --- pairs: ranges of (context, word)
    def count_pairs(batches):
        arrays = vocabulary.open()
        for h, per_row in _token_blocks(batches):
            ids = arrays.ids(h)
            keys, n = np.unique((_contexts(ids, per_row, v).astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64),
                                return_counts=True)
            cuts = np.append(np.append(0, np.searchsorted(keys, bounds)), len(keys))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k]), pa.array([_pack(_steps(keys[a:b] >> np.uint64(32)).astype("<u4"))], pa.binary()),
                         pa.array([_pack((keys[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4"))], pa.binary()),
                         pa.array([_pack(n[a:b].astype("<i8"))], pa.binary())], ["r", "contexts", "words", "n"])

    starts = np.array([places[s[0]][0] for s in sizes])

    def merge_pairs(t: pa.Table) -> pa.Table:
        k = t.column("r")[0].as_py()
        u = np.concatenate([np.cumsum(_unpack(x, "<u4"), dtype=np.uint64) for x in t.column("contexts").to_pylist()])
        w = np.concatenate([_unpack(x, "<u4") for x in t.column("words").to_pylist()]).astype(np.uint64)
        keys, n = _sum_by(u << np.uint64(32) | w, np.concatenate([_unpack(x, "<i8") for x in t.column("n").to_pylist()]))
        u, w = (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        context, first = np.unique(u, return_index=True)
        large = np.flatnonzero(n >= _OVER)
        for name, a in (("context", context), ("start", np.append(first, len(u)).astype("<i8")), ("word", w),
                        ("count", np.minimum(n, _OVER).astype("u1")), ("large_at", large.astype("<i8")), ("large", n[large])):
            _write(os.path.join(where, f"pair.{k}.{name}"), a)
        if order == 3:  # the numbers of words before pairs replace the counts
            heavy = np.flatnonzero(n > per_range)
            return pa.table({"range": pa.array([k]), "contexts": pa.array([len(context)]), "pairs": pa.array([len(u)]),
                             "large": pa.array([len(large)]), "heavy": pa.array([heavy.tolist()], pa.list_(pa.int64())),
                             "heavy_n": pa.array([n[heavy].tolist()], pa.list_(pa.int64()))})
        return pair_stats(k, u, w, n, {"contexts": len(context), "pairs": len(u), "large": len(large)})

    def pair_stats(k: int, u: np.ndarray, w: np.ndarray, n: np.ndarray, more: dict[str, int]) -> pa.Table:
        """What the pairs of a range add to their words' numbers, by range of words."""
        rows: dict[str, list] = {x: [] for x in ("r", "kind", "ids", "n")}

        def add(kind: str, ids: np.ndarray, values: np.ndarray):
            of = np.searchsorted(starts, ids, "right") - 1
            for r in np.unique(of).tolist():
                some = of == r
                rows["r"].append(r)
                rows["kind"].append(kind)
                rows["ids"].append(_pack(_steps(ids[some].astype("<u4"))))
                rows["n"].append(_pack(values[some].astype("<i8")))

        for kind, mask in (("once", n == 1), ("twice", n == 2), ("more", n >= 3)):
            ids, c = np.unique(u[mask], return_counts=True)
            add(kind, ids, c)
        if order == 3:
            add("total", *_sum_by(u, n))
        ids, c = np.unique(w, return_counts=True)
        add("before", ids, c)
        size = len(rows["r"])
        return pa.table({"range": pa.array([k] * size, pa.int64()), **{x: pa.array(rows[x], y) for x, y in
                                                         (("r", pa.int64()), ("kind", pa.string()), ("ids", pa.binary()), ("n", pa.binary()))},
                         **{x: pa.array([y] * size, pa.int64()) for x, y in more.items()},
                         "counts": pa.array([[int((n == c).sum()) for c in (1, 2, 3, 4)]] * size, pa.list_(pa.int64()))})

    pairs = text.mapInArrow(count_pairs, "r long, contexts binary, words binary, n binary").groupBy("r")
    if order == 2:
        stats = stage(pairs.applyInArrow(merge_pairs, "range long, r long, kind string, ids binary, n binary, contexts long, pairs long, "
                                                      "large long, counts array<long>"), "bigram-stats")
        parts = {r["range"]: r for r in stats.groupBy("range").agg(
            *[F.first(c).alias(c) for c in ("contexts", "pairs", "large", "counts")]).collect()}
    else:
        parts = {r["range"]: r for r in pairs.applyInArrow(
            merge_pairs, "range long, contexts long, pairs long, large long, heavy array<long>, heavy_n array<long>").collect()}
    model.sizes = [(parts[k]["contexts"], parts[k]["pairs"], parts[k]["large"]) if k in parts else (0, 0, 0)
                   for k in range(len(model.bounds) + 1)]
    model.pairs = sum(s[1] for s in model.sizes)
    if order == 3:
        stats = _count_trigrams(text, model, parts, per_range, pair_stats)
        parts = {r["range"]: r for r in stats.groupBy("range").agg(F.first("counts").alias("counts")).collect()}
    model.pair_discounts = _discounts(np.sum([p["counts"] for p in parts.values()], axis=0)).tolist()
    d, texts = model.pair_discounts, model.texts
    lengths = {i: s[1] for i, s in enumerate(sizes)}

    def merge_stats(t: pa.Table) -> pa.Table:
        r = t.column("r")[0].as_py()
        low, size = int(starts[r]), lengths[r] + (r == len(starts) - 1)  # the start context comes last
        sums = {k: np.zeros(size, np.int64) for k in ("once", "twice", "more", "before", "total")}
        for kind, ids, n in zip(*[t.column(c).to_pylist() for c in ("kind", "ids", "n")]):
            sums[kind][np.cumsum(_unpack(ids, "<u4"), dtype=np.int64) - low] += _unpack(n, "<i8")
        total = np.full(size, texts, np.float64)
        total[:lengths[r]] = np.memmap(os.path.join(where, "word.count"), "<i8", "r", offset=low * 8, shape=(lengths[r],))
        if order == 3:
            total = sums["total"]
            _region(os.path.join(where, "context.total"), "<i8", low, total)
        followed = sums["once"] + sums["twice"] + sums["more"] > 0
        share = (d[0] * sums["once"] + d[1] * sums["twice"] + d[2] * sums["more"]) / np.maximum(total, 1)
        _region(os.path.join(where, "context.share"), "<f8", low, np.where(followed, share, 1.0))
        before = sums["before"][:lengths[r]]
        _region(os.path.join(where, "word.before"), "<i8", low, before)
        return pa.table({"counts": pa.array([[int((before == c).sum()) for c in (1, 2, 3, 4)] + [int((before >= 3).sum())]],
                                            pa.list_(pa.int64()))})

    counts = np.sum([r["counts"] for r in stats.groupBy("r").applyInArrow(merge_stats, "counts array<long>").collect()], axis=0)
    model.word_discounts = _discounts(counts[:4]).tolist()
    e = model.word_discounts
    model.spare = (e[0] * counts[0] + e[1] * counts[1] + e[2] * counts[4]) / max(1, model.pairs)
    return model


def _count_trigrams(text: DataFrame, model: Model, parts: dict, per_range: int, pair_stats) -> DataFrame:
    """Count the trigrams of ``text``, write their arrays and the numbers of words before pairs; returns
    ``pair_stats`` of these."""
    v, where = model.words, model.folder
    width = v + 1
    if model.pairs * width >= 1 << 64:
        raise ValueError(f"{model.pairs} pairs of {v} words: a trigram does not fit 64 bits")
    known = Model(where, v, model.tokens, model.texts, model.bounds, model.sizes)  # its pairs can be looked up
    offsets = np.cumsum([0] + [s[1] for s in model.sizes])
    bounds = {int(o) * width for o in offsets[1:-1]}
    for k, part in parts.items():
        for at, n in zip(part["heavy"], part["heavy_n"]):
            place, cuts = int(offsets[k]) + at, -(-n // per_range)
            bounds |= {place * width + v * j // cuts for j in range(cuts)} | {(place + 1) * width}
    model.trigram_bounds = sorted(b for b in bounds if 0 < b < model.pairs * width)
    edges = [0, *model.trigram_bounds, model.pairs * width]
    inner = np.array(model.trigram_bounds, np.uint64)

    def count(batches):
        arrays = Arrays(known)
        for h, per_row in _token_blocks(batches, tokens=TRIGRAM_BLOCK_TOKENS):
            ids = arrays.ids(h)
            keys, back = np.unique((_contexts(ids, per_row, v).astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64),
                                   return_inverse=True)
            place = arrays.pair_places(keys)[back]
            later = np.ones(len(ids), bool)
            later[np.cumsum(per_row) - per_row] = False
            later = np.flatnonzero(later)
            keys, n = np.unique(place[later - 1].astype(np.uint64) * np.uint64(width) + ids[later].astype(np.uint64), return_counts=True)
            cuts = np.append(np.append(0, np.searchsorted(keys, inner)), len(keys))
            place = keys // np.uint64(width)
            word = (keys - place * np.uint64(width)).astype("<u4")
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k]), pa.array([_pack(_steps(place[a:b]).astype("<u8"))], pa.binary()),
                         pa.array([_pack(word[a:b])], pa.binary()), pa.array([_pack(n[a:b].astype("<i8"))], pa.binary())],
                        ["r", "contexts", "words", "n"])

    def merge(t: pa.Table) -> pa.Table:
        k = t.column("r")[0].as_py()
        place = np.concatenate([np.cumsum(_unpack(x, "<u8"), dtype=np.uint64) for x in t.column("contexts").to_pylist()])
        w = np.concatenate([_unpack(x, "<u4") for x in t.column("words").to_pylist()]).astype(np.uint64)
        keys, n = _sum_by(place * np.uint64(width) + w, np.concatenate([_unpack(x, "<i8") for x in t.column("n").to_pylist()]))
        place = keys // np.uint64(width)
        w = (keys - place * np.uint64(width)).astype("<u4")
        first, last = edges[k] // width, (edges[k + 1] - 1) // width
        at, size = place.astype(np.int64) - first, last - first + 1
        follow = [np.bincount(at[mask], minlength=size) for mask in (n == 1, n == 2, n >= 3)]
        start = np.append(0, np.cumsum(sum(follow)))
        if start[-1] >= 1 << 32:
            raise ValueError("a range has 2^32 trigrams: take more ranges")
        _write_all(os.path.join(where, f"trigram.{k}"), [np.array([first], "<i8"), start.astype("<u4"), w, *_small(n),
                                                         *[a for f in follow for a in _small(f)]])
        arrays, middle = Arrays(known), np.empty(len(place), np.uint64)
        cuts = np.searchsorted(place, offsets.astype(np.uint64))
        for i in np.flatnonzero(cuts[:-1] < cuts[1:]).tolist():  # the word that each context ends with
            middle[cuts[i]:cuts[i + 1]] = arrays.ranges[i][2][place[cuts[i]:cuts[i + 1]].astype(np.int64) - offsets[i]]
        keys, before = np.unique(middle << np.uint64(32) | w.astype(np.uint64), return_counts=True)
        place = arrays.pair_places(keys)
        cuts = np.searchsorted(place, offsets)
        some = np.flatnonzero(cuts[:-1] < cuts[1:]).tolist()
        return pa.table({"trigrams": pa.array([k] * len(some), pa.int64()), "r": pa.array(some, pa.int64()),
                         "places": pa.array([_pack(_steps(place[cuts[i]:cuts[i + 1]] - offsets[i])) for i in some], pa.binary()),
                         "n": pa.array([_pack(before[cuts[i]:cuts[i + 1]].astype("<i8")) for i in some], pa.binary()),
                         "counts": pa.array([[int((n == c).sum()) for c in (1, 2, 3, 4)]] * len(some), pa.list_(pa.int64()))})

    found = stage(text.mapInArrow(count, "r long, contexts binary, words binary, n binary").groupBy("r").applyInArrow(
        merge, "trigrams long, r long, places binary, n binary, counts array<long>"), "trigram-stats")
    counted = {r["trigrams"]: r["counts"] for r in found.groupBy("trigrams").agg(F.first("counts").alias("counts")).collect()}
    model.trigram_ranges = [k in counted for k in range(len(edges) - 1)]
    if counted:
        model.trigram_discounts = _discounts(np.sum(list(counted.values()), axis=0)).tolist()

    def adjust(t: pa.Table) -> pa.Table:
        k = t.column("r")[0].as_py()
        n = np.zeros(model.sizes[k][1], np.int64)
        for places, add in zip(t.column("places").to_pylist(), t.column("n").to_pylist()):
            if places is not None:
                n[np.cumsum(_unpack(places, "<i8"))] += _unpack(add, "<i8")
        context, start, word, *counts = Arrays(known).ranges[k]
        u = np.repeat(context, np.diff(start))
        at = np.flatnonzero(u == v)  # nothing stands before the start
        n[at] = _large(*counts, at)
        _write_all(os.path.join(where, f"adjusted.{k}"), _small(n))
        return pair_stats(k, u, np.asarray(word), n, {})

    every = text.sparkSession.range(len(model.sizes)).selectExpr("id AS r", "CAST(NULL AS binary) AS places", "CAST(NULL AS binary) AS n")
    return stage(found.select("r", "places", "n").unionByName(every).groupBy("r").applyInArrow(
        adjust, "range long, r long, kind string, ids binary, n binary, counts array<long>"), "bigram-stats")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text: log10
    probabilities by the smoothed unigram counts and by the model."""
    src = docs.select("doc_id", "text")

    def run(batches):
        arrays, n = model.open(), model.tokens
        v = model.words
        ids_held = []

        def remember(bs):
            for b in bs:
                ids_held.append(b.column("doc_id"))
                yield b

        for h, per_row in _token_blocks(remember(slices(batches, "text")), tokens=BLOCK_TOKENS if model.order == 2 else TRIGRAM_BLOCK_TOKENS):
            ids = arrays.ids(h)
            first = np.cumsum(per_row) - per_row
            count = np.where(ids < v, arrays.count[np.minimum(ids, v - 1)], 0) if v else np.zeros(len(ids), np.int64)
            base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
            own = (arrays.log10_probabilities(_contexts(ids, per_row, v), ids) if model.order == 2
                   else arrays.log10_of_order_3(ids, per_row))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids_held), pa.array(per_row), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                 pa.array(np.full(len(per_row), n)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(own, first))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            ids_held.clear()

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, "
                               "train_tokens long, base_score double, score double")
