"""Byte-level BPE over a corpus: every distinct word is encoded once.

Texts are cut into pre-tokens by the tokenizer's pattern. A block of documents (bounded text)
keeps its pre-tokens as a list of distinct words and, for each document, the word number at
each position. The distinct words of all blocks are shuffled by word, so that each one meets
one task and is merged by rank once; the ids go back to the blocks that asked, which put
them together by position. Blocks are written bucketed by block number, so only words
and ids are shuffled, never positions or texts. Decoding looks the ids up in the token-byte
table, whose size is the vocabulary's.

Defined results: a null or empty text has no ids; repeated rows are encoded each; an empty
table gives an empty one; extra columns are ignored. Text that spells a special token is
ordinary text. Unknown ids raise an error on decoding.
"""

from __future__ import annotations

import base64
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potentia.llm.textio import slices
from potentia.session import checkpoint_dir

BLOCK_BYTES = 32 << 20
_PIECE = 1 << 18  # words or ids that are put together at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (base64, space, rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@dataclass(frozen=True)
class Finish:
    """A last step over (doc_id, ids) pieces: the columns after doc_id, and a function that makes the
    step from the ranks."""
    columns: str
    make: Callable[[dict[bytes, int]], Callable[[pa.RecordBatch], pa.RecordBatch]]


def _pack(a: np.ndarray) -> bytes:
    """Little-endian 32-bit numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(a.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.ravel().data)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + size[i] - 1 of all i in a row."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _blocks(docs: DataFrame, pattern: str) -> DataFrame:
    """(block, doc_ids, lengths, codes, word_sizes, words): distinct words and positions."""
    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        find, number = regex.compile(pattern).findall, 0
        part = TaskContext.get().partitionId()

        def close(ids, lengths, parts, words):
            codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            parts.clear()
            # the most frequent words get the smallest numbers
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            new = np.empty(len(order), np.uint32)
            new[order] = np.arange(len(order))
            spelled = [w.encode() for w in words]
            spelled = [spelled[i] for i in order.tolist()]
            sizes = np.fromiter(map(len, spelled), np.uint32, len(spelled))
            ids = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([_pack(np.array(lengths))], pa.binary()), pa.array([_pack(new[codes])], pa.binary()),
                 pa.array([_pack(sizes)], pa.binary()),
                 pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(spelled))], pa.binary())],
                ["block", "doc_ids", "lengths", "codes", "word_sizes", "words"])

        ids, lengths, codes, size, words = [], [], [], 0, defaultdict()
        words.default_factory = words.__len__
        for piece in slices(batches, "text"):
            ids.append(piece.column("doc_id"))
            for text in piece.column("text").to_pylist():
                found = find(text) if text else []
                size += len(text or "")
                lengths.append(len(found))
                codes.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
            if size >= BLOCK_BYTES:
                yield close(ids, lengths, codes, words)
                number, ids, lengths, codes, size = number + 1, [], [], [], 0
                words.clear()
        if ids:
            yield close(ids, lengths, codes, words)

    return src.mapInArrow(run, f"block long, doc_ids array<{kind}>, lengths binary, codes binary, "
                               "word_sizes binary, words binary")


def _stage_bucketed(blocks: DataFrame) -> DataFrame:
    """Written once, bucketed by block, so that the ids can be joined back in place."""
    spark = blocks.sparkSession
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (blocks.write.format("parquet").option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}")
     .bucketBy(buckets, "block").saveAsTable(name))
    return spark.table(name)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, finish: Finish | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text, special tokens left out.

    ``finish`` maps pieces of that result in the task that puts them together, instead of in a
    Python worker of its own behind it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    blocks = _stage_bucketed(_blocks(docs, pattern))

    def explode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ends = np.cumsum(_unpack(batch.column("word_sizes")[i].as_py()), dtype=np.int64)
                data = zstandard.ZstdDecompressor().decompress(batch.column("words")[i].as_py())
                offsets = pa.py_buffer(np.append(0, ends).astype("<i4"))
                words = pa.StringArray.from_buffers(len(ends), offsets, pa.py_buffer(data))
                block = batch.column("block")[i].as_py()
                for k in range(0, len(words), 1 << 16):
                    some = words.slice(k, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)),
                                                      pa.array(np.arange(k, k + len(some), dtype=np.int32)), some],
                                                     ["block", "code", "word"])

    # one shuffle by word: equal words lie next to each other and are merged once
    words = (blocks.select("block", "word_sizes", "words").mapInArrow(explode, "block long, code int, word string")
             .repartition("word").sortWithinPartitions("word"))

    def merge(batches):
        import tiktoken
        # a pattern that takes a whole word: the words are cut already
        whole = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=shared.value, special_tokens={})
        last, ids = None, []
        held: dict[int, list] = {}
        rows = 0

        def flush():
            for block, (codes, sizes, flat) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), *[pa.array([_pack(np.array(x, np.uint32))], pa.binary()) for x in (codes, sizes, flat)]],
                    ["block", "codes", "sizes", "ids"])
            held.clear()

        for batch in batches:
            for block, code, word in zip(*[batch.column(c).to_pylist() for c in ("block", "code", "word")]):
                if word != last:
                    last, ids = word, whole.encode_ordinary(word)
                codes, sizes, flat = held.setdefault(block, ([], [], []))
                codes.append(code)
                sizes.append(len(ids))
                flat.extend(ids)
            rows += batch.num_rows
            if rows >= 1 << 20:
                yield from flush()
                rows = 0
        yield from flush()

    merged = words.mapInArrow(merge, "block long, codes binary, sizes binary, ids binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.int32()
    columns = finish.columns if finish else "ids array<int>"

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        out, last_step = [], finish.make(shared.value) if finish else None
        codes, sizes, flat = [np.concatenate(p) if p else np.zeros(0, np.uint32) for p in
                              ([_unpack(x) for x in right.column(c).to_pylist()] for c in ("codes", "sizes", "ids"))]
        start, size = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        start[codes], size[codes] = np.cumsum(sizes, dtype=np.int64) - sizes, sizes
        for i in range(left.num_rows):
            doc_ids = left.column("doc_ids")[i].values
            ends = np.cumsum(_unpack(left.column("lengths")[i].as_py()), dtype=np.int64)
            at = _unpack(left.column("codes")[i].as_py())
            first = 0
            while first < len(doc_ids):  # documents of about _PIECE words at a time
                low = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, low + _PIECE, "right")))
                some = at[low:ends[last - 1]]
                tokens = np.append(0, np.cumsum(size[some]))
                ids = flat[_spread(start[some], size[some])].astype(np.int32)
                bounds = tokens[np.append(low, ends[first:last]) - low]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, id_type))
                piece = pa.RecordBatch.from_arrays([doc_ids.slice(first, last - first), lists], names=["doc_id", "ids"])
                out.append(last_step(piece) if finish else piece)
                first = last
        if not out:  # no document: one empty piece has the columns
            piece = pa.RecordBatch.from_arrays([pa.array([], left.schema.field("doc_ids").type.value_type),
                                                pa.array([], pa.list_(id_type))], names=["doc_id", "ids"])
            out.append(last_step(piece) if finish else piece)
        return pa.Table.from_batches(out)

    return (blocks.select("block", "doc_ids", "lengths", "codes").groupBy("block")
            .cogroup(merged.groupBy("block")).applyInArrow(reassemble, f"doc_id {kind}, {columns}"))


def _token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token-byte table: (all bytes, start, size) by id; size -1 where an id is unknown."""
    start, size = np.zeros(max(ranks.values()) + 1, np.int64), np.full(max(ranks.values()) + 1, -1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    by_id = sorted((i, token) for token, i in ranks.items())
    start[[i for i, _ in by_id]] = np.cumsum([0] + [len(t) for _, t in by_id[:-1]])
    return np.frombuffer(b"".join(t for _, t in by_id), np.uint8), start, size


def _decoder(ranks: dict[bytes, int]):
    data, start, size = _token_bytes(ranks)

    def decode_lists(column: pa.Array) -> list[bytes]:
        column = column.fill_null([]) if column.null_count else column
        ids = column.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or (size[ids] < 0).any()):
            raise ValueError("unknown token id")
        ends = np.append(0, np.cumsum(size[ids]))
        raw = data[_spread(start[ids], size[ids])].tobytes() if len(ids) else b""
        bounds = ends[np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))]
        return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    return decode_lists


def _few(batches, column: str, most: int = _PIECE):
    """Cut batches of id lists to about ``most`` ids."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield batch.slice(i, j - i)
            i = j


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, bytes) from ``encoded(doc_id, ids)``; null ids decode to nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    src = encoded.select("doc_id", "ids")

    def run(batches):
        decode_lists = _decoder(shared.value)
        for piece in _few(batches, "ids"):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(decode_lists(piece.column("ids")), pa.binary())],
                                             ["doc_id", "bytes"])
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, bytes binary")


def digests(with_ids: bool = False) -> Finish:
    """n_tokens, ids_sha256 and decoded_sha256 of (doc_id, ids): the ids' decimal spelling, and the bytes
    that they decode to; ``with_ids`` keeps the ids."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else [])

    def make(ranks: dict[bytes, int]):
        decode_lists, spelled = _decoder(ranks), [b"%d" % i for i in range(max(ranks.values()) + 1)]

        def one(piece: pa.RecordBatch) -> pa.RecordBatch:
            column = piece.column("ids")
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
            lines = (b" ".join(map(spelled.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:]))
            out = [piece.column("doc_id"), pa.array(sizes.astype(np.int64)),
                   pa.array([sha256(x).hexdigest() for x in lines], pa.string()),
                   pa.array([sha256(x).hexdigest() for x in decode_lists(column)], pa.string())]
            return pa.RecordBatch.from_arrays([*out, column] if with_ids else out, names)

        return one

    return Finish("n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""), make)
