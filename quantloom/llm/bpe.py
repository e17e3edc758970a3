"""Byte-level BPE encoding by a global shuffle of distinct words.

Tasks cut their texts into pre-tokens and pack some megabytes of documents into
a block: its distinct words, numbered as they come, and for each position the
word's number, in packets of bounded size.  The words are shuffled by their hash
as compressed lists, one for each bucket, so that all blocks' copies of a word
meet and it is encoded once; the ids go back to their blocks, where positions
put the documents together again.  A word as common as " the" travels once for
each block, not once for each occurrence.  Packets and lists share one exchange:
a packet's key is its block, a list's its bucket.
Decoding looks ids up in the token-byte table inside tasks in place of a join:
the vocabulary bounds the table, and a join would need a row for each token.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .shared import tidy, with_columns
from .textkit import slices

#: Bytes of text in a block, whose documents share one list of words, and in a packet of it; a longer text has a block of its own.
BLOCK_BYTES, PACKET_BYTES = 8 << 20, 1 << 20
#: What an exchange carries: packets of documents by block, lists of words by bucket.
_PACKED = "key long, block long, bucket int, packed binary"


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    """A public vocabulary file: a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


@lru_cache(2)
def _word_encoder(path: str):
    """Encodes one pre-token, whatever it holds."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary


def _squeeze(x) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(pickle.dumps(x, 5))


def _expand(x: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def _planes(x: np.ndarray) -> list[bytes]:
    """Numbers below 2**32 as planes of bytes, low bytes first, as far as any number reaches: each plane compresses by itself."""
    n = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return [x.astype("<u4").view(np.uint8)[k::4].tobytes() for k in range(n)]


def _joined(planes: list[bytes]) -> np.ndarray:
    out = np.zeros((len(planes[0]), 4), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = np.frombuffer(plane, np.uint8)
    return out.view("<u4").ravel()


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    key, block, bucket, packed = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(packed, pa.binary())], ["key", "block", "bucket", "packed"])


class _Block:
    """The words that a task's current block has so far."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__

    def packet(self, find, ids: list, texts: pa.Array) -> tuple[int, int, int, bytes]:
        counts, numbers = [], [np.zeros(0, np.uint32)]
        for text in texts:
            words = find(text.as_py() or "")
            counts.append(len(words))
            numbers.append(np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words)))
        return self.number, self.number, -1, _squeeze((ids, np.array(counts), _planes(np.concatenate(numbers))))

    def lists(self, buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
        """A list of words for each bucket, in the order of their numbers; and, under the block's key, each word's bucket."""
        words = list(self.known)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.uint32, len(words))
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        yield self.number, self.number, -2, _squeeze(_planes(bucket))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            yield -1 - k, self.number, k, _squeeze([words[i] for i in order[ends[k] : ends[k + 1]]])


def _pack(pattern: str, block_bytes: int, packet_bytes: int, buckets: int):
    """Blocks of documents as packets, and their words as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, task = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        block = _Block(task)
        for batch in batches:
            for a, b in slices(batch["text"], packet_bytes):
                texts = batch["text"].slice(a, b - a)
                if block.bytes and block.bytes + texts.nbytes > block_bytes:
                    yield _batch(list(block.lists(buckets)))
                    block = _Block(block.number + 1)
                block.bytes += texts.nbytes
                yield _batch([block.packet(find, batch["id"].slice(a, b - a).to_pylist(), texts)])
        if block.bytes:
            yield _batch(list(block.lists(buckets)))

    return run


def _encode_lists(path: str):
    """All lists of a bucket come to one task, which encodes each of its distinct words once, when it first shows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place, ids, ends = _word_encoder(path), {}, array("I"), array("Q", [0])
        for batch in batches:
            for block, bucket, words in zip(batch["block"].to_pylist(), batch["bucket"].to_pylist(), batch["packed"], strict=True):
                if bucket < 0:
                    continue
                sizes, found = [], array("I")
                for word in _expand(words.as_py()):
                    at = place.get(word)
                    if at is None:
                        at = place[word] = len(place)
                        ids.extend(encode(word))
                        ends.append(len(ids))
                    sizes.append(ends[at + 1] - ends[at])
                    found.extend(ids[ends[at] : ends[at + 1]])
                out = _squeeze((_planes(np.array(sizes)), _planes(np.frombuffer(found, np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([out], pa.binary())], ["key", "bucket", "ids"])

    return run


def _spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... lengths[i] of them, for each i."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _reassemble(then: Callable[[pa.Table], pa.Table], id_type: pa.DataType):
    """The documents of a block from its packets and the ids of its words; `then` sees them packet by packet."""

    def run(packets: pa.Table, encoded: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], id_type), "ids": pa.array([], pa.binary())})
        kinds = packets["bucket"].to_pylist()
        if not kinds or kinds[0] >= 0:  # a bucket's lists have been encoded elsewhere
            return then(empty)
        bucket = np.zeros(0, np.uint32)
        if -2 in kinds:
            bucket = _joined(_expand(packets["packed"][kinds.index(-2)].as_py()))
        parts = [_expand(x.as_py()) for x in encoded.sort_by("bucket")["ids"]]
        sizes = np.concatenate([np.zeros(0, np.int64), *[_joined(p[0]) for p in parts]]).astype(np.int64)
        tokens = np.concatenate([np.zeros(0, "<u4"), *[_joined(p[1]) for p in parts]])
        if len(sizes) != len(bucket):
            raise ValueError("a block has not got all of its words back: a task must see the same rows when it runs again")
        starts, lengths = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        order = np.argsort(bucket, kind="stable")
        starts[order], lengths[order] = np.cumsum(sizes) - sizes, sizes
        out = [then(empty)]
        for kind, packed in zip(kinds, packets["packed"], strict=True):
            if kind == -1:
                ids, counts, planes = _expand(packed.as_py())
                number = _joined(planes)
                flat = tokens[_spread(lengths[number], starts[number])]
                ends = np.concatenate([[0], np.cumsum(lengths[number])])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
                out.append(then(pa.table({"id": pa.array(ids, id_type), "ids": pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})))
        return pa.concat_tables(out)

    return run


def _assemble(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, block_bytes: int, buckets: int | None, then: Callable[[pa.Table], pa.Table], more: str) -> DataFrame:
    """Columns id and `more`, as `then` makes them of tables of id and ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = plain.schema["id"].dataType
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one exchange feeds both uses: both read all its columns
    packed = plain.mapInArrow(tidy(_pack(pattern, block_bytes, min(block_bytes, PACKET_BYTES), buckets)), _PACKED).repartition("key")
    encoded = packed.mapInArrow(tidy(_encode_lists(vocabulary)), "key long, bucket int, ids binary")
    return packed.groupBy("key").cogroup(encoded.groupBy("key")).applyInArrow(_reassemble(then, to_arrow_type(kind)), f"id {kind.simpleString()}, {more}")


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """The id and `ids` of each row: token ids as little-endian unsigned 32-bit integers.

    vocabulary names a rank file that every executor can read; pattern cuts
    texts into pre-tokens; words are encoded in `buckets` groups, by default as many
    as the session has shuffle partitions; a task keeps the distinct words of its buckets, some 150
    bytes each, so that more buckets make tasks smaller.  Null and empty texts have no ids; an empty table gives
    an empty result; repeated rows are encoded each; ids may be null or of any type; other columns are
    not looked at.  A text longer than a block is held whole by one task, at some ten times its bytes.  docs should come
    from files or another source that gives a task the same rows again: else the job ends with an error.
    """
    return _assemble(docs, vocabulary, pattern, id_col, text_col, block_bytes, buckets, lambda t: t, "ids binary").withColumnRenamed("id", id_col)


@lru_cache(2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes end to end, and each id's start and size."""
    ranks = read_ranks(path)
    by_rank = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_rank[rank] = token
    sizes = np.array([len(x) for x in by_rank])
    return np.frombuffer(b"".join(by_rank), np.uint8), np.cumsum(sizes) - sizes, sizes


def _decoded(vocabulary: str, ids: pa.Array | pa.ChunkedArray) -> list[bytes]:
    table, starts, sizes = _token_bytes(vocabulary)
    out = []
    for x in ids:
        x = np.frombuffer(x.as_py() or b"", "<u4")
        out.append(table[_spread(sizes[x], starts[x])].tobytes())
    return out


def decode(df: DataFrame, vocabulary: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes of each row's ids as out_col, which takes the place of a column of that name.

    Each task reads the token-byte table and looks ids up in it, in place of a join.  Null and empty ids give no
    bytes; an empty table stays empty; repeated rows are decoded each; TypeError if ids_col is not binary.
    """
    if not isinstance(df.schema[ids_col].dataType, BinaryType):
        raise TypeError(f"{ids_col} must hold ids as binary")

    def looked_up(inside):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_decoded(vocabulary, batch[inside(ids_col)]), pa.binary())], [*batch.schema.names, f"+{out_col}"])

        return run

    return with_columns(df, looked_up, StructType([StructField(out_col, BinaryType())]))


def _digests(vocabulary: str):
    """encode() and decode() of a packet, digested where the documents come together: neither ids nor bytes travel on."""

    def run(t: pa.Table) -> pa.Table:
        sha = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())
        ids = [x.as_py() for x in t["ids"]]
        return pa.table({"id": t["id"], "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": sha(ids), "decoded_sha256": sha(_decoded(vocabulary, t["ids"]))})

    return run


def report(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Query op10: token counts, and digests of each document's ids and of what they decode to.

    Null and empty texts have no tokens; repeated rows give a row each; an empty table gives an empty result.
    """
    import public_tokenizers

    vocabulary = vocabulary or str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = _assemble(docs, vocabulary, pattern or public_tokenizers.PATTERN, "doc_id", "text", BLOCK_BYTES, None, _digests(vocabulary), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", "doc_id")
