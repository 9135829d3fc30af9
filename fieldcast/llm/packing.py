"""Token-id output packed into rows of a fixed length by best-fit decreasing.

A task encodes its documents in shards of at most about ``shard_tokens``
tokens. Documents longer than a row are cut into full rows and a rest; the
parts go, longest first, into the open row with the least room that is enough,
found by a segment tree over the possible amounts of room. Each packed row has
the ids as little-endian integers padded to the full length, the cumulative
lengths of its segments, the places where positions start again at 0, and of
each segment the document and its offset there, so that every document can be
put together again.

Defined results: null and empty texts have no tokens and no segment. Segments
of one length keep the documents' order. Repeated rows are packed each by
itself. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.bpe import read_ranks
from fieldcast.llm.common import col

ROW_TOKENS = 2048
SHARD_TOKENS = 4_000_000


class Room:
    """Open rows by the room they have left: a segment tree of counts over 0 .. capacity."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, and its room; removed from the tree."""
        node = self.base + need
        while not self.tree[node]:
            while node & 1:  # a right child: what is right of it is below an ancestor's sibling
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.base:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.base
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of segment numbers: longest first, each into the fullest row that can take it."""
    order = np.argsort(-lengths, kind="stable")
    rows: list[list[int]] = []
    room = Room(capacity)
    for k in order.tolist():
        need = int(lengths[k])
        found = room.take(need) if need < capacity else None
        row, left = found if found else (len(rows), capacity)
        if not found:
            rows.append([])
        rows[row].append(k)
        if left > need:
            room.put(row, left - need)
    return rows


def packed(docs: DataFrame, ranks_path: str, pattern: str, row_tokens: int = ROW_TOKENS,
           shard_tokens: int = SHARD_TOKENS, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows: (shard, row, n_tokens, doc_ids, doc_offsets, cu_seqlens, position_resets, input_ids, crc32).

    ``shard`` numbers the shards of a task after its partition, so (shard, row)
    names a packed row. Ids take 2 bytes if the vocabulary allows, else 4.
    """
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"),
                      F.spark_partition_id().alias("part"))
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("row", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(src.schema["doc_id"].dataType)),
        T.StructField("doc_offsets", T.ArrayType(T.LongType())), T.StructField("cu_seqlens", numbers),
        T.StructField("position_resets", numbers), T.StructField("input_ids", T.BinaryType()),
        T.StructField("crc32", T.LongType())])

    def pack(shard: int, ids: list, tokens: list[np.ndarray], kind: str, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        parts = [(d, at, tokens[d][at:at + row_tokens]) for d in range(len(ids)) for at in range(0, len(tokens[d]), row_tokens)]
        rows = best_fit(np.array([len(p) for *_, p in parts], np.int64), row_tokens)
        for lo in range(0, len(rows), 1024):
            some = rows[lo:lo + 1024]
            ends = [np.cumsum([0, *(len(parts[k][2]) for k in r)]) for r in some]
            matrix = np.full((len(some), row_tokens), pad_id, kind)
            for i, r in enumerate(some):
                matrix[i, :ends[i][-1]] = np.concatenate([parts[k][2] for k in r])
            data = [m.tobytes() for m in matrix]
            yield pa.RecordBatch.from_arrays([
                pa.array([shard] * len(some), pa.int64()), pa.array(range(lo, lo + len(some)), pa.int32()),
                pa.array([int(e[-1]) for e in ends], pa.int32()),
                pa.array([[ids[parts[k][0]] for k in r] for r in some], pa.list_(id_type)),
                pa.array([[parts[k][1] for k in r] for r in some], pa.list_(pa.int64())),
                pa.array([e.tolist() for e in ends], pa.list_(pa.int32())),
                pa.array([e[:-1].tolist() for e in ends], pa.list_(pa.int32())),
                pa.array(data, pa.binary()), pa.array([zlib.crc32(x) for x in data], pa.int64())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = kind = None
        ids, tokens, size, shards = [], [], 0, 0
        for b in batches:
            if encoding is None:
                encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
                kind = "<u2" if max(max(sent.value.values()), pad_id) < 1 << 16 else "<u4"
            first = (b.column(2)[0].as_py() << 32) if b.num_rows else 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                mine = np.array(encoding.encode_ordinary(text.as_py() or ""), kind)
                ids.append(key)
                tokens.append(mine)
                size += len(mine)
                if size >= shard_tokens:
                    yield from pack(first + shards, ids, tokens, kind, b.schema.types[0])
                    ids, tokens, size, shards = [], [], 0, shards + 1
            id_type = b.schema.types[0]
        if size:
            yield from pack(first + shards, ids, tokens, kind, id_type)

    return src.mapInArrow(run, schema)


def unpacked(rows: DataFrame, row_kind: str = "<u2") -> DataFrame:
    """(doc_id, doc_offset, ids) of every segment of packed rows: with offsets, the documents again."""
    width = np.dtype(row_kind).itemsize
    seg = rows.select(F.posexplode("doc_ids").alias("k", "doc_id"), "doc_offsets", "cu_seqlens", "input_ids")
    at, end = F.expr("cu_seqlens[k]"), F.expr("cu_seqlens[k + 1]")
    return seg.select("doc_id", F.expr("doc_offsets[k]").alias("doc_offset"),
                      F.substring("input_ids", at * width + 1, (end - at) * width).alias("ids"))


def write(rows: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet, one file or more a task, whole shards together."""
    rows.write.parquet(path)
