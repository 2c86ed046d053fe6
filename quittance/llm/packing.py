"""Packing of documents into token windows by best-fit decreasing.

A document's ids and the end id are cut into full windows and one shorter rest. The pieces are dealt into
groups of about PER_GROUP, and each group's task takes its pieces by decreasing length, each into the open
window with the least room that still holds it: a segment tree over remaining capacities, whose leaves count
the open windows of a capacity, finds it in a walk of logarithmic length. A full piece is a window of its
own. Only lengths are needed for that, so ids aren't shuffled unless they are asked for.

A task holds one number for each open window of its group, at most PER_GROUP; the number of groups grows with
the pieces. Ids are encoded and cut one batch of documents at a time. Pieces are dealt by Spark's round robin
from a stored table, which is the same at each attempt, and so are the ids of windows: ordinal of the window
within its group times the number of groups, plus the group.

Null and empty text: the end id only, one piece. Repeated rows: packed each. Ties of length: by doc_id, start
and checksum. A text of any length: as many full windows as it holds. Null doc_id: as any other. An empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.llm.common import stored
from quittance.llm.tokens import encoder, in_batches, tokenizer_path

WINDOW, END_ID, PER_GROUP = 1024, 0, 8192
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Rooms:
    """Open windows by remaining capacity, up to most; a segment tree over the capacities counts them."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.windows[room].append(window)
            self._add(room, 1)

    def tightest(self, length: int) -> int:
        """The least capacity of length or more that an open window has; 0 if none has."""
        at = length + self.leaves
        if self.count[at]:
            return length
        while at > 1:  # up to the first subtree to the right that holds a window, then down along its left
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return 0

    def take(self, room: int) -> int:
        """The window of a capacity that was put last, no longer open."""
        self._add(room, -1)
        return self.windows[room].pop()


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of the pieces of docs (doc_id, text), and their ids (array of int) if they are to be kept."""
    path, wide = tokenizer_path(tokenizer), 4 * window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), struct.pack("<I", end_id)
        for whole in batches:
            for b in in_batches(whole):
                cols: list[list] = [[], [], [], [], [], []]
                for doc_id, packed in zip(b.column("doc_id").to_pylist(), enc.packed([t or "" for t in b.column("text").to_pylist()]), strict=True):
                    packed += end
                    for s in range(0, len(packed), wide):
                        ids = packed[s : s + wide]
                        for col, x in zip(cols, (doc_id, s // 4, len(ids) // 4, zlib.crc32(ids), len(packed) // 4, ids), strict=True):
                            col.append(x)
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
                if keep_ids:
                    values = pa.array(memoryview(b"".join(cols[5])).cast("i"), pa.int32())
                    ends = [0]
                    for n in cols[2]:
                        ends.append(ends[-1] + n)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE + (", ids array<int>" if keep_ids else ""))


def pack(cut: DataFrame, window: int = WINDOW, per_group: int = PER_GROUP) -> DataFrame:
    """The rows of cut, which is read twice and has a length of 1 to window, with sequence_id and offset."""
    groups = max(1, -(-cut.count() // per_group))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group, rooms, opened = TaskContext.get().partitionId(), Rooms(window), 0
        for b in batches:
            ids, offsets = [], []
            for length in b.column("length").to_pylist():
                room = rooms.tightest(length)
                if room:
                    own = rooms.take(room)
                else:
                    own, room, opened = opened, window, opened + 1
                ids.append(own * groups + group)
                offsets.append(window - room)
                rooms.put(room - length, own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], [*b.schema.names, "sequence_id", "offset"])

    dealt = cut.repartition(groups).sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return dealt.mapInArrow(place, f"{kind}, sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, n_tokens, padded_tokens, ids, doc_ids, starts) of packed with ids: each window's ids, padded to window unless their number is a power of two."""
    of = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    even = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    sized = of.withColumn("padded_tokens", F.when(even, F.col("n_tokens")).otherwise(window))
    filled = F.concat(F.flatten("p.ids"), F.array_repeat(F.lit(pad_id), (F.col("padded_tokens") - F.col("n_tokens")).cast("int")))
    return sized.select("sequence_id", "n_tokens", "padded_tokens", filled.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"))


def packed_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW, per_group: int = PER_GROUP, keep_ids: bool = False) -> DataFrame:
    return pack(stored(pieces(docs, tokenizer, window, keep_ids=keep_ids), "pieces"), window, per_group)


def op13_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
