"""Token ids in binary files of bit or byte planes.

A file holds the ids of many documents in order. Ids go in blocks of BLOCK; a block's little-endian
32-bit values are transposed into 4 byte planes (or 32 bit planes) and each plane is compressed with
zstandard on its own, so the planes that hardly change cost next to nothing. After the blocks come
the chunk index (place, length, first id and plane lengths of each block) and the document table
(doc_id and token count), then a fixed-size tail that says where they are.

Documents are dealt by ranges of doc_id, so files in order of their numbers (part, and file of the
part) hold them in ascending doc_id order (null doc_ids first; rows of equal doc_id by a hash of
their text). Null and empty text: only the end id. A file is written under a name of the task's
attempt and then renamed, so a repeated task replaces it whole; what lost attempts leave is removed
at the end. A file is closed once it holds FILE_IDS ids or FILE_DOCS documents, so the chunk index and
document table that its writer and reader hold are bounded; beside them memory holds one block and one
batch of documents, and a text of any length is written and read in blocks. An empty table gives no
files and no rows. Other columns of docs are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quittance.llm.common import new_path, stored
from quittance.llm.tokens import encoder, in_batches, tokenizer_path

MAGIC, BLOCK, END_ID, LEVEL = b"QPL1", 1 << 16, 0, 3
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 18
_TAIL = struct.Struct("<QQQQB3x4s")  # index place and length, table length, blocks, planes, magic


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of uint32 ids, compressed; bits: 32 planes of bits, else 4 of bytes."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = raw.T
    z = zstandard.ZstdCompressor(level=LEVEL)
    return [z.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    planes = np.stack([np.frombuffer(z.decompress(p), np.uint8) for p in parts])
    if len(parts) == 32:
        planes = np.packbits(np.unpackbits(planes, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class PlaneWriter:
    def __init__(self, sink, bits: bool = False, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.at = self.n_ids = 0
        self.held: list[bytes] = []
        self.held_n = 0
        self.index: list[bytes] = []
        self.docs: list[int | None] = []
        self.counts = array("q")

    def add(self, doc_id: int | None, packed: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(packed) // 4)
        self.held.append(packed)
        self.held_n += len(packed) // 4
        while self.held_n >= self.block:
            self._flush()

    def _flush(self) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for s in range(0, len(ids) - self.block + 1, self.block) if len(ids) >= self.block else [0]:
            now = ids[s : s + self.block]
            planes = to_planes(now, self.bits)
            self.index.append(struct.pack(f"<QQI{len(planes)}I", self.at, self.n_ids, len(now), *map(len, planes)))
            for p in planes:
                self.sink.write(p)
                self.at += len(p)
            self.n_ids += len(now)
        rest = ids[len(ids) - len(ids) % self.block :] if len(ids) >= self.block else ids[:0]
        self.held, self.held_n = [rest.tobytes()], len(rest)

    def close(self) -> None:
        if self.held_n:
            self._flush()
        index = b"".join(self.index)
        batch = pa.record_batch([pa.array(self.docs, pa.int64()), pa.array(np.frombuffer(self.counts, np.int64))], ["doc_id", "n"])
        buf = pa.BufferOutputStream()
        with pa.ipc.new_stream(buf, batch.schema) as w:
            w.write_batch(batch)
        table = zstandard.ZstdCompressor(level=LEVEL).compress(buf.getvalue().to_pybytes())
        self.sink.write(index)
        self.sink.write(table)
        self.sink.write(_TAIL.pack(self.at, len(index), len(table), len(self.index), 32 if self.bits else 4, MAGIC))


class PlaneReader:
    """Chunk index and document table of a file; block(i) and ids(first, n) read only what they need."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - _TAIL.size)
        at, n_index, n_table, blocks, planes, magic = _TAIL.unpack(source.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        source.seek(at)
        entry = struct.Struct(f"<QQI{planes}I")
        self.index = list(entry.iter_unpack(source.read(n_index)))
        if len(self.index) != blocks:
            raise ValueError("the chunk index is cut")
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(source.read(n_table))).read_all()
        self.doc_ids, self.counts = table["doc_id"].combine_chunks(), table["n"].to_numpy()

    def block(self, i: int) -> np.ndarray:
        at, _, n, *lengths = self.index[i]
        self.source.seek(at)
        return from_planes([self.source.read(k) for k in lengths], n)

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from place first of the file, through the chunk index."""
        i = int(np.searchsorted([e[1] for e in self.index], first, side="right")) - 1
        out = []
        while n > 0:
            b = self.block(i)[first - self.index[i][1] :][:n]
            out.append(b)
            first, n, i = first + len(b), n - len(b), i + 1
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, bits: bool = False, block: int = BLOCK) -> DataFrame:
    """Encode docs (doc_id, text) and write plane files to path; a stored row (part, nth, file, n_docs, n_ids) for each."""
    most_ids, most_docs = FILE_IDS, FILE_DOCS

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, end = TaskContext.get(), struct.pack("<I", end_id)
        part, enc = task.partitionId(), encoder(tokenizer)
        store, top = _fs(path)
        out, sink, nth = None, None, 0

        def closed() -> pa.RecordBatch:
            out.close()
            sink.close()
            name = f"part-{part:05d}-{nth:05d}.planes"
            store.move(own, f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"part": [part], "nth": [nth], "file": [name], "n_docs": [len(out.docs)], "n_ids": [out.n_ids]})

        for whole in batches:
            for b in in_batches(whole):
                for doc_id, packed in zip(b.column("doc_id").to_pylist(), enc.packed([t or "" for t in b.column("text").to_pylist()]), strict=True):
                    if out is None:
                        store.create_dir(top)
                        own = f"{top}/_part-{part:05d}-{nth:05d}-{task.taskAttemptId()}"
                        sink = store.open_output_stream(own)
                        out = PlaneWriter(sink, bits, block)
                    out.add(doc_id, packed + end)
                    if out.n_ids + out.held_n >= most_ids or len(out.docs) >= most_docs:
                        yield closed()
                        out, nth = None, nth + 1
        if out is not None:
            yield closed()

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", F.xxhash64("text"))
    sorted_ = ranged.sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = stored(sorted_.mapInArrow(write, "part long, nth long, file string, n_docs long, n_ids long"), "token-files")
    _remove_unfinished(path)
    return files


def _remove_unfinished(path: str) -> None:
    from pyarrow import fs

    store, top = _fs(path)
    for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        if f.base_name.startswith("_part-"):
            store.delete_file(f.path)


def read_digests(files: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, block by block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                store, top = _fs(path)
                size = store.get_file_info(f"{top}/{name}").size
                with store.open_input_file(f"{top}/{name}") as source:
                    r = PlaneReader(source, size)
                    have, i, at = np.zeros(0, "<u4"), 0, base
                    for s in range(0, len(r.counts), 10_000):
                        counts = r.counts[s : s + 10_000]
                        crcs = []
                        for n in counts.tolist():
                            crc, need = 0, n
                            while need:
                                if not len(have):
                                    have, i = r.block(i), i + 1
                                crc = zlib.crc32(have[:need].tobytes(), crc)
                                have, need = have[need:], need - min(need, len(have))
                            crcs.append(crc)
                        starts = at + np.cumsum(counts) - counts
                        at += int(counts.sum())
                        yield pa.RecordBatch.from_arrays(
                            [r.doc_ids[s : s + 10_000], pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # one row per file: the only rows of this window
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = files.select("file", before.alias("base")).repartition(max(1, files.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", bits: bool = False) -> DataFrame:
    path = new_path(docs.sparkSession, "planes")
    return read_digests(write_ids(docs, path, tokenizer_path(tokenizer), bits=bits), path)


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
