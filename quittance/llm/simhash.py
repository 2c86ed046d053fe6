"""SimHash near-duplicates through a binary trie self-join.

Fingerprints of 64 bits are cut in four blocks. Two that differ in at most two bits agree in at
least two blocks, so each distinct fingerprint is dealt to six groups by a pair of its blocks, and
each group is joined with itself in a binary trie: node pairs are walked together, differing bits
are added up, and a pair is left as soon as it has more than the budget. Only edges that join two
parts of a group are kept (a spanning forest), so output and later work stay linear in the number
of distinct fingerprints, whatever the number of copies.

Null text, and text without words: fingerprint 0, linked like any other. Repeated rows: one result
each. A component of rows that all have a null doc_id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quittance.llm.common import connected_components, stored

SHINGLE, SEED, BUDGET = 3, 42, 2
#: Node pairs of up to this many leaf pairs are compared at once.
LEAF_PAIRS = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of whole UTF-8 text, as a signed 64-bit integer."""
    words = text.lower().split()  # both act on ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    starts = [0, *ends]
    hashes = np.fromiter(
        (h(line[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)), "<u8", len(words) - k + 1
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@F.arrow_udf(LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], pa.int64())


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share a doc_id or have none; equal only for repeated rows."""
    none = F.lit("null")
    return F.md5(F.concat_ws("/", F.coalesce(doc_id.cast("string"), none), F.md5(F.coalesce(text, F.lit(""))), text.isNull().cast("string")))


def trie_links(values: np.ndarray, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of distinct uint64 values within budget bits."""
    v = np.sort(values)
    parent = list(range(len(v)))
    edges: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    stack = [(0, len(v), 0, len(v), 64, 0)]  # two nodes as ranges of v, bits below them, differing bits above
    while stack:
        a0, a1, b0, b1, depth, off = stack.pop()
        if off > budget:
            continue
        na, nb = a1 - a0, b1 - b0
        if na * nb <= LEAF_PAIRS or depth == 0:
            near = np.argwhere(np.bitwise_count(v[a0:a1, None] ^ v[None, b0:b1]) <= budget)
            for i, j in near.tolist():
                if (p := a0 + i) < (q := b0 + j) and (x := root(p)) != (y := root(q)):
                    parent[max(x, y)] = min(x, y)
                    edges.append((p, q))
            continue
        bit = np.uint64(1 << (depth - 1))
        am = a0 + int(np.searchsorted(v[a0:a1], (v[a0] >> np.uint64(depth) << np.uint64(depth)) | bit)) if depth < 64 else int(np.searchsorted(v, bit))
        if (a0, a1) == (b0, b1):
            if a0 < am:
                stack.append((a0, am, a0, am, depth - 1, off))
            if am < a1:
                stack.append((am, a1, am, a1, depth - 1, off))
            if a0 < am < a1:
                stack.append((a0, am, am, a1, depth - 1, off + 1))
            continue
        bm = b0 + int(np.searchsorted(v[b0:b1], (v[b0] >> np.uint64(depth) << np.uint64(depth)) | bit))
        for x0, x1, zero_x in ((a0, am, True), (am, a1, False)):
            for y0, y1, zero_y in ((b0, bm, True), (bm, b1, False)):
                if x0 < x1 and y0 < y1:
                    stack.append((x0, x1, y0, y1, depth - 1, off + (zero_x != zero_y)))
    return [(int(v[p]), int(v[q])) for p, q in edges]


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, fp) sorted by g: the edges (a, b) in each run of equal g."""
    held_g, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for b in batches:
        g = np.concatenate([held_g, b.column("g").to_numpy(zero_copy_only=False)])
        f = np.concatenate([held_f, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(g):
            continue
        last = int(np.searchsorted(g, g[-1]))  # the last run may go on in the next batch
        yield _runs(g[:last], f[:last])
        held_g, held_f = g[last:], f[last:]
    yield _runs(held_g, held_f)


def _runs(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    edges: list[tuple[int, int]] = []
    if len(g) > 1:
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        ends = np.r_[starts[1:], len(g)]
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            edges += trie_links(f[s:e])
    got = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], ["a", "b"])


def links(distinct_fp: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fp that are linked through steps of at most BUDGET bits."""
    block = [F.shiftright(F.col("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [
        F.lit(n << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j])
        for n, (i, j) in enumerate(combinations(range(4), 2))
    ]
    dealt = distinct_fp.select("fp", F.explode(F.array(*pairs)).alias("g"))
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_group_links, "a long, b long").distinct()


def components(rows: DataFrame) -> DataFrame:
    """(fp, component, least, first) of each distinct fp of rows (doc_id, fp, row): least doc_id and first row of its fp."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), first.alias("first"))
    comp = connected_components(links(own.select("fp")), "simhash-links")
    named = own.join(comp, own.fp == comp.node, "left")
    return stored(named.select("fp", F.coalesce("component", "fp").alias("component"), "least", "first"), "simhash-components")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp, row of every row of docs, stored."""
    text = F.col("text")
    return stored(docs.select("doc_id", fingerprint_of(text).alias("fp"), row_key(F.col("doc_id"), text).alias("row")), "simhash")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id that the links reach."""
    rows = fingerprints(docs)
    parts = components(rows)
    ids = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    named = parts.join(ids, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of least doc_id, once."""
    parts = components(fingerprints(docs))
    stay = parts.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), row_key(F.col("doc_id"), F.col("text")).alias("row"))
    # the join deals the texts by row, and repeated rows are dropped in place
    return keyed.join(stay, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
