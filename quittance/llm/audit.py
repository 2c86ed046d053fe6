"""Interaction audit of filters: what each filter removes in every order of them, for each source.

Five conditions of a document make a mask of 32 values. FIRST says for a mask and each of the 120 orders at
which step the first failing filter stands, so an order needs no run of its own: np.bincount over the steps
of all orders at once gives what each step of each order removes, for all, good and toxic documents apart.
The arrays of each task are sums over its rows, and partial arrays are added up.

Whether an equal text has a smaller doc_id is told by digest (SHA-256). Documents are counted by digest, part,
mask and labels before anything meets by digest, and by part, mask and labels (128 rows a part) before the
lookup, so neither a text with very many copies nor a hot source makes a large task.

Null text: as an empty one (all words, symbols and capitals zero: A fails, B to D don't). Null source: part
"". Null doc_id: never compared, so E doesn't fail, and without labels. Repeated rows: counted each; rows of
equal doc_id and text don't make each other fail E. Repeated rows of labels: 1 if any of them is. Very long
texts are gone through in pieces, only their distinct words are held. An empty table: no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
KEPT = len(FILTERS) + 1
#: [mask, order]: the step at which the first failing filter stands, KEPT if none fails.
FIRST = np.array([[next((s for s, f in enumerate(o, 1) if m >> FILTERS.index(f) & 1), KEPT) for o in ORDERS] for m in range(32)])
#: Rows that are looked up at once, so also the most parts whose arrays a task holds.
AT_ONCE = 1000
PIECE = 1 << 20
_CAPITALS = bytes(range(65, 91))
_FOLLOWING = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"


def conditions(text: bytes) -> int:
    """Mask of A (1), B (2), C (4) and D (8) of whole UTF-8 text."""
    words, distinct, capitals, points, marked, rest = 0, set(), 0, 0, False, b""
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        capitals += len(piece) - len(piece.translate(None, _CAPITALS))
        points += len(piece.translate(None, _FOLLOWING))
        marked = marked or len(piece.translate(None, _MARKS)) < len(piece)
        found = (rest + piece).split()  # at ASCII white space only, for bytes
        rest = b""
        if at + PIECE < len(text) and found and not piece[-1:].isspace():
            rest = found.pop()  # it may go on in the next piece
        words += len(found)
        distinct.update(found)
    return (words < 50) | (100 * len(distinct) < 65 * words) << 1 | (100 * capitals > 5 * points) << 2 | marked << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks, digests = np.zeros(b.num_rows, np.int32), []
        for i, t in enumerate(b.column("text")):
            text = t.as_buffer().to_pybytes() if t.is_valid else b""
            masks[i] = conditions(text)
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(digests, pa.binary()), pa.array(masks)], ["doc_id", "part", "digest", "mask"])


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a source have a mask and labels."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), "text")
    judged = rows.mapInArrow(_judged, "doc_id long, part string, digest binary, mask int")
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    told = judged.join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    each = told.groupBy("doc_id", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    alike = each.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("n_null")
    )
    first = F.coalesce(F.when(F.col("least") == F.min("least").over(Window.partitionBy("digest")), F.col("n_least")), F.lit(0)) + F.coalesce("n_null", F.lit(0))
    both = alike.withColumn("first", first).select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("x")
    )
    return both.where("x.n > 0").groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n"))


def removals(part: np.ndarray, parts: int, mask: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """[part, order, step]: sum of the weights of rows whose first failing filter stands at the step, KEPT for none."""
    at = (part[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * (KEPT + 1) + FIRST[mask]
    counted = np.bincount(at.ravel(), np.repeat(weight, len(ORDERS)), parts * len(ORDERS) * (KEPT + 1))
    return counted.astype(np.int64).reshape(parts, len(ORDERS), KEPT + 1)


#: [order, step - 1]: the filter that stands there.
_FILTER = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def partial_counts(part: np.ndarray, parts: int, mask: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
    """COUNTS as arrays [part, order, step - 1] over some rows; all of them are sums over rows."""
    all_ = removals(part, parts, mask, n)
    removed = all_[:, :, 1:KEPT]
    fails = np.stack([np.bincount(part, n * (mask >> f & 1), parts) for f in range(len(FILTERS))], 1).astype(np.int64)
    only = np.stack([np.bincount(part, n * (mask == 1 << f), parts) for f in range(len(FILTERS))], 1).astype(np.int64)
    kept = all_.sum(2)[:, :, None] - removed.cumsum(2)
    by_filter = np.stack([removed[:, _FILTER == f].sum(1) for f in range(len(FILTERS))], 1)
    good_lost, toxic_lost = (removals(part, parts, mask, n * x)[:, :, 1:KEPT] for x in (good, toxic))
    return [kept, removed, fails[:, _FILTER] - removed, only[:, _FILTER], good_lost, toxic_lost, by_filter[:, _FILTER]]


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = len(ORDERS) * len(FILTERS)
    orders, step = pa.array(np.repeat(np.array(ORDERS, object), len(FILTERS))), pa.array(np.tile(np.arange(1, KEPT, dtype=np.int32), len(ORDERS)))
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            b = whole.slice(at, AT_ONCE)
            names, part = np.unique(b.column("part").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
            values = [b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "n", "good", "toxic")]
            counts = partial_counts(part, len(names), *values)
            for i, name in enumerate(names):
                yield pa.RecordBatch.from_arrays([pa.array([name] * steps, pa.string()), orders, step, *(pa.array(c[i].ravel()) for c in counts)], ["part", "filter_order", "step", *COUNTS])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row of COUNTS for every source, order of the filters and step."""
    rows = masked(docs, labels).repartition("part").sortWithinPartitions("part")
    found = rows.mapInArrow(_looked_up, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
    return found.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in COUNTS))


def op12_filter_interactions(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return interactions(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


OP12_SQL = r"""
WITH RECURSIVE lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS MATERIALIZED (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    map {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text),
         'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)} AS fails
  FROM t LEFT JOIN lab ON lab.doc_id = t.doc_id),
orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(x) WHERE NOT contains(o, x)),
steps AS (SELECT o, CAST(s AS INTEGER) AS s, o[s] AS x FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
cells AS MATERIALIZED (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
judged AS (
  SELECT part, o, s, x, n, good, toxic, fails[x] AS failed, len(list_filter(string_split(substr(o, 1, s - 1), ''), lambda y: y <> '' AND fails[y])) > 0 AS before,
         len(list_filter(map_values(fails), lambda y: y)) = 1 AS alone
  FROM cells, steps),
summed AS (
  SELECT part, o AS filter_order, s AS step, x, sum(CASE WHEN NOT failed AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND NOT before THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failed AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed AND alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failed AND NOT before THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND NOT before THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM summed"""
