"""Sharding by a minimax contiguous partition of ordered atomic groups.

Equal texts are one group and stay together. Groups are ordered by the digest of their text; the
smallest shard capacity for which a greedy walk over the ordered groups needs no more than the
shards there are is found by binary search, and the order is cut there. A group that is larger than
an even share of what is left gets a shard of its own first, so that it doesn't set the capacity of
all others. Law ``bytes``.

The walk never sees all groups. It works on sums of cells of the digest order: a first aggregation
gives 16 ** FIRST_DIGITS cells, the search on them bounds the capacity from below and above, which leaves few
cells in which a cut can fall, and only those are split into finer cells, until they are single
groups. The driver holds sums of cells: the first ones and, at each finer level, those of the at most
about shards * shards cells in which a cut can still fall, never rows.

Null text counts as empty. Repeated rows are rows of one group. Slots follow (digest of doc_id and
text) inside a shard, numbered through counts of sub-cells, so no task sorts a whole shard. An
empty table gives an empty result; shards may stay empty if there are fewer groups than shards.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quittance.llm.common import stored

SHARDS, ROW_BYTES = 40, 16
#: Hex digits of the text digest by which cells are told apart at first, and by which they are split further.
FIRST_DIGITS, MORE_DIGITS = 3, 1
DIGEST_DIGITS = 32
#: Sub-cells of a shard within which slots are numbered.
SLOT_CELLS = 512


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, grp (digest of the text) and a row digest, stored: later steps never see texts."""
    text = F.coalesce("text", F.lit(""))
    return stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("grp"),
            F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.crc32(text).cast("string"))).alias("row"),
        ),
        "shard-sizes",
    )


def greedy_ends(starts: list[int], upto: list[int], shards: int, capacity: int) -> list[int] | None:
    """Where a greedy walk cuts: the index after the last item of each shard; None if it runs out of shards.

    starts[i] and upto[i] are the sums before and after item i.
    """
    ends, at, done = [], 0, 0
    while at < len(upto):
        if len(ends) == shards:
            return None
        nxt = bisect_right(upto, done + capacity, at)
        if nxt == at:
            return None
        at, done = nxt, upto[nxt - 1]
        ends.append(at)
    return ends


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search of the smallest feasible capacity of contiguous shards over ordered sizes."""
    upto, total = [], 0
    for s in sizes:
        total += s
        upto.append(total)
    lo, hi = max([*sizes, -(-total // shards)], default=0), total
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy_ends(sizes, upto, shards, mid) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def minimax_cuts(groups: DataFrame, shards: int) -> list[str]:
    """The first grp of the second, third ... shard, for groups (grp, size) with one row per group.

    A cell is (prefix, sum, largest group). With cells instead of groups, a greedy walk that may cut
    only between cells gives a feasible capacity (an upper bound), and one that may cut anywhere gives
    a lower bound; any cell in which a walk between the two can end a shard is split by more digits.
    """
    if shards < 2:
        return []
    cells = _cells(groups, F.substring("grp", 1, FIRST_DIGITS))
    while True:
        sums = [c[1] for c in cells]
        upto, total = [], 0
        for s in sums:
            total += s
            upto.append(total)
        high = smallest_capacity(sums, shards)
        low = max([-(-total // shards), *(c[2] for c in cells)], default=0)
        low = _split_bound(cells, upto, shards, low, high)
        # with a capacity in [low, high] the end of each shard lies between the ends of the two extremes,
        # the lower one rounded down to a cell, as no group in the cell may fit
        coarse: set[int] = set()
        first = last = 0
        for _ in range(shards):
            i, j = bisect_right(upto, first + low), bisect_right(upto, last + high)
            coarse.update(k for k in range(i, min(j + 1, len(cells))) if cells[k][3] > 1)
            first = max(first, upto[i] - sums[i]) if i < len(cells) else total
            last = min(total, last + high)
        if not coarse:
            break
        finer = {}
        for n in {len(cells[k][0]) for k in coarse}:
            these = [cells[k][0] for k in coarse if len(cells[k][0]) == n]
            part = groups.where(F.substring("grp", 1, n).isin(these))
            for c in _cells(part, F.substring("grp", 1, min(n + MORE_DIGITS, DIGEST_DIGITS))):
                finer.setdefault(c[0][:n], []).append(c)
        cells = [c for k, old in enumerate(cells) for c in (finer.get(old[0], [old]) if k in coarse else [old])]
    sums = [c[1] for c in cells]
    upto, total = [], 0
    for s in sums:
        total += s
        upto.append(total)
    ends = greedy_ends(sums, upto, shards, smallest_capacity(sums, shards)) or []
    return [cells[e][0] for e in ends[:-1]]


def _split_bound(cells: list, upto: list[int], shards: int, low: int, high: int) -> int:
    """Smallest capacity that suffices if cells of several groups could be cut anywhere (a lower bound)."""
    total = upto[-1] if upto else 0
    whole = [(c[3] == 1) for c in cells]

    def enough(cap: int) -> bool:
        done, n = 0, 0
        while done < total:
            if n == shards:
                return False
            n, to = n + 1, done + cap
            if to < total:
                k = bisect_right(upto, to)
                if whole[k]:
                    to = max(upto[k] - cells[k][1], 0)
                    if to <= done:
                        return False
            done = to
        return True

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid + 1, high)
    return low


def _cells(groups: DataFrame, prefix: Column) -> list:
    """(prefix, sum, largest, groups) in order: one row per cell comes to the driver."""
    agg = groups.groupBy(prefix.alias("p")).agg(F.sum("size").alias("s"), F.max("size").alias("m"), F.count("*").alias("n"))
    return sorted((r.p, int(r.s), int(r.m), int(r.n)) for r in agg.collect())


def large_groups(groups: DataFrame, shards: int) -> list[str]:
    """Groups above an even share of the rest, largest first: fewer than shards rows can be."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    found = groups.where(F.col("size") > total / shards).orderBy(F.desc("size"), "grp").limit(shards - 1).collect()
    out, rest, left = [], total, shards
    for r in found:
        if left > 1 and r["size"] * left > rest:
            out.append(r["grp"])
            rest, left = rest - r["size"], left - 1
    return out


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows of sized() with shard and slot."""
    groups = stored(rows.groupBy("grp").agg(F.sum("size").alias("size")), "shard-groups")
    large = large_groups(groups, shards)
    cuts = minimax_cuts(groups.where(~F.col("grp").isin(large)) if large else groups, shards - len(large))
    # cuts and large groups: fewer than the number of shards
    after = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<string>"), lambda c: c <= F.col("grp"))) + len(large)
    shard = F.coalesce(*[F.when(F.col("grp") == g, i) for i, g in enumerate(large)], after).cast("int")
    placed = rows.withColumn("shard", shard).withColumn("cell", (F.xxhash64("row") % SLOT_CELLS).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(F.col("shard").alias("s"), F.col("cell").alias("c"), F.coalesce(ahead, F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row", "doc_id"))
    return (
        placed.withColumn("nth", nth)
        .join(base, (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c")))
        .withColumn("slot", (F.col("base") + F.col("nth") - 1).cast("long"))
        .drop("nth", "base", "s", "c", "cell")
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(sized(docs)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
