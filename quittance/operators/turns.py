"""Claims that are decided in turns: what an earlier one takes, later ones don't see.

Claims of a size that a single task goes through in seconds are streamed through one, in order. More are decided
in rounds of joins, each round all turns that nothing open before them can change, as long as a round decides a
fair share; what is left hangs together in chains, and each connected component is streamed through a task in
order, so no component is ever held as a whole: only the items it has taken are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quittance.operators.graph import connected_components
from quittance.sources.stored import stored

#: Claims that one task streams; the least share that a round has to decide for another to follow.
ONE_PASS, LEAST_SHARE = 1 << 18, 0.05


def streamed(rows: DataFrame, part: str | None, turn: str, order: list[str], decide: Callable[[Any, list[tuple]], Iterable[tuple]], schema: str, start: Callable[[], Any] = set) -> DataFrame:
    """Go through rows by turn, of each part or of all in one task; decide(taken, rows of a turn as tuples) yields results and adds to taken, which is start() for a part.

    order are the columns that order a turn's rows; tuples have the columns of rows without part.
    """
    names = [c for c in rows.columns if c != part]
    at, kinds = names.index(turn), to_arrow_schema(StructType.fromDDL(schema))

    def packed(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: Any = None
        mine: list[tuple] = []
        now = None
        for b in batches:
            found: list[tuple] = []
            parts = b.column(part).to_pylist() if part else [None] * b.num_rows
            for p, row in zip(parts, zip(*(b.column(c).to_pylist() for c in names), strict=True), strict=True):
                if mine and (p != now or row[at] != mine[0][at]):
                    found += decide(taken, mine)
                    mine = []
                if taken is None or p != now:
                    taken, now = start(), p
                mine.append(row)
            if found:
                yield packed(found)
        if mine and (found := list(decide(taken, mine))):
            yield packed(found)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(1) if part is None else rows.repartition(tasks, part)
    return dealt.sortWithinPartitions(*([part] if part else []), turn, *order).mapInArrow(run, schema)


def by_component(claims: DataFrame, turn: str, item: str, order: list[str], decide, schema: str) -> DataFrame:
    """streamed() over the connected components of claims between turns and items."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    parts = connected_components(claims.select(node("p", turn).alias("a"), node("t", item).alias("b")))
    keyed = claims.withColumn("node", node("t", item)).join(parts, "node").drop("node")
    return streamed(keyed, "component", turn, order, decide, schema)


def in_turns(claims: DataFrame, turn: str, item: str, order: list[str], decide, schema: str, a_round: Callable[[DataFrame], tuple[DataFrame, DataFrame]], one_pass: int | None = None) -> DataFrame:
    """The results of all turns; a_round(open claims) gives (results, claims that stay open), both stored."""
    one_pass = ONE_PASS if one_pass is None else one_pass
    open_, out = stored(claims, "claims"), []
    n = open_.count()
    while n > one_pass:
        found, left = a_round(open_)
        out.append(found)
        m, before = left.count(), n
        open_, n = left, m
        if before - m < LEAST_SHARE * before:
            break
    if n > one_pass:
        out.append(by_component(open_, turn, item, order, decide, schema))
    elif n:
        out.append(streamed(open_, None, turn, order, decide, schema))
    return reduce(DataFrame.unionByName, out) if out else claims.sparkSession.createDataFrame([], schema)
