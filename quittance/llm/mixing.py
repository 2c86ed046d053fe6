"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target in words. Complete epochs of a source come first; of the rest of its
target, documents are taken in the order of exponential keys -ln(u) / quality until it is met. u is
drawn from a digest of doc_id, so reruns agree. The order is never laid out in one task: keys fall
in cells of their logarithm, STEPS to an octave, so that a factor on all keys moves them along and
piles up none; sums of the cells say in which the target is met, sums of its SUBCELLS in which of
those, and only that part of a part is sorted.

A document is taken whole: the one at the boundary if at least half of it still fits. Rows of equal
source, key and doc_id (repeated rows) are taken together. Null or empty text has size 0. Null source
is a source, the last one; null doc_id is drawn as the text 'null'. An empty table gives an empty
result, a source without words is taken as often as its target has complete epochs: never. Texts of
any length are measured whole. Other columns, whatever their names, stay as they are in mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quittance.llm.common import SPACE, spaced_words, stored

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
STEPS, SUBCELLS = 256, 4096
SEED = "mix"
#: ASCII characters that aren't letters.
PLAIN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def quality(text: Column) -> Column:
    """Default quality weight in (0, 1]: the share of letters (ASCII ones and all beyond ASCII) among what isn't white space."""
    letters, solid = (F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), x, "")) for x in (PLAIN, SPACE))
    return (letters + 1) / (solid + 1)


def drawn(docs: DataFrame, weight: Column | None = None, keep: bool = False) -> DataFrame:
    """(doc_id, source, size, tie, key, cell, sub) of docs (doc_id, text, source); keep: and their own columns as the struct row."""
    tie = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), tie)), 1, 13), 16, 10).cast("long") + 0.5) / 2.0**52
    key = -F.log(u) / (quality(F.col("text")) if weight is None else weight)
    place = STEPS * F.log2("key")
    own = [F.struct(*docs.columns).alias("row")] if keep else []
    sized = docs.select("doc_id", "source", F.size(spaced_words(F.col("text"))).cast("long").alias("size"), tie.alias("tie"), key.alias("key"), *own)
    return sized.select(
        "doc_id", "source", "size", "tie", "key",
        F.floor(place).alias("cell"),
        F.floor((place - F.floor(place)) * SUBCELLS).alias("sub"),
        *(["row"] if keep else []),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    min(cap * size, level * weight) is where resharing the excess by weight ends; level is the one
    at which the targets add up to the share. Sources are ranked by the ratio cap * size / weight;
    the windows without a partition see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    s = sizes.withColumn("weight", nth).withColumn("cap", (cap * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (share * F.col("total") - F.col("full")) / F.col("open"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("rank", F.row_number().over(order)).withColumn(
        "level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("rank"))).over(everything)
    )
    met = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", met.alias("target"))


def _where_met(cells: DataFrame, cell: str, goal: DataFrame) -> DataFrame:
    """goal (s, rest, before, ...) with the cell of cells (source, cell, cell_size) in which rest is met, and the size before it."""
    sofar = F.sum("cell_size").over(Window.partitionBy("source").orderBy(cell)) - F.col("cell_size")
    laid = cells.withColumn("sofar", sofar).join(goal, F.col("source").eqNullSafe(F.col("s"))).withColumn("start", F.col("before") + F.col("sofar"))
    met = laid.where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("cell_size")))
    return met.select(*(c for c in goal.columns if c != "before"), cell, F.col("start").alias("before"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: its target, complete epochs, and up to which cell, cell in the cell and key it is taken once more."""
    cells = stored(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "mix-cells")
    goal = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, cap)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = stored(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-goal")
    at = _where_met(cells, "cell", goal.select(F.col("source").alias("s"), "rest").withColumn("before", F.lit(0)))
    at = at.withColumnRenamed("cell", "cut_cell")
    edge = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("cut_cell")))
    subs = edge.groupBy("source", "sub").agg(F.sum("size").alias("cell_size"))
    sub_at = stored(_where_met(subs, "sub", at).withColumnRenamed("sub", "cut_sub"), "mix-edges")
    edge = rows.join(sub_at, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("cut_cell")) & (F.col("sub") == F.col("cut_sub")))
    ties = edge.groupBy("s", "before", "rest", "key", "tie").agg(F.sum("size").alias("size"))
    run = F.sum("size").over(Window.partitionBy("s").orderBy("key", "tie")) - F.col("size") + F.col("before")
    last = ties.withColumn("run", run).where(F.col("run") + F.col("size") / 2 <= F.col("rest"))
    cut = last.groupBy("s").agg(F.max(F.struct("key", "tie")).alias("upto"))
    cells_cut = sub_at.select("s", "cut_cell", "cut_sub").join(cut.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
    return stored(
        goal.join(cells_cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
            F.col("source").alias("plan_source"), "source_size", "target", "epochs", "cut_cell", "cut_sub", F.col("upto.key").alias("cut_key"), F.col("upto.tie").alias("cut_tie")
        ),
        "mix-plan",
    )


def copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows of drawn() with source_size, target and copies: how often the mix takes each."""
    in_sub = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("tie") <= F.col("cut_tie")))
    in_cell = (F.col("sub") < F.col("cut_sub")) | ((F.col("sub") == F.col("cut_sub")) & in_sub)
    more = F.coalesce((F.col("cell") < F.col("cut_cell")) | ((F.col("cell") == F.col("cut_cell")) & in_cell), F.lit(False)).cast("int")
    return rows.join(planned, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("copies", F.col("epochs") + more)


def mix(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; the texts aren't shuffled."""
    keyed = drawn(docs, keep=True)
    planned = plan(stored(drawn(docs), "mix-sizes"))
    taken = copies(keyed, planned)
    return taken.where("copies > 0").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = stored(drawn(docs), "mix-sizes")
    return copies(rows, plan(rows)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, text,
         coalesce(CAST(doc_id AS VARCHAR), 'null') AS tie
  FROM documents),
k AS (
  SELECT doc_id, source, CAST(size AS BIGINT) AS size, tie,
         -ln((CAST('0x' || substr(md5('mix:' || tie), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
         / (CAST(length(regexp_replace(coalesce(text, ''), '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) + 1 AS DOUBLE)
            / (length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) + 1)) AS key
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS DOUBLE) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM k GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
     row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS rank
  FROM s),
t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, rank) FROM l WHERE level * weight <= cap) * weight, cap)) AS target
  FROM l),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT source, key, tie, sum(size) AS tied,
         sum(sum(size)) OVER (PARTITION BY source ORDER BY key, tie) - sum(size) AS run
  FROM k GROUP BY source, key, tie)
SELECT k.doc_id, k.size, g.source_size, g.target,
       CAST(k.size * (g.epochs + CASE WHEN r.run < g.target - g.epochs * g.source_size
                                       AND r.run + r.tied / 2.0 <= g.target - g.epochs * g.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
JOIN r ON k.source IS NOT DISTINCT FROM r.source AND k.key = r.key AND k.tie = r.tie
"""
