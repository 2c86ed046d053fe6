"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document is measured. A sketch counts the values of a measure in cells whose bounds grow by a
factor of GAMMA (zero has its own), so any quantile is known to a relative error; counts of a language
and source add up to those of the language and of all, and are the same however rows are dealt out.

No fence is a constant; REACH says how far out in terms of the group itself a value has to lie.
Where at least half of a group has a measure, fences lie REACH spreads beyond the quartiles, a spread
being the distance of the quartile from the median, at least what a cell can tell apart. Where fewer have
it, the fence is laid on those that do. The smallest share that a document of the group's median size can
have is its unit. Usual values reach up from there; if at some point from the unit on nearly all of what
lies above (PLATEAU of it) lies even REACH times as high, then nothing leads up to it, and the fence stands at that
height. Else it stands above the 0.99 quantile of the positive part by its distance from their median.

A group of fewer than MIN_GROUP documents uses its language's fences, and those of all documents if that
is small too. If a group's median lies within its language's fences but its quartile doesn't, the group holds junk
beside documents like the others, and the language's fence holds there. A document is kept if each
measure lies within its fences. Base rules come before and are never overruled.

A single repeated line or phrase and a single mark tell nothing, so shares count what is beyond the first.

Null and empty text: no words, so the base rules fail it. Null lang or source is a group of its own.
Very long texts are measured whole. Equal values fall in equal cells, so ties are judged alike.
Repeated rows: one result each; repeats count in the sketches. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quittance.llm.common import SPACE, spaced_words, stored

MIN_GROUP = 200
GAMMA, REACH, PLATEAU = 1.002, 12.0, 0.9
#: Measures, and what the unit of each is a part of.
MEASURES = {"symbol_share": "words", "dup_share": "lines", "word_length": "words", "repeat_share": "words"}
SIZES = {"words": "n_words", "lines": "n_lines"}
#: Cells that a factor of REACH spans; the cell of 1.
FAR, ONE = math.floor(math.log(REACH) / math.log(GAMMA)), 20_000


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts, all by functions of the row's own whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        "doc_id",
        "lang",
        "source",
        spaced_words(F.col("text")).alias("w"),
        F.char_length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    )
    counted = split.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    alike = F.size(F.array_distinct("g")) < F.size("g")
    return counted.withColumn("n_repeat_words", F.when(alike, _repeated(F.col("g"))).otherwise(0).cast("long")).drop("g")


def _repeated(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: windows in order of hash, those equal to a neighbour, their words."""

    def words_of(s: Column) -> Column:
        def mark(p: Column, j: Column) -> Column:
            x = p["x"]
            return F.when((x.eqNullSafe(F.get(s, j - 1)["x"])) | (x.eqNullSafe(F.get(s, j + 1)["x"])), p["i"])

        marked = F.filter(F.transform(s, mark), lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(marked, lambda i: F.array(i, i + 1, i + 2)))))

    ordered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.get(F.transform(F.array(ordered), words_of), F.lit(0))  # so that the order is made once for each row


def with_measures(counts: DataFrame) -> DataFrame:
    """counts with the measures that the fences are laid on; base_failed documents have measures too."""
    n = F.greatest("n_words", F.lit(1))
    beyond = lambda c, first: F.greatest(F.col(c) - first, F.lit(0))
    return (
        counts.withColumn("symbol_share", beyond("n_symbols", 1) / n)
        .withColumn("dup_share", beyond("n_dup_lines", 1) / F.greatest("n_lines", F.lit(1)))
        .withColumn("word_length", F.col("word_chars") / n)
        .withColumn("repeat_share", beyond("n_repeat_words", 6) / n)  # a phrase of three words said twice
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def cell(x: Column) -> Column:
    """The cell of a value: 0 for zero, else the place of its logarithm, counted from what is less than any measure."""
    return F.when(x > 0, F.floor(F.log(x) / math.log(GAMMA)) + ONE).otherwise(0).cast("int")


def value(cell: Column) -> Column:
    return F.when(cell > 0, F.pow(F.lit(GAMMA), cell - (ONE - 0.5))).otherwise(0.0)


def sketches(rows: DataFrame) -> DataFrame:
    """(level, lang, source, measure, cell, n): counts of measures and sizes per language and source, merged per language, merged over all."""
    good = rows.where(~F.col("base_failed"))
    values = {m: m for m in MEASURES} | SIZES
    both = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), cell(F.col(c)).alias("cell")) for m, c in values.items())))
    each = good.select("lang", "source", both.alias("x")).groupBy("lang", "source", "x.measure", "x.cell").agg(F.count("*").alias("n"))
    each = stored(each.select(F.lit("source").alias("level"), "lang", "source", "measure", "cell", "n"), "quality-sketches")
    none = F.lit(None).cast("string")
    by_lang = each.groupBy("lang", "measure", "cell").agg(F.sum("n").alias("n")).select(F.lit("lang").alias("level"), "lang", none.alias("source"), "measure", "cell", "n")
    over_all = each.groupBy("measure", "cell").agg(F.sum("n").alias("n")).select(F.lit("all").alias("level"), none.alias("lang"), none.alias("source"), "measure", "cell", "n")
    return each.unionByName(by_lang).unionByName(over_all)


def fences(sketched: DataFrame) -> DataFrame:
    """(level, lang, source, n, {measure}_lo, {measure}_hi and quartiles {measure}_q1, _q2, _q3) of each group."""
    group, key = ["level", "lang", "source"], ["level", "lang", "source", "measure"]
    total, upto = F.sum("n").over(Window.partitionBy(*key)), F.sum("n").over(Window.partitionBy(*key).orderBy("cell"))
    sizes = sketched.where(F.col("measure").isin(*SIZES)).withColumn("total", total).withColumn("upto", upto)
    median = sizes.groupBy(*key).agg(value(F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("cell")))).alias("size"))
    parts = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(of).alias("of")) for m, of in MEASURES.items())))
    # a cell without documents just below the unit of each group and measure
    below = cell(1 / F.col("size")) - 1
    start = median.select(*group, F.col("measure").alias("size_of"), "size", parts.alias("x")).where("size_of = x.of").select(*group, F.col("x.m").alias("measure"), below.alias("cell"), F.lit(0).cast("long").alias("n"), below.alias("start"))
    cells = sketched.where(F.col("measure").isin(*MEASURES)).withColumn("start", F.lit(None).cast("int")).unionByName(start).groupBy(*key, "cell").agg(F.sum("n").alias("n"), F.max("start").alias("start"))
    over = Window.partitionBy(*key).orderBy("cell")
    above = lambda far: F.coalesce(F.sum("n").over(over.rangeBetween(1 + far, Window.unboundedFollowing)), F.lit(0))
    whole = Window.partitionBy(*key)
    laid = (
        cells.withColumn("upto", F.sum("n").over(over))
        .withColumn("total", F.sum("n").over(whole))
        .withColumn("zeros", F.sum(F.when(F.col("cell") == 0, F.col("n")).otherwise(0)).over(whole))
        .withColumn("start", F.max("start").over(whole))
        .withColumn("above", above(0))
        .withColumn("far", above(FAR))
    )
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("cell"))).alias(f"c{q}")
    positive, rank = F.col("total") - F.col("zeros"), F.col("upto") - F.col("zeros")
    of_positive = lambda part, of, name: F.min(F.when((F.col("cell") > 0) & (rank * of >= positive * part), F.col("cell"))).alias(name)
    leads = (F.col("cell") >= F.col("start")) & (F.col("above") > 0) & (F.col("far") >= PLATEAU * F.col("above"))
    each = laid.groupBy(*key).agg(
        F.max("total").alias("n"), F.max(positive).alias("positive"), F.max("start").alias("start"), *map(quartile, (1, 2, 3)),
        of_positive(1, 2, "p50"), of_positive(99, 100, "p99"), F.min(F.when(leads, F.col("cell"))).alias("plateau"),
    )
    q1, q2, q3, p50, p99 = (value(F.col(c)) for c in ("c1", "c2", "c3", "p50", "p99"))
    least = q2 * (GAMMA - 1)
    rare = F.when(F.col("plateau").isNotNull(), value(F.col("plateau") + FAR)).when(F.col("positive") > 0, 2 * p99 - p50).otherwise(value(F.col("start") + FAR))
    sparse = F.col("c2") == 0
    each = each.select(
        *key, "n", q1.alias("q1"), q2.alias("q2"), q3.alias("q3"),
        F.when(sparse, 0.0).otherwise(q1 - REACH * F.greatest(q2 - q1, least)).alias("lo"), F.when(sparse, rare).otherwise(q3 + REACH * F.greatest(q3 - q2, least)).alias("hi"),
    )
    cols = [F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{m}_{e}") for m in MEASURES for e in ("lo", "hi", "q1", "q2", "q3")]
    return each.groupBy(*group).agg(F.max("n").alias("n"), *cols)


def group_fences(bounds: DataFrame) -> DataFrame:
    """(lang, source, {measure}_lo, {measure}_hi) to be used for every group: its own, its language's or those of all."""
    ends = [f"{m}_{e}" for m in MEASURES for e in ("lo", "hi")]
    lang = bounds.where(f"level = 'lang' AND n >= {MIN_GROUP}").select(F.col("lang").alias("l"), F.lit(True).alias("known"), *(F.col(x).alias(f"l_{x}") for x in ends))
    over_all = bounds.where("level = 'all'").select(*(F.col(x).alias(f"a_{x}") for x in ends))  # one row
    g = bounds.where("level = 'source'").join(lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(over_all), how="left")
    out = ["lang", "source"]
    own, listed = F.col("n") >= MIN_GROUP, F.coalesce("known", F.lit(False))
    for m in MEASURES:
        lo, hi, q1, q2, q3, llo, lhi = (F.col(f"{x}") for x in (f"{m}_lo", f"{m}_hi", f"{m}_q1", f"{m}_q2", f"{m}_q3", f"l_{m}_lo", f"l_{m}_hi"))
        inside = listed & (q2 >= llo) & (q2 <= lhi)
        high = F.when(own, F.when(inside & (q3 > lhi), lhi).otherwise(hi)).when(listed, lhi).otherwise(F.col(f"a_{m}_hi"))
        low = F.when(own, F.when(inside & (q1 < llo), llo).otherwise(lo)).when(listed, llo).otherwise(F.col(f"a_{m}_lo"))
        out += [low.alias(f"{m}_lo"), high.alias(f"{m}_hi")]
    return g.select(*out)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed and kept of every row."""
    rows = stored(with_measures(measured(docs)), "quality-measures")
    bounds = stored(group_fences(stored(fences(sketches(rows)), "quality-quartiles")), "quality-fences")
    # one row per language and source of which a document passes the base rules
    joined = rows.join(
        bounds.withColumnsRenamed({"lang": "g_lang", "source": "g_source"}),
        F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")),
        "left",
    )
    inside = F.lit(True)
    for m in MEASURES:
        # value and fences meet as cells' values: the same on both sides of a fence that lies on a value
        inside = inside & F.coalesce((value(cell(F.col(m))) >= F.col(f"{m}_lo")) & (value(cell(F.col(m))) <= F.col(f"{m}_hi")), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")).drop("lang", "source")
