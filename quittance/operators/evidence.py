"""Evidence of records: links from read identifiers, contradictions, neighbourhoods and completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quittance.sources.stored import stored

#: Levels of clearance, lowest first; states of which the later contradicts the earlier.
LEVELS = ("PUBLIC", "CONFIDENTIAL", "RESTRICTED", "HIGHLY_RESTRICTED")
CONFLICTS = (("settled", "reversed"), ("captured", "failed"), ("paid", "cancelled"))
CRITICAL_MINOR = 50_000


def level_of(name: Column) -> Column:
    """1 to 4; an unknown name has no level and is seen by nobody."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), name), F.lit(0))


def visible(items: DataFrame, clearance: str = LEVELS[-1], kinds: list[str] | None = None) -> DataFrame:
    """The items (level 1 to 4, kind) that a clearance allows, of some kinds if given."""
    seen = items.where(F.col("level") <= LEVELS.index(clearance) + 1)
    return seen if kinds is None else seen.where(F.col("kind").isin(kinds))


def read_identifier(token: Column) -> Column:
    """An identifier without marks at its ends, upper-case; after the first part O counts as 0, and I, L and | as 1."""
    plain = F.regexp_replace(F.upper(F.trim(token)), r"^[#:\-_]+|[#:\-_]+$", "")
    parts = F.split(plain, "[-_:]")
    rest = F.translate(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "-"), "OIL|", "0111")
    return F.when(F.size(parts) > 1, F.concat_ws("-", F.get(parts, F.lit(0)), rest)).otherwise(plain)


def without_one(text: Column) -> Column:
    """A text and all that are left when one character goes; two texts an edit apart have one of these in common."""
    return F.array_distinct(F.concat(F.array(text), F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))))))


def resolve_ids(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """(token_id, status, matched_id, distance, candidates) of tokens (token_id, token) among known ids (id).

    In this order: equal but for case, equal as read_identifier has them (the least id, if several), one edit
    apart if only one id is. Candidates of one edit are an equi join of the texts less one character, for
    distinct tokens that are left; null tokens are unresolved. No side is broadcast: the planner takes texts less
    one character for as small as the ids that they come from, and would collect them on the driver.
    """
    low = lambda c: F.lower(F.trim(c))
    exact = known.groupBy(F.lower("id").alias("low")).agg(F.min("id").alias("exact_id"))
    alike = known.groupBy(read_identifier(F.col("id")).alias("norm")).agg(F.min("id").alias("norm_id"))
    asked = tokens.select("token_id", F.trim("token").alias("token"), low(F.col("token")).alias("low"), read_identifier(F.col("token")).alias("norm")).join(exact.hint("merge"), "low", "left").join(alike.hint("merge"), "norm", "left")
    left = asked.where("low IS NOT NULL AND exact_id IS NULL AND norm_id IS NULL").select("low").distinct()
    parts = left.select("low", F.explode(without_one(F.col("low"))).alias("part")).join(known.select("id", F.explode(without_one(F.lower("id"))).alias("part")).hint("merge"), "part")
    near = parts.select("low", "id").distinct().where(F.levenshtein("low", F.lower("id")) <= 1)
    near = near.groupBy("low").agg(F.sort_array(F.collect_list("id")).alias("near"))
    told = asked.join(near.hint("merge"), "low", "left")
    one, many = F.size("near") == 1, F.size("near") > 1
    return told.select(
        "token_id",
        F.when(F.col("exact_id").isNotNull(), "VERIFIED_EXACT").when(F.col("norm_id").isNotNull() | one, "VERIFIED_FUZZY_NORMALIZED").when(many, "AMBIGUOUS_MULTIPLE_CANDIDATES").otherwise("UNRESOLVED_NO_MATCH").alias("status"),
        F.coalesce("exact_id", "norm_id", F.when(one, F.get("near", F.lit(0)))).alias("matched_id"),
        F.when(F.col("exact_id").isNotNull(), 0).when(F.col("norm_id").isNotNull(), F.levenshtein("token", "norm_id")).when(one | many, 1).alias("distance"),
        F.when(many, F.col("near")).alias("candidates"),
    )


def contradictions(items: DataFrame) -> DataFrame:
    """(record_id, type, value_a, value_b, evidence_a, evidence_b, severity) of items (record_id, evidence_id, at, amount, currency, status).

    Different amounts and currencies of a record contradict each other, the smaller first, and so do states of
    CONFLICTS if the second comes later. A row stands for all items with these values and names the first of
    each (of a later state, the last); so values are paired, not items.
    """

    def paired(value: str, type_: str, severity) -> DataFrame:
        first = items.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy("record_id", F.col(value).alias("value")).agg(F.min(F.struct("at", "evidence_id")).alias("e"))
        a, b = (first.select("record_id", F.col("value").alias(f"v{x}"), F.col("e.evidence_id").alias(f"evidence_{x}")) for x in "ab")
        both = a.join(b, "record_id").where("va < vb")
        return both.select("record_id", F.lit(type_).alias("type"), F.col("va").cast("string").alias("value_a"), F.col("vb").cast("string").alias("value_b"), "evidence_a", "evidence_b", severity(F.col("vb"), F.col("va")).alias("severity"))

    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CONFLICTS))
    state = items.groupBy("record_id", "status").agg(F.min(F.struct("at", "evidence_id")).alias("first"), F.max(F.struct("at", "evidence_id")).alias("last"))
    a = state.withColumn("p", F.explode(pairs)).where("status = p.a").select("record_id", F.col("p.b").alias("other"), F.col("status").alias("value_a"), "first")
    b = state.select("record_id", F.col("status").alias("other"), "last")
    states = a.join(b, ["record_id", "other"]).where("first < last").select(
        "record_id", F.lit("STATUS_MISMATCH").alias("type"), "value_a", F.col("other").alias("value_b"), F.col("first.evidence_id").alias("evidence_a"), F.col("last.evidence_id").alias("evidence_b"), F.lit("CRITICAL").alias("severity")
    )
    amounts = paired("amount", "AMOUNT_MISMATCH", lambda y, x: F.when(y - x > CRITICAL_MINOR, "CRITICAL").otherwise("HIGH"))
    return amounts.unionByName(paired("currency", "CURRENCY_MISMATCH", lambda *_: F.lit("HIGH"))).unionByName(states)


def neighbourhoods(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 2, clearance: str = LEVELS[-1]) -> tuple[DataFrame, DataFrame]:
    """Nodes (root, node, depth) and edges (root, a, b, kind) around each of roots (root): breadth first in either direction.

    Nodes (node, level) beyond the clearance are neither shown nor passed. Edges are those of nodes nearer than
    depth whose ends are both shown. A round is a join of the outermost nodes with the edges; each is stored.
    """
    open_ = nodes.where(F.col("level") <= LEVELS.index(clearance) + 1).select("node").distinct()
    ways = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct()
    shell = stored(roots.select("root", F.col("root").alias("node")).distinct().join(open_, "node").select("root", "node", F.lit(0).alias("depth")), "shell")
    shells = [shell]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, shells)
        out = shell.join(ways, "node").select("root", F.col("to").alias("node")).distinct().join(open_, "node").join(seen.select("root", "node"), ["root", "node"], "left_anti")
        shell = stored(out.select("root", "node", F.lit(d).alias("depth")), "shell")
        shells.append(shell)
    seen = reduce(DataFrame.unionByName, shells)
    inner = seen.where(F.col("depth") < depth)
    touched = inner.join(edges, F.col("node") == F.col("a")).unionByName(inner.join(edges, F.col("node") == F.col("b"))).select("root", "a", "b", "kind").distinct()
    for end in ("a", "b"):
        touched = touched.join(seen.select("root", F.col("node").alias(end)), ["root", end], "left_semi")
    return seen, touched.select("root", "a", "b", "kind")


def completeness(kinds: Column, conflict: Column) -> Column:
    """State of the evidence of which kinds (array) are there; conflict: whether a source contradicts itself."""
    has = lambda *x: F.arrays_overlap(kinds, F.array(*map(F.lit, x)))
    return (
        F.when(conflict, "CONFLICTING")
        .when(~has("PAYMENT") | ~has("SETTLEMENT", "BANK_RECORD"), "MISSING_CRITICAL_SOURCE")
        .when(~has("INVOICE", "REFUND", "DOCUMENT") & (F.size(kinds) < 3), "PARTIAL")
        .otherwise("COMPLETE")
    )
