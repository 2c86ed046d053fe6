"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting (doc_key, term, pos) for each training token. A phrase is looked up from
its rarest terms: the postings of the rarest give candidate starts (pos - offset), the offset-
adjusted postings of the next rarest terms are intersected with them, and what is left is compared
with the document's words, which decides exactly. With ``slop`` > 0 every term may lie up to that
many words from its place (a proximity match).

Null or empty text has no words and gives 0, 0, 0, the digest of an empty list and false. Repeated
rows get a result each, but are searched once: they share a key, and their equal postings are one
after the first shuffle. An empty benchmark, or one without words, hits nothing; empty documents give
no rows. An item whose item_id is null marks words as hit but isn't listed or counted. Rows are told
apart by a hash of doc_id and text, so doc_id may be null or repeated; other columns may have any
names. A very long text is one row of postings a word; only its hits are gathered in its row, and the
items of a phrase once for each document and phrase, not for each hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quittance.llm.common import ascii_lower, stored

#: Words are letters, digits and everything beyond ASCII; this is what lies between them. Upper case counts as
#: letters, as words are lower-cased one by one.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Lists that are intersected before the exact comparison.
DEPTH = 3
#: Tables of phrases and terms of up to this many bytes are sent to all executors, larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def doc_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (doc_key, term, pos) of docs (doc_id, text), stored; of all terms or of those in terms (term)."""
    found = docs.select(
        doc_key(F.col("doc_id"), F.col("text")).alias("doc_key"), F.posexplode(raw_words(F.col("text"))).alias("pos", "word")
    ).select("doc_key", ascii_lower(F.col("word")).alias("term"), "pos")
    if terms is not None:
        found = found.join(_small(terms), "term", "left_semi")
    return stored(found.select("doc_key", "term", "pos"), "postings")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (phrase, words, items) of items (item_id, text), stored."""
    w = F.transform(raw_words(F.col("text")), ascii_lower)
    cut = items.select(F.col("item_id").cast("string").alias("item"), w.alias("w")).where(F.size("w") > 0)
    each = cut.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {window - 1}, 1)), i -> slice(w, i, {window}))")).alias("words"))
    return stored(
        each.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.monotonically_increasing_id().alias("phrase"), "words", "items"),
        "phrases",
    )


def _small(df: DataFrame) -> DataFrame:
    """Broadcast df only if the bytes of its rows, summed up, are within the bound; else the join shuffles."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def candidates(index: DataFrame, wanted: DataFrame, slop: int = 0, depth: int = DEPTH) -> DataFrame:
    """(doc_key, phrase, start) where the depth rarest terms of the phrase are in place, or up to slop words from it."""
    at = wanted.select("phrase", F.posexplode("words").alias("off", "term"))
    seen = index.groupBy("term").agg(F.count("*").alias("n"))
    ranked = at.join(seen, "term").groupBy("phrase").agg(
        F.count("*").alias("known"), F.slice(F.sort_array(F.collect_list(F.struct("n", "off", "term"))), 1, depth).alias("rare")
    )
    # a phrase with a term that no document has can't occur
    ranked = wanted.join(ranked, "phrase").where(F.col("known") == F.size("words"))
    nth = lambda r: F.element_at("rare", F.least(F.lit(r), F.size("rare")))
    for_each = stored(ranked.select("phrase", *(nth(r)[k].alias(f"{k}{r}") for r in range(1, depth + 1) for k in ("term", "off"))), "rare-terms")
    first = index.join(_small(for_each), F.col("term") == F.col("term1"))
    start = F.col("pos") - F.col("off1")
    first = first.withColumn("start", F.explode(F.sequence(start - slop, start + slop)) if slop else start)
    later = [f"{k}{r}" for r in range(2, depth + 1) for k in ("term", "off")]
    found = first.where("start >= 0").select("doc_key", "phrase", "start", *later)
    width = 2 * slop + 1
    for r in range(2, depth + 1):
        due = F.col("start") + F.col(f"off{r}")
        cells = F.array_distinct(F.array(F.floor((due - slop) / width), F.floor((due + slop) / width)))
        key = ["doc_key", "term", "cell"]
        left = found.withColumn("term", F.col(f"term{r}")).withColumn("cell", F.explode(cells))
        these = index.join(_small(for_each.select(F.col(f"term{r}").alias("term")).distinct()), "term", "left_semi")
        right = these.select("doc_key", "term", F.floor(F.col("pos") / width).alias("cell"), "pos")
        # repeated rows have equal postings: dropped where they meet, on the partitions of the join
        left, right = (x.repartition(*key).dropDuplicates() for x in (left, right))
        near = left.join(right, key).where(F.abs(F.col("pos") - due) <= slop)
        found = near.select("doc_key", "phrase", "start", *later)
        if slop:
            found = found.distinct()
    return found.select("doc_key", "phrase", "start")


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc, n_words, hits): doc has the columns of docs (doc_id and text among them), hits the phrases that match.

    A hit is (starts, words, items) of a phrase. docs is read twice; only candidates meet the texts again.
    """
    wanted = phrases(items, window)
    index = build_index(docs, wanted.select(F.explode("words").alias("term")).distinct())
    starts = candidates(index, wanted, slop).groupBy("doc_key", "phrase").agg(F.collect_set("start").alias("starts"))
    per_doc = starts.join(_small(wanted), "phrase").groupBy("doc_key").agg(F.collect_list(F.struct("starts", "words", "items")).alias("found"))
    texts = docs.select(F.struct(*docs.columns).alias("doc")).select(
        doc_key(F.col("doc.doc_id"), F.col("doc.text")).alias("doc_key"), "doc"
    )
    joined = texts.join(per_doc, "doc_key", "left").select("doc", "found", raw_words(F.col("doc.text")).alias("raw"))

    def in_place(words: Column, start: Column) -> Column:
        if not slop:
            return F.transform(F.slice("raw", start + 1, F.size(words)), ascii_lower) == words
        around = lambda i: F.slice("raw", F.greatest(start + i - slop, F.lit(0)) + 1, F.least(start + i, F.lit(slop)) + slop + 1)
        return F.forall(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(F.transform(around(i), ascii_lower), F.get(words, i)))

    def verified(c: Column) -> Column:
        return F.struct(F.filter(c["starts"], lambda s: in_place(c["words"], s)).alias("starts"), c["words"].alias("words"), c["items"].alias("items"))

    hits = F.filter(F.transform(F.coalesce("found", F.array()), verified), lambda h: F.size(h["starts"]) > 0)
    return joined.select("doc", F.size("raw").cast("long").alias("n_words"), hits.alias("hits"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc and n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    words_of = lambda h: F.flatten(F.transform(h["starts"], lambda s: F.sequence(s, s + F.size(h["words"]) - 1)))
    places = F.flatten(F.transform("hits", words_of))
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return (
        search(docs, items, window)
        .select("doc", "n_words", F.size(F.array_distinct(places)).cast("long").alias("n_hit"), listed.alias("items"))
        .select(
            "doc",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return out.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, i, k, list_slice(w, i, i + k - 1) AS g
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY r),
t AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, coalesce(t.items_sha256, sha256('')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
