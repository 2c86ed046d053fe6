"""Token counts through a cache of content digests.

A text's count is stored under the SHA-256 of its normalised content (null becomes empty; nothing
else may change, as counts are of whole texts as they stand) and a digest of the tokenizer file and
library version. Only distinct digests without a stored count are encoded; their counts are appended
to the cache, so another run over the same texts encodes nothing.

The query keeps its cache in one folder for each tokenizer version, below spark.checkpoint.dir.

Null and empty text: 0 bytes, 0 tokens. Repeated rows: one result each, encoded once. Two runs that
append the same digest at a time do no harm: equal counts are read once. A text of any length is
encoded whole. An empty table gives no rows. Other columns are ignored. Rows meet their counts by
digest; the digest of a text that very many rows share is a skewed key, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.llm.common import new_path, shared_dir, stored
from quittance.llm.tokens import encoder, file_digest, in_batches, tokenizer_path

LIMIT = 1024
CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    return f"{lib.__name__}-{lib.__version__}-{file_digest(path)}"


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """Stored counts (digest, n_tokens) of a tokenizer version; None if there is no cache yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    known = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == version)
    return known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(docs: DataFrame, known: DataFrame | None, tokenizer: str, version: str) -> DataFrame:
    """Counts of the distinct digests of docs (digest, text) that known lacks."""
    if known is not None:
        missing = stored(docs.select("digest").distinct().join(known, "digest", "left_anti"), "misses")
        docs = docs.join(missing, "digest", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for b in in_batches(whole):
                n = [len(p) // 4 for p in enc.packed(b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    counted = docs.select("digest", "text").dropDuplicates(["digest"]).mapInArrow(count, "digest string, n_tokens long")
    return counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens")


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; cache: folder of stored counts, a new one if None."""
    spark, path = docs.sparkSession, tokenizer_path(tokenizer)
    version = tokenizer_version(path)
    cache = cache or new_path(spark, "token-counts")
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    texts = docs.select(F.sha2(text, 256).alias("digest"), text.alias("text"))
    encode_misses(texts, read_cache(spark, cache, version), path, version).write.mode("append").parquet(cache)
    return rows.join(read_cache(spark, cache, version), "digest").select("doc_id", "n_bytes", "n_tokens")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    name = "byte_bpe_50k.json"
    cache = f"{shared_dir(spark)}/token-counts/{tokenizer_version(tokenizer_path(name))}"
    return token_counts(docs, name, cache).withColumn("over_limit", F.col("n_tokens") > LIMIT)
