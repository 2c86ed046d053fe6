"""Language identification with error-correcting output codes.

Each language has a codeword of +1/-1 bits. One binary n-gram classifier per bit is trained on
hashed byte trigrams; a text's bit margins are decoded to the codeword of least weighted loss.

Null text, or text without a letter: ``und``, score 0. Repeated rows: one result each. Empty
table, or no labelled rows to learn from: every row is ``und``. A null doc_id is never learned
from and is not held out. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed trigram classes; the size of a feature row.
DIM = 4096
#: The classifiers are fitted on at most this many labelled rows, shared evenly by the languages.
MAX_TRAIN_ROWS = 1600
#: Up to this many languages, their row counts are sent to all executors; beyond it the join shuffles.
MAX_LANGS_SENT = 10_000
#: Decodings whose two best languages are closer than this in probability are flagged.
MIN_LEAD = 0.1


@dataclass
class EcocModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1/-1
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability and its lead over the second, for feature rows."""
        margins = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margins * c) * self.trust).sum(1) for c in self.code], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        return p.argmax(1), top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of n languages: all splits in two for few languages, else the best of some random codes."""
    if n <= 6:
        bits = [[1 if (s >> i) & 1 else -1 for i in range(n - 1)] + [-1] for s in range(1, 2 ** (n - 1))]
        return np.array(bits, np.float32).reshape(-1, n).T
    rng, best, best_d = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(64):
        m = rng.choice([-1.0, 1.0], (n, length))
        m = m[:, np.abs(m.sum(0)) < n]
        d = ((m.shape[1] - m @ m.T) / 2 + np.eye(n) * length).min()
        if d > best_d:
            best, best_d = m, d
    return best.astype(np.float32)


_LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint32)


def features(texts: pa.Array) -> np.ndarray:
    """A row of hashed byte-trigram frequencies (square roots, unit length) for each whole text."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, text in enumerate(texts):
        b = np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8)
        if b.size < 3:
            b = np.concatenate([b, np.full(3 - b.size, 32, np.uint8)])
        b = _LOWER[b]
        h = (b[:-2] * np.uint32(40503) + b[1:-1] * np.uint32(2654435) + b[2:] * np.uint32(97)) >> np.uint32(3)
        c = np.sqrt(np.bincount(h & np.uint32(DIM - 1), minlength=DIM))
        out[i] = c / np.linalg.norm(c)
    return out


def held_out_mod(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def training_rows(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """A bounded sample (lang, text) of the labelled rows that are not held out.

    Rows come in the order of a hash of doc_id. A threshold on the hash, from the counts of each
    language, leaves a few more rows than are wanted, so the ranking that follows sees only those.
    """
    known = docs.where((held_out_mod(F.col("doc_id")) != 2) & F.col("lang").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = max(1, counts.count())
    each = max(1, max_rows // n_langs)
    share = counts.select("lang", (F.lit(1.5 * each + 20) / F.col("n")).alias("share"))
    if n_langs <= MAX_LANGS_SENT:
        share = F.broadcast(share)
    order = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), 16, 10).cast("double") / 2.0**48
    near = (
        known.where(F.col("text").rlike(r"\p{L}"))
        .select("lang", "doc_id", "text", order.alias("o"))
        .join(share, "lang")
        .where("o < share")
    )
    w = F.row_number().over(_by("lang", "o", "doc_id", F.xxhash64("text")))
    return near.withColumn("r", w).where(F.col("r") <= each).select("lang", "text")


def _by(part: str, *order) -> object:
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(*order)


def train(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, rounds: int = 80) -> EcocModel | None:
    """Fit one logistic classifier per code bit; only fixed-size feature rows reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "x"]
            )

    got = training_rows(docs, max_rows).mapInArrow(rows, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    order = np.lexsort((np.array(got["x"].to_pylist(), dtype=object), np.array(got["lang"].to_pylist())))
    langs = np.array(got["lang"].to_pylist())[order]
    x = np.stack([np.frombuffer(v, np.float16) for v in got["x"].to_pylist()])[order].astype(np.float32)
    names = sorted(set(langs.tolist()))
    code = codewords(len(names))
    y = code[np.searchsorted(names, langs)]
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    step, lead_w = np.float32(24.0), w
    for k in range(rounds):
        g = -y / (1 + np.exp(np.clip(y * (x @ lead_w + b), -30, 30))) / len(x)
        new = lead_w - step * (x.T @ g + np.float32(1e-5) * lead_w)
        lead_w, w = new + np.float32(k / (k + 3)) * (new - w), new
        b = b - np.float32(1.0) * g.sum(0)
    ok = ((x @ w + b) * y > 0).mean(0) if len(names) > 1 else np.ones(code.shape[1])
    return EcocModel(names, code, w, b, np.log((ok + 0.01) / (1.01 - ok)).clip(0.1, 5))


def prediction(text: Column, model: EcocModel | None, min_lead: float = MIN_LEAD) -> Column:
    """Struct (lang_pred, score, ambiguous) of each whole text; only text is an input."""

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pa.Array, lettered: pa.Array) -> pa.Array:
        known = np.array(lettered.to_pylist(), bool)
        if model is None:
            known[:] = False
        pred, score, lead = np.full(len(known), "und", object), np.zeros(len(known)), np.zeros(len(known))
        for at in range(0, len(known), 256):
            some = np.flatnonzero(known[at : at + 256]) + at
            if len(some):
                best, p, ahead = model.decode(features(texts.take(pa.array(some))))
                pred[some], score[some], lead[some] = np.array(model.languages, object)[best], p, ahead
        return pa.StructArray.from_arrays(
            [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(lead < min_lead)],
            ["lang_pred", "score", "ambiguous"],
        )

    return predict(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, model: EcocModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row."""
    return docs.select(
        "doc_id",
        F.coalesce(held_out_mod(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        prediction(F.col("text"), model).alias("p"),
    ).select("doc_id", "held_out", "p.*")


def recognised(docs: DataFrame, model: EcocModel | None) -> DataFrame:
    """The rows of docs whose text has a language: und goes, and so does text for which no language reaches one half."""
    told = docs.select(F.struct(*docs.columns).alias("doc"), prediction(F.col("text"), model).alias("p"))
    return told.where((F.col("p.lang_pred") != "und") & ~(F.col("p.ambiguous") & (F.col("p.score") < 0.5))).select("doc.*")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
