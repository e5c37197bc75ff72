"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Each word gives two tokens: the word itself (lower case, outer punctuation off) and its shape (runs of lower case, upper
case, digits and single marks). Uni- and bigrams of both are hashed into ``2**BITS`` buckets (all bigrams of a word with itself share one); a text's feature vector
holds their counts over the square root of its word count, and its score is the logistic of a sparse dot product.

Training draws at most ``fit_rows`` labelled rows (those with the lowest id hash), deals them by hash to up to ``SHARDS``
tasks that each run FTRL-proximal over their share, and averages the shards' weights, so no task or driver holds more
than a bounded sample and a lost executor repeats only its shard.

Defined cases: null and empty texts score the logistic of the bias; repeated rows are scored one by one; an empty
table gives an empty result; without usable labels every score is 0.5; a document with several label rows counts with
its lowest quality; labels other than 0 and 1 are ignored; texts of any length are read whole; extra columns, whatever
their names, are ignored by :func:`score_documents` and pass through :func:`filter_documents`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import batch, draw, map_arrow, ship, texts_of

#: Buckets as a power of two; shards; labelled rows to learn from at most; passes over them.
BITS, SHARDS, FIT_ROWS, EPOCHS = 19, 16, 16384, 3
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.05, 0.5
#: Words a worker remembers the codes of.
MEMORY = 300_000
_MASK = np.uint64((1 << BITS) - 1)
_codes: dict[bytes, int] = {}
_CLASSES = bytes(
    ord("d") if 48 <= i <= 57 else ord("X") if 65 <= i <= 90 else ord("x") if 97 <= i <= 122 or i >= 128 else i for i in range(256)
)
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Fixed value: punctuation taken off a word's ends.
_OUTER = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _shape(word: bytes) -> bytes:
    out = bytearray()
    for c in word.translate(_CLASSES):
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out)


def _code(word: bytes) -> int:
    """Upper half: hash of the bare word; lower half: hash of its shape."""
    return (zlib.crc32(word.translate(_LOWER).strip(_OUTER)) << 32) | zlib.crc32(_shape(word), 1)


def buckets(text: str) -> np.ndarray:
    """The bucket of every n-gram occurrence of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.int64)
    memory = _codes
    if len(memory) > MEMORY:
        memory.clear()
    try:
        codes = [memory[w] for w in words]
    except KeyError:
        for w in words:
            if w not in memory:
                memory[w] = _code(w)
        codes = [memory[w] for w in words]
    c = np.array(codes, np.uint64)
    lex, shape = c >> np.uint64(32), c & np.uint64(0xFFFFFFFF)
    parts = []
    for salt, h in ((1, lex), (2, shape)):
        mix = np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
        parts.append((h + np.uint64(salt)) * mix)
        pair = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] + np.uint64(salt)) * mix
        parts.append(np.where(lex[:-1] == lex[1:], np.uint64(int(mix) * 97 & 0xFFFFFFFFFFFFFFFF), pair))
    return ((np.concatenate(parts) >> np.uint64(40)) & _MASK).astype(np.int64)


def ftrl(texts: list[str], targets: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the bias last) of FTRL-proximal logistic regression, rows in the given order."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = []
    for t in texts:
        b = buckets(t)
        idx, count = np.unique(b, return_counts=True)
        scale = np.sqrt(max(len(b) / 4, 1))
        rows.append((np.append(idx, size - 1), np.append(count / scale, 1.0)))

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) > L1, w, 0.0)

    for _ in range(epochs):
        for (i, x), y in zip(rows, targets, strict=True):
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights learned from labelled documents; ``use`` narrows the label rows (a condition on doc_id)."""
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if use is not None:
        own = own.where(use)
    drawn = draw(own.groupBy("doc_id").agg(F.min("quality").alias("quality")), ["doc_id"], fit_rows)
    shards = max(1, min(SHARDS, drawn.count() // 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(drawn), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def learn(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0]
        order = np.argsort([zlib.crc32(str(i).encode()) for i in group.column("doc_id").to_pylist()], kind="stable")
        group = group.take(pa.array(order))
        w = ftrl(texts_of(group.combine_chunks()), group.column("quality").to_pylist())
        return pa.table({"shard": pa.array([shard.as_py()], pa.int32()), "n": [group.num_rows], "w": [w.astype(np.float32).tobytes()]})

    ship(spark)
    learned = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(learn, "shard int, n long, w binary").collect()
    total = np.zeros((1 << BITS) + 1)
    for r in sorted(learned, key=lambda r: r["shard"]):
        total += np.frombuffer(r["w"], np.float32) * (r["n"] / sum(x["n"] for x in learned))
    return total.astype(np.float32)


def score_text(text: str, weights: np.ndarray) -> float:
    b = buckets(text)
    s = float(weights[-1]) + float(weights[b].sum(dtype=np.float64)) / np.sqrt(max(len(b) / 4, 1))
    return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def score_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        w = shared.value
        for b in batches:
            yield batch(schema, doc_id=b.column("doc_id"), score=[score_text(t, w) for t in texts_of(b)])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def filter_documents(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def keep(batches):
        w = shared.value
        for b in batches:
            yield b.filter(pa.array([score_text(t, w) >= least for t in texts_of(b)], pa.bool_()))

    return map_arrow(docs, keep, docs.schema)
