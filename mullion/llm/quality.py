"""Quality classifier on random-indexing word vectors, with temperature-calibrated probabilities.

Words are runs of letters, digits or other marks, hashed into ``BUCKETS`` rows. Every bucket has a fixed sparse ternary
index vector; the vector of a bucket is the sum of the index vectors of its neighbours, over all documents. A document
is the mean of its words' unit vectors, and a two-layer network, trained on a bounded sample of labelled documents,
gives the probability of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from mullion.llm.common import chunks, fold_of, picked, plain, scramble, span_hashes

BUCKETS = 1 << 14   # rows of the word-vector table: bounds what is broadcast
DIMENSIONS = 64
NONZERO = 4         # of an index vector
REACH = 2           # neighbours on either side
FIT_ROWS = 20_000   # labelled documents a fit takes at most, the first in the order of a hash of their id

_KIND = np.full(256, 3, np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def token_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of one kind of byte, the bytes, run starts and kinds, with the runs before each text last."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = _KIND[data]
    cut = np.flatnonzero(np.diff(kind)) + 1
    starts = np.concatenate(([0], cut))
    ends = np.concatenate((cut, [len(data)]))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return span_hashes(data, starts, ends, lower), data, np.stack((starts, ends)), np.searchsorted(starts, begin)


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Bucket of each run of a text; a run that says the one before it again falls into bucket 0, kept for that."""
    out = (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    out[out == 0] = 1
    out[1:][hashes[1:] == hashes[:-1]] = 0
    return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of the non-zero entries of every bucket's index vector."""
    seed = scramble(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, NONZERO)
    return (seed % np.uint64(DIMENSIONS)).astype(np.int64), np.where(seed >> np.uint64(63) > 0, 1.0, -1.0)


def _encoded(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [v.encode() for v in batch.column(column).to_pylist()]


def word_vectors(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors (BUCKETS x DIMENSIONS) summed over every document; a bucket no word falls into is zero.

    A task adds up its own table and gives it as one row per bucket, so the shuffle holds a table of fixed size per
    task; the sums are whole numbers and do not depend on the order of tasks.
    """
    def gather(batches):
        place, sign = index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            raw = _encoded(batch, 0)
            for lo, hi in chunks(raw, 1 << 20):
                hashes, _, _, before = token_hashes(raw[lo:hi])
                b = buckets(hashes)
                doc = np.repeat(np.arange(hi - lo), np.diff(before))
                for step in range(1, REACH + 1):
                    same = doc[step:] == doc[:-step]
                    left, right = b[:-step][same], b[step:][same]
                    for of, near in ((left, right), (right, left)):
                        for j in range(NONZERO):
                            total += np.bincount(of * DIMENSIONS + place[near, j], sign[near, j], BUCKETS * DIMENSIONS)
        total = total.reshape(BUCKETS, DIMENSIONS).astype(np.int64)
        used = np.flatnonzero(total.any(axis=1))
        for lo in range(0, len(used), 4096):
            part = used[lo:lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[pa.array(total[part, d]) for d in range(DIMENSIONS)]],
                                             names=["bucket", *[f"d{d}" for d in range(DIMENSIONS)]])

    schema = "bucket int, " + ", ".join(f"d{d} bigint" for d in range(DIMENSIONS))
    parts = picked(texts, text=text_col).select(plain(F.col("text")).alias("text")).mapInArrow(gather, schema)
    rows = parts.groupBy("bucket").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMENSIONS)]).toPandas().to_numpy()
    table = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    if len(rows):
        table[rows[:, 0].astype(int)] = rows[:, 1:]
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.where(norm > 0, norm, 1)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text; zeros for one without words."""
    out = np.zeros((len(texts), vectors.shape[1]), np.float32)
    for lo, hi in chunks(texts):
        hashes, _, _, before = token_hashes(texts[lo:hi])
        n = np.diff(before)
        if not len(hashes):
            continue
        full = np.flatnonzero(n)
        out[lo + full] = np.add.reduceat(vectors[buckets(hashes)], before[full]) / n[full, None]
    return out


@dataclass
class Network:
    """Two layers over standardised pooled vectors; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 400, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the temperature is the best one on the last fifth."""
    rng = np.random.default_rng(seed)
    n = len(x)
    if not n:
        return Network(np.zeros(DIMENSIONS), np.ones(DIMENSIONS), np.zeros((DIMENSIONS, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    held = np.arange(n) % 5 == 4
    tx, ty = x[~held].astype(float), y[~held].astype(float)
    mean, scale = tx.mean(axis=0), tx.std(axis=0) + 1e-6
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, 1 / np.sqrt(hidden), hidden), float(np.log((ty.sum() + 1) / (len(ty) - ty.sum() + 1))))
    z = (tx - mean) / scale
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        at = rng.integers(0, len(z), min(len(z), 1024))
        h = np.tanh(z[at] @ weights[0] + weights[1])
        error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3][0], -50, 50))) - ty[at]) / len(at)
        back = np.outer(error, weights[2]) * (1 - h * h)
        for i, g in enumerate((z[at].T @ back + decay * weights[0], back.sum(axis=0), h.T @ error + decay * weights[2], np.array([error.sum()]))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]))
    if held.any():
        logit, truth = net.logits(x[held].astype(float)), y[held]
        options = np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, np.where(truth > 0, -logit, logit) / t)) for t in options]
        net.temperature = float(options[int(np.argmin(loss))])
    return net


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label of at most ``limit`` labelled documents outside fold ``held``, the first in the order of a hash of the id.

    Null labels and ids are left out; a document labelled both ways takes the rounded mean.
    """
    rows = picked(labels, doc_id=id_col, label=label).filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(fold_of(F.col("doc_id"), folds) != held)
    rows = rows.groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label")).orderBy(F.xxhash64(F.col("doc_id").cast("bigint")), "doc_id").limit(limit)
    texts = picked(docs, doc_id=id_col, text=text_col).select("doc_id", plain(F.col("text")).alias("text"))
    return texts.join(F.broadcast(rows), "doc_id")  # at most ``limit`` ids and labels


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", folds: int = 5, held: int = 0, limit: int = FIT_ROWS) -> Network:
    """The network of a bounded sample; only its pooled vectors (``limit`` x DIMENSIONS numbers) reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = pooled(_encoded(part, 1), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2).cast(pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())],
                                                 names=["doc_id", "label", "x"])

    rows = labelled(docs, labels, label, folds, held, limit).select(F.col("doc_id").cast("bigint"), "text", "label").mapInArrow(features, "doc_id bigint, label int, x binary").toPandas()
    rows = rows.sort_values(["doc_id", "x"], kind="stable")
    order = np.argsort(scramble(rows["doc_id"].to_numpy(np.int64).view(np.uint64)), kind="stable")
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, DIMENSIONS)[order] if len(rows) else np.zeros((0, DIMENSIONS), np.float32)
    return train(x, rows["label"].to_numpy()[order])


def scored(docs: DataFrame, vectors: np.ndarray, net: Network, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` (as a struct ``row``), with score and predicted. One pass, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches):
        vectors, net = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [(t or "").encode() for t in pc.struct_field(part.column(0), [text_col]).to_pylist()]
                score = net.probability(pooled(texts, vectors).astype(float))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int"
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Scores depend on the text alone. Null and empty texts have the score of a zero vector, null ids are in fold 0; without
    usable labels every score is that of an untrained network, one half. Rows that repeat an id are scored each.
    """
    rows = picked(docs, doc_id="doc_id", text="text")
    vectors = word_vectors(rows)
    net = fit(rows, labels, vectors, folds=folds, held=held)
    out = scored(rows.select(F.col("doc_id"), plain(F.col("text")).alias("text")), vectors, net, threshold)
    return out.select(F.col("row.doc_id").alias("doc_id"), (fold_of(F.col("row.doc_id"), folds) == held).alias("held_out"), "score", "predicted")
