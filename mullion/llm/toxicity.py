"""Toxicity classifier that a swap of identity terms leaves nearly unmoved."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mullion.llm.common import chunks, fold_of, picked, plain, span_hashes
from mullion.llm.quality import labelled, token_hashes
from mullion.runtime import cut

BUCKETS = 1 << 16    # rows of the weight table, words and word beginnings together: bounds what is broadcast
SELECTED = 4096      # buckets a fit may give a weight
FIT_ROWS = 20_000    # labelled documents a fit takes at most
STEM = 4             # bytes of a word's beginning

# Identity terms; a term is swapped for others of its own line.
IDENTITY_TERMS = """
women men girls boys mothers fathers
woman man girl boy
gay straight lesbian bisexual transgender queer
black white asian latino hispanic african european
muslim christian jewish hindu buddhist atheist catholic
muslims christians jews hindus buddhists atheists catholics
immigrant refugee foreigner citizen
deaf blind disabled autistic
frauen männer mädchen jungen
muslime christen juden hindus atheisten
femmes hommes filles garçons
musulmans chrétiens juifs athées
mujeres hombres niñas niños
musulmanes cristianos judíos ateos
"""


def _hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    return span_hashes(data, ends - [len(r) for r in raw], ends)


def identity_table() -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted hashes of the identity terms, the hashes of the other terms of the line of each, and beginnings likewise ordered."""
    words, others = [], []
    for line in IDENTITY_TERMS.strip().splitlines():
        terms = line.split()
        for t in terms:
            words.append(t)
            others.append([o for o in terms if o != t])
    hashes = _hash(words)
    order = np.argsort(hashes)
    stems = _hash([w.encode()[:STEM].decode(errors="ignore") for w in words])
    stem_of = dict(zip(hashes.tolist(), stems.tolist()))
    return hashes[order], [_hash(others[i]) for i in order], np.array([stem_of[h] for h in hashes[order].tolist()], np.uint64)


def _word_bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(49)).astype(np.int64)


def _stem_bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(49)).astype(np.int64) + BUCKETS // 2


def features(texts: list[bytes]):
    """Per text: word hashes (in lower case, repeated) and the distinct buckets of its words and word beginnings."""
    for lo, hi in chunks(texts):
        hashes, data, spans, before = token_hashes(texts[lo:hi], lower=True)
        stems = span_hashes(data, spans[0], np.minimum(spans[1], spans[0] + STEM)) if len(hashes) else hashes
        words, roots = _word_bucket(hashes), _stem_bucket(stems)
        for a, b in zip(before[:-1], before[1:]):
            yield hashes[a:b], np.unique(np.concatenate((words[a:b], roots[a:b])))


@dataclass
class Model:
    weight: np.ndarray
    bias: float


def train(rows: list[np.ndarray], y: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], size: int, fairness: float = 20.0,
          ridge: float = 1e-5, rounds: int = 500, rate: float = 0.02) -> Model:
    """Logistic regression on presence of features, with ``fairness`` times the mean squared change of the logit under swaps added.

    Features enter scaled by the log ratio of their shares in the two labels, so a rare feature of one label only counts at once.
    ``swaps``: per counterfactual sentence, the features the swap takes away and those it brings. Full-batch Adam.
    """
    if not len(rows):
        return Model(np.zeros(size), 0.0)
    lengths = np.array([len(r) for r in rows])
    flat, doc = np.concatenate(rows) if lengths.sum() else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), lengths)
    lost = np.concatenate([s[0] for s in swaps]) if swaps else np.zeros(0, np.int64)
    won = np.concatenate([s[1] for s in swaps]) if swaps else np.zeros(0, np.int64)
    of_lost = np.repeat(np.arange(len(swaps)), [len(s[0]) for s in swaps]).astype(int)
    of_won = np.repeat(np.arange(len(swaps)), [len(s[1]) for s in swaps]).astype(int)
    share = (y.sum() + 1) / (len(y) + 2)
    k, n = np.bincount(flat, y[doc], size), np.bincount(flat, minlength=size)
    scale = np.log((k + 0.5) / (y.sum() + 1) / ((n - k + 0.5) / (len(y) - y.sum() + 1)))
    u, b = np.zeros(size), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, rounds + 1):
        w = scale * u
        logit = np.bincount(doc, w[flat], len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / len(rows)
        g, gb = np.bincount(flat, error[doc], size), error.sum()
        if swaps:
            change = (np.bincount(of_won, w[won], len(swaps)) - np.bincount(of_lost, w[lost], len(swaps))) * (2 * fairness / len(swaps))
            g += np.bincount(won, change[of_won], size) - np.bincount(lost, change[of_lost], size)
        g = scale * g + ridge * u
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        u -= rate * m / c1 / (np.sqrt(v / c2) + 1e-8)
        b -= rate * mb / c1 / (np.sqrt(vb / c2) + 1e-8)
    return Model(scale * u, b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, limit: int = FIT_ROWS, fairness: float = 20.0) -> Model:
    """Weights of the buckets that tell the labels apart most, from a bounded sample of labelled documents.

    Bucket counts by label are summed on Spark; the driver gets the ``SELECTED`` buckets of largest z-score and, of every
    document of the sample, those it has. In sampled documents with identity terms each term is swapped for another of
    its line; the buckets that change are kept beside the selected ones, so the penalty reaches every one.
    """
    def parts(batches):
        known, others, stems = identity_table()
        other_stems = dict(zip(known.tolist(), stems.tolist()))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                names = part.column(0).to_pylist()
                rows, gone, come = [], [], []
                for name, (hashes, has) in zip(names, features([t.encode() for t in part.column(1).to_pylist()])):
                    at = np.searchsorted(known, hashes)
                    met = np.unique(at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == hashes)])
                    new = np.array([others[i][(name + i) % len(others[i])] for i in met], np.uint64)
                    out = np.unique(np.concatenate((_word_bucket(known[met]), _stem_bucket(stems[met])))) if len(met) else np.zeros(0, np.int64)
                    into = np.unique(np.concatenate((_word_bucket(new), _stem_bucket(np.array([other_stems[h] for h in new.tolist()], np.uint64))))) if len(met) else out
                    rows.append(has)
                    gone.append(np.setdiff1d(out, into))
                    come.append(np.setdiff1d(np.setdiff1d(into, out), has))
                lists = [pa.array([r.tolist() for r in x], pa.list_(pa.int32())) for x in (rows, gone, come)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), *lists], names=["doc_id", "label", "has", "gone", "come"])

    sample = labelled(docs, labels, label, folds, held, limit).select(F.col("doc_id").cast("bigint"), "text", "label")
    sample = cut(sample.mapInArrow(parts, "doc_id bigint, label int, has array<int>, gone array<int>, come array<int>"))
    n, positive = sample.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return Model(np.zeros(BUCKETS), 0.0)
    counts = sample.select(F.explode("has").alias("bucket"), "label").groupBy("bucket").agg(F.count("label").alias("n"), F.sum("label").alias("k"))
    p, q = (F.col("k") + 0.5) / (positive + 1), (F.col("n") - F.col("k") + 0.5) / (n - positive + 1)
    z = F.abs(F.log(p / q)) / F.sqrt(1 / (F.col("k") + 0.5) + 1 / (F.col("n") - F.col("k") + 0.5))
    best = [r.bucket for r in counts.orderBy(z.desc(), "bucket").limit(SELECTED).collect()]
    known, _, stems = identity_table()
    chosen = np.unique(np.concatenate((np.array(best, np.int64), _word_bucket(known), _stem_bucket(stems))))
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def narrowed(batches):
        keep = shared.value
        for batch in batches:
            lists = []
            for c in ("has", "gone", "come"):
                lists.append(pa.array([np.intersect1d(np.array(x, np.int64), keep).astype(np.int32).tobytes() for x in batch.column(c).to_pylist()], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "label", "has", "gone", "come"])

    rows = sample.mapInArrow(narrowed, "doc_id bigint, label int, has binary, gone binary, come binary").toPandas().sort_values(["doc_id", "has"])
    place = lambda raw: np.searchsorted(chosen, np.frombuffer(raw, np.int32))
    swaps = [(place(g), place(c)) for g, c in zip(rows["gone"], rows["come"]) if g or c]
    small = train([place(x) for x in rows["has"]], rows["label"].to_numpy(float), swaps, len(chosen), fairness)
    weight = np.zeros(BUCKETS)
    weight[chosen] = small.weight
    return Model(weight, small.bias)


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    """Probability of label 1 of each text; one without words has that of the bias."""
    out = np.array([model.weight[has].sum() for _, has in features(texts)] + [0.0])[:len(texts)] + model.bias
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Scores depend on the text alone, read whole. Null and empty texts score as a text without words; null ids are in fold
    0; without usable labels every score is one half. Rows that repeat an id are scored each. Nothing is shuffled but counts.
    """
    rows = picked(docs, doc_id="doc_id", text="text").select("doc_id", plain(F.col("text")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, folds=folds, held=held))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                score = scores([t.encode() for t in part.column(1).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = rows.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")
