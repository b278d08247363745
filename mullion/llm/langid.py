"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts counts the distinct n-grams of 1 to ``LONGEST`` letters that both hold,
divided by the root of the product of their own counts. Landmark texts of every language span a Nyström approximation of
it; kernel ridge regression, one language against the rest, is solved there on a bounded sample of labelled documents.
Scoring a batch of texts is one product of its text-by-gram incidence with the gram-by-landmark incidence, and one of the
normalised kernel rows with the regression's coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mullion.llm.common import fold_of, picked, plain, scramble
from mullion.runtime import cut

LONGEST = 4         # letters of the longest n-gram
LANDMARKS = 96      # landmark texts, of all languages together; four of each language at least
TYPICAL = 2000      # grams of the documents that are taken for landmarks first
FIT_ROWS = 4000     # labelled documents a fit takes, an equal share of each language; 8 of each at least
RIDGE = 1e-3
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Of every code point whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def letter_runs(text: str) -> np.ndarray:
    """Code points in lower case with every run of other marks as one space, before the first and after the last letter too; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    real = _letters()[points]
    if not real.any():
        return np.zeros(0, np.uint32)
    points = np.concatenate((np.uint32([32]), np.where(real, points, np.uint32(32)), np.uint32([32])))
    space = points == 32
    return points[~(space & np.concatenate(([False], space[:-1])))]


def grams(text: str, longest: int = LONGEST) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams of 1 to ``longest`` marks."""
    points = letter_runs(text).astype(np.uint64)
    parts, run = [], np.zeros(len(points), np.uint64)
    for n in range(1, longest + 1):
        if len(points) < n:
            break
        run = run[:len(points) - n + 1] * _BASE + points[n - 1:] + np.uint64(n)
        parts.append(run)
    return np.unique(scramble(np.concatenate(parts))) if parts else np.zeros(0, np.uint64)


@dataclass
class Model:
    """``vocabulary``: the landmarks' grams; ``incidence``: gram by landmark; ``root``: of each landmark's own count."""

    languages: list
    vocabulary: np.ndarray
    incidence: np.ndarray
    root: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    sharpness: float = 1.0

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel of each gram set with each landmark."""
        out = np.zeros((len(sets), len(self.root)), np.float32)
        for lo in range(0, len(sets), 64):
            some = sets[lo:lo + 64]
            size = np.array([len(s) for s in some])
            flat, of = np.concatenate(some), np.repeat(np.arange(len(some)), size)
            at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == flat
            present = np.zeros((len(some), len(self.vocabulary)), np.float32)
            present[of[hit], at[hit]] = 1
            out[lo:lo + 64] = present @ self.incidence / (self.root * np.sqrt(np.maximum(size, 1))[:, None])
        return out

    def probability(self, sets: list[np.ndarray]) -> np.ndarray:
        """Of each language; a row adds up to one."""
        value = (self.kernel(sets) @ self.weight + self.bias) * self.sharpness
        value = np.exp(value - value.max(axis=1, keepdims=True))
        return value / value.sum(axis=1, keepdims=True)


def spanned_by(landmarks: list[np.ndarray], languages: list) -> Model:
    """The landmarks' kernel, with no language told apart yet."""
    vocabulary = np.unique(np.concatenate(landmarks))
    incidence = np.zeros((len(vocabulary), len(landmarks)), np.float32)
    for j, s in enumerate(landmarks):
        incidence[np.searchsorted(vocabulary, s), j] = 1
    root = np.sqrt(np.array([len(s) for s in landmarks], np.float32))
    return Model(languages, vocabulary, incidence, root, np.zeros((len(landmarks), len(languages))), np.zeros(len(languages)))


def train(model: Model, kernel: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression of the sample's kernel rows, on Nyström features; every language weighs the same.

    The regression's values become probabilities with the sharpness that suits the fifth of the sample left out of a first fit.
    """
    languages, incidence, root = model.languages, model.incidence, model.root
    value, vector = np.linalg.eigh((incidence.T @ incidence / np.outer(root, root)).astype(float))
    keep = value > 1e-6 * value.max()
    to_features = vector[:, keep] / np.sqrt(value[keep])
    kernel = kernel.astype(float)
    phi, target = kernel @ to_features, np.eye(len(languages))[y]

    def solve(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = np.bincount(y[rows], minlength=len(languages))
        w = 1 / np.maximum(many, 1)[y[rows]]
        x = np.concatenate((phi[rows], np.ones((len(rows), 1))), axis=1)
        penalty = ridge * w.sum() * np.diag(np.append(np.ones(x.shape[1] - 1), 1e-6))
        beta = np.linalg.solve(x.T @ (x * w[:, None]) + penalty, x.T @ (target[rows] * w[:, None]))
        return to_features @ beta[:-1], beta[-1]

    every = np.arange(len(kernel))
    held = every % 5 == 4
    if held.any() and (~held).any():
        weight, bias = solve(every[~held])
        out = kernel[held] @ weight + bias
        loss = []
        options = np.geomspace(1, 64, 25)
        for s in options:
            z = out * s
            z = z - z.max(axis=1, keepdims=True)
            loss.append(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), y[held]]))
        model.sharpness = float(options[int(np.argmin(loss))])
    model.weight, model.bias = solve(every)
    return model


def sample(docs: DataFrame, folds: int, held: int, limit: int) -> tuple[list, DataFrame]:
    """The learned languages, and (doc_id, lang, text) of an equal share of each: the first in the order of a hash of the id.

    An id or text in two languages counts for the lesser one; of rows that share id and language, the least text stands.
    """
    usable = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(fold_of(F.col("doc_id"), folds) != held)
    names = usable.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    counts = names.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    languages = [r["lang"] for r in counts]
    share = max(8, limit // max(1, len(languages)))
    # Hashes below a bound that lets four times the share through; only those of a language meet in its window.
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(1 << 40))
    bounds = docs.sparkSession.createDataFrame([(r["lang"], (1 << 40) * min(1.0, 4 * share / r["n"])) for r in counts], "lang string, bound double")
    few = names.join(bounds, "lang").withColumn("at", at).filter(F.col("at") < F.col("bound"))
    chosen = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))).filter(F.col("rank") <= share)
    chosen = chosen.select("doc_id", "lang")
    if share * len(languages) <= 1 << 18:  # rows; only thousands of languages pass it
        chosen = F.broadcast(chosen)
    return languages, usable.join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, folds: int = 3, held: int = 1, limit: int = FIT_ROWS, landmarks: int = LANDMARKS, longest: int = LONGEST) -> Model | None:
    """The model of a bounded sample, or None when no document has a language and a letter.

    The landmarks of a language are its documents of the sample nearest to TYPICAL grams. The driver gets their grams and one
    kernel row of each document of the sample.
    """
    languages, texts = sample(docs, folds, held, limit)
    if not languages:
        return None

    def to_grams(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sets = [grams(t, longest) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["doc_id", "lang", "size", "grams"])

    sets = cut(texts.select(F.col("doc_id").cast("bigint"), "lang", "text").mapInArrow(to_grams, "doc_id bigint, lang string, size bigint, grams binary")).filter("size > 0")
    near = Window.partitionBy("lang").orderBy(F.abs(F.col("size") - TYPICAL), "doc_id")
    each = max(4, landmarks // len(languages))
    marks = sets.withColumn("at", F.row_number().over(near)).filter(F.col("at") <= each).select("doc_id", "lang", "grams").toPandas().sort_values(["lang", "doc_id"])
    if not len(marks):
        return None
    model = spanned_by([np.frombuffer(g, np.uint64) for g in marks["grams"]], languages)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def to_kernel(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = shared.value.kernel([np.frombuffer(g, np.uint64) for g in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "lang", "kernel"])

    rows = sets.select("doc_id", "lang", "grams").mapInArrow(to_kernel, "doc_id bigint, lang string, kernel binary").toPandas().sort_values(["doc_id", "lang"])
    rows = rows.iloc[np.argsort(scramble(rows["doc_id"].to_numpy(np.int64).view(np.uint64)), kind="stable")]
    place = {v: i for i, v in enumerate(languages)}
    return train(model, np.frombuffer(b"".join(rows["kernel"]), np.float32).reshape(len(rows), -1), rows["lang"].map(place).to_numpy())


def identify(docs: DataFrame, folds: int = 3, held: int = 1, limit: int = FIT_ROWS, landmarks: int = LANDMARKS, longest: int = LONGEST) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    A prediction depends on the whole text alone, and score is its probability. Null texts and texts without a letter are
    ``und`` with score 0, and so is every text when nothing can be learned. Null ids are in fold 0 and not learned from; rows
    that repeat an id are predicted each. Of equal scores the language first in order is taken. Ids and languages are shuffled once, texts of the sample only.
    """
    rows = picked(docs, doc_id="doc_id", text="text", lang="lang").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, folds, held, limit, landmarks, longest))

    def run(batches):
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [grams(t, longest) for t in part.column(1).to_pylist()]
                name, score = np.full(len(sets), "und", object), np.zeros(len(sets))
                full = np.flatnonzero([len(s) > 0 for s in sets])
                if model is not None and len(full):
                    p = model.probability([sets[i] for i in full])
                    name[full] = np.array(model.languages, object)[p.argmax(axis=1)]
                    score[full] = p.max(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = rows.select("doc_id", plain(F.col("text")).alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
