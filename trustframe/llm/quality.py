"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's features are hashed counts of its word shapes and words and a few ratios. A truncated singular value
decomposition, fitted on a bounded balanced sample of labelled rows, maps them to ``LATENT`` dimensions. The labelled
vectors (a few thousand at most) are broadcast; every document is compared with all of them by blocked matrix
products, and its ``NEIGHBOURS`` most similar ones vote with the similarity as weight.

Defined cases: NULL and empty texts have only the bias feature and are scored like others; nothing learned: score
0; a document labelled twice has the smaller label; ties between neighbours go to the smaller row of the sample.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm.common import bounded_sample, remainder
from trustframe.session import cut_lineage, load_table

#: Labelled rows of either class that are broadcast.
SAMPLE = 1500
NEIGHBOURS = 25
LATENT = 48
SHAPES, WORDS, RATIOS = 256, 1024, 8
WIDTH = SHAPES + WORDS + RATIOS
BLOCK = 256
#: Weights of the three groups of features before the decomposition.
GROUP_WEIGHTS = (1.0, 0.4, 1.0)
MOST_KEPT = 400_000
THRESHOLD = 0.3
RUNS = re.compile(r"(.)\1+")


class _Codes(dict):
    """chunk -> shape bucket * WORDS + word bucket."""

    def __missing__(self, chunk: str) -> int:
        if len(self) > MOST_KEPT:
            self.clear()
        shape = RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in chunk))
        value = xxhash.xxh32_intdigest(shape) % SHAPES * WORDS + xxhash.xxh32_intdigest(chunk.lower()) % WORDS
        self[chunk] = value
        return value


_CODES = _Codes()


def _unit(x: np.ndarray) -> np.ndarray:
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else x


def features(text: str | None) -> np.ndarray:
    """Feature vector of a whole text."""
    out = np.zeros(WIDTH, np.float32)
    chunks = (text or "").split()
    out[-1] = 1.0
    if not chunks:
        return out
    n = len(chunks)
    codes = np.fromiter(map(_CODES.__getitem__, chunks), np.int64, n)
    out[:SHAPES] = GROUP_WEIGHTS[0] * _unit(np.sqrt(np.bincount(codes // WORDS, minlength=SHAPES)))
    out[SHAPES : SHAPES + WORDS] = GROUP_WEIGHTS[1] * _unit(np.log1p(np.bincount(codes % WORDS, minlength=WORDS)))
    lines = [x for x in text.split("\n") if x]
    spaces = n - 1
    ratios = (
        float((codes[1:] == codes[:-1]).mean()) if spaces else 0.0,
        len(np.unique(codes)) / n,
        len(set(lines)) / max(1, len(lines)),
        min(1.0, len(text) / n / 20),
        min(1.0, math.log1p(n) / 10),
        sum(map(str.isupper, chunks)) / n,
        sum(not c.isalnum() for c in chunks) / n,
    )
    out[SHAPES + WORDS : -1] = np.array(ratios, np.float32) * GROUP_WEIGHTS[2]
    return out


def labelled_vectors(docs: DataFrame, labels: DataFrame, keep) -> DataFrame:
    """(doc_id, quality, f) of about ``SAMPLE`` labelled documents of either class."""
    best = labels.where(F.col("quality").isin(0, 1) & keep).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(best, "quality", SAMPLE, ["doc_id"])
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # two times SAMPLE rows

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "quality"]].assign(f=[features(t).tobytes() for t in pdf["text"]])

    return cut_lineage(texts.mapInPandas(measure, "doc_id long, quality int, f binary"))


def fit(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projection (features, LATENT), labelled unit vectors, their labels."""
    pdf = vectors.toPandas().sort_values(["doc_id", "quality", "f"])
    x = np.frombuffer(b"".join(pdf["f"]), np.float32).reshape(len(pdf), WIDTH).astype(np.float64)
    values, basis = np.linalg.eigh(x.T @ x)
    basis = basis[:, np.argsort(values)[::-1][:LATENT]]
    z = x @ basis
    return basis, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12), pdf["quality"].to_numpy(float)


def vote(x: np.ndarray, basis: np.ndarray, known: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors, for a block of feature rows."""
    z = x @ basis
    near = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)) @ known.T
    k = min(NEIGHBOURS, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(near, top, axis=1).min(axis=1)
    # where more vectors than k reach the k-th similarity, the smaller rows come first
    for row in np.flatnonzero((near >= least[:, None]).sum(axis=1) > k):
        top[row] = np.argsort(-near[row], kind="stable")[:k]
    weights = np.maximum(np.take_along_axis(near, top, axis=1), 1e-6) ** 8
    return (weights * labels[top]).sum(axis=1) / weights.sum(axis=1)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, held_out, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis, known, labels = shared.value
        for pdf in batches:
            texts, score = pdf["text"].tolist(), np.zeros(len(pdf))
            for at in range(0, len(texts) if len(labels) else 0, BLOCK):
                rows = np.stack([features(t) for t in texts[at : at + BLOCK]]).astype(np.float64)
                score[at : at + BLOCK] = vote(rows, basis, known, labels)
            yield pdf[["doc_id", "held_out"]].assign(score=np.clip(score, 0.0, 1.0))

    return docs.mapInPandas(measure, "doc_id long, held_out boolean, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from those whose id has another remainder than 0."""
    docs, labels = load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels")
    rest = remainder(F.col("doc_id"), 5)
    vectors = labelled_vectors(docs, labels, rest != 0)
    scored = score_documents(docs.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "text"), fit(vectors))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
