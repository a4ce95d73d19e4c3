"""Quality of documents by a vote of their nearest labelled neighbours in a latent space.

Hashed features of a bounded sample of labelled documents are reduced to latent-semantic
vectors. Sample, projection and labels are broadcast (their size is fixed by the parameters),
and every document is compared with the whole sample in exact blocked cosine products.

Defined results: a null text counts as empty; an empty text, and one without any similarity to
the sample, gets the sample's share of label 1; without labelled rows every score is 0.5.
Each row is scored by its text alone, so repeated rows and null ids keep their place; other
columns are carried along by `score` and may have any name but those it adds.
An empty table gives no rows; a text is scored whole, however long, one task holding it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lossledger.llm.features import ROUND_ROWS, rounds, text_features
from lossledger.llm.labelled import held_out, labelled_features

#: Labelled documents to learn from, at most.
SAMPLE = 4096
#: Hash buckets of each feature block, latent dimensions, neighbours that vote.
DIMS, LATENT, NEIGHBOURS = 1024, 48, 15
#: Directions beyond `LATENT` that subspace iteration carries along, and its rounds.
EXTRA, ROUNDS = 16, 12


@dataclass(frozen=True)
class Neighbours:
    """Latent vectors of labelled documents, and how to get such vectors for others."""

    weights: np.ndarray  # inverse document frequencies in the sample
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.latent(x * self.weights)

    def latent(self, weighted: np.ndarray) -> np.ndarray:
        z = weighted @ self.basis
        length = np.linalg.norm(z, axis=1, keepdims=True)
        return np.where(length > 1e-9, z / np.maximum(length, 1e-9), 0).astype(np.float32)

    def scores(self, column: pa.Array) -> np.ndarray:
        x = text_features(column, DIMS, with_shapes=True)
        if not len(self.vectors):
            return np.full(len(x), self.prior)
        sims = np.round((self.project(x) @ self.vectors.T).astype(np.float64), 6)
        k = min(NEIGHBOURS, sims.shape[1])
        # Everything as near as the k-th neighbour votes, so ties need no order.
        edge = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k, None]
        votes = np.where(sims >= edge, np.maximum(sims, 0), 0)
        total = votes.sum(axis=1)
        share = (votes @ self.labels) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 1e-9, share, self.prior), 0, 1)


def leading_directions(x: np.ndarray, count: int) -> np.ndarray:
    """Orthonormal columns spanning the directions in which the rows of `x` are largest, largest first.

    Subspace iteration from a fixed start; it holds some thin matrices and never x' x.
    """
    wide = min(count + EXTRA, x.shape[1])
    span = np.random.default_rng(0).standard_normal((x.shape[1], wide), dtype=np.float32)
    for _ in range(ROUNDS):
        span = np.linalg.qr(x.T @ (x @ span))[0]
    seen = (x @ span).astype(np.float64)
    turn = np.linalg.eigh(seen.T @ seen)[1][:, ::-1][:, :count]
    return np.ascontiguousarray(span @ turn.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Neighbours:
    """Latent-semantic vectors of at most `sample` labelled documents."""
    x, y = labelled_features(docs, labels, sample, DIMS, with_shapes=True)
    width = 2 * DIMS + 512
    if not len(x):
        return Neighbours(np.ones(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    weights[2 * DIMS :] *= 2  # shapes are few; without this the vocabulary hides them
    x *= weights  # in place, as the sample is the largest thing the driver holds
    model = Neighbours(weights, leading_directions(x, LATENT), np.zeros((0, 1), np.float32), y, float(y.mean()))
    return Neighbours(weights, model.basis, model.latent(x), y, model.prior)


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (0 or 1, at 0.5)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # fixed size: SAMPLE * LATENT and features * LATENT numbers
    names = docs.columns
    schema = StructType(docs.schema.fields + [StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        model = sent.value
        for batch in batches:
            for part in rounds(batch, rows=ROUND_ROWS):
                s = model.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"]
                )

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return score(inner, fit(docs, labels)).where("predicted = 1").select("doc.*")
