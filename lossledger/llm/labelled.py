"""The bounded sample of labelled documents that the two classifiers learn from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.llm.features import ROUND_ROWS, rounds, text_features


def held_out(column: str = "doc_id") -> F.Column:
    """True for the third of ids whose labels are never learned from; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def labelled_features(
    docs: DataFrame, labels: DataFrame, limit: int, dims: int, with_shapes: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of at most `limit` labelled documents, in an order by hash.

    Only labels outside the held-out third with both an id and a quality of 0 or 1 are used;
    a document with several rows counts once for each label it has.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("i"), F.col("quality").cast("int").alias("y"))
        .where("i is not null and y in (0, 1)")
        .where(~held_out("i"))
        .distinct()
        .orderBy(F.xxhash64("i"), "i", "y")
        .limit(limit)
    )
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("i"), "text")
        .join(F.broadcast(chosen), "i")  # at most `limit` rows
        .groupBy("i", "y")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )

    def count(batches):
        for batch in batches:
            for part in rounds(batch, rows=ROUND_ROWS):
                x = text_features(part.column("text"), dims, with_shapes).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("i"), part.column("y"), pa.array([v.tobytes() for v in x], pa.binary())], ["i", "y", "x"]
                )

    # Bounded: `limit` vectors of fixed length.
    rows = sorted(texts.mapInArrow(count, "i long, y int, x binary").collect(), key=lambda r: (r.i, r.y))
    width = 2 * dims + (512 if with_shapes else 0)
    x = np.array([np.frombuffer(r.x, np.float16) for r in rows], dtype=np.float32).reshape(len(rows), width)
    return x, np.array([r.y for r in rows], dtype=np.float64)
