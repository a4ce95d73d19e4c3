"""Tables, row identities and stored intermediate results shared by the operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossledger.session import shared_dir

#: Removes the shuffle files of a query when it ends; stored results don't need them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Text held by one task of a shuffle by document, in bytes.
TASK_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A runtime setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """Stored intermediate results of one operator call, in the shared folder.

    Each result is a Parquet table, so lineage ends there and a lost executor costs only the
    tasks it ran. Shuffle files go when the result is written; `drop` frees a table that no
    later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, shared_dir(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with setting(self.spark, CLEANUP, "true"):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def bucketed(self, df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
        """Stored in buckets of `key`, sorted by it: joins on `key` between such tables don't shuffle."""
        path, title = self.path(name), f"{name}_{uuid.uuid4().hex}"
        with setting(self.spark, CLEANUP, "true"):
            writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
            writer.bucketBy(buckets, key).sortBy(key).saveAsTable(title)
        out = self.spark.table(title)
        out._stored_at, out._title = path, title
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete stored results that this object wrote."""
        for df in tables:
            if hasattr(df, "_title"):
                self.spark.sql(f"DROP TABLE IF EXISTS `{df._title}`")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def size_hint(df: DataFrame) -> int:
    """Bytes that Spark's statistics give for a frame; for a file scan the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_for(df: DataFrame, per_task: int = TASK_BYTES) -> int:
    """Tasks for a shuffle of whole texts: one for each `per_task` bytes of the input files."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, -(-size_hint(df) // per_task)))


def identified(scratch: Scratch, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, ord, text, *keep): `row` is unique, `ord` is the document's id, null ids last of all.

    Where ids are unique they serve as rows. Otherwise (repeated or null ids) the rows are
    stored once with numbers of their own, so that every later step sees the same numbers.
    """
    ids = F.col("doc_id").cast("long")
    body = [F.coalesce(F.col("text"), F.lit("")).alias("text"), *(F.col(c).alias(f"kept_{c}") for c in keep)]
    odd = docs.select(ids.alias("i")).groupBy("i").count().where("i is null or count > 1").limit(1)
    if not odd.take(1):
        return docs.select(ids.alias("row"), ids.alias("ord"), *body)
    last = F.lit((1 << 63) - 1)
    return scratch.store(
        docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(ids, last).alias("ord"), *body), "rows"
    )


def public_id(column: str = "ord") -> F.Column:
    """The document id back from `ord` of `identified`."""
    last = F.lit((1 << 63) - 1)
    return F.when(F.col(column) == last, F.lit(None)).otherwise(F.col(column)).cast("long")
