"""Session settings every plan in this package relies on, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Runtime settings that change results or plans; all may be set on a live session.
RUNTIME_CONF = {
    # Version keys and reporting dates are derived from timestamps, so the zone is pinned.
    "spark.sql.session.timeZone": "UTC",
    # The last of two equal JSON keys wins, as in common JSON parsers.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Skewed join keys are split at run time; small sides are broadcast from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM never compiles methods above 8,000 bytes; wide steps run one by one instead of in one such method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Ids of a small batch are looked up in the ledger by value (see operators.ledger).
    "spark.sql.parquet.pushdown.inFilterThreshold": "256",
    # Skewed write partitions are split as well (see sinks.bronze).
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "lossledger", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the package settings; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


#: Removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside removes its shuffle files when it is stored; later steps start from what is stored."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder the cluster names in `spark.checkpoint.dir`.

    Only a session without that setting (a local test) gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="lossledger-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when `path` (or any match of a glob) exists on its file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = fs.globStatus(hadoop_path)
    return matches is not None and len(matches) > 0
