"""What a query stores leaves no shuffle files behind."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from lossledger.fixtures import queries
from lossledger.operators.stored_events import StoredEvents
from lossledger.plans import incremental
from lossledger.session import shuffles_removed
from lossledger.sinks.tables import write_table


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.length()))
    return {n for n in names if n.startswith("shuffle_")}


def left_by(spark, step) -> set[str]:
    before = shuffle_files(spark)
    step()
    for _ in range(40):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.25)
    return left


def test_stored_tables_leave_no_shuffle_files(spark, lake):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("event_id"), (F.col("id") % 7).alias("k"))
    dealt = rows.repartition(3, "event_id")
    assert left_by(spark, lambda: dealt.write.format("noop").mode("overwrite").save())
    steps = {
        "table": lambda: write_table(dealt, lake, "run", "silver", "t"),
        "events": lambda: StoredEvents.store(dealt),
        "batch": lambda: incremental._kept(dealt),
        "ids": lambda: queries._kept(rows.select("k").distinct()),
    }
    assert {name: left_by(spark, step) for name, step in steps.items()} == dict.fromkeys(steps, set())


def test_the_setting_is_as_before_after_a_write(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with shuffles_removed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before
