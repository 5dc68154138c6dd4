"""Session settings the library is written for."""

from __future__ import annotations

SETTINGS = {
    # Plans are adapted to measured sizes: joins broadcast only what is small at run
    # time, partitions are sized by data, and skewed join partitions are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Datasets are folders of small files; at this cost a task opens up to 512 of them.
    "spark.sql.files.openCostInBytes": "256k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode. Wide projections
    # run faster operator by operator than as one method that is only interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call-site capture for every column costs more than building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configured(builder):
    """A session builder with the library's settings."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
