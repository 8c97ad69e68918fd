"""Session settings the plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The share and feature projections are wide.  A generated method over 8000
# bytes of bytecode is never compiled by the JVM; with this limit Spark splits
# such a stage into smaller methods, which runs them two to three times faster.
#
# Rows wait in the JVM, and their arguments in Python, for as long as a task
# function works on their Arrow batch.  10,000 rows, the default, can be
# whole documents, so a batch is bounded in bytes as well.
RECOMMENDED = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def apply(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark
