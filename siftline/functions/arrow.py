"""Bounds of what a Python worker holds of its input at once."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to BATCH_ROWS and BATCH_BYTES."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"[^0-9-]", "", spark.conf.get(key)))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
