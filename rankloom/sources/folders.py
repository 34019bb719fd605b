"""What queries write and read again: folders, and tables that are built once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. A local session without one, as in tests, gets a temporary
    folder, which goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="rankloom-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = _OWN[0]
    return f"{base.rstrip('/')}/rankloom/{uuid.uuid4().hex}"


#: Rows that a Python worker gets at a time where a row is a text's words: 10,000 of these, Spark's default, are some 60 MB, in both processes, for each task.
BATCH_ROWS = 500


@contextmanager
def batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Actions inside send Python workers at most so many rows at a time; the session's setting is as before after that."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(rows: DataFrame) -> DataFrame:
    """rows, written once and read from there: no executor keeps them in memory."""
    path = work_folder(rows.sparkSession)
    with batches(rows.sparkSession):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
