"""An index that grows with a stream of documents, and a watermarked history. Beyond what the batch operators need; the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.functions import text as T
from rankloom.operators.segments import FAN, Segments


def documents(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def index_stream(docs: DataFrame, path: str, checkpoint: str, cfg: T.Tokenizing = T.Tokenizing(), fan: int = FAN) -> StreamingQuery:
    """Each micro-batch becomes a segment of the index at path (operators.segments), merged in levels; newer documents replace those of the same id.

    A batch that is run again, after a failure, is in the log already and adds nothing. Of an id that a batch has twice, one document stays.
    """
    segments = Segments(docs.sparkSession, path, fan)

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("doc_id").cast("string").alias("doc_id"), "text").dropDuplicates(["doc_id"])
        segments.append(rows.select("doc_id", T.tokenize(F.col("text"), cfg).alias("tokens")), checkpoint, number)

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
