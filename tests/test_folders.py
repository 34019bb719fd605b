from pyspark.sql import functions as F

from rankloom.sources import folders

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def sizes(spark):
    def each(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    return spark.range(2000, numPartitions=1).mapInArrow(each, "n long")


def test_stored_sends_few_rows_at_a_time_and_keeps_nothing_in_memory(spark):
    before = spark.conf.get(NAME)
    rows = folders.stored(sizes(spark))
    assert rows.agg(F.max("n")).first()[0] <= folders.BATCH_ROWS and rows.agg(F.sum("n")).first()[0] == 2000
    assert spark.conf.get(NAME) == before and not rows.is_cached


def test_batches_never_raise_a_smaller_setting(spark):
    before = spark.conf.get(NAME)
    spark.conf.set(NAME, "7")
    try:
        with folders.batches(spark):
            assert spark.conf.get(NAME) == "7"
        assert spark.conf.get(NAME) == "7"
    finally:
        spark.conf.set(NAME, before)
