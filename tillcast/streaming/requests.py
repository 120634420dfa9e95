"""Lookup requests as a stream.

Requests arrive as files instead of calls to a service. The lookups are joins with a published table
without state, so no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tillcast.schema import MERCHANT
from tillcast.sources.tables import read_published

Lookup = Callable[[DataFrame, DataFrame], DataFrame]


def read_requests(
    spark: SparkSession, folder: str, files_per_batch: int | None = None, more: str = ""
) -> DataFrame:
    """Stream of requests: JSON lines with a merchant id, and the fields that ``more`` declares."""
    reader = spark.readStream.schema(", ".join(x for x in (f"{MERCHANT} STRING", more) if x))
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def write_answers(answers: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Answer what is there and stop; run again for what has come since.

    ``answers`` is a lookup of a stream in a table, which every batch reads as a whole.
    """
    return (
        answers.writeStream.format("json")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def answer_batch(
    batch: DataFrame, batch_id: int, published: str, look_up: Lookup, folder: str
) -> None:
    """Write the answers of one batch to ``folder/batch=<id>``, whatever an earlier attempt left there.

    Only the files of the published table in which a merchant of the batch may lie are read.
    """
    spark = batch.sparkSession
    batch = batch.persist()  # read twice: for the files, and for the answers
    try:
        table = read_published(spark, published, batch)
        look_up(batch, table).write.mode("overwrite").json(f"{folder.rstrip('/')}/batch={batch_id}")
    finally:
        batch.unpersist()


def answer_requests(
    requests: DataFrame, published: str, look_up: Lookup, folder: str, checkpoint: str
) -> StreamingQuery:
    """Answer a stream of requests from a published table, batch by batch, and stop when all are answered.

    ``look_up`` is ``lookup_offers`` or ``lookup_forecasts``. A batch that is repeated after a failure
    has the same number and so replaces what it wrote; answers are there once.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        answer_batch(batch, batch_id, published, look_up, folder)

    return (
        requests.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
