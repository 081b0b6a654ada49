"""Generation over files that keep arriving.

The batch job finds its remaining work by an anti-join with its own output;
here the stream's checkpoint remembers which files were done, and the file
sink commits each micro-batch once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.hooks import Generator
from ..plans.inference import generate


def stream_generation(spark: SparkSession, input_dir: str, output: str, checkpoint: str,
                      generator: Generator | None = None, schema: T.StructType = schemas.SFT_INPUT,
                      max_files: int | None = None, available_now: bool = True,
                      **options: object) -> StreamingQuery:
    """Append answers to every new JSON-lines file of `input_dir`.

    `checkpoint` lies in a folder all executors share. With `available_now`
    the query works off what is there and stops.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.json*")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.json(input_dir).withColumn("data_source", F.col("_metadata.file_name"))
    answered = generate(rows.where(F.col("text").isNotNull()), generator, **options)
    writer = (answered.writeStream.format("json").option("path", output)
              .option("checkpointLocation", checkpoint).option("ignoreNullFields", "false")
              .outputMode("append"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
