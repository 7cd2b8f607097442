"""The row-wise operators on a stream of files: they hold no state, so the batch plans run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import lines
from quillmill.plans import pipeline
from quillmill.sources import reader
from quillmill.streaming import status


def clean_stream(spark: SparkSession, folder: str, merge: pipeline.MergeOptions = pipeline.MergeOptions(), post: pipeline.PostProcess = pipeline.PostProcess(), longest: int = reader.LONGEST) -> DataFrame:
    """A streaming DataFrame of the processed lines of files as they arrive in ``folder``. The stream finds the files by name; a file that cannot be read by then, or is longer
    than ``longest`` bytes, is a row with an error and without lines."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    # only the path is asked for, so the content is not read here
    arrived = spark.readStream.format("binaryFile").schema(schema).load(folder).select("path")
    text = status.read_requests(arrived, longest).withColumn("lines", lines.to_lines(F.col("text"))).drop("text")
    return pipeline.process(text, merge, post, charset=F.col("charset"))
