"""Element rows of a stream of pages: an extension, as the language itself is about tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.nodes import Needs, documents, nodes


def page_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", files_per_trigger: int = 100) -> DataFrame:
    """Pages from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_nodes(pages: DataFrame, needs: Needs | None = None) -> DataFrame:
    """The elements of arriving pages; a page is parsed whole, so no state is kept between batches."""
    return nodes(documents(pages), needs)


def write_nodes(stream: DataFrame, path: str, checkpoint: str):
    """Append element rows as Parquet, exactly once, and return the started query."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
