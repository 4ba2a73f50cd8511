"""Streaming ingest of declarations: stateless tokenising of new files, appended to a table.

Frequencies, postings and translations need whole-corpus sums, so a build runs over the
appended table; the stream does the work that is per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lexicon import with_words
from ..schemas import DECLARATION


def declarations(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of declarations from JSON lines that appear in ``folder``."""
    return spark.readStream.schema(DECLARATION).option("maxFilesPerTrigger", files_a_batch).json(folder)


def append_words(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append tokenised declarations to a Parquet table; each batch is written once, also after a restart."""
    rows = with_words(stream.withColumn("decl_id", F.xxhash64("module", "name", "line", "provenance")))
    writer = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
