"""Topics, labels and text cuts on a streaming table.

The rule, label and cut expressions are stateless projections, so a stream
goes through the same code as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from thresher.operators.rules import topic_labels, with_topics


def stream_topics(stream: DataFrame, rules) -> DataFrame:
    """Adds ``text`` and ``label`` to a stream of numeric rows."""
    return topic_labels(with_topics(stream, rules))


def write_topics(stream: DataFrame, rules, path: str, checkpoint: str,
                 available_now: bool = False) -> StreamingQuery:
    """Appends labelled rows to a parquet table; exactly once, by the file sink's log."""
    writer = (stream_topics(stream, rules).writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
