"""The chain over streams of documents.

Detection, normalisation and cutting within a document are stateless and run on a stream as they
are.  What needs a whole document (numbering, context, merging) runs on each micro-batch, which
holds whole documents because a file is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import NormalizeConfig
from ..operators.normalize import normalize


def blocks_stream(docs: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    """A stream of blocks from a stream of docs; no state."""
    return normalize(docs, config)


def run_stream(docs: DataFrame, chain, sink: Callable[[DataFrame, int], None], *, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``chain`` (anything with run(docs)) on every micro-batch and hand the result to ``sink``.

    The sink gets the batch's number, so that writing it again after a failure replaces it."""

    def batch(frame: DataFrame, number: int) -> None:
        frame = frame.persist()
        try:
            sink(chain.run(frame), number)
        finally:
            frame.unpersist()

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch in a folder of its own, replaced if it is written again."""

    def sink(frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink
