"""Pool records that arrive as a stream, matched against a standing index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from samewise.functions.normalize import prepare
from samewise.operators.blocking import block, prune


def candidates_of_stream(stream: DataFrame, index: DataFrame, out: str, checkpoint: str, k: int = 7, max_df: float = 0.3, margin: float = 0.7, max_rank: int = 8) -> StreamingQuery:
    """Append the candidates of each micro-batch of pool records to the Parquet table ``out``.

    The records are prepared as they come. A batch is written under its number, so a batch that is run again
    after a failure replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = prune(block(index, prepare(batch), k, max_df=max_df), margin, 0.0, max_rank)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
