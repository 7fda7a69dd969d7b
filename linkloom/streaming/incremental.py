"""Candidates for S1 records that arrive in a stream, against a reference that lies still.

Each micro-batch runs the blocker over its own records and the whole reference side, which the blocker prepares anew. So a
stream finds, in the end, the pairs that one batch over all of its records finds, as long as what makes a token rare is
the reference side alone. Late and repeated records are joined
like any other; a watermark on the caller's side may drop repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def stream_candidates(arrivals: DataFrame, ref: DataFrame, blocker: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """arrivals: a streaming DataFrame of S1 records; ref: the others; sink: gets each batch's edges and number."""

    def batch(records: DataFrame, number: int) -> None:
        sink(blocker(records.unionByName(ref.select(*records.columns))), number)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
