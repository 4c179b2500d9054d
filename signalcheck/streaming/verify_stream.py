"""Claim checking on a stream: each micro-batch runs the same resumable step as the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from signalcheck.operators.verify import Check, check_new_claims


def verify_stream(
    claims: DataFrame, verdict_path: str, checkpoint: str, check: Check, available_now: bool = False
) -> StreamingQuery:
    """Check the claims of a streaming frame with a ``claim`` column and append the verdicts.

    A micro-batch that runs again after a failure finds its claims in the verdict table
    and adds nothing, so at-least-once delivery is enough.
    """

    def step(batch: DataFrame, _: int) -> None:
        check_new_claims(batch, verdict_path, check)

    writer = claims.select("claim").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
