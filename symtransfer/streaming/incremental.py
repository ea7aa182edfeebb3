"""Matching of entities as they arrive, against a fixed set of targets.

Each batch of a stream is matched on its own, so it keeps no state. The targets' key counts and bands are computed once
and kept over all batches; a lost executor's part of them is computed again from the targets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import TransferConfig
from ..operators.select import meets
from ..plans.frontends import Side, with_sizes
from ..plans.pipeline import match_lsh, prepared


def match_stream(arriving: DataFrame, to_members: Callable[[DataFrame], DataFrame], targets: Side, path: str, checkpoint: str, config: TransferConfig = TransferConfig()) -> StreamingQuery:
    """Starts a query that appends u, t, score of each batch to path. arriving: a stream with entity_id, ord, flags and refs.

    targets: as `prepared` with the same settings gives them, to be let go by the caller once the query has ended; others
    are prepared here and stay with the session.
    """
    right = targets if targets.bands is not None and targets.counts is not None else prepared(targets, config)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        member = to_members(rows).persist()
        try:
            left = Side(with_sizes(rows.select("entity_id", "ord", "flags", "refs"), member), member)
            best = match_lsh(left, right, config).where(meets(config.threshold))
            best.select("u", "t", "score").write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            member.unpersist()
            rows.unpersist()

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
