"""Re-evaluation of a plan for each micro-batch of new charges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from orbweave.plans.engine import Fmm


def evaluate_stream(plan: Fmm, charges: DataFrame, sink: Callable[[DataFrame, int], None], changes: bool = False, trigger: dict | None = None, **options) -> StreamingQuery:
    """Starts a query over a stream of charges (gid, q, ...); results go to ``sink(results, batch)``, which should be idempotent for a
    batch number. A micro-batch replaces all the plan's charges, or with ``changes`` those of its gids alone, the latest in a batch by
    its order being undefined: a gid should occur once in it. ``changes`` start from ``plan`` again when the query is restarted.
    ``trigger`` is what Structured Streaming takes, by default all that is there (availableNow)."""
    now = [plan]

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        if changes:
            now[0] = now[0].change_charges(batch)
        sink((now[0] if changes else plan.attach_charges_unordered(batch)).evaluate(), number)

    writer = charges.writeStream.foreachBatch(each)
    for name, value in options.items():
        writer = writer.option(name, value)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
