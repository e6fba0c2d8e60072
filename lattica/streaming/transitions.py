"""Task status as a stream: transition events in, accepted steps and promotions out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lattica.operators.tasks import STATUS_STEPS

OUT = "id string, seq long, old_status string, new_status string, accepted boolean"


def apply_events(events: DataFrame) -> DataFrame:
    """A streaming (id, seq, status) frame to one row for each event: whether the step was
    legal from the node's status at that time. Status lives in the state store, keyed by
    node, so a restart goes on where it stopped. Events of a batch apply in seq order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else ""
        rows = []
        for e in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            ok = e.status in STATUS_STEPS.get(now, ())
            rows.append((key[0], int(e.seq), now, e.status if ok else now, ok))
            now = e.status if ok else now
        state.update((now,))
        yield pd.DataFrame(rows, columns=["id", "seq", "old_status", "new_status", "accepted"])

    return events.groupBy("id").applyInPandasWithState(step, OUT, "status string", "append", GroupStateTimeout.NoTimeout)


def degree_counts(edges: DataFrame) -> DataFrame:
    """A streaming (src, dst) frame to running (id, out_degree) counts, in update mode."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
