"""Early stopping over a stream of losses: the state of a key is its running best, not its history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def early_stop_stream(losses: DataFrame, key: str, order: str, loss: str, patience: int, min_delta: float = 1e-4) -> DataFrame:
    """(key, best_loss, stopped_at, n) of the keys of each micro-batch, to be written in update mode.

    The same fold as ``operators.stats.early_stop``: a loss improves under best - min_delta, and ``patience`` losses in a row that don't
    end a key; stopped_at is their number until then (0 before). A key's losses come in order over the batches, in any
    order within one; rows that aren't after the last one seen, or have no loss, are left out.
    """

    def fold(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, bad, n, stop, last = state.get if state.exists else (float("inf"), 0, 0, 0, None)
        rows = pd.concat(parts).dropna().sort_values("at")
        for at, x in zip(rows["at"].tolist(), rows["loss"].tolist(), strict=True):
            if last is not None and at <= last:
                continue
            last, n = at, n + 1
            if not stop:
                better = x < best - min_delta
                best, bad = (x, 0) if better else (best, bad + 1)
                stop = n if bad >= patience else 0
        state.update((best, bad, n, stop, last))
        yield pd.DataFrame({key: [name[0]], "best_loss": [best], "stopped_at": [stop], "n": [n]})

    rows = losses.select(F.col(key), F.col(order).cast("long").alias("at"), F.col(loss).cast("double").alias("loss"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(
        fold, f"{key} {kind}, best_loss double, stopped_at int, n int", "best double, bad int, n int, stop int, last long", "update", GroupStateTimeout.NoTimeout
    )
