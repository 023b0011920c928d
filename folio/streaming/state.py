"""One way to run a small step function per key: over a stream, or over a sorted table.

``step(state, row) -> (state, outputs)`` with ``state`` a plain dict that fits in JSON. The
stream keeps it in the state store; the batch twin carries it along sorted partitions, so a
key of any length needs memory for one record batch only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from folio.session import shuffle_partitions

Step = Callable[[dict, object], tuple[dict, tuple]]


def stream(df: DataFrame, key: str, order: str, keep: list[str], step: Step, init: dict, out: str, columns: list[str], idle_ms: int | None = None) -> DataFrame:
    """``key``, ``keep`` and the step's ``columns`` (schema ``out``) for each row of a stream.

    Rows of one micro-batch are put in order before they are stepped; keys are independent.
    With ``idle_ms`` the state of a key that has had no rows for so long (processing time) is
    removed, so the store of a stream that runs on holds live keys only. Such a stream looks
    for idle keys for ever and so suits a processing-time trigger, not ``availableNow``.
    """
    names = [key, *keep, *columns]

    def run(group, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        s = json.loads(state.get[0]) if state.exists else dict(init)
        rows = pd.concat(list(batches)).sort_values(order)  # one micro-batch of one key
        res = []
        for r in rows.itertuples(index=False):
            s, o = step(s, r)
            res.append((group[0], *[getattr(r, c) for c in keep], *o))
        state.update((json.dumps(s),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(res, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, out, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def batch(df: DataFrame, key: str, order: str, keep: list[str], step: Step, init: dict, out: str, columns: list[str]) -> DataFrame:
    """The same over a table: keys side by side in sorted partitions, state carried from batch to batch."""
    names = [key, *keep, *columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, s = None, dict(init)
        for pdf in batches:
            res = []
            for r in pdf.itertuples(index=False):
                k = getattr(r, key)
                if k != current:
                    current, s = k, dict(init)
                s, o = step(s, r)
                res.append((k, *[getattr(r, c) for c in keep], *o))
            yield pd.DataFrame(res, columns=names)

    d = df.repartition(shuffle_partitions(df.sparkSession), key).sortWithinPartitions(key, order)
    return d.mapInPandas(run, out)
