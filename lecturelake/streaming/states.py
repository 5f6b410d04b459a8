"""State machines over streams: the steps of operators.folds, with a state kept for each key between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Step


def machine(events: DataFrame, key: str, order: list[str], columns: list[str], step: Step, state: str, schema: str) -> DataFrame:
    """Feed each key's rows to a step, in order within a batch (batches are taken to arrive in order); state and schema are DDL.

    A batch holds as many rows of a key as the source's rate limit lets through; columns are the step's row, order may use others.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(group: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now, out = (kept.get if kept.exists else None), []
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for row in rows[columns].itertuples(index=False, name=None):
            now, sent = step(now, row)
            out += [(group[0], *x) for x in sent]
        kept.update(now)
        yield pd.DataFrame(out, columns=names)

    every = [key, *dict.fromkeys([*columns, *order])]
    return events.select(*every).groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)
