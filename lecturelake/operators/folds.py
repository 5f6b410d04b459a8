"""Sequential operators: state machines that read each key's rows in order, in memory bounded by the state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: step(state or None, row) gives the next state and the rows it sends on.
Step = Callable[[tuple | None, tuple], tuple[tuple | None, list[tuple]]]


def fold(df: DataFrame, key: str, order: list[str], columns: list[str], step: Step, last: Callable[[tuple], list[tuple]], schema: str) -> DataFrame:
    """Run a state machine over each key's rows in order; last sends on what the final state holds.

    Rows stream through a sorted partition, so a hot key costs time and no memory. Null keys are a key of their own.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []
        for pdf in batches:
            for k, *row in pdf.itertuples(index=False, name=None):
                k = None if pd.isna(k) else k
                if (k,) != now:
                    out += [(now[0], *x) for x in last(state)] if now and state is not None else []
                    now, state = (k,), None
                state, sent = step(state, tuple(row))
                out += [(k, *x) for x in sent]
            yield pd.DataFrame(out, columns=names)
            out = []
        if now and state is not None:
            yield pd.DataFrame([(now[0], *x) for x in last(state)], columns=names)

    return df.select(key, *columns).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def pack_speech(limit: float) -> tuple[Step, Callable[[tuple], list[tuple]]]:
    """Greedy chunks of pieces (start, length) of at most limit in all: sends (start, seconds, pieces); a longer piece is a chunk."""

    def step(state, row):
        start, length = row
        if state is None:
            return (start, length, 1), []
        if state[1] + length > limit:
            return (start, length, 1), [state]
        return (state[0], state[1] + length, state[2] + 1), []

    return step, lambda state: [state]


def annotation_step(ratio: float, active: float, quiet: int) -> Step:
    """Writing on a slide, from rows (id, ink): sends (id, frames) of the last active frame once writing has rested.

    Stable until ink differs from the base by ratio; then writing, until quiet frames in a row change by less than active
    (capture, and the frame becomes the base) or the ink returns to the base. The first frame is the base.
    """

    def step(state, row):
        frame, ink = row
        if state is None:
            return (ink, ink, False, 0, 0, frame), []
        base, before, writing, still, frames, held = state
        far, moved = abs(ink - base) >= ratio, abs(ink - before) >= active
        if not writing or not far:
            return (base, ink, far and not writing, 0, int(far), frame if far else held), []
        still, held = (0, frame) if moved else (still + 1, held)
        if still >= quiet:
            return (ink, ink, False, 0, 0, held), [(held, frames + 1)]
        return (base, ink, True, still, frames + 1, held), []

    return step


def annotation_flush(state: tuple) -> list[tuple]:
    """Writing that is still going on at the end counts up to its last active frame."""
    _, _, writing, _, frames, held = state
    return [(held, frames + 1)] if writing else []


def heartbeat_step(ttl: int) -> tuple[Step, Callable[[tuple], list[tuple]]]:
    """Sessions that heartbeats keep for ttl microseconds, from rows (us,): sends (start, last, heartbeats, expired) of a session
    once it has ended; a heartbeat that comes as the session expires, or later, opens another."""
    over = lambda s: (s[0], s[1], s[2], s[1] + ttl)

    def step(state, row):
        if state is None or row[0] - state[1] >= ttl:
            return (row[0], row[0], 1), ([] if state is None else [over(state)])
        return (state[0], row[0], state[2] + 1), []

    return step, lambda state: [over(state)]
