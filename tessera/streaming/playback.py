"""Playback of sample streams with reference slots, as a stateful operator of Structured Streaming.

A track's state is its cursor and the eight slots. A sample shows a slot or brings a frame that takes the slots of its mask; a sample that
shows an empty slot is a fault and leaves the state as it was. Samples come in order within a track: what isn't after the cursor has
been played and is left out, so replays change nothing. The batch form is operators.sequence.slots(); both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SLOTS = 8
OUT = "track bigint, sample bigint, frame bigint, fault string"


def step(cursor: int, slots: list[int | None], sample: int, shows: bool, idx: int, mask: int) -> tuple[tuple, int, list[int | None]]:
    """The output of one sample (frame, fault), and the state after it."""
    if shows:
        frame = slots[idx]
        return (frame, None if frame is not None else "unsupported"), sample, slots
    return (sample, None), sample, [sample if mask >> i & 1 else held for i, held in enumerate(slots)]


def play(samples: DataFrame, track: str, sample: str) -> DataFrame:
    """track, sample, frame (the sample whose frame is shown) and fault, of a stream with the columns track, sample, shows, idx and mask."""

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor, *held = state.get if state.exists else (-1, *[-1] * SLOTS)
        slots = [None if s < 0 else s for s in held]
        rows = pd.concat(list(batches)).sort_values(sample)
        out = []
        for n, shows, idx, mask in zip(rows[sample].tolist(), rows["shows"].tolist(), rows["idx"].tolist(), rows["mask"].tolist(), strict=True):
            if n > cursor:
                (frame, fault), cursor, slots = step(cursor, slots, n, shows, idx, mask)
                out.append((key[0], n, frame, fault))
        state.update((cursor, *(-1 if s is None else s for s in slots)))
        yield pd.DataFrame(out, columns=["track", "sample", "frame", "fault"]).astype({"frame": "Int64"})

    picked = samples.select(samples[track].alias("track"), sample, "shows", "idx", "mask")
    fields = "cursor bigint, " + ", ".join(f"slot_{i} bigint" for i in range(SLOTS))
    return picked.groupBy("track").applyInPandasWithState(run, OUT, fields, "append", GroupStateTimeout.NoTimeout)


def pair_step(state: tuple, sample: int, colour: tuple, alpha: tuple | None) -> tuple[tuple, tuple]:
    """Output (frame, alpha frame, fault) and state (cursor, colour slots, alpha slots, static alpha) after a colour sample and its alpha.

    Both are stepped on copies and kept only if both succeed. A sample without alpha of its own shows the alpha of the first that had one.
    """
    cursor, slots, alpha_slots, static = state
    (frame, fault), _, new = step(cursor, slots, sample, *colour)
    if alpha is None:
        own, alpha_fault, alpha_new = static, None, alpha_slots
    else:
        (own, alpha_fault), _, alpha_new = step(cursor, alpha_slots, sample, *alpha)
    if fault or alpha_fault:
        return (None, None, fault or alpha_fault), (sample, slots, alpha_slots, static)
    return (frame, own, None), (sample, new, alpha_new, static if static is not None else own)


PAIR_OUT = "track bigint, sample bigint, frame bigint, alpha bigint, fault string"


def play_pairs(samples: DataFrame, track: str, sample: str, streaming: bool | None = None) -> DataFrame:
    """track, sample, frame, alpha and fault of colour samples with alpha: columns shows, idx, mask and alpha_shows, alpha_idx, alpha_mask (null: no
    alpha of its own). The states of colour and alpha are one and change together. Streams keep it from batch to batch; batch tables take a
    track's samples in order, one track a group, since each depends on all before it."""
    names = [sample, "shows", "idx", "mask", "alpha_shows", "alpha_idx", "alpha_mask"]
    picked = samples.select(samples[track].alias("track"), *names)
    fresh = (-1, [None] * SLOTS, [None] * SLOTS, None)

    def fold(key: int, rows: pd.DataFrame, state: tuple) -> tuple[list, tuple]:
        out = []
        for n, shows, idx, mask, a_shows, a_idx, a_mask in rows.sort_values(sample)[names].astype(object).itertuples(index=False):
            if n > state[0]:
                shown, state = pair_step(state, n, (shows, idx, mask), None if pd.isna(a_shows) else (bool(a_shows), int(a_idx), int(a_mask)))
                out.append((key, n, *shown))
        return out, state

    def frame_of(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["track", "sample", "frame", "alpha", "fault"]).astype({"frame": "Int64", "alpha": "Int64"})

    if not (samples.isStreaming if streaming is None else streaming):
        return picked.groupBy("track").applyInPandas(lambda key, rows: frame_of(fold(key[0], rows, fresh)[0]), PAIR_OUT)

    def run(key: tuple, batches: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = fresh
        if held.exists:
            cursor, *rest = held.get
            rest = [None if v < 0 else v for v in rest]
            state = (cursor, rest[:SLOTS], rest[SLOTS : 2 * SLOTS], rest[-1])
        out, (cursor, slots, alpha_slots, static) = fold(key[0], pd.concat(list(batches)), state)
        held.update((cursor, *(-1 if v is None else v for v in (*slots, *alpha_slots, static))))
        yield frame_of(out)

    fields = "cursor bigint, " + ", ".join(f"{k}_{i} bigint" for k in ("slot", "alpha") for i in range(SLOTS)) + ", static_alpha bigint"
    return picked.groupBy("track").applyInPandasWithState(run, PAIR_OUT, fields, "append", GroupStateTimeout.NoTimeout)
