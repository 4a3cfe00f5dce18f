"""Frames as a stream: each is released once its neighbours have arrived, in whatever order that was."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REACH = 2


def ready_frames(arrivals: DataFrame, reach: int = REACH) -> DataFrame:
    """``sequence, frame_idx`` of frames whose ``reach`` neighbours on either side have arrived, from a stream
    ``sequence string, frame_idx int``. Frames are numbered from 0 and a sequence's first frames have fewer neighbours; its last
    ``reach`` wait for the flush at the end, which a batch job does (`remaining`). A frame that arrives again is not released again.

    State is kept for each sequence: the first frame not yet released and those that arrived at or after ``reach`` before it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        start, held = state.get if state.exists else (0, [])
        have = set(held)
        for pdf in batches:
            have |= {int(i) for i in pdf["frame_idx"].dropna()}
        out = []
        # frames may be released in any order, so all that are complete go now
        released = {i for i in have if i < 0}
        done = {-i - 1 for i in released}
        have -= released
        for i in sorted(have):
            if i >= start and i not in done and all(j in have or j < start - reach for j in range(max(0, i - reach), i + reach + 1)):
                out.append(i)
                done.add(i)
        while start in done:
            done.discard(start)
            start += 1
        state.update((start, sorted(i for i in have if i >= start - reach) + [-i - 1 for i in sorted(done)]))
        yield pd.DataFrame({"sequence": key[0], "frame_idx": pd.array(out, dtype="int32")})

    return arrivals.groupBy("sequence").applyInPandasWithState(step, "sequence string, frame_idx int", "start int, held array<int>", "append", "NoTimeout")


def remaining(arrived: DataFrame, released: DataFrame) -> DataFrame:
    """What a finished sequence still has to release."""
    return arrived.select("sequence", "frame_idx").distinct().join(released, ["sequence", "frame_idx"], "left_anti")


class _Reorder(StatefulProcessor):
    """The state of one sequence: the first frame that isn't linked, how many frames there are, and a row for each frame that has arrived and isn't finished."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "at int, n_frames int")
        self.held = handle.getMapState("held", "frame_idx int", "arrived boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, total = self.place.get() if self.place.exists() else (0, None)
        out = []
        for pdf in rows:
            known = pdf["n_frames"].dropna()
            total = int(known.max()) if len(known) else total
            for i in pdf["frame_idx"].dropna().astype(int):
                # what was linked ``REACH + 2`` frames ago is finished
                if i > at - REACH - 2 and i >= 0 and (total is None or at < total):
                    self.held.updateValue((int(i),), (True,))
        # frames are linked in order, so this ends at the first gap
        while total is None or at < total:
            last = at + REACH if total is None else min(at + REACH, total - 1)
            if not all(self.held.containsKey((i,)) for i in range(max(0, at - REACH), last + 1)):
                break
            out.append((at, "linked"))
            done = at - REACH - 1
            if done >= 0 and (total is None or at < total - REACH - 1):
                out.append((done, "finished"))
                self.held.removeKey((done,))
            at += 1
        if total is not None and at == total:
            rest = sorted(k[0] for k in self.held.keys())
            out += [(i, "finished") for i in rest]
            for i in rest:
                self.held.removeKey((i,))
        self.place.update((at, total))
        text = lambda values: pd.Series(values, dtype=object)
        yield pd.DataFrame({"sequence": text([key[0]] * len(out)), "frame_idx": pd.Series([i for i, _ in out], dtype="int32"), "action": text([a for _, a in out])})

    def close(self) -> None:
        pass


def reorder(arrivals: DataFrame) -> DataFrame:
    """``sequence, frame_idx, action`` of a stream ``sequence string, frame_idx int, n_frames int`` in any order of arrival. A frame is ``linked`` once all before it are and
    its two neighbours on either side have arrived; with it the frame three before is ``finished`` and leaves the state. ``n_frames``, null where it isn't known, says
    where a sequence ends: its last frames have fewer neighbours, and what is left is finished when the last is linked. Frames that arrive again change nothing, nulls neither.

    State is a row for each frame that has arrived and isn't finished, so it grows with the disorder of arrivals only. The session needs the RocksDB state store.
    """
    return arrivals.groupBy("sequence").transformWithStateInPandas(_Reorder(), "sequence string, frame_idx int, action string", "Append", "None")
