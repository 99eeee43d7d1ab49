"""A replay with late labels, held in the state store of a stream.

Events are scores, labels and ticks of lines. A line's state says where it stands: pointer, cycle
and run number; the counts of its open windows; scores that wait for their label, and labels that
came before their score. A label that hasn't come when the watermark passes its score's time is
missing for good, so what waits is bounded by the lateness. A window is given out once it is full
and no row of it waits. A query that is started again with the same checkpoint goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultline.operators.joins import require

OUT = "line string, run_seq long, cycle_id long, window long, rows long, labelled long, tp long, fp long, fn long, tn long"
STATE = "pointer long, cycle long, runs long, opened binary, waiting binary, early binary"
_COUNTS = ["rows", "labelled", "tp", "fp", "fn", "tn"]
_OPENED = {"run_seq": "int64", "cycle_id": "int64", "window": "int64", "need": "int64", **dict.fromkeys(_COUNTS, "int64")}
_WAITING = {"id": "int64", "run_seq": "int64", "flagged": "bool", "at": "int64"}
_EARLY = {"id": "int64", "response": "int64", "at": "int64"}


def _frame(blob: bytes | None, types: dict[str, str]) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_pandas() if blob else pd.DataFrame({c: pd.Series([], dtype=t) for c, t in types.items()})


def _blob(frame: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


class Line:
    """One line's state and what events do to it; a window is named by its run number."""

    def __init__(self, held: tuple | None, width: int, cycle_rows: int, threshold: int) -> None:
        self.pointer, self.cycle, self.runs = held[:3] if held else (0, 0, 0)
        self.opened, self.waiting, self.early = (_frame(held[k] if held else None, t) for k, t in ((3, _OPENED), (4, _WAITING), (5, _EARLY)))
        self.width, self.cycle_rows, self.threshold = width, cycle_rows, threshold
        self.in_cycle = -(-cycle_rows // width)  # windows of a cycle; the last may be shorter

    def add(self, events: pd.DataFrame) -> None:
        """Scores take the next places, in the order of seq; labels wait for their scores. Of several labels of an id the first counts."""
        scores = events[events["kind"] == "score"].sort_values(["seq", "id"])
        place = self.cycle * self.cycle_rows + self.pointer + pd.Series(range(len(scores)), index=scores.index, dtype="int64")
        cycle, inside = place // self.cycle_rows, place % self.cycle_rows
        run = cycle * self.in_cycle + inside // self.width
        end = self.cycle * self.cycle_rows + self.pointer + len(scores)
        self.cycle, self.pointer = end // self.cycle_rows, end % self.cycle_rows
        new = pd.DataFrame({"run_seq": run, "cycle_id": cycle, "window": inside // self.width}).drop_duplicates()
        new = new[~new["run_seq"].isin(self.opened["run_seq"])]
        need = (self.cycle_rows - new["window"] * self.width).clip(upper=self.width)
        self.runs = max(self.runs, int(run.max()) + 1) if len(run) else self.runs
        self.opened = pd.concat([self.opened, new.assign(need=need, **dict.fromkeys(_COUNTS, 0))]).astype(_OPENED)
        counted = run.value_counts()
        self.opened["rows"] += self.opened["run_seq"].map(counted).fillna(0).astype("int64")
        waits = pd.DataFrame({"id": scores["id"], "run_seq": run, "flagged": scores["q"] >= self.threshold, "at": scores["ts"].astype("datetime64[ms]").astype("int64")})
        self.waiting = pd.concat([self.waiting, waits]).astype(_WAITING)
        labels = events[events["kind"] == "label"].sort_values(["seq", "id"])
        came = pd.DataFrame({"id": labels["id"], "response": labels["response"], "at": labels["ts"].astype("datetime64[ms]").astype("int64")})
        self.early = pd.concat([self.early, came]).astype(_EARLY).drop_duplicates("id")

    def settle(self, watermark: int) -> pd.DataFrame:
        """Counts what has met its label, and gives up what is older than the watermark; the windows that are done."""
        both = self.waiting.merge(self.early[["id", "response"]], "left", "id")
        met = both[both["response"].notna()]
        y, d = met["response"] == 1, met["flagged"]
        for name, mask in (("labelled", y | ~y), ("tp", y & d), ("fp", ~y & d), ("fn", y & ~d), ("tn", ~y & ~d)):
            self.opened[name] += self.opened["run_seq"].map(met.loc[mask, "run_seq"].value_counts()).fillna(0).astype("int64")
        left = both[both["response"].isna() & (both["at"] >= watermark)]
        self.waiting = left[list(_WAITING)].astype(_WAITING)
        self.early = self.early[~self.early["id"].isin(met["id"]) & (self.early["at"] >= watermark)]
        done = (self.opened["rows"] == self.opened["need"]) & ~self.opened["run_seq"].isin(self.waiting["run_seq"])
        out, self.opened = self.opened[done].sort_values("run_seq"), self.opened[~done]
        return out

    @property
    def state(self) -> tuple:
        return self.pointer, self.cycle, self.runs, _blob(self.opened), _blob(self.waiting), _blob(self.early)

    @property
    def oldest(self) -> int | None:
        at = pd.concat([self.waiting["at"], self.early["at"]])
        return int(at.min()) if len(at) else None


def label_replay(events: DataFrame, *, width: int, cycle_rows: int, threshold: int = 6000, late: str = "2 hours") -> DataFrame:
    """A row for each window of `width` scores of a line (fewer at the end of a cycle of `cycle_rows`), once its labels have come or are too late.

    events: a stream of line, seq, kind (score, label or tick), id, q, response and ts. Ticks
    only move the time on. Scores of a line count in the order in which they come, those of one
    micro-batch in the order of seq. Rows without a line are left out; a null score isn't flagged.
    """
    require(events, "line", "seq", "kind", "id", "q", "response", "ts")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line = Line(tuple(state.get) if state.exists else None, width, cycle_rows, threshold)
        came = list(frames)  # a line's events of one micro-batch, which maxFilesPerTrigger bounds; they count in the order of all of them
        if came:
            line.add(pd.concat(came))
        watermark = state.getCurrentWatermarkMs()
        done = line.settle(watermark)
        state.update(line.state)
        if line.oldest is not None:
            state.setTimeoutTimestamp(max(line.oldest, watermark) + 1)
        if len(done):
            yield done.assign(line=key[0])[["line", "run_seq", "cycle_id", "window", *_COUNTS]]

    timed = events.where("line IS NOT NULL").select("line", "seq", "kind", "id", "q", "response", "ts").withWatermark("ts", late)
    return timed.groupBy("line").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
