"""Utterances from packets: a keyed state machine that opens at the first transcript and closes on silence, on length or at the end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values of the recorder.
THRESHOLD, SILENT_PACKETS, LONGEST_SECONDS, PACKET_SECONDS, INTERRUPTION_PACKETS = 100.0, 5, 20.0, 0.192, 3
OUT = "call_id string, utterance_id string, text string, n_packets int, has_interruptions boolean, reason string, started double, ended double"
_STATE = "buffer array<string>, silent int, packets int, started double, n int, other_run int, interrupted boolean, last double"
_EMPTY = ([], 0, 0, -1.0, 0, 0, False, -1.0)


def _merge(buffer: list[str], text: str) -> bool:
    """Adds a partial transcript to the buffer; False where it says nothing new."""
    text = text.strip()
    if not text or (buffer and buffer[-1].startswith(text)):
        return False
    if buffer and text.startswith(buffer[-1]):
        buffer[-1] = text
    else:
        buffer.append(text)
    return True


def step(call: str, state: tuple, rows: Iterator[tuple[float, float, float, str | None]]) -> tuple[tuple, list[tuple]]:
    """Feeds rows (time, level, other level, partial transcript or None) in order to the state; returns the new state and the utterances that closed.

    A level at the threshold is neither speech nor silence and ends a run of silence. A text that changes the buffer ends it as well. Speech of the other side in
    INTERRUPTION_PACKETS packets on end while the utterance is open marks it.
    """
    buffer, silent, packets, started, n, other_run, interrupted, last = list(state[0]), *state[1:]
    out = []
    for time, level, other, text in rows:
        last = time
        if text and _merge(buffer, text):
            silent = 0
            if started < 0:
                started = time
        if started < 0:
            continue
        packets += 1
        silent = silent + 1 if level < THRESHOLD and not text else 0 if level >= THRESHOLD else silent
        other_run = other_run + 1 if other > THRESHOLD else 0
        interrupted = interrupted or other_run >= INTERRUPTION_PACKETS
        reason = "silence" if silent >= SILENT_PACKETS else "length" if time - started >= LONGEST_SECONDS else ""
        if reason:
            out.append((call, f"{call}:{n + 1}", " ".join(buffer), packets, interrupted, reason, started, time))
            buffer, silent, packets, started, n, other_run, interrupted = [], 0, 0, -1.0, n + 1, 0, False
    return (buffer, silent, packets, started, n, other_run, interrupted, last), out


def _close(call: str, state: tuple) -> list[tuple]:
    buffer, _, packets, started, n, _, interrupted, last = state
    return [(call, f"{call}:{n + 1}", " ".join(buffer), packets, interrupted, "end", started, last)] if started >= 0 else []


_COLUMNS = [c.strip().split(" ")[0] for c in OUT.split(",")]


def utterances_stream(packets: DataFrame, idle_seconds: int = 60) -> DataFrame:
    """Streaming: packets (call_id, ts timestamp, level, other_level, transcript) with a watermark on ts; a call without packets for idle_seconds is closed."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else _EMPTY
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(_close(key[0], held), columns=_COLUMNS)
            return
        frame = pd.concat(list(frames)).sort_values("ts", kind="stable")
        rows = zip(frame["ts"].astype("int64") / 1e9, frame["level"], frame["other_level"], frame["transcript"])
        held, out = step(key[0], held, rows)
        state.update(held)
        state.setTimeoutTimestamp(max(int(held[7] * 1000), state.getCurrentWatermarkMs()) + idle_seconds * 1000)
        yield pd.DataFrame(out, columns=_COLUMNS)

    return packets.groupBy("call_id").applyInPandasWithState(run, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def utterances(packets: DataFrame) -> DataFrame:
    """Batch twin: all packets of each call in order of time, the last utterance closed at the end. A call is one conversation, which bounds its group."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable")
        rows = zip(pd.to_datetime(frame["ts"]).astype("datetime64[ns]").astype("int64") / 1e9, frame["level"], frame["other_level"], frame["transcript"])
        held, out = step(key[0], _EMPTY, rows)
        return pd.DataFrame(out + _close(key[0], held), columns=_COLUMNS)

    return packets.groupBy("call_id").applyInPandas(run, OUT)
