"""The packer as a stream: keyed state for each slot, exactly once through Spark's checkpoints.

Windows arrive in micro-batches; a slot's state is the buffer that isn't full yet, on the state store. A full buffer is packed by first fit
decreasing, as in the batch operator, and its sequences leave with the buffer's number, so batch and stream give equal rows. What is
left at the end leaves when a row marked `flush` arrives, never by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators.packing import BUFFER, first_fit

OUT = "slot int, buffer_idx long, doc_pos long, seq_idx int, place int"


class BufferPacker(StatefulProcessor):
    def __init__(self, length: int, size: int = BUFFER):
        self.length, self.size = length, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "doc_pos long, n int")
        self.done = handle.getValueState("done", "buffers long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buffer = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        number = self.done.get()[0] if self.done.exists() else 0
        fresh, flush = [], False
        for part in rows:
            flush |= bool(part["flush"].any())
            own = part[~part["flush"]]
            fresh += list(zip(own["doc_pos"].tolist(), own["n_tokens"].tolist(), strict=True))
        out = []
        for item in sorted(fresh):
            buffer.append(item)
            if len(buffer) == self.size:
                out += self._pack(key[0], number, buffer)
                buffer, number = [], number + 1
        if flush and buffer:
            out += self._pack(key[0], number, buffer)
            buffer, number = [], number + 1
        if buffer:
            self.waiting.put(buffer)
        elif self.waiting.exists():
            self.waiting.clear()
        self.done.update((number,))
        yield pd.DataFrame(out, columns=["slot", "buffer_idx", "doc_pos", "seq_idx", "place"]).astype({"slot": "int32", "seq_idx": "int32", "place": "int32"})

    def _pack(self, slot: int, number: int, buffer: list) -> list[tuple]:
        rows = sorted(buffer, key=lambda r: (-r[1], r[0]))
        filled: dict[int, int] = {}
        out = []
        for (pos, _), seq in zip(rows, first_fit([min(n, self.length) for _, n in rows], self.length), strict=True):
            out.append((slot, number, pos, seq, filled.get(seq, 0)))
            filled[seq] = filled.get(seq, 0) + 1
        return out

    def close(self) -> None:
        pass


def pack_stream(windows: DataFrame, length: int, size: int = BUFFER) -> DataFrame:
    """Places (slot, buffer_idx, doc_pos, seq_idx, place) of a stream of windows (slot, doc_pos, n_tokens, flush). A slot's windows must arrive in order of
    doc_pos across micro-batches. Needs the RocksDB state store."""
    slim = windows.select("slot", "doc_pos", "n_tokens", "flush")
    return slim.groupBy("slot").transformWithStateInPandas(BufferPacker(length, size), OUT, outputMode="Append", timeMode="None")
