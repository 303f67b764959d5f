"""Server-sent events of a body that arrives in pieces.

A piece can end anywhere, within an event or between the two line feeds that
end one. What is left of the last event waits in keyed state, so a piece is
read once and no body is ever put together. Nothing comes after [DONE].
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHUNKS = "stream_id string, place int, chunk string"


def chunk_of(payload: str) -> str | None:
    """The `chunk` of an event's JSON as text; None if it is invalid or has none. Numbers stand as they were written."""
    try:
        data = json.loads(payload, parse_int=str, parse_float=str)
    except ValueError:
        return None
    chunk = data.get("chunk") if isinstance(data, dict) else None
    return chunk if chunk is None or isinstance(chunk, str) else json.dumps(chunk, ensure_ascii=False, separators=(",", ":"))


@dataclass
class Parser:
    tail: str = ""
    place: int = 0
    over: bool = False

    def take(self, piece: str | None) -> Iterator[tuple[int, str]]:
        """(place, chunk) of the events that a piece ends."""
        if self.over or not piece:
            return
        *events, self.tail = (self.tail + piece).split("\n\n")
        for event in events:
            if event == "data: [DONE]":
                self.tail, self.over = "", True
                return
            if event.startswith("data: ") and (chunk := chunk_of(event[6:])) is not None:
                yield self.place, chunk
            self.place += 1


class SseProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("parser", "tail string, place int, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parser = Parser(*self.state.get()) if self.state.exists() else Parser()
        pieces = sorted((r for frame in rows for r in zip(frame["seq"].tolist(), frame["piece"].tolist())), key=lambda r: r[0])
        out = [(key[0], *x) for _, piece in pieces for x in parser.take(piece)]
        self.state.update((parser.tail, parser.place, parser.over))
        yield pd.DataFrame(out, columns=["stream_id", "place", "chunk"])

    def close(self) -> None:
        pass


def parse_stream(pieces: DataFrame) -> DataFrame:
    """(stream_id, place, chunk) of streamed pieces (stream_id, seq, piece), in order of seq; equal to parse_sse of whole bodies."""
    rows = pieces.select("stream_id", F.col("seq").cast("long").alias("seq"), "piece")
    return rows.groupBy("stream_id").transformWithStateInPandas(SseProcessor(), CHUNKS, "append", "none")
