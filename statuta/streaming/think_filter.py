"""Filters `<think>` blocks out of streams of model chunks.

What is emitted depends on where chunks end, so chunks of a stream are taken
in order: until a block has ended, text is held back; a text of more than FLUSH
characters without a block passes; after that all passes. Over a finished table
this is a fold of native functions, of which only the held text is state. Over
a stream it is a small machine in keyed state (chunks ordered by their number
within a trigger), with a timer for streams that never say they are done.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from statuta.functions.text import strip
from statuta.options import DEFAULTS

OPEN, CLOSE, FLUSH = "<think>", "</think>", DEFAULTS.think_flush_chars
EMITTED, ANSWERED = "stream_id string, seq long, chunk string", "stream_id string, answer string, ended string"


def decode(line: str | None) -> tuple[str, bool] | None:
    """(content, done) of a line; None for blank and invalid ones."""
    try:
        data = json.loads(line) if line else None
    except ValueError:
        return None
    if not isinstance(data, dict):
        return None
    message = data.get("message") or {}
    content = message.get("content") if isinstance(message, dict) else None
    return (content if isinstance(content, str) else ""), bool(data.get("done"))


@dataclass
class Machine:
    held: str = ""
    passing: bool = False
    over: bool = False

    def take(self, content: str) -> str:
        """What to emit now."""
        if self.passing:
            return content
        self.held += content
        if CLOSE in self.held:
            out = self.held.partition(CLOSE)[2]
        elif OPEN not in self.held and len(self.held) > FLUSH:
            out = self.held
        else:
            return ""
        self.held, self.passing = "", True
        return out

    def end(self) -> str:
        """What to emit at the end of the stream."""
        held, self.held, self.over = self.held, "", True
        if OPEN not in held:
            return held
        rest = held.partition(OPEN)[2]
        return rest if rest.strip() else ""

    def lines(self, rows: Iterable[tuple[int, str | None]]) -> Iterator[tuple[int, str]]:
        for seq, line in rows:
            if self.over or (found := decode(line)) is None:
                continue
            out = self.take(found[0])
            if out:
                yield seq, out
            if found[1]:
                if out := self.end():
                    yield seq, out


def decoded(line: Column) -> Column:
    """struct<ok, content, done> of a line: not ok if it is blank or no JSON object, done if its `done` is true in Python's sense."""
    data = F.try_parse_json(line)
    content, done = (F.try_variant_get(data, path, "variant") for path in ("$.message.content", "$.done"))
    text, flag = F.try_variant_get(data, "$.message.content", "string"), F.try_variant_get(data, "$.done", "string")
    kind = F.schema_of_variant(done)
    said = F.when(kind == "BOOLEAN", flag == "true").when(kind == "STRING", flag != "").when(kind.rlike("^(ARRAY|OBJECT)"), ~flag.isin("[]", "{}")).when(kind == "VOID", False).otherwise(flag.try_cast("double") != 0)
    ok = F.coalesce(F.schema_of_variant(data).startswith("OBJECT"), F.lit(False))
    return F.struct(ok.alias("ok"), F.coalesce(F.when(F.schema_of_variant(content) == "STRING", text), F.lit("")).alias("content"), F.coalesce(said, F.lit(False)).alias("done"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def behind(text: Column, mark: str) -> Column:
    """What stands behind the first mark."""
    return F.substr(text, F.instr(text, mark) + len(mark))


def has(text: Column, mark: str) -> Column:
    return F.contains(text, F.lit(mark))


def _take(state: Column, line: Column) -> Column:
    """The fold's step: held text, lines gone, the line from which all passes (0: not yet), and what that line emits."""
    at = state["gone"] + 1

    def step(held: Column) -> Column:
        closed = F.struct(F.lit("").alias("held"), at.alias("gone"), at.alias("passing"), behind(held, CLOSE).alias("out"))
        flushed = F.struct(F.lit("").alias("held"), at.alias("gone"), at.alias("passing"), held.alias("out"))
        waiting = F.struct(held.alias("held"), at.alias("gone"), F.lit(0).alias("passing"), F.lit("").alias("out"))
        return F.when(has(held, CLOSE), closed).when(~has(held, OPEN) & (F.length(held) > FLUSH), flushed).otherwise(waiting)

    return F.when(state["passing"] > 0, state).otherwise(let(F.concat(state["held"], line["content"]), step))


def filter_batch(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, chunk) of finished streams (stream_id, seq, line); a stream's lines are folded in one row.

    A stream without a valid line emits nothing; a stream that was never done ends with its last line.
    """
    read = lines.select("stream_id", F.col("seq").cast("long").alias("seq"), decoded(F.col("line")).alias("d"))
    line = F.when(F.col("d.ok"), F.struct("seq", "d.content", "d.done"))
    streams = read.groupBy("stream_id").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.max("seq").alias("last"))
    end = F.array_position(F.transform("lines", lambda x: x["done"]), True).cast("int")
    streams = streams.select("stream_id", F.when(end > 0, F.slice("lines", 1, end)).otherwise(F.col("lines")).alias("lines"), F.when(end > 0, F.element_at("lines", F.greatest(end, F.lit(1)))["seq"]).otherwise(F.col("last")).alias("last"))
    start = F.struct(F.lit("").alias("held"), F.lit(0).alias("gone"), F.lit(0).alias("passing"), F.lit("").alias("out"))
    streams = streams.withColumn("f", F.aggregate("lines", start, _take))
    at = F.col("f.passing")
    rest = F.transform(F.slice("lines", at + 1, F.size("lines")), lambda x: F.struct(x["seq"].alias("seq"), x["content"].alias("chunk")))
    first = F.array(F.struct(F.get("lines", at - 1)["seq"].alias("seq"), F.col("f.out").alias("chunk")))
    held = F.col("f.held")
    tail = F.when(~has(held, OPEN), held).otherwise(let(behind(held, OPEN), lambda t: F.when(strip(t) != "", t).otherwise("")))
    emitted = F.when(at > 0, F.concat(first, rest)).otherwise(F.array(F.struct(F.col("last").alias("seq"), tail.alias("chunk"))))
    return streams.select("stream_id", F.inline(F.filter(emitted, lambda x: x["chunk"] != "")))


class ThinkProcessor(StatefulProcessor):
    """The machine in keyed state. A stream ends with its `done` line, or when none of its lines came for idle_ms; what comes
    behind its end is left out. With `whole` the chunks are kept and emitted once, as the answer, at the end."""

    def __init__(self, idle_ms: int | None = None, whole: bool = False):
        self.idle_ms, self.whole = idle_ms, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "held string, passing boolean, over boolean, last long")
        self.kept = handle.getListState("kept", "chunk string")

    def _emit(self, key, out: list[tuple[int, str]], ended: str) -> Iterator[pd.DataFrame]:
        if not self.whole:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["stream_id", "seq", "chunk"])
            return
        for _, chunk in out:
            self.kept.appendValue((chunk,))
        if ended:
            answer = "".join(x[0] for x in self.kept.get()) if self.kept.exists() else ""
            self.kept.clear()
            yield pd.DataFrame([(key[0], answer, ended)], columns=["stream_id", "answer", "ended"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *fields, last = self.state.get() if self.state.exists() else ("", False, False, -1)
        machine = Machine(*fields)
        lines = sorted((r for frame in rows for r in zip(frame["seq"].tolist(), frame["line"].tolist())), key=lambda r: r[0])
        if machine.over or not lines:
            return
        out = list(machine.lines(lines))
        self.state.update((machine.held, machine.passing, machine.over, max(last, lines[-1][0])))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not machine.over:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._emit(key, out, "done" if machine.over else "")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *fields, last = self.state.get() if self.state.exists() else ("", False, True, -1)
        machine = Machine(*fields)
        if machine.over:
            return
        tail = machine.end()
        self.state.update((machine.held, machine.passing, machine.over, last))
        yield from self._emit(key, [(last, tail)] if tail else [], "idle")

    def close(self) -> None:
        pass


def _stateful(lines: DataFrame, processor: ThinkProcessor, schema: str) -> DataFrame:
    mode = "none" if processor.idle_ms is None else "processingTime"
    return lines.select("stream_id", F.col("seq").cast("long").alias("seq"), "line").groupBy("stream_id").transformWithStateInPandas(processor, schema, "append", mode)


def filter_stream(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream; a stream ends with its `done` line, or after idle_ms without a line, when its held text is emitted."""
    return _stateful(lines, ThinkProcessor(idle_ms), EMITTED)


def answer_stream(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(stream_id, answer, ended) of each stream, once, when it is done or idle: what is saved of it."""
    return _stateful(lines, ThinkProcessor(idle_ms, whole=True), ANSWERED)


def answers(chunks: DataFrame) -> DataFrame:
    """(stream_id, answer): the emitted chunks of each stream as one text."""
    grouped = chunks.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "chunk"))).alias("c"))
    return grouped.select("stream_id", F.array_join(F.transform("c", lambda x: x["chunk"]), "").alias("answer"))


def sse(chunk: Column) -> Column:
    """Server-sent event of a chunk."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(chunk.alias("chunk"))), F.lit("\n\n"))


SSE_END = "data: [DONE]\n\n"


def sse_rows(chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, event): an event for each chunk, and the end of each stream behind its last one."""
    events = chunks.select("stream_id", "seq", sse(F.col("chunk")).alias("event"))
    return events.unionByName(chunks.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq")).withColumn("event", F.lit(SSE_END)))


def parse_sse(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, chunk): events of a body up to [DONE]; others, bad JSON and an unfinished last event are left out."""
    events = F.split(F.col(body), "\n\n", -1)
    rows = bodies.select(key, F.posexplode(F.slice(events, 1, F.size(events) - 1)).alias("place", "event"))
    ends = bodies.select(key, F.array_position(events, "data: [DONE]").alias("end"))
    kept = rows.join(ends, key).where(((F.col("end") == 0) | (F.col("place") < F.col("end") - 1)) & F.col("event").startswith("data: "))
    return kept.select(key, "place", F.get_json_object(F.substring("event", 7, 2**31 - 1), "$.chunk").alias("chunk")).where(F.col("chunk").isNotNull())
