"""Structured Streaming forms of the stateful work: windows, session spans, append log, TTL cache, slot dialogue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.dialogue import FEMALE_OCCUPATIONS, SLOTS
from ..functions.fixed import BINARY_SLOTS, NO_WORDS, OCCUPATION_BUTTONS, YES_WORDS
from ..sources.keyed import KeyedTable, put_latest


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events and value sums by event-time window and type; windows close ``late`` after the newest event."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "events", "value")


def session_spans(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Spans of activity of each user that a gap ends."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def activity(events: DataFrame) -> DataFrame:
    """First, last and number of events of each user so far."""
    return events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("events"))


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only log partitioned by day, exactly once through the file sink; stops when the input is used up."""
    return events.withColumn("day", F.to_date("ts")).writeStream.outputMode("append").format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: State of a key that has been idle for this long is dropped; longer than any entry lives.
IDLE_MS = 30 * 24 * 3600 * 1000


def keyed(rows: DataFrame, key: str, step, schema: str, state: str, idle_ms: int | None) -> DataFrame:
    """``rows`` through a stateful step by key. With ``idle_ms`` state times out; None is for availableNow triggers, which end only where nothing can time out."""

    def run(k, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        yield from step(k, batches, held)
        if idle_ms is not None and held.exists:
            held.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(run, schema, state, "append", timeout)


def _ttl_step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
    until = state.get[0] if state.exists else None
    hits = []
    for at, ttl in zip(rows["at"].tolist(), rows["ttl"].tolist()):
        hit = until is not None and at <= until
        if not hit:
            until = at + ttl
        hits.append(int(hit))
    state.update((until,))
    yield pd.DataFrame({"cache_key": [key[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "at": rows["at"].to_numpy(), "hit": hits})


def ttl_cache(requests: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Requests ``(cache_key, event_id, at, ttl)`` with ``hit``; an entry lives from its miss for its own ttl. Batches must come in time order for a key."""
    return keyed(requests, "cache_key", _ttl_step, "cache_key string, event_id long, at long, hit int", "until long", idle_ms)


def _slot_step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    facts: dict[str, str] = dict(zip(state.get[0], state.get[1])) if state.exists else {}
    rows = pd.concat(list(batches)).sort_values(["turn"])
    out = []
    for turn, message in zip(rows["turn"].tolist(), rows["text"].tolist()):
        slot = open_slot(facts)
        value = read_reply(slot, message or "")
        if value is not None:
            facts |= value
        out.append((key[0], turn, slot, value is not None, open_slot(facts)))
    state.update((list(facts), list(facts.values())))
    yield pd.DataFrame(out, columns=["conv_id", "turn", "asked", "filled", "next_slot"])


def open_slot(facts: dict[str, str]) -> str | None:
    """The slot to ask next; an occupation that implies it settles the gender."""
    if "gender" not in facts and facts.get("occupation", "").lower() in FEMALE_OCCUPATIONS:
        facts["gender"] = "female"
    return next((s for s in SLOTS if s not in facts), None)


_BUTTONS = {label.lower(): kind for label, kind in OCCUPATION_BUTTONS.items()}


def read_reply(slot: str | None, message: str) -> dict[str, str] | None:
    """Facts in a reply: occupation buttons at any time, yes/no to binary slots, any other text to the open slot."""
    low = message.strip().lower()
    if low in _BUTTONS:
        return {"occupation": _BUTTONS[low]}
    if slot is None or not low:
        return None
    if slot in BINARY_SLOTS:
        return {slot: "true"} if low in YES_WORDS else {slot: "false"} if low in NO_WORDS else None
    return {slot: message.strip()}


SLOT_ROWS = "conv_id long, turn long, asked string, filled boolean, next_slot string"


def slot_dialogue(messages: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """User messages ``(conv_id, turn, text)`` through the slot dialogue, as a stream: what was asked, whether it was filled, what comes next."""
    return keyed(messages, "conv_id", _slot_step, SLOT_ROWS, "names array<string>, vals array<string>", idle_ms)


class _Memory:
    """Empty state for replaying a dialogue in batch."""

    exists = hasTimedOut = False

    def update(self, value) -> None:
        pass


def slot_dialogue_replay(messages: DataFrame) -> DataFrame:
    """The same dialogue over stored messages; a conversation is bounded by its turns."""

    def replay(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(_slot_step(key, iter([rows]), _Memory())))

    return messages.groupBy("conv_id").applyInPandas(replay, SLOT_ROWS)


def upsert_sessions(sessions: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Latest row of each session, kept as a keyed table of which a batch rewrites the buckets it touches; read it by ``KeyedTable(...).read()``.

    Rows may be those of ``sinks.encoded_sessions``.
    """
    table = KeyedTable(sessions.sparkSession, path, "id", sessions.schema, buckets)
    return table.follow(sessions, put_latest("id", F.desc("turn"), F.desc("updated_at")), checkpoint)
