"""The session machine: the state of a conversation from its first message to its last, as a stream and replayed in batch.

What a message alone tells (guardrail, script, intent, question) is computed as columns before the stateful step; the step only moves the
state. As a stream the state lives in variables of its own kind, so that a message reads and writes what it touches: facts and pending summaries are
maps, the turn buffer and the recent entities lists, the rest values. Under processing time each variable expires when it has not been written for
``idle_ms``; under event time an idle timer clears them. Summaries, which wait for a model, are put off to a timer: what they are made from is kept as it
was when they fell due, so their texts don't depend on when the timer fires.

Texts are left to models: ``action`` says which reply is due: refuse, ask (a slot), brief (answer, then ask again), check (eligibility), answer (by retrieval), general.
``Boundary`` takes functions for replies, eligible entities and summaries; without them the action stands for the reply and the last turns for the summary.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import dialogue, guardrail, language
from .jobs import _BUTTONS, IDLE_MS, open_slot, read_reply

BUFFER = 8
RECENT = 5
SUMMARY_EVERY = 4
SUMMARY_TURNS = 4
ROWS = (
    "kind string, conv_id long, turn long, allowed boolean, action string, slot string, language string, language_source string, session_turn int, facts int, buffered int, "
    "last_intent string, last_scheme string, recent array<string>, in_flow boolean, done boolean, summary_due boolean, summary string"
)
_NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _said(action: str, slot: str | None, session: Session) -> str:
    return action if slot is None else f"{action} {slot}"


@dataclass(frozen=True)
class Boundary:
    """Functions of external models; they run inside tasks."""

    reply: Callable[[str, str | None, Session], str] = _said
    eligible: Callable[[dict[str, str]], list[str]] = lambda facts: []
    summarise: Callable[[str, str], str] = lambda before, history: history


def prepared(messages: DataFrame) -> DataFrame:
    """Messages ``(conv_id, turn, text)``, and ``entity`` and ``at_ms`` where there, with what does not depend on the session."""
    t = F.coalesce("text", F.lit(""))

    def allowed(in_flow: bool):
        return guardrail.check(t, F.lit(in_flow), F.lit("en"))["allowed"]

    entity = F.col("entity").cast("string") if "entity" in messages.columns else F.lit(None).cast("string")
    at = [F.col("at_ms").cast("long").alias("at_ms")] if "at_ms" in messages.columns else [F.lit(0).cast("long").alias("at_ms")]
    # The time column itself goes along, as it carries the watermark.
    timed = [c for c in messages.columns if c == "at"]
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), t.alias("text"), allowed(True).alias("allowed_in"), allowed(False).alias("allowed_out"),
        language.language_by_script(t).alias("script"), dialogue.intent_by_words(t, F.lit(False)).alias("intent"), dialogue.looks_like_question(t).alias("question"), entity.alias("entity"), *at, *timed,
    )


@dataclass
class Session:
    language: str = "hi"
    source: str = "default"
    turn: int = 0
    facts: dict[str, str] = field(default_factory=dict)
    buffer: list[tuple[str, str, int]] = field(default_factory=list)
    recent: list[str] = field(default_factory=list)
    scheme: str | None = None
    intent: str | None = None
    in_flow: bool = False
    done: bool = False

    def speak(self, lang: str | None, source: str) -> None:
        if lang and (self.source != "user_selected" or source == "user_selected"):
            self.language, self.source = lang, source

    def start(self) -> tuple[str, str]:
        self.in_flow, self.done, self.facts = True, False, {}
        return "ask", "occupation"

    def mention(self, scheme: str | None, intent: str | None) -> None:
        if scheme:
            self.scheme = scheme
            if scheme not in self.recent:
                self.recent = [scheme, *self.recent][:RECENT]
        self.intent = intent or self.intent

    def history(self, turns: int = SUMMARY_TURNS) -> str:
        return "\n".join(line for said, bot, _ in self.buffer[-turns:] for line in (f"User: {said}", f"Bot: {bot}")) or "No previous conversation."

    def advance(self, m, boundary: Boundary) -> tuple:
        """Moves on by one prepared message; the output row after its key, without the summary."""
        open_flow = self.in_flow and not self.done
        allowed = bool(m.allowed_in if self.in_flow else m.allowed_out)
        action, slot, said, counted = "refuse", None, m.text.strip(), False
        script, entity = (x if isinstance(x, str) else None for x in (m.script, m.entity))
        if allowed and m.text == "__init__":
            action, slot = self.start()
        elif allowed and open_flow:
            asked = open_slot(self.facts)
            given = read_reply(asked, m.text)
            if said.lower() not in _BUTTONS:
                self.speak(script, "script_detected")
            if given is not None:
                self.facts.update(given)
                slot = open_slot(self.facts)
                action = "ask" if slot else "check"
                if slot is None:
                    self.done, self.in_flow = True, False
                    found = boundary.eligible(dict(self.facts))
                    self.recent = found[:RECENT] or self.recent
                counted = True
            else:
                action, slot = ("brief" if m.question else "ask"), asked
        elif allowed:
            counted = True
            button = _BUTTONS.get(said.lower())
            if button:
                self.facts["occupation"] = button
                self.mention(None, "slot_fill_response")
                action = "general"
            else:
                self.speak(script, "auto_detected")
                self.mention(entity, m.intent)
                if m.intent == "eligibility_check":
                    action, slot = self.start()
                else:
                    action = "answer" if m.intent in ("scheme_query", "document_query", "how_to_apply") else "general"
        if allowed:
            said = "__start__" if m.text == "__init__" else m.text
            self.buffer = [*self.buffer, (said, boundary.reply(action, slot, self), self.turn)][-BUFFER:]
            self.turn += 1
        due = counted and self.turn % SUMMARY_EVERY == 0
        return (allowed, action, slot, self.language, self.source, self.turn, len(self.facts), len(self.buffer), self.intent, self.scheme, list(self.recent), self.in_flow, self.done, due, None)


def _summary_row(conv: int, turn: int, session_turn: int, text: str) -> tuple:
    return ("summary", conv, turn, None, None, None, None, None, session_turn, None, None, None, None, None, None, None, None, text)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES, dtype=object)


class SessionProcessor(StatefulProcessor):
    """The machine over state variables. ``mode`` is the time mode; with None, summaries are made at once and nothing expires."""

    def __init__(self, boundary: Boundary, mode: str, idle_ms: int, delay_ms: int) -> None:
        self.boundary, self.mode, self.idle_ms, self.delay_ms = boundary, mode, idle_ms, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.idle_ms if self.mode == "ProcessingTime" else None
        self.handle = handle
        self.flow = handle.getValueState("flow", "language string, source string, turn int, scheme string, intent string, in_flow boolean, done boolean, at long", ttl)
        self.facts = handle.getMapState("facts", "slot string", "value string", ttl)
        self.buffer = handle.getListState("buffer", "said string, bot string, turn int", ttl)
        self.recent = handle.getListState("recent", "scheme string", ttl)
        self.summary = handle.getValueState("summary", "text string", ttl)
        self.waiting = handle.getMapState("waiting", "session_turn int", "turn long, due long, history string", ttl)

    def _load(self) -> tuple[Session, int]:
        if not self.flow.exists():
            return Session(), 0
        lang, source, turn, scheme, intent, in_flow, done, at = self.flow.get()
        facts = {k[0]: v[0] for k, v in self.facts.iterator()} if self.facts.exists() else {}
        buffer = [tuple(r) for r in self.buffer.get()] if self.buffer.exists() else []
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        return Session(lang, source, turn, facts, buffer, recent, scheme, intent, in_flow, done), at

    def _save(self, s: Session, at: int, before: Session | None) -> None:
        """Writes the variables that changed."""
        self.flow.update((s.language, s.source, s.turn, s.scheme, s.intent, s.in_flow, s.done, at))
        if before is None or s.facts != before.facts:
            old = {} if before is None else before.facts
            for k in old.keys() - s.facts.keys():
                self.facts.removeKey((k,))
            for k, v in s.facts.items():
                if old.get(k) != v:
                    self.facts.updateValue((k,), (v,))
        if s.buffer and (before is None or s.buffer != before.buffer):
            self.buffer.put(list(s.buffer))
        if s.recent and (before is None or s.recent != before.recent):
            self.recent.put([(r,) for r in s.recent])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, at = self._load()
        before = Session(**{**session.__dict__, "facts": dict(session.facts)})
        out = []
        for m in pd.concat(list(rows)).sort_values("turn", kind="stable").itertuples(index=False):
            row = session.advance(m, self.boundary)
            out.append(("turn", key[0], m.turn, *row))
            at = max(at, int(m.at_ms) if self.mode == "EventTime" else 0)
            if row[-2]:
                if self.mode == "None":
                    out.append(_summary_row(key[0], m.turn, session.turn, self._summarised(session.history())))
                else:
                    due = (int(m.at_ms) if self.mode == "EventTime" else timerValues.getCurrentProcessingTimeInMs()) + self.delay_ms
                    self.waiting.updateValue((session.turn,), (int(m.turn), due, session.history()))
                    self.handle.registerTimer(due)
        if self.mode == "EventTime":
            self.handle.registerTimer(at + self.idle_ms)
        self._save(session, at, before)
        yield _frame(out)

    def _summarised(self, history: str) -> str:
        before = self.summary.get()[0] if self.summary.exists() else ""
        text = self.boundary.summarise(before, history)
        self.summary.update((text,))
        return text

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.waiting.exists():
            for (session_turn,), (turn, due, history) in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
                if due <= now:
                    out.append(_summary_row(key[0], turn, session_turn, self._summarised(history)))
                    self.waiting.removeKey((session_turn,))
        if self.mode == "EventTime" and self.flow.exists() and now >= self.flow.get()[7] + self.idle_ms:
            for variable in (self.flow, self.facts, self.buffer, self.recent, self.summary, self.waiting):
                variable.clear()
        yield _frame(out)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            s, summary = restored(r)
            self._save(s, int(r.at_ms), None)
            if summary:
                self.summary.update((summary,))
            if self.mode == "EventTime":
                self.handle.registerTimer(int(r.at_ms) + self.idle_ms)

    def close(self) -> None:
        pass


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def restored(r) -> tuple[Session, str]:
    """A session, and its summary, from a stored row as ``sinks.encoded_sessions`` writes it."""
    facts = json.loads(_text(r.confirmed_facts) or "{}")
    memory = json.loads(_text(r.entity_memory) or "{}")
    turns = json.loads(_text(r.conversation_buffer) or "[]")
    said = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in facts.items() if v is not None and v != ""}
    return Session(
        _text(r.language) or "hi", _text(r.language_source) or "default", int(r.turn), said, [(t.get("role_user") or "", t.get("role_bot") or "", int(t.get("turn") or 0)) for t in turns][-BUFFER:],
        (memory.get("last_schemes_discussed") or [])[:RECENT], memory.get("last_scheme_id"), memory.get("last_intent"), bool(r.in_eligibility_flow), bool(r.eligibility_done),
    ), _text(r.conversation_summary) or ""


STORED = ("language", "language_source", "confirmed_facts", "conversation_buffer", "entity_memory", "conversation_summary")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stored_sessions(rows: DataFrame) -> DataFrame:
    """Encoded session rows as the initial state: keyed by the number their id holds."""
    cols = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in STORED]
    at = F.unix_millis("updated_at") if "updated_at" in rows.columns else F.lit(0)
    return rows.select(F.col("id").cast("long").alias("conv_id"), *cols, F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), "eligibility_done", "in_eligibility_flow", F.coalesce(at, F.lit(0)).cast("long").alias("at_ms"))


def session_stream(messages: DataFrame, mode: str = "ProcessingTime", idle_ms: int = IDLE_MS, delay_ms: int = 0, stored: DataFrame | None = None, boundary: Boundary = Boundary()) -> DataFrame:
    """The machine over a stream of ``(conv_id, turn, text)``: a row a message (kind turn) and a row a summary (kind summary).

    Messages of a conversation must come in order over the batches; within a batch they are sorted. ``mode`` is ProcessingTime for a running service, EventTime for streams with
    ``at`` (watermarked) and ``at_ms``, None for triggers that end with their input. ``stored`` are encoded session rows to start from. State variables need the RocksDB provider, which is
    set here where the session has another.
    """
    spark = messages.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    first = None if stored is None else stored_sessions(stored).groupBy("conv_id")
    processor = SessionProcessor(boundary, mode, idle_ms, delay_ms)
    return prepared(messages).groupBy("conv_id").transformWithStateInPandas(processor, ROWS, "Append", mode, first)


def session_replay(messages: DataFrame, boundary: Boundary = Boundary()) -> DataFrame:
    """The same over stored messages: sorted partitions are read as a stream that holds the session at hand only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, session, summary = None, Session(), ""
        for rows in batches:
            out = []
            for m in rows.itertuples(index=False):
                if m.conv_id != at:
                    at, session, summary = m.conv_id, Session(), ""
                row = session.advance(m, boundary)
                out.append(("turn", m.conv_id, m.turn, *row))
                if row[-2]:
                    summary = boundary.summarise(summary, session.history())
                    out.append(_summary_row(m.conv_id, m.turn, session.turn, summary))
            yield _frame(out)

    return prepared(messages.where("conv_id is not null")).repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInPandas(run, ROWS)
