"""Repair of conversation structure by cheapest edits, computed once per node of a suffix-shared automaton.

A row enters the grammar only through its symbol: the class of its role (system, user, assistant, other) and what its fault asks for
(nothing, one more if it stays, deletion). A conversation is a word over these twelve symbols, and the cheapest repair of what is
left of it depends on that suffix and the grammar state alone. So the distinct words of all conversations are sorted from their
ends (a distributed range sort of the reversed words); in that order equal suffixes lie together, and each task keeps the automaton's
nodes along the current word only: a node is built once, for all words that end alike, with the cost-to-go and the best edit (whose pointers spell
the audit suffix) of each grammar state. Words split by a range border cost one path once more. Answers go back to the conversations by a join on the word.

Rows are shuffled twice: narrow (flags and digests) to spell the words, whole to write the repaired text. Both passes read sorted partitions as a
stream: of a conversation they hold one symbol a row and one running digest, never its rows, so a conversation may have any number of them.

Grammar of role initials: ``(s?(ua)+)?``. Edits: K(eep) 0, R(erole) 2, D(elete) 3, I(nsert) 2; a kept truncated row adds 1. From a grammar state a
rerole or insert has one useful role, so an audit fixes the repaired rows, and of equally cheap edits the least letter leads to the least audit.

Defined cases. Rows are taken by turn (nulls first), then role, then the digest of their text. Null roles and texts are one space; a null ``conv_id`` is a conversation of its own.
Repeated rows are damaged alike and are duplicates of the first. A role's class is its first letter; the class "other" fits nowhere in the grammar.
A conversation all of whose rows were dropped gives zeros, an empty audit and the digest of the empty string. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, materialize

SEEN = r"[^\x20\x09-\x0D]"
CLASSES = "sua"
KEEP, RISK, DELETE = range(3)
#: Grammar states and the state that follows a role: nothing read, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
EXPECTED = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
NEXT = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
ROLES = {"u": "user", "a": "assistant"}
COSTS = {"D": 3, "I": 2, "K": 0, "R": 2}


def symbol(role_class: int, fault: int) -> str:
    return chr(ord("A") + 3 * role_class + fault)


def _inserted(best: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The best of each state when rows may also be inserted first; two rounds reach every useful number of insertions."""
    for _ in range(2):
        best = [min(best[g], (COSTS["I"] + best[NEXT[EXPECTED[g]]][0], "I")) for g in range(4)]
    return best


#: The node of the empty suffix: what it costs to end in each state.
END = _inserted([(0, ""), (99, ""), (99, ""), (0, "")])


def node(sign: str, after: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """``(cost to go, edit)`` for each grammar state at a row with symbol ``sign``, given those of the suffix after it."""
    role, fault = divmod(ord(sign) - ord("A"), 3)
    initial = CLASSES[role] if role < 3 else "o"
    best = []
    for g in range(4):
        options = [(COSTS["D"] + after[g][0], "D")]
        if fault != DELETE:
            options.append((COSTS["R"] + fault + after[NEXT[EXPECTED[g]]][0], "R"))
            if initial == EXPECTED[g] or (initial == "s" and g == START):
                options.append((COSTS["K"] + fault + after[NEXT[initial]][0], "K"))
        best.append(min(options))
    return _inserted(best)


def audit(signs: str, path: list[list[tuple[int, str]]]) -> str:
    """The edits from the first row on; ``path[i]`` is the node before the last ``i`` rows."""
    g, at, out = START, len(signs), []
    while True:
        edit = path[at][g][1]
        if not edit:
            return "".join(out)
        out.append(edit)
        if edit == "K":
            initial = CLASSES[(ord(signs[len(signs) - at]) - ord("A")) // 3]
        if edit != "D":
            g = NEXT[initial if edit == "K" else EXPECTED[g]]
        if edit != "I":
            at -= 1


def cheapest(signs: DataFrame) -> DataFrame:
    """``(signs, cost, audit)`` for distinct words, through automaton nodes shared by equal suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, path = "", [END]
        for batch in batches:
            words, costs, audits = batch.column(0).to_pylist(), [], []
            for word in words:
                back = word[::-1]
                shared, most = 0, min(len(back), len(last))
                while shared < most and back[shared] == last[shared]:
                    shared += 1
                del path[shared + 1 :]
                for sign in back[shared:]:
                    path.append(node(sign, path[-1]))
                last = back
                costs.append(path[-1][START][0])
                audits.append(audit(word, path))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["signs", "cost", "audit"])

    back = F.reverse("signs")
    return signs.repartitionByRange(back).sortWithinPartitions(back).select("signs").mapInArrow(run, "signs string, cost long, audit string")


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)`` after the stated damage; dropped rows stay as marks, so that no conversation is lost."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
                       F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (kind == 0).alias("gone"),
                       F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def last_seen(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)


def _conversations(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """Rows of sorted batches, each with whether it starts a conversation."""
    at, first = None, True
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
            yield first or row[0] != at, row
            at, first = row[0], False


def _flushed(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


#: Ascending order puts nulls first. Equal keys are equal texts, so which of them comes first makes no difference.
ORDER = ("conv_id", "turn", "role", "key")
SPELLED = "conv_id long, signs string, gaps long, blank long, duplicate long, truncated long, illegal long"


def spelled(rows: DataFrame) -> DataFrame:
    """A row for each conversation: its word and its counts of faults, spelled from sorted narrow rows."""
    blank = ~F.col("text").rlike(SEEN)
    letter = F.substring("role", 1, 1)
    role = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    flags = rows.select("conv_id", "turn", "role", "gone", "key", blank.alias("blank"), (~blank & ~last_seen(F.col("text")).isin(".", "!", "?")).alias("cut"), role.cast("int").alias("class"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "key").orderBy("turn")) > 1
    flags = flags.repartition("conv_id").withColumn("seen", seen).sortWithinPartitions(*ORDER)
    names = ("conv_id", "turn", "class", "gone", "blank", "seen", "cut")
    schema = pa.schema([("conv_id", pa.int64()), ("signs", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            state = None
            for first, (conv, turn, kind, gone, blank, seen, cut) in _conversations(batches, names):
                if first:
                    if state:
                        yield closed(state)
                    state = {"conv": conv, "signs": bytearray(), "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "before": None}
                if gone:
                    continue
                if turn is not None and turn != state["high"]:
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"] = turn
                    state["turns"] += 1
                fault = "blank" if blank else "duplicate" if seen else "truncated" if cut else None
                if fault:
                    state[fault] += 1
                if state["before"] is not None and (state["before"], kind) not in ((0, 1), (1, 2), (2, 1)):
                    state["illegal"] += 1
                state["before"] = kind
                state["signs"].append(ord(symbol(kind, KEEP if fault is None else RISK if fault == "truncated" else DELETE)))
            if state:
                yield closed(state)

        def closed(s):
            gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
            return s["conv"], s["signs"].decode("ascii"), gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"]

        yield from _flushed(each(), schema)

    return flags.select(*names).mapInArrow(run, SPELLED)


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def written(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``found`` with ``repaired_sha256``: sorted rows follow their conversation's audit, and the repaired text runs through one digest."""
    head = found.select("conv_id", F.lit(0).alias("kind"), *FACTS)
    body = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "key", "text")
    lined = head.unionByName(body, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])
    kinds = {"audit": pa.string()}
    schema = pa.schema([("conv_id", pa.int64()), *((c, kinds.get(c, pa.int64())) for c in FACTS), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            facts, text = None, None
            for _, (conv, kind, role, said, *rest) in _conversations(batches, ("conv_id", "kind", "role", "text", *FACTS)):
                if kind == 0:
                    if text:
                        yield *facts, text.done()
                    facts, text = (conv, *rest), Repaired(rest[-1])
                else:
                    text.add(role, said)
            if text:
                yield *facts, text.done()

        yield from _flushed(each(), schema)

    return lined.select("conv_id", "kind", "role", "text", *FACTS).mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class Repaired:
    """The repaired rows of one conversation, as a running digest."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START
        self.digest, self.empty = hashlib.sha256(), True

    def _line(self, role: str, text: str) -> None:
        self.digest.update((("" if self.empty else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.empty = False
        self.state = NEXT[role[0]]

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(ROLES[EXPECTED[self.state]], "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else ROLES[EXPECTED[self.state]], text)

    def done(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for every conversation of damaged ``rows``
    ``(conv_id, turn, role, text, gone)``."""
    rows = rows.withColumn("key", F.md5(F.col("text").cast("binary")))
    words = materialize(spelled(rows), "words")
    answers = materialize(cheapest(words.select("signs").distinct()), "audits")
    return written(rows, words.join(answers, "signs"))
