"""Repair of conversation structure by Viterbi decoding with coalescing survivors.

A conversation should read: at most one system turn, then pairs of a user's and an assistant's turn. The cheapest edits
that make it so are a shortest path through four states (nothing yet, after system, after user, after assistant), a
step for each turn. The best way into each state is its survivor; survivors are kept as a tree of back pointers with
counts of references. Where all survivors share an ancestor, the edits up to it are certain: they are handed on and
forgotten, with the texts that they use. So a task holds the unresolved part of one conversation only, however long it is.

Of ways of equal cost the one whose string of edits comes first in ASCII order wins. Two survivors that both end with a
turn never are prefixes of each other, so the order of their whole strings holds whatever follows. That order is
carried on from turn to turn: it compares complete unresolved strings without walking them again.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state that a user's or an assistant's turn leads to, and by initial what may be kept in each state.
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {NONE: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: Insertions before a turn that can be worth while: the string of edits and the state after them.
BEFORE = {NONE: (("", NONE), ("I", USER), ("II", ASSISTANT)), SYSTEM: (("", SYSTEM), ("I", USER), ("II", ASSISTANT)), USER: (("", USER), ("I", ASSISTANT)), ASSISTANT: (("", ASSISTANT), ("I", USER))}
#: Insertions that end a conversation well.
AFTER = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: (a, b, x): what a survivor in a can still do, one in b can do for at most x more; so a is out if it costs over x more.
OUTDONE = ((NONE, ASSISTANT, 2), (NONE, USER, 7), (NONE, SYSTEM, 10), (SYSTEM, ASSISTANT, 0), (SYSTEM, USER, 5), (USER, ASSISTANT, 5), (ASSISTANT, USER, 5))
SPACE = " \t\n\x0b\x0c\r"
EDIT = "edit string, turn long, was string, role string, text string, fault string, cost int"


class _Node:
    """The edits of one turn on a survivor's way; ``kids`` and ``held`` (by a survivor) are its references."""

    __slots__ = ("parent", "edits", "kids", "held")

    def __init__(self, parent: _Node | None, edits: str):
        self.parent, self.edits, self.kids, self.held = parent, edits, [], True
        if parent is not None:
            parent.kids.append(self)

    def release(self) -> None:
        self.held, node = False, self
        while not node.held and not node.kids and node.parent is not None:
            node.parent.kids.remove(node)
            node = node.parent


class Decoder:
    """Edits of one conversation, turn by turn. ``add`` and ``end`` give the edits that have become certain."""

    def __init__(self) -> None:
        self.base = _Node(None, "")
        self.alive = {NONE: (0, 0, self.base)}  # by state: cost, place in the order of strings, end of the way
        self.turns: deque = deque()  # turns whose edits are open
        self.state = NONE  # after the edits handed on

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> Iterator[tuple]:
        self.turns.append((turn, role, text, fault))
        extra, must = TRUNCATED * (fault == "truncated"), fault in ("blank", "duplicate")
        best: dict[int, tuple] = {}
        for state, (cost, place, node) in self.alive.items():
            for inserted, then in BEFORE[state]:
                spent = cost + INSERT * len(inserted)
                ways = [("D", then, DELETE)]
                if not must:
                    ways.append(("R", NEXT[then], REROLE + extra))
                    if role[:1] in KEPT[then]:
                        ways.append(("K", KEPT[then][role[:1]], KEEP + extra))
                for edit, after, price in ways:
                    way = (spent + price, place, inserted + edit)
                    if after not in best or way < best[after][0]:
                        best[after] = (way, node)
        best = {s: x for s, x in best.items() if not any(s == a and b in best and x[0][0] > best[b][0][0] + more for a, b, more in OUTDONE)}
        order = {s: k for k, s in enumerate(sorted(best, key=lambda s: best[s][0][1:]))}
        ends = [node for _, _, node in self.alive.values()]
        self.alive = {s: (way[0], order[s], _Node(node, way[2])) for s, (way, node) in best.items()}
        for node in ends:
            node.release()
        yield from self._certain()

    def _certain(self) -> Iterator[tuple]:
        while len(self.base.kids) == 1 and not self.base.held:
            self.base = self.base.kids[0]
            self.base.parent = None
            yield from self._applied(self.base.edits)

    def _applied(self, edits: str) -> Iterator[tuple]:
        for edit in edits:
            if edit == "I":
                self.state = NEXT[self.state]
                yield "I", None, None, ROLE[self.state], "", None, INSERT
                continue
            turn, was, text, fault = self.turns.popleft()
            extra = TRUNCATED * (fault == "truncated")
            if edit == "D":
                yield "D", turn, was, was, text, fault, DELETE
            elif edit == "K":
                self.state = KEPT[self.state][was[:1]]
                yield "K", turn, was, was, text, fault, KEEP + extra
            else:
                self.state = NEXT[self.state]
                yield "R", turn, was, ROLE[self.state], text, fault, REROLE + extra

    def end(self) -> Iterator[tuple]:
        state = min(self.alive, key=lambda s: (self.alive[s][0] + INSERT * len(AFTER[s]), self.alive[s][1]))
        for s, (_, _, node) in self.alive.items():
            if s != state:
                node.release()
        self.alive[state][2].held = False
        yield from self._certain()
        yield from self._applied(AFTER[state])


def fault_of(text: str, repeated: bool) -> str | None:
    """blank, duplicate or truncated, whichever comes first; else None."""
    seen = text.rstrip(SPACE)
    return "blank" if not seen else "duplicate" if repeated else "truncated" if seen[-1] not in ".!?" else None


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches as tuples."""
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id and the edits of each conversation, its edits in order within a partition: edit (K, R, D or I), turn, was (role before), role, text, fault, cost.

    Turns are taken by ``turn`` (nulls first; rows of one turn by role, then text, copies side by side). A null role or
    text is one space; a null conv_id is a conversation of its own. A role counts by its first letter; other roles than
    s, u and a, or an empty one, are given another or deleted. Insertions have no turn and no ``was``. Extra columns are
    ignored. An empty table gives no edits. A conversation passes through one task, in memory that its unresolved part bounds;
    repeated turns are found by a window over its equal turns, not by remembering them.
    """
    key = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    turn = F.col("turn").asc_nulls_first()
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(turn)))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", turn, "role", "text", "copy")

    def edits(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, decoder = None, None
        for conv, turn, role, text, copy in rows:
            if decoder is None or conv != now:
                if decoder is not None:
                    for edit in decoder.end():
                        yield now, *edit
                now, decoder = conv, Decoder()
            for edit in decoder.add(turn, role, text, fault_of(text, copy > 1)):
                yield now, *edit
        if decoder is not None:
            for edit in decoder.end():
                yield now, *edit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
            schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *((c, kinds[k]) for c, k in (x.split() for x in EDIT.split(", ")))])
            yield from _batches(edits(_grouped(x for some in ([first], batches) for x in some)), schema)

    return rows.mapInArrow(run, f"conv_id {key}, {EDIT}")


class _Digest:
    """What is reported of one conversation, from its edits one by one."""

    def __init__(self) -> None:
        self.first = self.last = self.initial = None
        self.distinct = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.audit: list[str] = []
        self.sha, self.any = hashlib.sha256(), False

    def add(self, edit, turn, was, role, text, fault, cost) -> None:
        self.audit.append(edit)
        self.cost += cost
        if was is not None:
            if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = was[:1]
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if fault:
            self.faults[fault] += 1
        if edit != "D":
            self.sha.update(("\n" * self.any + f"{role}:{text}").encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(edits: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`repair`, whose partitions hold each conversation's edits together and in order."""
    key = edits.schema["conv_id"].dataType.simpleString()

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        now, digest = None, None
        for conv, *edit in found:
            if digest is None or conv != now:
                if digest is not None:
                    yield now, *digest.row()
                now, digest = conv, _Digest()
            digest.add(*edit)
        if digest is not None:
            yield now, *digest.row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *((c, pa.int64() if k == "long" else pa.string()) for c, k in (x.split() for x in REPORT.split(", ")))])
            yield from _batches(rows(_grouped(x for some in ([first], batches) for x in some)), schema)

    return edits.mapInArrow(run, f"conv_id {key}, {REPORT}")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32(``conv_id:turn``) mod 20 (nulls: one space): 0 drops a row,
    1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("spaced", "[.!?]", "")).otherwise(F.col("spaced"))
    rows = conversations.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("spaced"), kind.alias("kind")).filter("kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("time", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("time", "kind")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = report(repair(damage(conversations))).withColumnRenamed("conv_id", "found_id")
    every = conversations.select("conv_id").distinct()
    rows = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").drop("found_id")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()} | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    return rows.select("conv_id", *[F.coalesce(c, F.lit(v).cast("string" if isinstance(v, str) else "long")).alias(c) for c, v in sorted(nothing.items())])
