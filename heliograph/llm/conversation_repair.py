"""Repair of conversations whose turns were damaged, by the cheapest edits.

Damage and faults are JVM expressions. Rows are then dealt by conversation and sorted, and
each task walks its conversations one after the other. A conversation is repaired by Dijkstra's
search on a lattice that is never built: a node is (turns consumed, state of the role grammar),
an edge keeps, re-roles or deletes a turn or inserts an empty one, and the queue is ordered by
(cost, audit), so that the first accepting end node that leaves it is the answer, ties included.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.storage import ship

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: The grammar (s?(ua)+)? of role initials: state -> initial -> state. 0 begins, 1 follows s, 2 u and 3 a.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTING = {0, 3}
BLANKS = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Edits that one link of an audit holds.
LINK = 256

REPAIRED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Audit:
    """A string of edits that grows at its end and shares all but its last part with others.

    Audits of one search are nodes of a tree: two that share a link object are equal up to it, and
    two that don't differ in a link of theirs.
    """

    __slots__ = ("links", "before", "tail")

    def __init__(self, links: int = 0, before: "Audit | None" = None, tail: str = ""):
        self.links, self.before, self.tail = links, before, tail

    def plus(self, edit: str) -> "Audit":
        if len(self.tail) == LINK:
            return Audit(self.links + 1, self, edit)
        return Audit(self.links, self.before, self.tail + edit)

    def __lt__(self, other: "Audit") -> bool:
        a, b = self, other
        while a.links > b.links:
            a = a.before
        while b.links > a.links:
            b = b.before
        x, y = a.tail, b.tail
        while a.before is not b.before:
            a, b = a.before, b.before
            x, y = (a.tail, b.tail) if a.tail != b.tail else (x, y)
        return (x, self.links) < (y, other.links) if x != y else self.links < other.links

    def __str__(self) -> str:
        parts, at = [], self
        while at is not None:
            parts.append(at.tail)
            at = at.before
        return "".join(reversed(parts))


@dataclass
class Turn:
    role: str
    text: str
    fault: int


def cheapest(turns: list[Turn]) -> tuple[int, str, list[tuple[str, int, str]]]:
    """(cost, audit, edits) of the cheapest repair; an edit is (initial, turn or -1, role)."""
    came: dict[tuple[int, int], tuple] = {}
    queue: list[tuple] = [(0, Audit(), 0, 0, None, ("", -1, ""))]
    while True:
        cost, audit, at, state, parent, edit = heapq.heappop(queue)
        if (at, state) in came:
            continue
        came[at, state] = (parent, edit)
        if at == len(turns) and state in ACCEPTING:
            break
        following = [("I", -1, i, INSERT, at) for i in GRAMMAR[state] if i in ROLES]
        if at < len(turns):
            t = turns[at]
            following.append(("D", at, "", DELETE, at + 1))
            if t.fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if t.fault == CUT else 0
                following.append(("K", at, t.role[:1], more, at + 1))
                following += [("R", at, i, REROLE + more, at + 1) for i in GRAMMAR[state] if i in ROLES]
        for name, turn, initial, price, then in following:
            to = state if name == "D" else GRAMMAR[state].get(initial)
            if to is not None and (then, to) not in came:
                role = turns[turn].role if name == "K" else ROLES.get(initial, "")
                heapq.heappush(queue, (cost + price, audit.plus(name), then, to, (at, state), (name, turn, role)))
    edits, node = [], (at, state)
    while node != (0, 0):
        node, edit = came[node]
        edits.append(edit)
    return cost, str(audit), edits[::-1]


def repair(rows: list[tuple]) -> tuple:
    """The REPAIRED columns of a conversation's rows (turn, role, text, fault), which are in order."""
    seen: set[bytes] = set()
    turns, counts = [], [0, 0, 0, 0]
    for _, role, text, fault in rows:
        if fault != BLANK:
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            fault = DUPLICATE if key in seen else fault
            seen.add(key)
        counts[fault] += 1
        turns.append(Turn(role, text, fault))
    numbered = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbered) - min(numbered) + 1 - len(set(numbered)) if numbered else 0
    illegal = sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit, edits = cheapest(turns)
    sha = hashlib.sha256()
    lines = ((role, turns[turn].text if turn >= 0 else "") for name, turn, role in edits if name != "D")
    for number, (role, text) in enumerate(lines):
        sha.update(f"{chr(10) if number else ''}{role}:{text}".encode())
    return gaps, counts[BLANK], counts[DUPLICATE], counts[CUT], illegal, cost, audit, sha.hexdigest()


def faults(text: Column) -> Column:
    """BLANK, CUT or FINE by a text alone: blank, or its last non-blank character ends no sentence."""
    solid = F.rtrim(text, F.lit(BLANKS))
    return F.when(solid == "", BLANK).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of conversations (conv_id, turn, role, text) with planted damage.

    A null reads as one space. The checksum of ``conv_id:turn`` decides: it drops a row (``gone``),
    empties its text, takes its sentence ends, repeats it or makes it the user's.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    hit = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """A row per conv_id of ``rows`` (conv_id, turn, role, text, gone): faults, cost, audit, digest.

    Rows that are ``gone`` count for nothing but their conv_id. Rows without a conv_id are one
    conversation; a null role or text reads as one space; equal turns go by role and text, null
    turns first. An empty table gives no rows; other columns are ignored. Roles other than those of
    the grammar are re-roled or deleted. A conversation is one task's work, as its digest is over
    all of it; its search keeps a node per turn and state and no texts but its own.
    """
    spark = rows.sparkSession
    ship(spark)
    spaced = lambda name: F.coalesce(F.col(name), F.lit(" "))
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), F.coalesce("gone", F.lit(False)).alias("gone"))
    judged = plain.select("conv_id", "turn", *[F.when(F.col("gone"), None).otherwise(F.col(n)).alias(n) for n in ("role", "text")], "gone", F.when(F.col("gone"), FINE).otherwise(faults(F.col("text"))).alias("fault"))
    dealt = judged.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *[f.split()[0] for f in REPAIRED.split(", ")]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, None, []
        for batch in batches:
            fields = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "gone", "fault")]
            for conv_id, turn, role, text, gone, fault in zip(*fields):
                if held is None or conv_id != key:
                    if held is not None:
                        done.append((key, *repair(held)))
                    key, held = conv_id, []
                if not gone:
                    held.append((turn, role, text, fault))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types(batch))], names=names)
                done = []
            last = batch
        if held is not None:
            done.append((key, *repair(held)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types(last))], names=names)

    def types(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]

    return dealt.mapInArrow(run, f"conv_id {kind}, {REPAIRED}")
