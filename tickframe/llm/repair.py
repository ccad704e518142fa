"""Operator 11, conversation structure repair: the cheapest edits that give a conversation the order system?, (user, assistant)+.

A conversation's rows and the states of the role order span a lattice of edits. Bidirectional Dijkstra searches it: a heap from the
start and one from the end take turns, go on until no equal-cost crossing can be missing, and of all crossings the least
concatenated audit wins. From a node every kind of edit leads to one other node only, so two audits of equal cost to the same
node are never prefixes of each other, and the least halves give the least whole.

A conversation may hold any share of the rows. Rows are dealt by ranges of (conversation, turn), and each task cuts what it has of
a conversation into pieces of bounded size. Most conversations lie whole in one piece and are solved there. Of the others each piece
gives its least costs between the four states and the order of their audits; one pass backward over these small rows
finds each piece's best exits, one forward its entry, and the pieces are then solved where they lie. Only the digest of a
repaired conversation, which SHA-256 defines sequentially, reads its pieces in order in one task, as a stream.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import shared_folder, small_batches

#: States of the role order: nothing yet, after system, after user, after assistant. A conversation may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: What the next role may be, by state; s for system can be kept, but not inserted or given.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
RIGHT_PAIRS = ("su", "ua", "au")
DELETE_COST, GIVE_COST, INSERT_COST, TRUNCATED_COST = 4, 3, 3, 3
#: A row that has to go.
GONE = "-"


@dataclass(frozen=True)
class Repair:
    #: Rows and bytes of text of one piece; a single longer text is a piece of its own.
    piece_rows: int = 512
    piece_bytes: int = 8 << 20


def _given(state: int) -> tuple[str, int]:
    """The role that an inserted or re-roled row must have in this state, and the state after it."""
    return ("a", ASSISTANT) if state == USER else ("u", USER)


def _edges(codes: str, i: int, q: int, ends: bool) -> list[tuple[str, int, int, int]]:
    """Edits at row i in state q as (letter, cost, next row, next state); inserts behind the last row only where the piece ends
    its conversation."""
    out = []
    if i < len(codes):
        code = codes[i]
        out.append(("D", DELETE_COST, i + 1, q))
        if code != GONE:
            extra = TRUNCATED_COST if code.isupper() else 0
            if (kept := NEXT[q].get(code.lower())) is not None:
                out.append(("K", extra, i + 1, kept))
            out.append(("R", GIVE_COST + extra, i + 1, _given(q)[1]))
    if i < len(codes) or ends:
        out.append(("I", INSERT_COST, i, _given(q)[1]))
    return out


def _back_edges(codes: str, i: int, q: int, ends: bool) -> list[tuple[str, int, int, int]]:
    """The edits that lead to (i, q), as (letter, cost, former row, former state)."""
    return [(letter, cost, j, p) for j in ((i - 1, i) if i else (i,)) for p in range(4) for letter, cost, to, state in _edges(codes, j, p, ends) if (to, state) == (i, q)]


@dataclass
class _Side:
    """One direction of the search: costs found, nodes settled in order, and the least audit of each settled node."""

    heap: list[tuple[int, int, int]]
    found: dict[tuple[int, int], int]
    settled: dict[tuple[int, int], int] = field(default_factory=dict)
    audits: dict[tuple[int, int], str] = field(default_factory=dict)

    def top(self) -> float:
        while self.heap and (abs(self.heap[0][1]), self.heap[0][2]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")


@lru_cache(maxsize=1 << 16)
def solve(codes: str, entry: int, leave: int | None) -> tuple[int, str] | None:
    """The least cost from `entry` to the state `leave` (None: to an accepted end of the conversation), and the ASCII-least audit
    of that cost; None where no edits lead there."""
    ends, n = leave is None, len(codes)
    goals = ACCEPTED if ends else (leave,)
    ahead = _Side([(0, 0, entry)], {(0, entry): 0})
    back = _Side([(0, -n, q) for q in goals], {(n, q): 0 for q in goals})
    heapq.heapify(back.heap)
    best = min((0 for q in goals if n == 0 and q == entry), default=float("inf"))
    # what costs nothing is settled on both sides, so that a side which runs out meets the other one's ends; ties at one cost
    # settle rows in the order of the search, so that every equal-cost predecessor has its audit first
    while ((a := ahead.top()) + (b := back.top()) <= best and min(a, b) < float("inf")) or min(a, b) == 0:
        side, other, edges, sign = (ahead, back, _edges, 1) if a <= b else (back, ahead, _back_edges, -1)
        cost, i, q = heapq.heappop(side.heap)
        node = (abs(i), q)
        side.settled[node] = cost
        for letter, more, j, p in edges(codes, *node, ends):
            total = cost + more
            if total < side.found.get((j, p), float("inf")):
                side.found[j, p] = total
                heapq.heappush(side.heap, (total, sign * j, p))
            if (j, p) in other.found:
                best = min(best, total + other.found[j, p])
    if best == float("inf"):
        return None
    for node, cost in ahead.settled.items():
        options = [ahead.audits[j, p] + letter for letter, more, j, p in _back_edges(codes, *node, ends) if ahead.settled.get((j, p)) == cost - more and (j, p) in ahead.audits]
        ahead.audits[node] = min(options) if node != (0, entry) else ""
    for node, cost in back.settled.items():
        options = [letter + back.audits[j, p] for letter, more, j, p in _edges(codes, *node, ends) if back.settled.get((j, p)) == cost - more and (j, p) in back.audits]
        back.audits[node] = min(options) if cost or not (node[0] == n and node[1] in goals) else ""
    crossings = [ahead.audits[v] + back.audits[v] for v, cost in ahead.settled.items() if back.settled.get(v) == best - cost]
    for v, cost in ahead.settled.items():
        crossings += [ahead.audits[v] + letter + back.audits[j, p] for letter, more, j, p in _edges(codes, *v, ends) if back.settled.get((j, p)) == best - cost - more]
    return best, min(crossings)


def lines(audit: str, entry: int, roles: list[str], bodies: list[str]) -> tuple[list[str], int]:
    """The repaired rows as role:text, and the state after them."""
    out, i, q = [], 0, entry
    for letter in audit:
        if letter == "D":
            i += 1
        elif letter == "K":
            out.append(f"{roles[i]}:{bodies[i]}")
            q = NEXT[q][roles[i][0]]
            i += 1
        else:
            role, q = _given(q)
            name = "user" if role == "u" else "assistant"
            out.append(f"{name}:{bodies[i] if letter == 'R' else ''}")
            i += letter == "R"
    return out, q


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of conv_id and turn picks; nulls of any column read as one space."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    read = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), kind.alias("_kind")).where("_kind <> 0")
    body = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return read.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), copies.alias("_")).drop("_")


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PLACE = ["no_turn", "turn", "digest", "id"]
_PIECE = "conv_id {conv}, no_turn int, turn long, digest binary, id long, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, last_turn long, alone boolean, codes string, costs array<long>, ranks array<long>, roles array<string>, bodies array<string>, cost long, audit string, repaired_sha256 string"


class _Piece:
    def __init__(self, conv: Any, place: tuple, first: bool):
        self.conv, self.place, self.opens = conv, place, first
        self.codes, self.roles, self.bodies, self.bytes = [], [], [], 0
        self.n = dict.fromkeys(_COUNTS, 0)
        self.turns, self.least, self.most, self.last_turn = 0, None, None, None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if repeated else "truncated" if body[-1] not in ".!?" else None
        if fault:
            self.n[fault] += 1
        if self.roles and self.roles[-1][:1] + role[:1] not in RIGHT_PAIRS:
            self.n["illegal"] += 1
        letter = role[0] if role[:1] in ("s", "u", "a") else "x"
        self.codes.append(GONE if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
        self.roles.append(role)
        self.bodies.append(text)
        self.bytes += len(text)
        if turn is not None:
            self.turns += turn != self.last_turn
            self.least, self.most, self.last_turn = turn if self.least is None else self.least, turn, turn

    def row(self, alone: bool) -> tuple:
        codes = "".join(self.codes)
        known = (self.conv, *self.place, *self.n.values(), self.roles[0][:1], self.roles[-1][:1], self.least, self.most, self.turns, self.last_turn, alone)
        if alone:
            cost, audit = solve(codes, START, None)
            repaired = "\n".join(lines(audit, START, self.roles, self.bodies)[0])
            return (*known, None, None, None, None, None, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
        found = [[solve(codes, q, p) for p in range(4)] for q in range(4)]
        ranks = [[sorted(x[1] for x in row if x).index(x[1]) if x else -1 for x in row] for row in found]
        return (*known, codes, [x[0] if x else -1 for row in found for x in row], [x for row in ranks for x in row], self.roles, self.bodies, None, None, None)


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def _cut(c: Repair, schema: pa.Schema):
    """Sorted rows to pieces. A mark (a row without role) says of the next row that its role and text came before."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, out, size, marked, several = None, [], 0, False, True
        for batch in batches:
            for conv, no_turn, turn, digest, id_, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", *_PLACE, "role", "text")), strict=True):
                if role is None:
                    marked = True
                    continue
                fresh = piece is None or conv != piece.conv
                if fresh or len(piece.codes) >= c.piece_rows or piece.bytes + len(text) > c.piece_bytes:
                    if piece is not None:
                        # whole in this task, as other conversations lie before and behind it
                        out.append(piece.row(fresh and not several))
                        size += piece.bytes
                    several = piece is None or not fresh
                    piece = _Piece(conv, (no_turn, turn, digest, id_), fresh)
                piece.add(None if no_turn == 0 else turn, role, text, marked)
                marked = False
                if size > c.piece_bytes or len(out) > 10_000:
                    yield _out(out, schema)
                    out, size = [], 0
        if piece is not None:
            out.append(piece.row(False))
        yield _out(out, schema)

    return cut


END_COSTS, END_AUDITS = (0, 2 * INSERT_COST, INSERT_COST, 0), ("", "II", "I", "")


def _exits(schema: pa.Schema):
    """Pieces of a conversation from its last to its first: each one's best exit by entry."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, after, begun = None, None, False
        for batch in batches:
            rows = []
            for own, *place, costs, ranks in zip(*(batch.column(n).to_pylist() for n in ("conv_id", *_PLACE, "costs", "ranks")), strict=True):
                last = not begun or own != conv
                if last:
                    conv, after, begun = own, END_COSTS, True
                ways = [[(costs[4 * q + p] + after[p], ranks[4 * q + p], p) for p in range(4) if costs[4 * q + p] >= 0] for q in range(4)]
                rows.append((own, *place, last, [min(w)[2] if w else -1 for w in ways]))
                after = [min(w)[0] if w else 1 << 60 for w in ways]
            yield _out(rows, schema)

    return walk


def _entries(schema: pa.Schema):
    """The same pieces from the first to the last: the state in which each one is entered and left."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, START, False
        for batch in batches:
            rows = []
            for own, id_, last, exits in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "id", "ends", "exits")), strict=True):
                if not begun or own != conv:
                    conv, state, begun = own, START, True
                rows.append((id_, state, exits[state], last))
                state = exits[state]
            yield _out(rows, schema)

    return walk


def _assemble(schema: pa.Schema):
    """Each piece between its states: cost, audit, and its repaired rows in one string."""

    def solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                cost, audit = solve(x["codes"], x["entry"], x["leave"])
                repaired, state = lines(audit, x["entry"], x["roles"], x["bodies"])
                if x["ends"]:
                    ending = END_AUDITS[state]
                    cost, audit, repaired = cost + END_COSTS[state], audit + ending, repaired + lines(ending, state, [], [])[0]
                rows.append((*(x[n] for n in schema.names[:-3]), cost, audit, "\n".join(repaired) if repaired else None))
            yield _out(rows, schema)

    return solved


def _join(schema: pa.Schema):
    """The pieces of a conversation in order to its one row."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, Any] | None = None

        def done() -> tuple:
            return (at["conv_id"], at["gaps"], *(at[n] for n in _COUNTS), at["cost"], "".join(at["audit"]), at["sha"].hexdigest())

        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if at is None or x["conv_id"] != at["conv_id"]:
                    if at is not None:
                        rows.append(done())
                    at = {"conv_id": x["conv_id"], "sha": hashlib.sha256(), "lines": False, "last": None, "least": None, "last_turn": None, "turns": 0, "gaps": 0, "audit": [], "cost": 0} | dict.fromkeys(_COUNTS, 0)
                for n in (*_COUNTS, "cost"):
                    at[n] += x[n]
                if at["last"] is not None and at["last"] + x["first"] not in RIGHT_PAIRS:
                    at["illegal"] += 1
                at["last"] = x["last"]
                if x["least"] is not None:
                    at["turns"] += x["turns"] - (x["least"] == at["last_turn"])
                    at["least"], at["last_turn"] = x["least"] if at["least"] is None else at["least"], x["most"]
                    at["gaps"] = at["last_turn"] - at["least"] + 1 - at["turns"]
                at["audit"].append(x["audit"])
                if x["repaired"] is not None:
                    at["sha"].update((b"\n" if at["lines"] else b"") + x["repaired"].encode())
                    at["lines"] = True
            yield _out(rows, schema)
        if at is not None:
            yield _out([done()], schema)

    return whole


def _arrow(df_schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], df_schema).schema)


def repair_conversations(conversations: DataFrame, c: Repair = Repair()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage.

    Rows count by turn, nulls first; those of one turn by a digest of role and text. Equal rows of a turn are repetitions but
    the first. A null conv_id is a conversation of its own; a null role or text is one space, so such a text is blank. Role
    initials are first code points; an empty role has none and fits no pair. Empty conversations and an empty table give zeros
    and no rows. Texts count whole, whatever their length; other columns are not read.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    folder = f"{shared_folder(spark)}/repair-{uuid.uuid4().hex}"
    conv = conversations.schema["conv_id"].dataType.simpleString()
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    placed = damage(conversations).select("conv_id", F.col("turn").isNotNull().cast("int").alias("no_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), digest.alias("digest"), F.monotonically_increasing_id().alias("id"), "role", "text")
    placed.write.option("compression", "zstd").parquet(f"{folder}/damaged")
    rows = spark.read.parquet(f"{folder}/damaged")
    place = F.struct("no_turn", "turn", "id")
    narrow = rows.select("conv_id", *_PLACE)
    again = narrow.groupBy("conv_id", "digest").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "earliest")
    marks = narrow.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))).where(place > F.col("earliest")).select("conv_id", *_PLACE, F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    dealt = rows.unionByName(marks).repartitionByRange("conv_id", *_PLACE).sortWithinPartitions("conv_id", *_PLACE, F.col("role").isNotNull())
    schema = _PIECE.format(conv=conv)
    dealt.mapInArrow(_cut(c, _arrow(schema, spark)), schema).write.option("compression", "zstd").parquet(f"{folder}/pieces")
    pieces = spark.read.parquet(f"{folder}/pieces")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    result = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = [x.split()[0] for x in result.split(", ")]
    alone = pieces.where("alone").withColumn("gaps", gaps).select(*names)
    cut = pieces.where("NOT alone")
    order = lambda down: [F.col("conv_id"), *[F.col(x).desc() if down else F.col(x) for x in _PLACE]]
    schema = f"conv_id {conv}, no_turn int, turn long, digest binary, id long, ends boolean, exits array<int>"
    exits = cut.select("conv_id", *_PLACE, "costs", "ranks").repartition("conv_id").sortWithinPartitions(*order(True)).mapInArrow(_exits(_arrow(schema, spark)), schema)
    schema = "id long, entry int, leave int, ends boolean"
    entries = exits.repartition("conv_id").sortWithinPartitions(*order(False)).mapInArrow(_entries(_arrow(schema, spark)), schema)
    schema = f"conv_id {conv}, no_turn int, turn long, digest binary, id long, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, cost long, audit string, repaired string"
    solved = cut.drop("cost", "audit", "repaired_sha256", "alone", "costs", "ranks").join(entries, "id").mapInArrow(_assemble(_arrow(schema, spark)), schema)
    joined = solved.repartition("conv_id").sortWithinPartitions(*order(False)).mapInArrow(_join(_arrow(result, spark)), result)
    found = alone.unionByName(joined).withColumnRenamed("conv_id", "_conv").withColumn("_found", F.lit(True))
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero: list[Column] = [F.coalesce(n, F.lit(0)).alias(n) for n in names[1:7]]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
