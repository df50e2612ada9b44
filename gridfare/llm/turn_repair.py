"""Conversation repair: the cheapest edits that make the roles of a conversation alternate.

A repaired conversation is empty, or an optional system turn followed by user and assistant turns in turn. Keeping a row is
free, giving it another role costs 3, deleting it 4, inserting an empty turn 3, and a truncated row that stays costs 3 more;
blank and duplicate rows must go. The edits are found by iterative-deepening A*: a depth-first search in the order of the
edits' initials (Delete, Insert, Keep, Rerole) under a growing bound on the cost, so the first accepting path is the answer,
of all cheapest ones the least in that order. A table keeps for each state, a row number and what the grammar has read, how
dear its rest is at least: states that have failed are not entered again until the bound allows for more than that.

Texts move once, to be hashed in order. The search sees one character a row: rows are narrowed to a digest and what their
text ends in, equal rows are counted before they move, and the first row of a role and text is found by an aggregate. Rows of
a conversation then pass its task in order, one batch at a time. What a task holds of a conversation is that character, the
edit and five numbers a row; the digest of the repaired conversation is sequential by definition.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What the grammar has read: nothing, the system turn, a user turn, an assistant turn. The next turn after each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ACCEPTING = (NOTHING, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A row in the search: ``!`` must be deleted; otherwise the initial of its role, ``x`` for any other and ``e`` for an empty
#: role; upper case if truncated.
DOOMED = "!"
LEGAL_PAIRS = ("su", "ua", "au")
#: Rows of a segment whose cost is bounded from below.
SEGMENT = 12
#: Searches a task remembers, and the longest conversation remembered.
HELD, HELD_ROWS = 50_000, 64

_UNREACHED = 1 << 30


def _kept(state: int, kind: str) -> int | None:
    """The state after a kept row, or None where the grammar has no place for it."""
    if kind == "e":
        return state
    if kind == "s":
        return SYSTEM if state == NOTHING else None
    if kind == "u":
        return USER if state != USER else None
    return ASSISTANT if kind == "a" and state == USER else None


def _crossings() -> dict[str, list[list[int]]]:
    """For each kind of row the least cost from what was read before it to what is read after it, turns before it included."""
    table = {}
    for row in "!suaxeSUAXE":
        costs = [[_UNREACHED] * 4 for _ in range(4)]
        for start in range(4):
            read, inserted = start, 0
            for _ in range(4):
                moves = [(DELETE, read)]
                if row != DOOMED:
                    stays, after = (TRUNCATED if row.isupper() else 0), _kept(read, row.lower())
                    moves.append((REROLE + stays, NEXT[read]))
                    if after is not None:
                        moves.append((KEEP + stays, after))
                for cost, after in moves:
                    costs[start][after] = min(costs[start][after], inserted + cost)
                read, inserted = NEXT[read], inserted + INSERT
        table[row] = costs
    return table


_CROSSINGS = _crossings()
_ARRIVALS = {row: list(zip(*costs)) for row, costs in _CROSSINGS.items()}
#: What is missing at the end: a user and an assistant turn, or an assistant turn.
_MISSING = (0, 2 * INSERT, INSERT, 0)


def lower_bounds(rows: str, segment: int = SEGMENT) -> array:
    """For each state ``4 * row + read`` a cost that its rest has at least.

    Rows are cut into segments of at most ``segment``, each entered and left as is cheapest for itself; the dearest cut counts.
    """
    size = len(rows)
    rest = [0] * (size + 1)
    bounds = array("q", bytes(32 * (size + 1)))
    bounds[4 * size :] = array("q", _MISSING)
    for at in range(size - 1, -1, -1):
        costs, least = [0] * 4, 0
        for end in range(at, min(at + segment, size)):
            costs = [min(map(int.__add__, costs, arrival)) for arrival in _ARRIVALS[rows[end]]]
            through = min(costs) + rest[end + 1] if end + 1 < size else min(map(int.__add__, costs, _MISSING))
            least = max(least, through)
        rest[at] = least
        for read in range(4):
            follows = bounds[4 * at + 4 + read] if rows[at] == DOOMED else rest[at + 1]
            bounds[4 * at + read] = max(least, min(_CROSSINGS[rows[at]][read]) + follows)
    return bounds


def _edits(rows: str, node: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits of a state, in the order of their initials."""
    at, read = divmod(node, 4)
    if at == len(rows):
        yield "I", INSERT, node - read + NEXT[read]
        return
    row = rows[at]
    yield "D", DELETE, node + 4
    yield "I", INSERT, node - read + NEXT[read]
    if row != DOOMED:
        stays = TRUNCATED if row.isupper() else 0
        after = _kept(read, row.lower())
        if after is not None:
            yield "K", KEEP + stays, node + 4 - read + after
        yield "R", REROLE + stays, node + 4 - read + NEXT[read]


def cheapest_repair(rows: str) -> tuple[int, str]:
    """(cost, edits' initials) of the cheapest repair; among equal ones the least string."""
    bounds = lower_bounds(rows)
    ends = [4 * len(rows) + read for read in ACCEPTING]
    while True:
        limit = bounds[NOTHING]
        path = _within(rows, bounds, ends, limit)
        if path is not None:
            return limit, path


def _within(rows: str, bounds: array, ends: list[int], limit: int) -> str | None:
    """The first accepting path of at most ``limit``, depth first; a state that fails learns what its rest costs at least."""
    if NOTHING in ends:
        return ""
    path: list[str] = []
    stack = [[NOTHING, limit, _edits(rows, NOTHING), _UNREACHED, 0]]
    while stack:
        frame = stack[-1]
        for initial, cost, child in frame[2]:
            left = frame[1] - cost
            if bounds[child] > left:
                frame[3] = min(frame[3], cost + bounds[child])
                continue
            path.append(initial)
            if child in ends:
                return "".join(path)
            stack.append([child, left, _edits(rows, child), _UNREACHED, cost])
            break
        else:
            node, _, _, least, cost = stack.pop()
            bounds[node] = max(bounds[node], least)
            if stack:
                path.pop()
                stack[-1][3] = min(stack[-1][3], cost + bounds[node])
    return None


# ---- rows ----


def damaged(conversations: DataFrame, *, cases: int = 20) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage that the CRC-32 of ``conv_id:turn`` decides.

    Of ``cases`` remainders 0 drops the row (``copies`` 0, its text is left out), 1 empties its text, 2 removes the signs that
    end sentences, 3 repeats it, 4 makes it the user's. Null role, text and parts of the key count as one space.
    """
    blank = F.lit(" ")
    where = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    source = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        (F.crc32(where.cast("binary")) % cases).alias("case"),
    )
    case = F.col("case")
    text = F.when(case.isin(0, 1), "").when(case == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(case == 0, "").when(case == 4, "user").otherwise(F.col("role"))
    copies = F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
    return source.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def _narrow(rows: DataFrame) -> DataFrame:
    """Rows without their text: its digest together with the role, and whether it is blank or truncated."""
    bare = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    return rows.select("conv_id", "turn", "role", "copies", _digest().alias("digest"), F.right(bare, F.lit(1)).alias("ends"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ORDER = ("turn", "role", "digest")


class _Conversation:
    """What is gathered of a conversation while its rows pass in order."""

    def __init__(self) -> None:
        self.rows = bytearray()
        self.first = self.last = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, ends: str, copies: int, repeated: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        initial = role[:1]
        self.illegal += (self.initial is not None and self.initial + initial not in LEGAL_PAIRS) + copies - 1
        self.initial = initial
        doomed = copies if repeated else copies - 1
        if not ends:
            self.blank += copies
            doomed = copies
        else:
            self.duplicate += doomed
        if doomed < copies:
            kind = "e" if not initial else initial if initial in "sua" else "x"
            if ends not in ".!?":
                self.truncated += 1
                kind = kind.upper()
            self.rows += kind.encode()
        self.rows += DOOMED.encode() * doomed

    def result(self, held: dict[str, tuple[int, str]]) -> tuple:
        rows = self.rows.decode()
        found = held.get(rows)
        if found is None:
            found = cheapest_repair(rows)
            if len(rows) <= HELD_ROWS:
                if len(held) >= HELD:
                    held.clear()
                held[rows] = found
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *found


_KEY = pa.field("conv_id", pa.string())
_FOUND_ARROW = pa.schema([_KEY, *[pa.field(c, pa.int64()) for c in _COUNTS], pa.field("audit", pa.string())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its rows in order; partitions hold whole conversations."""
    held: dict[str, tuple[int, str]] = {}
    now, gathered, out = None, None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "ends", "copies", "repeated")]
        for key, *row in zip(*columns):
            if gathered is None or key != now:
                if gathered is not None:
                    out.append((now, *gathered.result(held)))
                now, gathered = key, _Conversation()
            gathered.add(*row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND_ARROW)], schema=_FOUND_ARROW)
            out = []
    if gathered is not None:
        out = [(now, *gathered.result(held))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND_ARROW)], schema=_FOUND_ARROW)


class _Rewriter:
    """Hashes a repaired conversation while its rows pass."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.read = audit, 0, NOTHING
        self.digest, self.started = hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.started else ''}{role}:{text}".encode())
        self.started = True

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.read = NEXT[self.read]
            self._write(ROLES[self.read], "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self.insert()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.read = _kept(self.read, role[:1] or "e")
                self._write(role, text)
            elif edit == "R":
                self.read = NEXT[self.read]
                self._write(ROLES[self.read], text)

    def result(self) -> str:
        self.insert()
        return self.digest.hexdigest()


_REPAIRED_ARROW = pa.schema([*_FOUND_ARROW, pa.field("repaired_sha256", pa.string())])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digest to what was found of a conversation: that row comes first, its rows follow in order."""
    head, writer, out = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if head is not None:
                    out.append((*head, writer.result()))
                head, writer = [row[c] for c in _FOUND_ARROW.names], _Rewriter(row["audit"])
            else:
                writer.row(row["role"], row["text"], row["copies"])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _REPAIRED_ARROW)], schema=_REPAIRED_ARROW)
            out = []
    if head is not None:
        out = [(*head, writer.result())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _REPAIRED_ARROW)], schema=_REPAIRED_ARROW)


def find_repairs(rows: DataFrame) -> DataFrame:
    """(conv_id as text, counts, cost, audit) of the conversations of ``damaged`` rows."""
    narrow = _narrow(rows)
    counted = narrow.groupBy("conv_id", "turn", "role", "digest", "ends").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    earliest = counted.where("copies > 0").groupBy("conv_id", "digest").agg(F.min(place).alias("first"))
    met = earliest.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), F.col("first").alias("_first"))
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    marked = counted.join(met, here, "left").select(
        F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "digest", "ends", "copies",
        F.coalesce(place > F.col("_first"), F.lit(False)).alias("repeated"),
    )
    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    return ordered.mapInArrow(_search, "conv_id string, " + FOUND)


def repair_conversations(conversations: DataFrame, *, cases: int = 20) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text) rows after ``damaged``.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows go by turn, null turns first;
    equal turns by role, then by the digest of role and text. A null conv_id is one conversation. A row with an empty role
    adds nothing to the roles: it may stay anywhere, but every pair it is part of is illegal. Repeated rows are rows, and all
    but the first are duplicates. A conversation without rows after damage has zeros, no edits and the digest of nothing; an
    empty table gives no rows. Further columns are not read.
    """
    kind = conversations.schema["conv_id"].dataType
    rows = damaged(conversations, cases=cases)
    found = find_repairs(rows)
    texts = rows.where("copies > 0").select(
        F.col("conv_id").cast("string").alias("conv_id"),
        *[F.lit(None).cast("long").alias(c) for c in _COUNTS],
        F.lit(None).cast("string").alias("audit"),
        "turn", "role", "text", "copies", _digest().alias("digest"),
    )
    heads = found.select(
        "*", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.lit(0).cast("long").alias("copies"), F.lit(b"").alias("digest"),
    )
    passing = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_ORDER)
    done = passing.drop("digest", "turn").mapInArrow(_rewrite, f"conv_id string, {FOUND}, repaired_sha256 string")
    return done.withColumn("conv_id", F.col("conv_id").cast(kind))
