"""Conversation repair: the search against plain dynamic programming, the whole operator against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

import pytest

from gridfare.llm import queries, turn_repair

BLANKS = " \t\n\v\f\r"


def plain_repair(rows):
    """(cost, audit) by taking the least (cost, audit) of every rest, from the back; rows are (initial, doomed, truncated)."""
    legal = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @cache
    def best(at, read, inserts):
        found = [(0, "")] if at == len(rows) and read in (0, 3) else []
        if inserts:
            cost, audit = best(at, 3 if read == 2 else 2, inserts - 1)
            found.append((cost + 3, "I" + audit))
        if at < len(rows):
            initial, doomed, truncated = rows[at]
            cost, audit = best(at + 1, read, 2)
            found.append((cost + 4, "D" + audit))
            if not doomed:
                after = read if initial == "" else legal[read].get(initial)
                if after is not None:
                    cost, audit = best(at + 1, after, 2)
                    found.append((cost + 3 * truncated, "K" + audit))
                cost, audit = best(at + 1, 3 if read == 2 else 2, 2)
                found.append((cost + 3 + 3 * truncated, "R" + audit))
        return min(found, default=(10**9, ""))

    for at in range(len(rows), 0, -1):
        for read in range(4):
            best(at, read, 2)
    return best(0, 0, 2)


def plain(table):
    """The contract in plain Python, for (conv_id, turn, role, text) rows."""
    whole = defaultdict(list)
    for conv, turn, role, text in table:
        rows = whole[conv]
        role, text = (" " if v is None else v for v in (role, text))
        case = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if case == 1:
            text = ""
        elif case == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif case == 4:
            role = "user"
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(case, 1)
    out = {}
    for conv, rows in whole.items():
        digest = {r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest() for r in rows}
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest[r]))
        counts, seen, marks = [0, 0, 0], set(), []
        for _, role, text in rows:
            bare = text.rstrip(BLANKS)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marks.append((role[:1], fault in (0, 1), fault == 2))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit = plain_repair(tuple(marks))
        lines, left, read = [], list(rows), 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else left.pop(0)[1:]
            if edit == "D":
                continue
            if edit in "IR":
                role = "assistant" if read == 2 else "user"
            lines.append(f"{role}:{text}")
            read = {"s": 1, "u": 2, "a": 3}.get(role[:1], read)
        assert not left
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    rows = df.collect()
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(got) == len(rows)
    return got


def test_search_finds_the_least_of_the_cheapest():
    random.seed(5)
    for _ in range(400):
        rows = "".join(random.choice("!suaxeSUAXE") for _ in range(random.randrange(9)))
        marks = tuple(("" if r in "eE" else r.lower(), r == "!", r.isupper()) for r in rows)
        assert turn_repair.cheapest_repair(rows) == plain_repair(marks), rows


def test_bounds_never_exceed_the_cost():
    random.seed(6)
    for _ in range(300):
        rows = "".join(random.choice("!suaxeSUAXE") for _ in range(random.randrange(8)))
        assert turn_repair.lower_bounds(rows)[0] <= turn_repair.cheapest_repair(rows)[0]


def test_long_conversations_end_soon():
    rows = "".join(random.Random(1).choices("uaUA!s", k=5_000))
    cost, audit = turn_repair.cheapest_repair(rows)
    assert len(audit) - audit.count("I") == len(rows)
    assert cost == 4 * audit.count("D") + 3 * (audit.count("I") + audit.count("R")) + 3 * sum(
        row.isupper() and edit != "D" for row, edit in zip(rows, audit.replace("I", ""))
    )


def test_query_equals_plain_python(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()]
    assert found(queries.QUERIES["op13_turn_repair"](spark, sf)) == plain(rows)


@pytest.fixture
def odd_turns():
    """Nulls everywhere, empty roles, other roles, repeated rows, equal turns, one long and one repetitive conversation."""
    rows = [
        (None, 0, "user", "No id."), (None, 1, "assistant", "Still none."), (1, None, None, None), (1, None, "user", "x"), (2, 5, "", "Empty role."),
        (2, 6, "user", "Hi?"), (2, 7, "tool", "Out!"), (2, 9, "assistant", "Yes \t\n"), (3, 1, "user", ""), (4, 1, "user", "one. \x85"),
        (5, 1, "system", "Be kind."), (5, 1, "system", "Be kind."), (5, 2, "user", "Go."), (5, 2, "assistant", "Gone."), (5, 2, "assistant", "Gone."),
    ]
    rows += [(6, t, "user" if t % 2 else "assistant", f"Turn {t}." if t % 7 else "Again.") for t in range(700)]
    rows += [(7, 3, "user", "Same.")] * 40 + [(8, t, "user", "Same.") for t in range(40)]
    rows += [(9, t, "assistant", " " * 50_000 + "x" * (t % 2)) for t in range(3)]
    rows += [(10 + t, 0, "assistant", "Alone.") for t in range(60)]
    return [(*r, "a", "b", "c") for r in rows]


def test_odd_conversations(spark, odd_turns):
    table = spark.createDataFrame(odd_turns, "conv_id long, turn long, role string, text string, copies string, audit string, digest string")
    got, expected = found(turn_repair.repair_conversations(table)), plain([r[:4] for r in odd_turns])
    assert got == expected
    dropped = [v for v in expected.values() if v[6] == "" and v[5] == 0]
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in dropped


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    rows = turn_repair.repair_conversations(empty)
    assert rows.collect() == [] and rows.columns == ["conv_id", *COLUMNS]
