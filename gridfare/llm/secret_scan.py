"""Secrets: fixed patterns, and formats learned from what the patterns find.

The values that the patterns catch are labelled credentials. For each kind a bounded sample of different values builds a
prefix tree over character classes; states whose ending and branching frequencies agree within Hoeffding's bound are
merged, which leaves a small probabilistic automaton of the format. Another one learns from the remaining runs of the same
alphabet, and from what is left of a run beside the patterns' spans. Every such run of every text is then scored: how much likelier is it under a credential format than as an
ordinary run? Runs that pass are added as spans of kind ``format``; spans of the patterns always stay.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from gridfare.llm.columns import keyed_text
from gridfare.session import scratch_path

KINDS = ("assign", "access", "hex", "format")
#: The words before an assigned secret, and the patterns.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Shapes whose verdict a task keeps.
HELD_SHAPES = 100_000

SAMPLE_PER_KIND, LONGEST_SAMPLED, ALPHA, FLOOR, ODDS = 400, 128, 0.05, 1e-4, math.log(99)
SALTS = 64

Span = tuple[str, int, int]


def base_spans(text: str) -> tuple[list[Span], list[tuple[str, str]], list[tuple[int, int]]]:
    """(spans of the patterns, (kind, value) of each, other runs of the alphabet, of ``ASSIGN_LEAST`` characters or more).

    Matches are the leftmost ones that do not overlap within a kind; those too short are dropped afterwards. Access keys and
    hexadecimal strings that are long enough lie inside a run, so only runs are searched for them. Spans are cut out of a run,
    and each part that is left and long enough counts as a run.
    """
    spans: list[Span] = []
    values: list[tuple[str, str]] = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        for match in ASSIGN.finditer(text):
            if len(match[2]) >= ASSIGN_LEAST:
                spans.append(("assign", match.start(), match.end()))
                values.append(("assign", match[2]))
    others: list[tuple[int, int]] = []
    runs = [match.span() for match in RUN.finditer(text)]
    for begin, end in runs:
        for kind, pattern, least in (("access", ACCESS, ACCESS_LEAST), ("hex", HEX, HEX_LEAST)):
            for match in pattern.finditer(text, begin, end):
                if match.end() - match.start() >= least:
                    spans.append((kind, match.start(), match.end()))
                    values.append((kind, match[0]))
    spans.sort(key=lambda span: (span[1], KINDS.index(span[0])))
    covered = at = 0
    for begin, end in runs:
        start = max(begin, covered)
        while at < len(spans) and spans[at][1] < end:
            if spans[at][1] - start >= ASSIGN_LEAST:
                others.append((start, spans[at][1]))
            covered = max(covered, spans[at][2])
            start = max(start, covered)
            at += 1
        if end - start >= ASSIGN_LEAST:
            others.append((start, end))
    return spans, values, others


def shape(value: str) -> str:
    """Character classes: letters that can be hexadecimal and others, by case; digits; signs stand for themselves."""
    return value.translate(_CLASSES)


_CLASSES = {
    **{ord(c): "h" for c in "abcdef"}, **{ord(c): "l" for c in "ghijklmnopqrstuvwxyz"}, **{ord(c): "H" for c in "ABCDEF"},
    **{ord(c): "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}, **{ord(c): "0" for c in "0123456789"},
}


@dataclass
class State:
    seen: int = 0
    ended: int = 0
    next: dict[str, int] = field(default_factory=dict)
    taken: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton over strings, from a prefix tree whose compatible states are merged."""

    def __init__(self, strings: Iterable[str], alpha: float = ALPHA) -> None:
        self.states = [State()]
        for string in sorted(strings):
            self._count(string)
        self._width = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _count(self, string: str) -> None:
        at = self.states[0]
        at.seen += 1
        for sign in string:
            if sign not in at.next:
                at.next[sign] = len(self.states)
                self.states.append(State())
            at.taken[sign] = at.taken.get(sign, 0) + 1
            at = self.states[at.next[sign]]
            at.seen += 1
        at.ended += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._width * (n1**-0.5 + n2**-0.5)

    def _compatible(self, red: int, blue: int) -> bool:
        waiting = [(red, blue)]
        while waiting:
            one, two = (self.states[i] for i in waiting.pop())
            if self._differ(one.ended, one.seen, two.ended, two.seen):
                return False
            for sign in one.taken.keys() | two.taken.keys():
                if self._differ(one.taken.get(sign, 0), one.seen, two.taken.get(sign, 0), two.seen):
                    return False
                if sign in one.next and sign in two.next:
                    waiting.append((one.next[sign], two.next[sign]))
        return True

    def _fold(self, red: int, blue: int) -> list[tuple[int, str]]:
        """Add the tree below ``blue`` to ``red``; the edges that are new to a state."""
        waiting, grown = [(red, blue)], []
        while waiting:
            home, other = waiting.pop()
            one, two = self.states[home], self.states[other]
            one.seen += two.seen
            one.ended += two.ended
            for sign, count in two.taken.items():
                one.taken[sign] = one.taken.get(sign, 0) + count
                if sign in one.next:
                    waiting.append((one.next[sign], two.next[sign]))
                else:
                    one.next[sign] = two.next[sign]
                    grown.append((home, sign))
        return grown

    def _merge(self) -> None:
        """Settle states breadth first: each is folded into the first settled state it agrees with, or settles itself."""
        settled = [0]
        edges = deque((0, sign) for sign in sorted(self.states[0].next))
        known = {0}
        while edges:
            source, sign = edges.popleft()
            blue = self.states[source].next.get(sign)
            if blue is None or blue in known:
                continue
            home = next((red for red in settled if self._compatible(red, blue)), None)
            if home is None:
                settled.append(blue)
                known.add(blue)
                edges += [(blue, other) for other in sorted(self.states[blue].next)]
            else:
                self.states[source].next[sign] = home
                edges += [(state, other) for state, other in self._fold(home, blue) if state in known]
        places = {state: place for place, state in enumerate(settled)}
        self.states = [self.states[state] for state in settled]
        self.table = [
            (
                math.log(max(state.ended / max(state.seen, 1), FLOOR)),
                {sign: (places[state.next[sign]], math.log(count / state.seen)) for sign, count in state.taken.items()},
            )
            for state in self.states
        ]

    def log_likelihood(self, string: str) -> float:
        """Log-probability of a string; a step never seen costs the floor and keeps the state."""
        at, total, unseen = 0, 0.0, math.log(FLOOR)
        for sign in string:
            step = self.table[at][1].get(sign)
            if step is None:
                total += unseen
            else:
                at = step[0]
                total += step[1]
        return total + self.table[at][0]


@dataclass
class Formats:
    """Automata of the credential kinds and of ordinary runs, and the log odds that a run is a credential."""

    kinds: dict[str, list]
    ordinary: list | None
    prior: float
    _held: dict[str, bool] = field(default_factory=dict, repr=False)

    def accepts(self, value: str) -> bool:
        if not self.kinds or self.ordinary is None:
            return False
        string = shape(value)
        verdict = self._held.get(string)
        if verdict is None:
            best = max(_likelihood(table, string) for table in self.kinds.values())
            verdict = best - _likelihood(self.ordinary, string) + self.prior >= ODDS
            if len(string) <= LONGEST_SAMPLED:
                if len(self._held) >= HELD_SHAPES:
                    self._held.clear()
                self._held[string] = verdict
        return verdict


def _likelihood(table: list, string: str) -> float:
    automaton = Automaton.__new__(Automaton)
    automaton.table = table
    return automaton.log_likelihood(string)


def find_spans(text: str, formats: Formats) -> list[Span]:
    spans, _, others = base_spans(text)
    added = [("format", begin, end) for begin, end in others if formats.accepts(text[begin:end])]
    return sorted(spans + added, key=lambda span: (span[1], KINDS.index(span[0]))) if added else spans


def _labelled(text: Column) -> Column:
    @arrow_udf("array<struct<kind:string,value:string>>")
    def values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                _, found, others = base_spans(text or "")
                different = dict.fromkeys([*found, *(("ordinary", text[a:b]) for a, b in others)])
                out.append([{"kind": k, "value": v} for k, v in different])
            yield pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))

    return values(text)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_PER_KIND) -> Formats:
    """Learn the formats: at most ``sample`` different values of a kind, those of smallest hash, build its automaton.

    Counts behind the prior cover all different values of the corpus; long ones build no automaton and are told apart by their
    SHA-256. Without a credential or without an ordinary run nothing is added.
    """
    found = keyed_text(docs, id_col, text_col).select(F.explode(_labelled(F.col("text"))).alias("v")).select("v.kind", "v.value")
    short = F.length("value") <= LONGEST_SAMPLED
    different = found.select("kind", short.alias("short"), F.when(short, F.col("value")).otherwise(F.sha2("value", 256)).alias("value")).distinct()
    # Texts are scanned once: the sample and the counts read what is written here.
    path = scratch_path(docs.sparkSession, "secret-values")
    different.write.parquet(path)
    distinct = docs.sparkSession.read.parquet(path)
    # The least of each salt, then the least of these: no task sees more than a sample from every salt.
    order = (F.xxhash64("value"), "value")
    salted = distinct.where("short").withColumn("salt", F.crc32(F.col("value").cast("binary")) % SALTS)
    for keys in (["kind", "salt"], ["kind"]):
        place = Window.partitionBy(*keys).orderBy(*order)
        salted = salted.withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample)
    taken = salted
    by_kind: dict[str, list[str]] = {}
    for row in taken.select("kind", "value").collect():
        by_kind.setdefault(row["kind"], []).append(shape(row["value"]))
    ordinary = by_kind.pop("ordinary", None)
    if not by_kind or not ordinary:
        return Formats({}, None, 0.0)
    counts = {row["kind"]: row["count"] for row in distinct.groupBy("kind").count().collect()}
    credentials = sum(count for kind, count in counts.items() if kind != "ordinary")
    prior = math.log(credentials / counts["ordinary"])
    return Formats({kind: Automaton(own).table for kind, own in sorted(by_kind.items())}, Automaton(ordinary).table, prior)


def spans(text: Column, formats: Formats) -> Column:
    """array<struct<kind, start, end>> of a text column, in code points, by start and then kind."""

    @arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [find_spans(text or "", formats) for text in batch.to_pylist()]
            yield pa.array([[dict(zip(("kind", "start", "end"), span)) for span in own] for own in found], kind)

    return scan(text)


def _listed(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan_documents(docs: DataFrame, formats: Formats, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format) of every row; null texts are empty."""
    found = keyed_text(docs, id_col, text_col).select("doc_id", spans(F.col("text"), formats).alias("found"))
    base = F.filter("found", lambda s: s["kind"] != "format")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        count("format"),
    )


def mask(text: Column, formats: Formats, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans are replaced once. Null stays null."""

    @arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                parts, done = [], 0
                for _, begin, end in find_spans(text or "", formats):
                    if begin >= done:
                        parts += [text[done:begin], mark]
                    done = max(done, end)
                out.append(text if not parts else "".join(parts) + text[done:])
            yield pa.array(out, pa.string())

    return masked(text)
