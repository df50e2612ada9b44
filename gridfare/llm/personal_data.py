"""Personal data: fixed patterns, and further spans found by weak supervision. DataFrame functions only.

Four fixed patterns give the base spans, which always stay. Candidates are their matches, valid or not, and what a looser
pattern finds: obscured addresses, national numbers, accounts, names after a title. Four labelers vote on each candidate for,
against, or not at all: its format (regular expressions and check digits), gazetteers (top-level domains, calling codes, card
issuers, countries, given names), the words before it, and the characters beside it. Candidates are counted by kind, votes and
number of digits, of which there are at most ``8 * 3**4 * 4`` different ones; that table is all the driver sees. Expectation
maximisation estimates how reliable each labeler is, for personal and for other candidates, and how common personal ones are
among each kind; a logistic regression on kind, votes and digits then learns from the resulting probabilities. It decides which
of the loose candidates become spans.

A match's place is the sum of the lengths before it: a text is split by a pattern and its matches extracted, so no position is
searched for. Patterns start a match only where a run starts and never give back what they have taken, so long runs of letters
or digits cost time in proportion to their length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfare.llm.columns import keyed_text

BASE, LOOSE = ("email", "ip", "card", "phone"), ("contact", "number", "account", "name")
KINDS = (*BASE, *LOOSE)
LABELERS = ("format", "gazetteer", "words", "neighbours")
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: The base patterns, and what a text must hold to be searched for one. A match may also start where the last one ended.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Titles before a name; gazetteers; words that speak for or against personal data, in four languages.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Monsieur", "Madame", "Mme")
DOMAINS = (
    "com", "org", "net", "edu", "gov", "info", "io", "co", "me", "eu", "us", "uk", "de", "at", "ch", "fr", "be", "es", "mx", "ar", "it", "nl", "pt", "br", "pl", "se", "ca", "au", "in", "jp",
)
CALLING_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "64", "65", "81", "82", "86", "90", "91",
)
ACCOUNT_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
GIVEN_NAMES = (
    "James", "John", "Robert", "Michael", "David", "William", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Emma", "Olivia", "Hans", "Peter", "Klaus", "Thomas", "Anna", "Sabine", "Claudia",
    "Jean", "Pierre", "Michel", "Marie", "Sophie", "Claire", "José", "Juan", "Carlos", "Luis", "María", "Carmen", "Ana", "Laura",
)
CUES = (
    "tel", "phone", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "mail", "email", "e-mail", "contact", "write", "reach", "ssn", "iban", "account", "card", "visa", "name", "address", "telefon", "handy",
    "anruf", "konto", "karte", "kontakt", "téléphone", "appelez", "portable", "courriel", "compte", "teléfono", "móvil", "llame", "correo", "cuenta", "tarjeta",
)
COUNTER_CUES = (
    "version", "ver", "v", "release", "build", "page", "pages", "chapter", "section", "figure", "table", "isbn", "issn", "doi", "sku", "item", "part", "article", "model", "serial", "order", "invoice", "seite", "kapitel",
    "artikel", "página", "capítulo", "chapitre", "date", "year", "usd", "eur", "gbp", "price",
)

_NOT_IN_WORD = r"(?<![\p{L}0-9])"
_OBSCURED = rf"{_NOT_IN_WORD}{_LOCAL}{{1,64}}+\x20?[(\[](?:at|AT|@)[)\]]\x20?{_LABEL}{{1,63}}+(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?){_LABEL}{{1,63}}+){{1,4}}+"
_NUMBER = r"(?<![\p{L}0-9.+-])(?:\([0-9]{2,4}\)[\x20-]?|[0-9]{2,4}[\x20.-])[0-9]{2,4}(?:[\x20.-][0-9]{2,5}){1,3}+(?![\p{L}0-9])"
_ACCOUNT = rf"{_NOT_IN_WORD}[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+(?:\x20?[A-Z0-9]{{1,3}})?(?![\p{{L}}0-9])"
_NAME = rf"{_NOT_IN_WORD}(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}\p{{Ll}}{{1,30}}+(?:\x20\p{{Lu}}\p{{Ll}}{{1,30}}+){{0,2}}+"
#: Loose candidates; the strict address and international number come first, so that no candidate starts inside one.
LOOSE_PATTERN = f"{PATTERNS['email']}|{PATTERNS['phone']}|{_OBSCURED}|{_ACCOUNT}|{_NAME}|{_NUMBER}"
_LOOSE_NEEDS = rf"[(\[](?:at|AT|@)[)\]]|[0-9][\x20.)-]|[A-Z]{{2}}[0-9]{{2}}|(?:{'|'.join(TITLES)})\.?\x20"
#: Characters before a match that labelers see, and matches whose places are added up in one go.
CONTEXT, BLOCK = 40, 256
THRESHOLD = 0.8


def _words(values: tuple[str, ...]) -> str:
    return "(?:" + "|".join(value.replace("-", r"\-") for value in values) + ")"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


# ---- matches ----


def _hits(rows: DataFrame, pattern: str, needs: str, into: str) -> DataFrame:
    """Add an array of (n characters since the last match, tail of them, match, head of what follows)."""
    cut = rows.withColumns({
        "_searched": F.when(F.col("text").rlike(needs), F.col("text")).otherwise(""),
    }).withColumns({
        "_pieces": F.transform(F.split("_searched", pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(CONTEXT)).alias("tail"), F.left(p, F.lit(1)).alias("head"))),
        "_found": F.regexp_extract_all("_searched", F.lit(pattern), F.lit(0)),
    })
    before, after = F.slice("_pieces", 1, F.size("_found")), F.slice("_pieces", 2, F.size("_found") + 1)
    joined = F.zip_with(F.zip_with(before, "_found", lambda p, m: F.struct(p["n"].alias("n"), p["tail"].alias("tail"), m.alias("match"))), after, _with_head)
    return cut.withColumn(into, joined).drop("_searched", "_pieces", "_found")


def _with_head(hit: Column, piece: Column) -> Column:
    return F.struct(hit["n"].alias("n"), hit["tail"].alias("tail"), hit["match"].alias("match"), piece["head"].alias("head"))


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern is a span."""
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "email":
        return F.lit(True)
    digits = _digits(match)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def _located(hits: Column) -> Column:
    """(start, place, end, kind) of the hits that are ``ok``, from an array of (n, size, ok, kind)."""
    spot = "struct<start:long,place:int,end:long,kind:string>"
    none = F.array().cast(f"array<{spot}>")

    def step(state: Column, hit: Column) -> Column:
        start = state["at"] + hit["n"]
        end = start + hit["size"]
        place = F.array_position(F.array(*map(F.lit, KINDS)), hit["kind"]).cast("int")
        span = F.array(F.struct(start.alias("start"), place.alias("place"), end.alias("end"), hit["kind"].alias("kind")))
        return F.struct(end.alias("at"), F.when(hit["ok"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def block(state: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(state["at"].alias("at"), none.alias("spans")), step)
        joined = F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(state["spans"], i["spans"]).alias("spans")))
        return F.element_at(joined, 1)

    starts = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(hits, b * BLOCK + 1, F.lit(BLOCK)))
    whole = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), block, lambda state: state["spans"])
    return F.when(F.size(hits) > 0, whole).otherwise(none)


# ---- labelers ----


def loose_kind(match: Column) -> Column:
    """The kind of a loose match; null for the strict ones, which are base candidates."""
    return (
        F.when(match.startswith("+"), None)
        .when(match.rlike(r"[(\[](?:at|AT|@)[)\]]"), "contact")
        .when(match.contains("@"), None)
        .when(match.rlike(r"^[A-Z]{2}[0-9]{2}"), "account")
        .when(match.rlike(r"^[(0-9]"), "number")
        .otherwise("name")
    )


def _account_rest(match: Column) -> Column:
    """The remainder by 97 of an account number, its first four signs last and letters as numbers from 10."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    signs = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")

    def add(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(sign == "", rest).when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(signs, F.lit(0), add)


def _vote(plus: Column, minus: Column) -> Column:
    return F.when(minus, -1).when(plus, 1).otherwise(0)


def format_vote(kind: Column, match: Column) -> Column:
    """Strict forms and check digits; dates, dotted quads and other groupings speak against a number."""
    no = F.lit(False)
    base = {k: _vote(valid(k, match), ~valid(k, match)) for k in BASE}
    plan = match.rlike(r"^(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^0[0-9](?:[\x20.][0-9]{2}){4}$|^\(?0[0-9]{2,4}")
    date = match.rlike(r"^(?:1[89]|20)[0-9]{2}[\x20.-][0-9]{2}[\x20.-][0-9]{2}$|^[0-9]{2}[\x20.-][0-9]{2}[\x20.-](?:1[89]|20)[0-9]{2}$|^[0-9]{4}(?:[\x20-][0-9]{4})+$|^[0-9]+(?:\.[0-9]+){3,}$")
    loose = {"contact": _vote(match.rlike(r"[A-Za-z]{2,}$"), no), "number": _vote(plan, date), "account": _vote(_account_rest(match) == 1, _account_rest(match) != 1)}
    return _by_kind(kind, {**base, **loose})


def gazetteer_vote(kind: Column, match: Column) -> Column:
    domain = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
    known = domain.isin(*DOMAINS)
    issuer = _digits(match).rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)")
    reserved = match.rlike(r"^(?:0|10|127|255|192\.168|169\.254|22[4-9]|2[34][0-9])\.")
    code = _digits(match).rlike(f"^{_words(CALLING_CODES)}")
    given = F.regexp_extract(match, r"\x20(\p{Lu}\p{Ll}+)", 1).isin(*GIVEN_NAMES)
    country = F.substring(match, 1, 2).isin(*ACCOUNT_COUNTRIES)
    no = F.lit(False)
    votes = {"email": (known, ~known), "contact": (known, ~known), "card": (issuer, ~issuer), "ip": (no, reserved), "phone": (code, ~code), "account": (country, ~country), "name": (given, no)}
    return _by_kind(kind, {k: _vote(*v) for k, v in votes.items()})


def words_vote(tail: Column) -> Column:
    """Words shortly before the candidate."""
    low = F.lower(tail)
    edge, end = r"(?:^|[^\p{L}])", r"(?:$|[^\p{L}])"
    return _vote(low.rlike(f"{edge}{_words(CUES)}{end}"), low.rlike(f"{edge}{_words(COUNTER_CUES)}{end}"))


def neighbours_vote(tail: Column, head: Column) -> Column:
    """Glued to letters, digits or signs of code on either side speaks against; a colon or bracket before it for."""
    glued = tail.rlike(r"[\p{L}0-9_/=#$€£%]$") | head.rlike(r"[\p{L}0-9_/=%]")
    return _vote(tail.rlike(r"[:(<]\x20?$"), glued)


def _by_kind(kind: Column, votes: dict[str, Column]) -> Column:
    whole = F.lit(0)
    for name, vote in votes.items():
        whole = F.when(kind == name, vote).otherwise(whole)
    return whole


def _digit_class(match: Column) -> Column:
    size = F.length(_digits(match))
    return F.when(size < 7, 0).when(size < 10, 1).when(size < 14, 2).otherwise(3)


def _evidence(kind: Column, hit: Column) -> dict[str, Column]:
    votes = (format_vote(kind, hit["match"]), gazetteer_vote(kind, hit["match"]), words_vote(hit["tail"]), neighbours_vote(hit["tail"], hit["head"]))
    return {**dict(zip(LABELERS, votes)), "digits": _digit_class(hit["match"])}


# ---- the model ----


def _searched(texts: DataFrame) -> DataFrame:
    for kind in BASE:
        texts = _hits(texts, PATTERNS[kind], _NEEDS[kind], f"_{kind}")
    return _hits(texts, LOOSE_PATTERN, _LOOSE_NEEDS, "_loose")


@dataclass
class Evidence:
    """Reliabilities and the final classifier.

    ``votes[j][y][v]`` is how often labeler j casts vote v - 1 on a candidate that is (y = 1) or is not (y = 0) personal,
    ``common[kind]`` the share of personal ones, ``weights`` the classifier's, by feature name.
    """

    votes: np.ndarray
    common: dict[str, float]
    weights: dict[str, float] = field(default_factory=dict)

    def log_odds(self, kind: Column, evidence: dict[str, Column]) -> Column:
        terms = [F.lit(self.weights.get("bias", 0.0)), *_lookups(self.weights, "kind", kind, KINDS)]
        for name, values in (*((labeler, (-1, 0, 1)) for labeler in LABELERS), ("digits", (0, 1, 2, 3))):
            terms += _lookups(self.weights, name, evidence[name], values)
        return reduce(lambda a, b: a + b, terms)


def _lookups(weights: dict[str, float], name: str, value: Column, values: tuple) -> list[Column]:
    return [F.when(value == v, F.lit(weights.get(f"{name}={v}", 0.0))).otherwise(0.0) for v in values]


def _tagged(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("hit")))


def vote_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates of all documents counted by kind, votes and digits."""
    found = _searched(keyed_text(docs, id_col, text_col))
    tagged = [_tagged(kind) for kind in BASE]
    loose = F.filter(F.transform("_loose", lambda h: F.struct(loose_kind(h["match"]).alias("kind"), h.alias("hit"))), lambda c: c["kind"].isNotNull())
    every = found.select(F.explode(F.concat(*tagged, loose)).alias("c")).select("c.kind", "c.hit")
    # Digit chains of any length match the card pattern; those as short as a number's groups are no candidates for a card.
    sized = every.where((F.col("kind") != "card") | (F.length(_digits(F.col("hit.match"))) >= 13))
    marks = {name: column.alias(name) for name, column in _evidence(F.col("kind"), F.col("hit")).items()}
    return sized.select("kind", *marks.values()).groupBy("kind", *marks).agg(F.count(F.lit(1)).alias("n"))


#: Votes a labeler is taken to have cast before any is seen, against, none and for: on other candidates, on personal ones.
PRIOR_VOTES = ((6.0, 3.0, 1.0), (1.0, 3.0, 6.0))


def reliabilities(rows: list[tuple], rounds: int = 60) -> tuple[Evidence, np.ndarray]:
    """Expectation maximisation over (kind, votes…, digits, n) rows; the model, and the chance of each row to be personal."""
    prior = np.array(PRIOR_VOTES)
    casts = np.array([[v + 1 for v in row[1:5]] for row in rows], np.int64).reshape(len(rows), 4)
    counts = np.array([row[6] for row in rows], float)
    kinds = np.array([KINDS.index(row[0]) for row in rows], np.int64)
    votes = np.tile(prior / prior.sum(axis=1, keepdims=True), (len(LABELERS), 1, 1))
    common = np.full(len(KINDS), 0.5)
    chance = np.zeros(len(rows))
    for _ in range(rounds):
        logs = np.log(np.stack([1 - common[kinds], common[kinds]]))
        for j in range(len(LABELERS)):
            logs += np.log(votes[j][:, casts[:, j]])
        chance = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        shares = np.stack([(1 - chance) * counts, chance * counts])
        for j in range(len(LABELERS)):
            seen = np.stack([np.bincount(casts[:, j], shares[y], 3) for y in (0, 1)]) + prior
            votes[j] = seen / seen.sum(axis=1, keepdims=True)
        personal, all_ = np.bincount(kinds, shares[1], len(KINDS)), np.bincount(kinds, counts, len(KINDS))
        common = (personal + 1) / (all_ + 2)
    return Evidence(votes, dict(zip(KINDS, common.tolist()))), chance


def _features(row: tuple) -> list[str]:
    return ["bias", f"kind={row[0]}", *(f"{labeler}={vote}" for labeler, vote in zip(LABELERS, row[1:5])), f"digits={row[5]}"]


def train(model: Evidence, rows: list[tuple], chance: np.ndarray, *, ridge: float = 0.1, steps: int = 30) -> None:
    """Logistic regression on the features of the rows, whose labels are probabilities and whose weights are counts, by Newton steps.

    Counts enter as their logarithm, so that a kind found often does not drown the others.
    """
    names = sorted({name for row in rows for name in _features(row)})
    at = {name: place for place, name in enumerate(names)}
    design = np.zeros((len(rows), len(names)))
    for place, row in enumerate(rows):
        design[place, [at[name] for name in _features(row)]] = 1
    mass = np.log1p([row[6] for row in rows])
    weights = np.zeros(len(names))
    for _ in range(steps):
        fitted = 1 / (1 + np.exp(-design @ weights))
        slope = design.T @ (mass * (fitted - chance)) + ridge * weights
        curve = (design * (mass * fitted * (1 - fitted))[:, None]).T @ design + ridge * np.eye(len(names))
        weights -= np.linalg.solve(curve, slope)
    model.weights = dict(zip(names, weights.tolist()))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Evidence:
    """Learn from the votes on all candidates of all documents; without any, nothing will be added."""
    table = vote_table(docs, id_col=id_col, text_col=text_col)
    rows = sorted(tuple(row) for row in table.collect())
    model, chance = reliabilities(rows)
    if rows:
        train(model, rows, chance)
    return model


# ---- spans ----


def _checked(kind: str) -> Column:
    def check(h: Column) -> Column:
        return F.struct(h["n"].alias("n"), F.length(h["match"]).alias("size"), valid(kind, h["match"]).alias("ok"), F.lit(kind).alias("kind"))

    return F.transform(f"_{kind}", check)


def find_spans(docs: DataFrame, model: Evidence, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base, added): arrays of (start, place of the kind, end, kind) of every row, in code points, by start and kind."""
    found = _searched(keyed_text(docs, id_col, text_col))
    checked = {f"_{kind}": _checked(kind) for kind in BASE}
    marked = F.transform("_loose", lambda h: F.struct(loose_kind(h["match"]).alias("kind"), h.alias("hit")))
    least = math.log(threshold / (1 - threshold))

    def judged(c: Column) -> Column:
        odds = model.log_odds(c["kind"], _evidence(c["kind"], c["hit"])) if model.weights else F.lit(-1.0)
        ok = F.when(c["kind"].isNull(), False).otherwise(odds >= least)
        return F.struct(c["hit"]["n"].alias("n"), F.length(c["hit"]["match"]).alias("size"), ok.alias("ok"), c["kind"].alias("kind"))

    judged_rows = found.withColumns({**checked, "_loose": marked}).withColumn("_loose", F.transform("_loose", judged))
    placed = judged_rows.select("doc_id", *[_located(F.col(f"_{kind}")).alias(kind) for kind in BASE], _located(F.col("_loose")).alias("loose"))
    both = placed.select("doc_id", F.array_sort(F.concat(*BASE)).alias("base"), "loose")
    apart = F.filter("loose", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return both.select("doc_id", "base", apart.alias("added"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan_documents(docs: DataFrame, model: Evidence, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    Null texts are empty; a text without spans has the digest of nothing and an empty list. Repeated rows are rows, and an
    empty table gives no rows. Only the two named columns are read. Added spans never overlap a base span.
    """
    found = find_spans(docs, model, id_col=id_col, text_col=text_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
