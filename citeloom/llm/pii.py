"""Personal data by weak supervision, with DataFrame functions only.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches of their patterns that pass
their checks; failing matches are dropped and not tried again. More candidates come from looser patterns (ssn,
iban, phones without a plus, spelled-out e-mail addresses) and from gazetteers (persons by given name or
title, postal addresses by street word). Three labelers vote on every candidate: its strict form (regex),
listed prefixes and names (gazetteer), and the words before it (context); a vote is yes, no or none.
Expectation-maximisation over counted votes estimates how reliable each labeler is and how likely each
vote pattern is right. A logistic span classifier learns these likelihoods from features of the span and
what surrounds it (length, share of digits, capital, characters on both sides, words before), not from
the votes of form and gazetteer, and decides about the extra candidates; base spans stay. What the driver
sees is counts of (kind, votes, features): 27 * 1,536 a kind at most, a few dozen in practice.

How positions are found: split() gives the pieces between matches and regexp_extract_all() the matches,
so running sums of their lengths are the offsets, in code points, ends exclusive. Patterns are written
so that no repeated group has to be tried again: inner dots and separators first become one private
character (U+E000; a text's own ones become U+E001, of the same length), which keeps time linear and
the matcher's stack flat on very long texts.

Null and empty texts have no spans. Rows are independent: repeated rows, null ids and extra columns
change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, text_or_empty

BASE = ("email", "ip", "card", "phone")
EXTRA = ("ssn", "iban", "local_phone", "spelled_email", "person", "address")
LABELERS = ("regex", "gazetteer", "context")
NO, NONE, YES = 0, 1, 2

MARK, OWN_MARK = "", ""
_LOCAL = "A-Za-z0-9._%+" + MARK + "-"

# The base patterns, in the form described above, and the looser ones.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{MARK}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+.()-])(?<![0-9)] )\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63} ?[\[(]dot[\])] ?[A-Za-z]{2,24}(?![A-Za-z])"

# Gazetteers. Given names and titles, street words before and after a name.
GIVEN_NAMES = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Mark", "Paul", "Steven", "Andrew", "George", "Peter", "Henry",
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Margaret", "Emily", "Anna", "Laura", "Emma", "Olivia", "Sophia", "Julia", "Alice",
    "Pierre", "Jean", "Michel", "Jacques", "Philippe", "Marie", "Nathalie", "Isabelle", "Sophie", "Camille", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Andreas", "Petra", "Sabine", "Monika", "Ursula",
    "José", "Juan", "Carlos", "Luis", "Miguel", "Javier", "Carmen", "María", "Ana", "Lucía",
)
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame")
STREETS_AFTER = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Drive", "Boulevard", "Court", "Square", "Terrace")
STREETS_BEFORE = ("rue", "avenue", "boulevard", "place", "Calle", "Avenida", "Plaza")
STREETS_JOINED = ("straße", "strasse", "weg", "platz", "allee", "gasse")
_NAME = r"\p{Lu}[\p{Ll}'-]{1,30}"
PERSON = rf"(?<![\p{{L}}])(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.? {_NAME}(?: {_NAME})?|(?:{'|'.join(GIVEN_NAMES)}) {_NAME})(?![\p{{L}}])"
ADDRESS = (
    rf"(?<![\p{{L}}0-9])(?:[0-9]{{1,5}} {_NAME}(?: {_NAME})? (?:{'|'.join(STREETS_AFTER)})"
    rf"|[0-9]{{1,4}},? (?:{'|'.join(STREETS_BEFORE)}) (?:de |du |des |la |le )?(?:la )?{_NAME}"
    rf"|(?:{'|'.join(STREETS_BEFORE)}) {_NAME},? [0-9]{{1,4}}"
    rf"|\p{{Lu}}\p{{Ll}}{{1,30}}(?:{'|'.join(STREETS_JOINED)}) [0-9]{{1,4}})(?![\p{{L}}0-9])"
)
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "de", "fr", "es", "uk", "it", "nl", "eu", "us", "ca", "ch", "at", "au", "jp", "br", "in")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "62", "64", "65", "81", "82", "86", "90", "91")
IBAN_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
NEAR = {
    "email": ("mail", "contact", "write", "address"), "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "debit", "mastercard"), "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "cell"), "spelled_email": ("mail", "contact", "write", "address"),
    "person": ("name", "contact", "author", "dear", "signed", "patient", "from", "by"), "address": ("address", "live", "ship", "send", "visit", "home", "located", "at"),
}
AWAY = ("order", "invoice", "version", "isbn", "part", "serial", "issue")
_WINDOW = 32
#: Matches whose offsets are summed together.
_RUN = 128

_SPAN = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body's lambdas name it."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str) -> Column:
    """start, end, value, the text shortly before and the character after, of all matches in order.

    A growing accumulator is copied at every step, so offsets are summed within runs of _RUN matches,
    and each run is then moved by the length of the runs before it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = _bound(F.split(text, pattern, -1), lambda ps: F.zip_with(F.zip_with(F.slice(ps, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match"))), F.slice(ps, F.lit(2), F.size(found)), lambda x, p: F.struct(x["piece"].alias("piece"), x["match"].alias("match"), F.left(p, F.lit(1)).alias("after"))))

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("value"), F.right(x["piece"], F.lit(_WINDOW)).alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(_SPAN).alias("out"))
    firsts = lambda ps: F.sequence(F.lit(1), F.greatest(F.size(ps), F.lit(1)), F.lit(_RUN))
    runs = _bound(parts, lambda ps: F.transform(firsts(ps), lambda i: F.aggregate(F.slice(ps, i, F.lit(_RUN)), zero, add)))

    def moved(run: Column, by: Column) -> Column:
        return F.transform(run["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")))

    def joined(rs: Column) -> Column:
        ahead = F.transform(rs, lambda r, i: F.aggregate(F.slice(rs, F.lit(1), i), F.lit(0).cast("bigint"), lambda n, x: n + x["pos"]))
        return F.flatten(F.zip_with(rs, ahead, moved))

    return _bound(runs, joined)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        x = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets_fit(value: Column) -> Column:
    def fits(part: Column) -> Column:
        short = F.ltrim(part, F.lit("0"))
        return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), fits)


def _good_card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


CHECKS: dict[str, Callable[[Column], Column]] = {
    "ip": _octets_fit,
    "card": _good_card,
    "phone": lambda value: F.length(_digits(value)).between(10, 15),
}


def _passing(spans: Column, check: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: check(s["value"]))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(no, F.lit(False)), NO).when(F.coalesce(yes, F.lit(False)), YES).otherwise(NONE)


def _listed(value: Column, prefixes: tuple[str, ...]) -> Column:
    return value.rlike("^(?:" + "|".join(prefixes) + ")")


def _votes(kind: str, value: Column, before: Column) -> list[Column]:
    """The labelers' votes on a candidate."""
    plain = F.replace(value, F.lit(MARK), F.lit(".")) if kind == "email" else value
    never = F.lit(False)
    if kind == "email":
        regex = _vote(plain.rlike(r"^[A-Za-z0-9][^@]*[A-Za-z0-9_+-]?@[^@]+\.[A-Za-z]{2,24}$"), plain.rlike(r"\.[0-9]+$"))
        listed = _vote(plain.rlike(r"\.(?:" + "|".join(TOP_DOMAINS) + ")$"), never)
    elif kind == "spelled_email":
        regex = _vote(plain.rlike(r"^[A-Za-z0-9]"), never)
        listed = _vote(F.lower(plain).rlike(r"[\])] ?(?:" + "|".join(TOP_DOMAINS) + ")$"), never)
    elif kind == "ip":
        regex = _vote(~plain.rlike(r"(?:^|\.)0[0-9]"), plain.rlike(r"(?:^|\.)0[0-9]|^0\."))
        listed = _vote(plain.rlike(r"^(?:10|127|172|192)\."), plain.rlike(r"^(?:22[4-9]|2[3-5][0-9])\."))
    elif kind == "card":
        regex = _vote(F.length(_digits(plain)).isin(14, 15, 16, 19), never)
        listed = _vote(_listed(plain, ("3[04-8]", "4", "5[1-5]", "2[2-7]", "6")), _listed(plain, ("0",)))
    elif kind == "phone":
        regex = _vote(plain.rlike(r"^\+[0-9]{1,3}[ (.-]"), plain.rlike(r"[.-]{3}"))
        listed = _vote(_listed(_digits(plain), CALLING_CODES), _listed(_digits(plain), ("0",)))
    elif kind == "local_phone":
        regex = _vote(plain.rlike(r"^\([2-9][0-9]{2}\) ?[2-9]"), plain.rlike(r"^\(?[01]"))
        listed = _vote(never, plain.rlike(r"[ .-]000[.-]"))
    elif kind == "ssn":
        regex = _vote(~plain.rlike(r"^(?:000|666|9)|-00-|-0000$"), plain.rlike(r"^(?:000|666|9)|-00-|-0000$"))
        listed = _vote(never, plain.isin("123-45-6789", "078-05-1120", "219-09-9999"))
    elif kind == "person":
        regex = _vote(plain.rlike(rf"^(?:{'|'.join(TITLES)})\.? "), plain.rlike(r" (?:The|Of|And|At|In|On|For|To|Is|De|La|El|Le|Les|Der|Die|Das|Und|Et|Y)$"))
        listed = _vote(plain.rlike(rf"(?:^| )(?:{'|'.join(GIVEN_NAMES)}) "), never)
    elif kind == "address":
        regex = _vote(plain.rlike(r"^[1-9][0-9]{0,4},? |[ ][1-9][0-9]{0,3}$"), plain.rlike(r"^0|[ ]0"))
        listed = _vote(plain.rlike(rf"(?:^| )(?:{'|'.join((*STREETS_AFTER, *STREETS_BEFORE))})(?: |$)|(?:{'|'.join(STREETS_JOINED)}) "), never)
    else:  # iban
        regex = _vote(F.length(plain).between(15, 34), never)
        listed = _vote(_listed(plain, IBAN_COUNTRIES), ~_listed(plain, IBAN_COUNTRIES))
    return [regex, listed, _context(kind, before)]


def _context(kind: str, before: Column) -> Column:
    words = r"(?:^|[^a-z])(?:e-)?(?:{})"
    return _vote(before.rlike(words.format("|".join(NEAR[kind]))), before.rlike(words.format("|".join(AWAY))))


#: Features of a span and their numbers of values; one number names a combination.
FEATURES = {"length": 4, "digits": 4, "capital": 2, "left": 4, "right": 4, "words": 3}


def _side(c: Column) -> Column:
    """Of a neighbouring character: none, white space, letter or digit, another one."""
    return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^[\p{L}0-9]$"), 2).otherwise(3)


def _features(kind: str, s: Column) -> Column:
    n, digits = F.length(s["value"]), F.length(_digits(s["value"]))
    values = {
        "length": F.when(n <= 10, 0).when(n <= 16, 1).when(n <= 24, 2).otherwise(3),
        "digits": F.when(digits == 0, 0).when(digits * 2 < n, 1).when(digits * 10 < n * 9, 2).otherwise(3),
        "capital": s["value"].rlike(r"^\p{Lu}").cast("int"),
        "left": _side(F.right(s["before"], F.lit(1))),
        "right": _side(s["after"]),
        "words": _context(kind, F.lower(s["before"])),
    }
    code = F.lit(0)
    for name, size in FEATURES.items():
        code = code * size + values[name]
    return code


def _coded(spans: Column, kind: str) -> Column:
    """Spans with their three votes as one number and their features as another; the matched text is not kept."""

    def code(s: Column) -> Column:
        a, b, c = _votes(kind, s["value"], F.lower(s["before"]))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), (a * 9 + b * 3 + c).alias("votes"), _features(kind, s).alias("features"))

    return F.transform(spans, code)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, an array of (start, end, votes, features)."""
    text = F.replace(text_or_empty(), F.lit(MARK), F.lit(OWN_MARK))
    t = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    digits, at = F.col("text").rlike("[0-9]{2}|[0-9].[0-9]"), F.col("text").contains("@")
    t = t.withColumn("has_digits", digits)
    t = t.withColumn("dotted", F.when(at, F.regexp_replace("text", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)))
    t = t.withColumn("joined", F.when(F.col("has_digits"), F.regexp_replace("text", r"(?<=[0-9])[ -](?=[0-9])", MARK)))
    none = F.array().cast(_SPAN)
    spans = {
        "email": F.when(at, _matches(F.col("dotted"), EMAIL)).otherwise(none),
        "ip": F.when(F.col("has_digits"), _matches(F.col("text"), IP)).otherwise(none),
        "card": F.when(F.col("has_digits"), _matches(F.col("joined"), CARD)).otherwise(none),
        "phone": F.when(F.col("text").contains("+") & F.col("text").rlike("[+][0-9]"), _matches(F.col("text"), PHONE)).otherwise(none),
        "ssn": F.when(F.col("has_digits"), _matches(F.col("text"), SSN)).otherwise(none),
        "iban": F.when(F.col("has_digits"), _matches(F.col("text"), IBAN)).otherwise(none),
        "local_phone": F.when(F.col("has_digits"), _matches(F.col("text"), LOCAL_PHONE)).otherwise(none),
        "spelled_email": F.when(F.col("text").rlike(r"[\[(]at[\])]"), _matches(F.col("text"), SPELLED)).otherwise(none),
        "person": F.when(F.col("text").rlike(PERSON), _matches(F.col("text"), PERSON)).otherwise(none),
        "address": F.when(F.col("text").rlike("[0-9]") & F.col("text").rlike(ADDRESS), _matches(F.col("text"), ADDRESS)).otherwise(none),
    }
    checked = {k: _passing(s, CHECKS[k]) if k in CHECKS else s for k, s in spans.items()}
    return t.select("doc_id", *(_coded(s, k).alias(k) for k, s in checked.items()))


def pattern_counts(found: DataFrame) -> dict[tuple[str, int, int], int]:
    """How often each (kind, votes, features) occurs."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["votes"].alias("votes"), s["features"].alias("features")))

    spans = F.concat(*map(named, (*BASE, *EXTRA)))
    rows = found.select(F.explode(spans).alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n")).collect()
    return {(r["kind"], r["votes"], r["features"]): r["n"] for r in rows}


def vote_counts(patterns: dict[tuple[str, int, int], int]) -> dict[tuple[str, int], int]:
    """How often each vote pattern occurs, by kind: at most 27 a kind."""
    out: dict[tuple[str, int], int] = {}
    for (kind, votes, _), n in patterns.items():
        out[kind, votes] = out.get((kind, votes), 0) + n
    return out


def _split(votes: int) -> tuple[int, int, int]:
    return votes // 9, votes // 3 % 3, votes % 3


def estimate(counts: dict[tuple[str, int], int], rounds: int = 60) -> tuple[dict[tuple[str, int], float], list[list[list[float]]]]:
    """EM over counted votes: the chance that each (kind, votes) is right, and each labeler's reliability.

    reliability[labeler][right][vote] is the chance of the vote. Every kind has a prior of its own.
    """
    right = {p: 0.9 if sum(_split(p[1])) > 3 else 0.6 if sum(_split(p[1])) == 3 else 0.1 for p in counts}
    reliability: list[list[list[float]]] = []
    for _ in range(rounds):
        prior = {}
        for kind in {k for k, _ in counts}:
            n = sum(c for p, c in counts.items() if p[0] == kind)
            prior[kind] = (sum(c * right[p] for p, c in counts.items() if p[0] == kind) + 1) / (n + 2)
        reliability = [[[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]] for _ in LABELERS]
        for p, c in counts.items():
            for j, v in enumerate(_split(p[1])):
                reliability[j][1][v] += c * right[p]
                reliability[j][0][v] += c * (1 - right[p])
        for labeler in reliability:
            for side in labeler:
                total = sum(side)
                side[:] = [x / total for x in side]
        for p in counts:
            odds = math.log(prior[p[0]] / (1 - prior[p[0]])) + sum(math.log(reliability[j][1][v] / reliability[j][0][v]) for j, v in enumerate(_split(p[1])))
            right[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return right, reliability


def feature_values(code: int) -> dict[str, int]:
    out = {}
    for name, size in reversed(FEATURES.items()):
        code, out[name] = divmod(code, size)
    return out


#: Features whose meaning depends on the kind.
BY_KIND = ("length", "digits", "capital")


def inputs(kind: str, code: int) -> list[str]:
    """The names of the weights that a span's score adds up."""
    return [kind, *(f"{kind}:{name}:{v}" if name in BY_KIND else f"{name}:{v}" for name, v in feature_values(code).items())]


def train_classifier(patterns: dict[tuple[str, int, int], int], right: dict[tuple[str, int], float], steps: int = 400) -> dict[str, float]:
    """Logistic weights of a span's features, fitted to EM's likelihoods as soft labels."""
    if not patterns:
        return {}
    rows = sorted(patterns)
    names = sorted({name for kind, _, code in rows for name in inputs(kind, code)})
    place = {name: i for i, name in enumerate(names)}
    at = np.array([[place[name] for name in inputs(kind, code)] for kind, _, code in rows])
    goal = np.array([right[kind, votes] for kind, votes, _ in rows])
    mass = np.sqrt([patterns[r] for r in rows])  # a pattern weighs the root of its count, so that rare kinds are learnt as well
    weights = np.zeros(len(names))
    for _ in range(steps):
        error = mass * (goal - 1 / (1 + np.exp(-np.clip(weights[at].sum(1), -30, 30))))
        gradient = np.bincount(at.ravel(), np.repeat(error, at.shape[1]), len(names))
        weights += 2.0 * gradient / mass.sum() - 1e-4 * weights
    return dict(zip(names, weights.tolist(), strict=True))


def _accepts(kind: str, code: Column, weights: dict[str, float]) -> Column:
    z, rest = F.lit(weights.get(kind, 0.0)), code
    for name, size in reversed(FEATURES.items()):
        prefix = f"{kind}:{name}" if name in BY_KIND else name
        z = z + F.element_at(F.array(*(F.lit(weights.get(f"{prefix}:{v}", 0.0)) for v in range(size))), (rest % size + 1).cast("int"))
        rest = F.floor(rest / size)
    return z > 0


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _free(spans: Column, base: Column) -> Column:
    """Spans that overlap none of base, which is in order. Base spans are looked at in runs, so that a span meets the
    run that it falls into, not all of them."""
    firsts = lambda bs: F.sequence(F.lit(1), F.size(bs), F.lit(_RUN))

    def run(part: Column) -> Column:
        return F.struct(F.element_at(part, 1)["start"].alias("low"), F.array_max(F.transform(part, lambda b: b["end"])).alias("high"), part.alias("part"))

    def touches(s: Column, runs: Column) -> Column:
        near = F.filter(runs, lambda r: (r["low"] < s["end"]) & (s["start"] < r["high"]))
        return F.exists(near, lambda r: F.exists(r["part"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    runs = _bound(base, lambda bs: F.transform(firsts(bs), lambda i: run(F.slice(bs, i, F.lit(_RUN)))))
    kept = _bound(runs, lambda rs: F.filter(spans, lambda s: ~touches(s, rs)))
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), kept).otherwise(spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, all spans and their number (n_spans) for every row of docs."""
    found = keep(candidates(docs), "pii")
    patterns = pattern_counts(found)
    counts = vote_counts(patterns)
    right, _ = estimate(counts) if counts else ({}, [])
    weights = train_classifier(patterns, right)
    kind_rank = {k: i for i, k in enumerate((*BASE, *EXTRA))}

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(kind_rank[kind]).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    def accepted(kind: str) -> Column:
        return F.filter(kind, lambda s: _accepts(kind, s["features"], weights)).alias(kind)

    rows = found.select("doc_id", *BASE, *map(accepted, EXTRA)).withColumn("base", F.array_sort(F.concat(*map(named, BASE))))
    rows = rows.withColumn("extra", _free(F.concat(*map(named, EXTRA)), F.col("base")))
    n = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    every = (F.size("base") + F.size("extra")).cast("long").alias("n_spans")
    return rows.select("doc_id", *n, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", "extra")).alias("spans"), every)
