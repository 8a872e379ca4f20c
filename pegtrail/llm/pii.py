"""Personal data by weak supervision.

Fixed patterns give the base spans: email, ip, card and phone. Wider patterns give candidates: secrets, telephone
numbers without a country code, addresses with a spelled "at", social security and account numbers, names after a
title. Labelers (shape patterns, gazetteers and contexts) vote for or against each match or abstain. Expectation-
maximisation over the votes estimates how reliable each labeler is and how likely each match is real; these
probabilities train a logistic classifier over the span's own features, which decides on the candidates. Base spans
always stay.

Spark counts vote patterns and feature patterns over all documents. Both kinds of patterns are finite whatever the
corpus (3 to the number of labelers; the product of the feature sizes), so the two fits see tables of bounded size.

Defined cases: a null or empty text has no spans; with no match at all nothing is fitted; offsets are code points, ends
exclusive; candidates that overlap a base span or an earlier candidate are left out; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegtrail.llm.batches import map_slices, shared_dir, strings

#: Kinds in the order that spans of one start are listed in.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "account", "name")
BASE_KINDS = KINDS[:4]

#: A match that starts within a run of digits would also start at the run's first, so that only those are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: The wider patterns, by kind: (needs a digit in the text, pattern with the span as group 1).
WIDER = (
    ("secret", True, re.compile(r"\b((?:AKIA|ASIA)[0-9A-Z]{12,})\b")),
    ("secret", False, re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*\"?([^\s\"]{6,})")),
    ("secret", True, re.compile(r"(?<![A-Za-z0-9])([A-Fa-f0-9]{32,}|(?:gh[pousr]_|sk-|xox[bap]-)[A-Za-z0-9-]{16,})(?![A-Za-z0-9])")),
    ("email", False, re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]+(?:(?: ?(?:\[dot\]|\(dot\)) ?|\.)[A-Za-z0-9-]+)+)")),
    ("ssn", True, re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")),
    ("phone", True, re.compile(r"(?<![0-9+(-])(\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9-])")),
    ("account", True, re.compile(r"\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7})\b")),
    ("name", False, re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. ([A-Z][a-z]+(?: [A-Z][a-z]+)?)")),
)
#: Given names and family names that are common in English text.
GIVEN_NAMES = (
    "Alice", "Amanda", "Andrew", "Anna", "Anthony", "Barbara", "Carol", "Charles", "Christopher", "Daniel", "David", "Deborah", "Donald", "Edward", "Elizabeth", "Emily", "Emma", "George", "Helen", "James",
    "Jennifer", "Jessica", "John", "Joseph", "Karen", "Kevin", "Laura", "Linda", "Lisa", "Margaret", "Maria", "Mark", "Mary", "Matthew", "Michael", "Michelle", "Nancy", "Patricia", "Paul", "Peter",
    "Richard", "Robert", "Ruth", "Sandra", "Sarah", "Steven", "Susan", "Thomas", "Timothy", "William",
)
FAMILY_NAMES = (
    "Adams", "Allen", "Anderson", "Baker", "Brown", "Campbell", "Carter", "Clark", "Davis", "Evans", "Garcia", "Gonzalez", "Green", "Hall", "Harris", "Hernandez", "Hill", "Jackson", "Johnson", "Jones",
    "King", "Lee", "Lewis", "Lopez", "Martin", "Martinez", "Miller", "Mitchell", "Moore", "Nelson", "Perez", "Phillips", "Roberts", "Robinson", "Rodriguez", "Scott", "Smith", "Taylor", "Thomas", "Thompson",
    "Torres", "Turner", "Walker", "White", "Williams", "Wilson", "Wright", "Young",
)
_NAMES = re.compile(rf"\b((?:{'|'.join(GIVEN_NAMES)}) (?:[A-Z]\. )?[A-Z][a-z]+)\b")
_GIVEN, _FAMILY = frozenset(GIVEN_NAMES), frozenset(FAMILY_NAMES)
_TITLES = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof)\. ")

#: Words before a span that speak for it (for a name, a listed family name as well), and strings that speak against it.
GAZETTEER = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|key|mail|contact|phone|tel|call|mobile|fax|ssn|iban|account|card|visa|address|host|server|ip|mr|mrs|ms|dr|prof)\W{0,4}$")
PLACEHOLDER = re.compile(r"(?i)x{4,}|\*{3,}|your|changeme|placeholder|12345678|(.)\1{5,}")

LABELERS = ("shape", "checksum", "gazetteer", "placeholder", "assignment", "numbers_around", "entropy", "alone")
FEATURES = {"kind": len(KINDS), "length": 6, "digits": 5, "before": 5, "after": 5, "entropy": 4}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, valid) of every base match, also of those that fail their check."""
    found = []
    found += [(start, 0, end, True) for start, end in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            found.append((m.start(), 1, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))))
        for m in _CARD.finditer(text):
            digits = _only_digits(m[0])
            if 12 <= len(digits) <= 19:
                found.append((m.start(), 2, m.end(), len(digits) >= 14 and luhn(digits)))
        if "+" in text:
            for m in _PHONE.finditer(text):
                found.append((m.start(), 3, m.end(), 10 <= len(_only_digits(m[0])) <= 15))
    return sorted(found)


def emails(text: str) -> list[tuple[int, int]]:
    """(start, end) of the base pattern's addresses, leftmost first: from each @ back over the local part, so that long runs are read once."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        low, at = end, text.find("@", end)
    return found


def wider_matches(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates that overlap neither `taken` nor each other."""
    digit, found = bool(_DIGIT.search(text)), []
    for kind, needs, pattern in WIDER:
        if needs and not digit or kind == "email" and "at" + ")" not in text and "at]" not in text or kind == "name" and not _TITLES.search(text):
            continue
        if kind == "secret" and not needs and "=" not in text and ":" not in text:
            continue
        found += [(m.start(1), KINDS.index(kind), m.end(1)) for m in pattern.finditer(text)]
    found += [(m.start(1), KINDS.index("name"), m.end(1)) for m in _NAMES.finditer(text)]
    taken = sorted(taken)
    begins, reach, kept, last = [a for a, _ in taken], list(accumulate((b for _, b in taken), max)), [], 0
    for start, kind, end in sorted(found):
        before = bisect_left(begins, end)
        if start >= last and not (before and reach[before - 1] > start):
            kept.append((start, kind, end))
            last = end
    return kept


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text)))


def votes_of(text: str, start: int, end: int, kind: int, valid: bool | None) -> int:
    """The labelers' votes as one number in base 3: 0 abstains, 1 against, 2 for."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    h = entropy(span)
    digits = sum("0" <= c <= "9" for c in span)
    name = KINDS[kind]
    shape = {"email": "@" in span or "at" in span, "ip": True, "card": digits in (15, 16), "phone": 10 <= digits <= 13, "secret": digits >= 4, "ssn": True, "account": digits >= 8, "name": len(span) > 3}[name]
    votes = (
        2 if shape else 1,
        0 if valid is None else 2 if valid else 1,
        2 if GAZETTEER.search(before) or name == "name" and _FAMILY.intersection(span.split(" ")) else 1 if name == "name" and not _GIVEN.intersection(span.split(" ")) else 0,
        1 if PLACEHOLDER.search(span) else 0,
        2 if re.search(r"[=:]\s*\"?$", before) else 0,
        1 if re.search(r"[0-9][,.;/ ]+$", before) and re.match(r"[,.;/ ]+[0-9]", after) else 0,
        (2 if h >= 3 else 1 if h < 1.5 else 0) if name in ("secret", "account") else (1 if h < 1.5 else 0),
        2 if (not before or before[-1].isspace() or before[-1] in "\"'(<=:") and (not after or after[0].isspace() or after[0] in "\"').,;>") else 1,
    )
    return sum(v * 3**i for i, v in enumerate(votes))


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4


def features_of(text: str, start: int, end: int, kind: int) -> int:
    """The span's features, packed by the sizes in FEATURES."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span) / len(span)
    values = (kind, min(5, len(span).bit_length() - 1), min(4, int(digits * 5)), _side(text[start - 1 : start] if start else ""), _side(text[end : end + 1]), min(3, int(entropy(span))))
    packed = 0
    for value, size in zip(values, FEATURES.values()):
        packed = packed * size + value
    return packed


def unpack(packed: int) -> list[int]:
    values = []
    for size in reversed(FEATURES.values()):
        values.append(packed % size)
        packed //= size
    return values[::-1]


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts of base spans, base_sha256, base, matches): one pass over the texts."""
    kind = df.schema[key].dataType.simpleString()
    span = "array<struct<start:int,rank:int,end:int>>"
    counts = [f"n_{k}" for k in BASE_KINDS]

    def make():
        def step(part: pa.RecordBatch) -> dict:
            out = {c: [] for c in (*counts, "base_sha256", "base", "matches")}
            for x in strings(part.column(1)):
                every = base_matches(x)
                base = [(s, k, e) for s, k, e, ok in every if ok]
                for i, c in enumerate(counts):
                    out[c].append(sum(k == i for _, k, _ in base))
                out["base_sha256"].append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                out["base"].append([{"start": s, "rank": k, "end": e} for s, k, e in base])
                more = wider_matches(x, [(s, e) for s, _, e in base])
                matches = [(s, k, e, None, False) for s, k, e in more] + [(s, k, e, ok, True) for s, k, e, ok in every]
                out["matches"].append([{"start": s, "rank": k, "end": e, "votes": votes_of(x, s, e, k, ok), "features": features_of(x, s, e, k), "base": b} for s, k, e, ok, b in matches])
            return {key: part.column(0)} | out

        return step

    columns = ", ".join(f"{c} long" for c in counts)
    return map_slices(df, [key, text], text, f"`{key}` {kind}, {columns}, base_sha256 string, base {span}, matches array<struct<start:int,rank:int,end:int,votes:int,features:int,base:boolean>>", make)


def fit_votes(patterns: dict[int, int], rounds: int = 60) -> tuple[dict[int, float], np.ndarray]:
    """Expectation-maximisation over counted vote patterns: P(real) of each pattern, and each labeler's (right when real, right when not)."""
    if not patterns:
        return {}, np.zeros((len(LABELERS), 2))
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    votes = np.array([[k // 3**i % 3 for i in range(len(LABELERS))] for k in keys])
    for_, against = votes == 2, votes == 1
    p = (for_.sum(1) + 1) / (for_.sum(1) + against.sum(1) + 2)
    for _ in range(rounds):
        w, v = n * p, n * (1 - p)
        hit = ((w @ for_) + 4) / ((w @ for_) + (w @ against) + 5)  # a labeler is taken as better than chance until counts say otherwise
        miss = ((v @ against) + 4) / ((v @ for_) + (v @ against) + 5)
        prior = (w.sum() + 1) / (n.sum() + 2)
        real = math.log(prior) + for_ @ np.log(hit) + against @ np.log(1 - hit)
        none = math.log(1 - prior) + for_ @ np.log(1 - miss) + against @ np.log(miss)
        p = 1 / (1 + np.exp(np.clip(none - real, -50, 50)))
    return dict(zip(keys, p.tolist())), np.stack([hit, miss], 1)


def fit_spans(table: dict[int, tuple[float, int]], rounds: int = 30, l2: float = 1.0) -> dict[int, float]:
    """Logistic regression on one-hot features, weighted by counts: the score of each feature pattern."""
    if not table:
        return {}
    keys = sorted(table)
    starts = np.cumsum([1, *FEATURES.values()])
    x = np.zeros((len(keys), starts[-1]))
    x[:, 0] = 1
    for row, k in enumerate(keys):
        x[row, starts[:-1] + np.array(unpack(k))] = 1
    n = np.array([table[k][1] for k in keys], float)
    y = np.array([table[k][0] for k in keys]) / n
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + l2 * np.eye(x.shape[1]), x.T @ (n * (y - p)) - l2 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))).tolist()))


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, n_secret, n_ssn, n_account, n_name) of each whole text.

    The first four count base spans, `n_more` the added ones of any kind, the last four those of their kind.
    """
    spark = df.sparkSession
    shared_dir(spark)
    found = find(df, key, text).checkpoint()
    match = found.select(F.explode("matches").alias("m")).select("m.votes", "m.features")
    counted = match.groupBy("votes", "features").count().checkpoint()
    patterns = {r["votes"]: r["n"] for r in counted.groupBy("votes").agg(F.sum("count").alias("n")).collect()}
    real, _ = fit_votes(patterns)
    table = {}
    if real:
        by_votes = F.broadcast(spark.createDataFrame(sorted(real.items()), "votes int, p double"))
        rows = counted.join(by_votes, "votes").groupBy("features").agg(F.sum(F.col("p") * F.col("count")).alias("p"), F.sum("count").alias("n")).collect()
        table = {r["features"]: (r["p"], r["n"]) for r in rows}
    accepted = [k for k, p in fit_spans(table).items() if p >= threshold]
    added = F.filter("matches", lambda m: ~m["base"] & m["features"].isin(accepted)) if accepted else F.filter("matches", lambda m: F.lit(False))
    place = lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end"))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_sort(F.concat(F.transform("base", place), F.transform(added, place)))
    text_of = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda rank: F.size(F.filter(added, lambda m: m["rank"] == rank)).cast("long")
    of_kind = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS) if k not in BASE_KINDS]
    return found.select(key, *[f"n_{k}" for k in BASE_KINDS], "base_sha256", text_of.alias("spans"), F.size(added).cast("long").alias("n_more"), *of_kind)
