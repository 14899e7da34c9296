"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base spans come from fixed formats.  High-recall generators propose further spans,
which may overlap: numbers of seven digits and more in any grouping, addresses whose
sign or dots are spelled out (with their shorter and their longer end), account numbers.
Boosted trees judge each by format and context features; they and their calibration
are fitted on generated examples (``TRAINING`` of them, seeded), never on the corpus, so
that they are the same at every size.  Examples that are no personal data look like it:
other numbers, digits inside words and hashes, and sentences that end after "at" and a
word.  Thresholds are tried on held-out examples with ``ODDS`` times as many of what looks
like personal data as of personal data: of those that reach ``PRECISION`` and catch
the most, less ``LOSS``, a generator has the middle one.  Accepted spans that meet no base
span are added, the likelier of two that overlap.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.boosting import Boosted
from tessera.llm.common import slices, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "address", "account")
KINDS = BASE + ADDED
#: Generated examples: the first half trains the trees, the rest calibrates them and sets thresholds.
TRAINING = 6000
PRECISION = 0.9
ODDS = 20
LOSS = 0.02
#: Characters of context before and after a candidate.
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_NUMBER = re.compile(r"\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}")
_SIGN = re.compile(r"\s?(?:\(at\)|\[at\]|\{at\}|@)\s?|\sat\s", re.IGNORECASE)
_LABEL, _SPELT_DOT = "[A-Za-z0-9-]++", r"\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\sdot\s"
_TIGHT = re.compile(rf"{_LABEL}(?:(?:{_SPELT_DOT}|\.){_LABEL})++", re.IGNORECASE)
_LOOSE = re.compile(rf"{_LABEL}(?:(?:{_SPELT_DOT}|\s?\.\s?){_LABEL})++", re.IGNORECASE)
_ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
#: Last labels that many addresses have.
ENDINGS = frozenset("com org net edu gov info biz io eu de fr es it uk us ca".split())
#: Fixed word lists of the context features.
CLUES = (
    ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "anruf"),
    ("mail", "contact", "write", "correo", "kontakt", "courriel"),
    ("card", "visa", "account", "iban", "bank", "konto", "compte", "cuenta"),
    ("ssn", "social", "passport", "born", "tax"),
    ("order", "invoice", "ref", "isbn", "version", "item", "number", "no.", "id", "serial", "part"),
    ("date", "year", "since", "until", "population", "total", "km", "usd", "eur", "page"),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed formats, leftmost non-overlapping per kind."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((0, start, last))
        at = text.find("@", found.end() if found else at + 1)
    if not _DIGIT.search(text):
        return out
    for m in _CHAIN.finditer(text):
        if m[0].count(".") >= 3:
            parts = [(p.start(), p[0]) for p in re.finditer(r"[0-9]+", m[0])]
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for _, p in four):
                    out.append((1, m.start() + four[0][0], m.start() + four[3][0] + len(four[3][1])))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the generators propose, numbers from KINDS."""
    out = []
    if _DIGIT.search(text):
        out += [(4, m.start(), m.end()) for m in _NUMBER.finditer(text)]
        out += [(6, m.start(), m.end()) for m in _ACCOUNT.finditer(text)]
    last = 0
    for m in _SIGN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            ends = {d.end() for d in (_TIGHT.match(text, m.end()), _LOOSE.match(text, m.end())) if d}
            out += [(5, start, end) for end in sorted(ends)]
        last = m.end()
    return out


def _address_features(value: str) -> list[float]:
    """Of its last label: length, whether many addresses end so, whether it begins with
    a capital or has a digit; how sign and dots are written."""
    last = re.split(r"[\s.()\[\]{}]+", value)[-1] if value else ""
    low = value.lower()
    return [
        len(last), float(last in ENDINGS), float(last[:1].isupper()), float(any(c.isdigit() for c in last)),
        float(any(x in low for x in ("(at)", "[at]", "{at}"))), float(" at " in low), float(any(x in low for x in ("(dot)", "[dot]", "{dot}", " dot "))),
        len(re.findall(r"\s\.|\.\s", value)),
    ]


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    kind, start, end = span
    value = text[start:end]
    digits = "".join(c for c in value if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", value)
    around = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
    before = text[start - 1 : start]
    return [
        kind, len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(value) - len(digits),
        value.count("-"), value.count("."), value.count(" "), value.count("("), value.count("/"), float(before.isalnum() or before in ("/", "#", "$", "_", "=")),
        float(bool(digits) and luhn(digits)), float(digits[:1] == "0"), float(bool(re.match(r"(19|20)[0-9]{2}[-/.]", value))), float("at" in value.lower()),
        *_address_features(value if KINDS[kind] == "address" else ""), float("@" in value), float([len(g) for g in groups] in ([3, 3, 4], [3, 4], [3, 2, 4], [2, 2, 2, 2, 2])), float(text[end : end + 1].isalnum()),
        *[float(any(c in around for c in clue)) for clue in CLUES],
    ]


def examples(n: int, seed: int = 11) -> list[tuple[str, tuple[int, int, int], int]]:
    """Generated (text, candidate, label): personal data, and what looks like it."""
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choices("0123456789", k=k))
    w = lambda: "".join(rnd.choices("abcdeilmnorstu", k=rnd.randint(2, 8)))
    c = lambda: w().capitalize()
    x = lambda: "".join(rnd.choices("abcdef", k=2)) + "".join(rnd.choices("0123456789abcdef", k=rnd.randint(0, 9))) + "".join(rnd.choices("abcdef", k=2))
    end = lambda: rnd.choice(sorted(ENDINGS))
    good = [
        (lambda: f"({d(3)}) {d(3)}-{d(4)}", 0), (lambda: f"{d(3)}-{d(3)}-{d(4)}", 0), (lambda: f"{d(3)}.{d(3)}.{d(4)}", 0), (lambda: f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", 0),
        (lambda: f"{d(3)}-{d(2)}-{d(4)}", 3), (lambda: f"{w()} (at) {w()} (dot) {end()}", 1), (lambda: f"{w()}.{w()}[at]{w()}[dot]{end()}", 1), (lambda: f"{w()} at {w()} dot {end()}", 1),
        (lambda: f"{w()}{d(2)} at {w()}.{end()}", 1), (lambda: f"{w()} at {w()}.{end()}", 1), (lambda: f"{w()} @ {w()}.{end()}", 1), (lambda: f"{w()}.{w()} (at) {w()}.{w()}.{end()}", 1),
        (lambda: f"{w()} [at] {w()} . {end()}", 1), (lambda: f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", 2), (lambda: f"GB{d(2)}WEST{d(14)}", 2),
    ]
    bad = [
        (lambda: d(rnd.randint(7, 12)), 4), (lambda: f"20{d(2)}-0{rnd.randint(1, 9)}-1{d(1)}", 5), (lambda: f"{d(2)}/{d(2)}/20{d(2)}", 5), (lambda: f"{d(1)}.{d(2)}.{d(3)}.{d(4)}", 4),
        (lambda: f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", 4), (lambda: f"#{d(8)}", 4), (lambda: f"{d(3)} {d(3)} {d(3)}", 5), (lambda: d(rnd.randint(13, 19)), 2), (lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", 5),
        (lambda: f"{w()} @ {w()}.{d(1)}", 5), (lambda: f"AB{d(2)} {d(4)} {d(4)}", 4), (lambda: f"{w()}@{w()}.{d(2)}", 4), (lambda: f"1{d(2)} {d(2)} {d(4)}-{d(4)}", 5),
        (lambda: f"{x()}{d(rnd.randint(7, 11))}{x()}", 2), (lambda: f"{x()}{d(rnd.randint(7, 9))}", 4), (lambda: f"{d(rnd.randint(7, 9))}{x()}", 5), (lambda: f"{w()} = \"{d(8)}{x()}", 4),
        (lambda: f"{w()} at {w()}. {c()}", 5), (lambda: f"{w()} at {w()}.{c()}", 1), (lambda: f"{w()} at {w()}. {w()}", 4), (lambda: f"{c()} at {d(1)}.{d(2)}", 5), (lambda: f"{w()} at {d(2)}. {c()}", 5),
        (lambda: f"{w()} @ {w()}. {c()}", 1), (lambda: f"{w()} at {w()}.{w()}", 4),
    ]
    out = []
    while len(out) < n:
        label = rnd.random() < 0.5
        make, clue = rnd.choice(good if label else bad)
        hint = f"{rnd.choice(CLUES[clue])} " if rnd.random() < 0.6 else ""
        head = " ".join(w() for _ in range(rnd.randint(0, 6)))
        value, tail = make(), " ".join(w() for _ in range(rnd.randint(0, 6)))
        # Half of the time a sentence ends after it.
        text = f"{head} {hint}{value}{rnd.choice((' ', ' ', '. ' + c() + ' ', ', '))}{tail}"
        at = text.index(value)
        for found in candidates(text):
            if found[1] < at + len(value) and found[2] > at:
                # Only what was made, whole and alone, is personal data.
                out.append((text, found, int(label and found[1:] == (at, at + len(value)))))
    return out[:n]


@functools.lru_cache(1)
def model() -> tuple[Boosted, dict[int, float]]:
    """Trees, and each generator's threshold."""
    rows = examples(TRAINING)
    x = np.array([features(t, c) for t, c, _ in rows])
    y = np.array([label for *_, label in rows], float)
    half = len(y) // 2
    trees = Boosted().fit(x[:half], y[:half]).calibrate(x[half:], y[half:])
    p, kinds, thresholds = trees.probability(x[half:]), x[half:, 0], {}
    for kind in range(len(BASE), len(KINDS)):
        own, label = p[kinds == kind], y[half:][kinds == kind]
        tried = np.linspace(0.02, 0.99, 98)
        caught = np.array([(own[label == 1] >= t).mean() for t in tried])
        wrong = np.array([(own[label == 0] >= t).mean() for t in tried])
        fine = (caught > 0) & (caught >= PRECISION * (caught + ODDS * wrong))
        best = fine & (caught >= caught[fine].max(initial=0) - LOSS)
        thresholds[kind] = float(np.median(tried[best])) if fine.any() else 1.01
    return trees, thresholds


def _found(fitted: tuple[Boosted, dict[int, float]]):
    trees, thresholds = fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                base, tried, rows = [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    base.append(base_spans(text or ""))
                    for c in candidates(text) if text else ():
                        tried.append((k, c))
                        rows.append(features(text, c))
                p = trees.probability(np.array(rows)) if rows else []
                chosen: dict[int, list] = {}
                for (k, c), prob in sorted(zip(tried, p), key=lambda x: (x[0][0], -x[1], x[0][1][1])):
                    own = chosen.setdefault(k, [])
                    if prob >= thresholds[c[0]] and not any(s < c[2] and e > c[1] for _, s, e in own) and not any(s < c[2] and e > c[1] for _, s, e in base[k]):
                        own.append(c)
                spans = [sorted(b + chosen.get(k, [])) for k, b in enumerate(base)]
                struct = [[{"kind": KINDS[c], "start": s, "end": e} for c, s, e in own] for own in spans]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(struct, kind)], ["doc_id", "spans"])

    return run


def find(docs: DataFrame) -> DataFrame:
    """Return (doc_id, spans) for each row of ``docs`` (doc_id, text; other columns are
    ignored): an array of (kind, start, end), sorted by place in KINDS, then start;
    code points, end exclusive.

    Null and empty texts have none; rows are independent of each other; an empty
    table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_found(model()), "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op2_pii": op2}
ORACLE: dict[str, str] = {}
