"""Secret scans: fixed patterns and sliding-window entropy.  DataFrame functions only.

Base kinds come from patterns.  The method proposes candidate strings of two
character classes (hexadecimal; letters, digits and +/_-), runs a window of
``WINDOW`` characters over each, and keeps the window's counts and the sum of
c * log2(c) as characters enter and leave.  A candidate whose highest window entropy
reaches its class's threshold is a secret, unless an allow-list pattern fits it.
Positions are code points: the pieces between matches and the matches add up, by
doubling, so that many matches and long candidates take no more than linear-logarithmic time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Words of which a text with an assignment has one, in lower case.
NAMES = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
#: Class: (pattern of candidates, alphabet, folded to lower case, threshold in bits).
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{20,}", "0123456789abcdef", True, 3.0),
    "entropy_base64": (r"[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", False, 3.8),
}
#: Candidates that one of these fits are no secrets: letters alone, digits alone, without a digit, UUIDs, placeholders, paths of words.
ALLOWED = (r"^[A-Za-z]+$", r"^[0-9]+$", r"^[^0-9]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i:example|placeholder|xxxx|your_|changeme)", r"^/?([a-z]+/)+[a-z0-9_-]*$")
#: c * log2(c) in millionths, by count.
PARTS = tuple(round(1_000_000 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1))
MILLION = 1_000_000
#: Characters that are worked on at once in a long candidate or text.
BLOCK = 2048
#: Counts of up to 31, this many in a long.
PACKED = 12
#: The powers of two that an array's length can have.
POWERS = tuple(1 << k for k in range(31))

_SPAN = "array<struct<start:int,rank:int,end:int,group:string,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join) -> Column:
    """What ``join`` makes of the values up to each place: in each round a place takes
    in the one as far before it as it already covers."""
    rounds = F.filter(F.array(*map(F.lit, POWERS)), lambda p: p < F.size(values))

    def step(state: Column, p: Column) -> Column:
        return F.transform(state, lambda x, i: F.when(i >= p, join(x, F.get(state, i - p))).otherwise(x))

    return F.aggregate(rounds, values, step)


def _spans(text: Column, pattern: str, rank: int, group: int, maybe: Column) -> Column:
    """The matches as (start, rank, end, group, value), where ``maybe`` holds."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("group")] if group else []
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), values, *groups)

    def placed(both: Column) -> Column:
        lengths = F.transform(both, lambda x: F.char_length(x["gap"]) + F.char_length(x["value"]))

        def span(ends: Column):
            def of(x: Column, i: Column) -> Column:
                start = F.get(ends, i) - F.char_length(x["value"])
                return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.get(ends, i).alias("end"), x["group" if group else "value"].alias("group"), x["value"].alias("value"))

            return of

        return _let(_let(lengths, lambda n: running(n, lambda x, y: x + y)), lambda ends: F.transform(both, span(ends)))

    # The text after the last match is no match's.
    found = _let(zipped, lambda all_: _let(F.slice(all_, 1, F.size(all_) - 1), placed)).cast(_SPAN)
    return F.when(maybe, found).otherwise(F.array().cast(_SPAN))


def _block_entropy(block: Column, alphabet: str) -> Column:
    """window_entropy of one block; 2**31 - 1 if it is shorter than a window."""
    parts = F.array(*[F.lit(p) for p in PARTS])

    def code(c: Column) -> Column:
        """The long that has the character's count, the count's first bit and a one there."""
        at = F.instr(F.lit(alphabet), c)
        bit = 5 * (at % PACKED)
        return F.struct(F.floor(at / PACKED).cast("int").alias("in"), bit.alias("bit"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one"))

    longs = F.array_repeat(F.lit(0).cast("long"), len(alphabet) // PACKED + 1)
    zero = F.struct(longs.alias("n"), F.lit(0).alias("sum"), F.lit(2**31 - 1).alias("least"), F.lit(0).alias("at"))

    def over(codes: Column) -> Column:
        def step(state: Column, came: Column) -> Column:
            n, gone = state["n"], F.get(codes, state["at"] - WINDOW)
            count = lambda x: F.call_function("shiftright", F.get(n, x["in"]), x["bit"]).bitwiseAND(F.lit(31).cast("long")).cast("int")
            change = F.get(parts, count(came) + 1) - F.get(parts, count(came)) + F.coalesce(F.get(parts, count(gone) - 1) - F.get(parts, count(gone)), F.lit(0))
            total = state["sum"] + F.when(came["one"] == gone["one"], F.when(came["in"] == gone["in"], 0).otherwise(change)).otherwise(change)
            full = state["at"] >= WINDOW - 1
            counts = F.transform(n, lambda v, k: F.when(k == came["in"], v + came["one"]).otherwise(v) - F.when(k == gone["in"], gone["one"]).otherwise(0))
            return F.struct(counts.alias("n"), total.alias("sum"), F.when(full, F.least(state["least"], total)).otherwise(state["least"]).alias("least"), (state["at"] + 1).alias("at"))

        return F.aggregate(codes, zero, step, lambda s: s["least"])

    return _let(F.transform(F.split(block, ""), code), over)


def window_entropy(value: Column, alphabet: str) -> Column:
    """The least sum of c * log2(c), in millionths, of any window of ``value``; the
    entropy is log2(WINDOW) less a WINDOW-th of it.  Blocks overlap by a window."""
    blocks = F.regexp_extract_all(value, F.lit(f"(?=(.{{1,{BLOCK + WINDOW - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    return F.array_min(F.transform(blocks, lambda block: _block_entropy(block, alphabet)))


def _iterated(pattern: str) -> str:
    """The pattern with its group of path parts possessive, which changes nothing, but
    Java then iterates where it would recurse."""
    return pattern.replace("/)+", "/)++")


def _high_entropy(text: Column, kind: str) -> Column:
    pattern, alphabet, fold, threshold = CLASSES[kind]
    most = round(MILLION * WINDOW * (math.log2(WINDOW) - threshold))

    def secret(x: Column) -> Column:
        allowed = F.lit(False)
        for p in ALLOWED:
            allowed = allowed | x["value"].rlike(_iterated(p))
        value = F.lower(x["value"]) if fold else x["value"]
        return F.when(allowed, False).otherwise(window_entropy(value, alphabet) <= most)

    return F.filter(_spans(text, pattern, KINDS.index(kind), 0, text.rlike(pattern)), secret)


def scan(docs: DataFrame) -> DataFrame:
    """Return ``docs`` (doc_id, text and any other columns) with two more columns:
    ``base``, the base spans, and ``secrets``, all spans, as arrays of (start, rank,
    end, group, value) by start, then rank (place in KINDS); code points, end
    exclusive.  Null and empty texts have none; rows are independent of each other.
    Columns of docs named base or secrets are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    small = F.lower(text)
    named = F.lit(False)
    for name in NAMES:
        named = named | F.contains(small, F.lit(name))
    assign = F.filter(_spans(text, ASSIGN, 0, 2, named), lambda x: F.char_length(x["group"]) >= 6)
    access = _spans(text, ACCESS, 1, 0, F.contains(text, F.lit("AKIA")))
    hexa = _spans(text, HEX, 2, 0, text.rlike(HEX))
    found = docs.withColumn("base", F.sort_array(F.concat(assign, access, hexa)))
    more = F.concat(*[_high_entropy(text, kind) for kind in CLASSES])
    return found.withColumn("secrets", F.sort_array(F.concat("base", more)))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Characters from start to end of a text that is cut into blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    head = F.substring(F.get(blocks, first), start % BLOCK + 1, F.when(first == last, end - start).otherwise(BLOCK))
    inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.when(last > first, F.substring(F.get(blocks, last), F.lit(1), end % BLOCK))
    return F.concat(F.coalesce(head, F.lit("")), inner, F.coalesce(tail, F.lit("")))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of ``text`` that secrets cover replaced by ``mask``
    (and n_chars, if there is such a column, counted anew)."""
    spans, nothing = F.col("secrets"), F.lit(0)

    def masked(blocks: Column) -> Column:
        def joined(ends: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                done = F.coalesce(F.get(ends, i - 1), nothing)
                return F.when(x["start"] >= done, F.concat(_between(blocks, done, x["start"]), F.lit(mask))).otherwise("")

            rest = _between(blocks, F.element_at(ends, -1), F.char_length("text"))
            return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

        return _let(_let(F.transform(spans, lambda x: x["end"]), lambda e: running(e, F.greatest)), joined)

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    found = scan(docs).withColumn("text", F.when(F.size("secrets") > 0, _let(blocks, masked)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("secrets") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("secrets").alias("spans"),
    )


def _oracle() -> str:
    """The same in DuckDB; entropies from each window's own histogram."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    patterns = [("assign", ASSIGN, 2, "text"), ("access", ACCESS, 0, "text"), ("hex", HEX, 0, "text")]
    patterns += [(k, CLASSES[k][0], 0, "text") for k in CLASSES]
    rows = " UNION ALL ".join(
        f"""SELECT doc_id, {quote(kind)} AS kind, {KINDS.index(kind)} AS rank, string_split_regex(text, {quote(p)}) AS gaps,
            regexp_extract_all(text, {quote(p)}, 0) AS v, regexp_extract_all(text, {quote(p)}, {g}) AS g FROM d"""
        for kind, p, g, _ in patterns
    )
    entropy = []
    for kind, (_, _, fold, threshold) in CLASSES.items():
        most = round(MILLION * WINDOW * (math.log2(WINDOW) - threshold))
        value = "lower(value)" if fold else "value"
        allowed = " OR ".join(f"regexp_matches(value, {quote(p)})" for p in ALLOWED)
        entropy.append(
            f"""kind = {quote(kind)} AND NOT ({allowed}) AND list_min(list_transform(range(1, len(value) - {WINDOW - 2}), lambda i:
                list_sum(list_transform(map_values(list_histogram(string_split({value}[i:i + {WINDOW - 1}], ''))), lambda c: {list(PARTS)}[CAST(c AS BIGINT) + 1])))) <= {most}"""
        )
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        m AS ({rows}),
        p AS (SELECT doc_id, kind, rank, gaps, v, g, unnest(range(1, len(v) + 1)) AS k FROM m WHERE len(v) > 0),
        s AS (SELECT doc_id, kind, rank, v[k] AS value, g[k] AS part,
                     CAST(list_sum(list_transform(gaps[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(v[1:k - 1], lambda x: len(x))), 0) AS BIGINT) AS start FROM p),
        ok AS (SELECT *, concat_ws(':', kind, start, start + len(value)) AS span FROM s
               WHERE CASE kind WHEN 'assign' THEN len(part) >= 6 WHEN 'access' THEN true WHEN 'hex' THEN true ELSE ({" OR ".join(f"({e})" for e in entropy)}) END),
        a AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
                     string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM ok GROUP BY 1)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a USING (doc_id)"""


QUERIES = {"op8_secrets": op8}
ORACLE = {"op8_secrets": _oracle()}
