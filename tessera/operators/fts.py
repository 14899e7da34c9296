"""Full-text search over a postings table (term, doc, at).

The index is a DataFrame: build it once, write it as Parquet partitioned as you like,
and search it with joins.  It is cut row by row, without a shuffle; what is grouped is
grouped in a search, which keeps the postings of its own terms first.  Terms are lower-cased runs of letters, digits and _ of at
least two characters; CJK text gives its 1- to 3-character pieces.  Queries are cut alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25's fixed constants, and those of fuzzy matching.
K1, B = 1.2, 0.75
FUZZY_EDITS, FUZZY_SIMILARITY, FUZZY_TERMS = 2, 0.7, 20
_CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯]"


def terms(text: Column) -> Column:
    """The text's Latin terms in order."""
    pieces = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: F.char_length(t) >= 2)
    return F.when(text.rlike(_CJK), F.filter(pieces, lambda t: ~t.rlike(_CJK))).otherwise(pieces)


def cjk_pieces(text: Column) -> Column:
    """1- to 3-character pieces of runs of CJK signs."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_CJK}+)"), F.lit(1))

    def pieces(run: Column) -> Column:
        at = F.sequence(F.lit(1), F.char_length(run))
        return F.flatten(F.transform(at, lambda i: F.filter(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(run, i, n)), lambda s: F.char_length(s) > 0)))

    return F.array_distinct(F.flatten(F.transform(runs, pieces)))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, doc, at), a row for each term of a document and its place; a CJK piece is
    there once, without a place.  A row without a term ends each document, however empty:
    its place is the document's length."""
    ended = F.concat(terms(F.col(text)), F.array(F.lit(None).cast("string")))
    latin = docs.select(F.col(key).alias("doc"), F.posexplode(ended).alias("at", "term"))
    cjk = docs.where(F.col(text).rlike(_CJK)).select(F.explode(cjk_pieces(F.col(text))).alias("term"), F.col(key).alias("doc"))
    return latin.select("term", "doc", "at").unionByName(cjk.withColumn("at", F.lit(None).cast("int")))


def query_terms(query: str) -> list[str]:
    """The query's Latin terms in order, cut as ``terms`` cuts a text."""
    return [t for t in regex.split(r"[^\p{L}\p{N}_]+", query.lower()) if len(t) >= 2 and not regex.search(_CJK, t)]


def query_pieces(query: str) -> list[str]:
    """The CJK pieces a document must hold: a run of up to three signs whole, of a
    longer one all pieces of three."""
    runs = regex.findall(f"{_CJK}+", query)
    return sorted({run[i : i + 3] for run in runs for i in range(max(1, len(run) - 2))})


def _with_all(df: DataFrame, by: Sequence[str], column: str, values: Sequence) -> DataFrame:
    """The groups in which the column takes each of the values."""
    found = df.groupBy(*by).agg(*[F.bool_or(F.col(column) == v).alias(f"_{i}") for i, v in enumerate(values)])
    return found.where(" AND ".join(f"_{i}" for i in range(len(values)))).select(*by)


def match(index: DataFrame, query: str) -> DataFrame:
    """(doc) that hold all terms; in quotes: one after another.  A query without a term
    finds nothing.  CJK pieces have no positions: in quotes too, all must be there."""
    words, pieces = query_terms(query), query_pieces(query)
    wanted = sorted({*words, *pieces})
    if not wanted:
        return index.where("false").select("doc")
    own = index.where(F.col("term").isin(*wanted))
    held = _with_all(own, ["doc"], "term", wanted)
    if len(words) < 2 or not regex.fullmatch(r'\s*".*"\s*', query, regex.DOTALL):
        return held
    # A start must be there for every term, each shifted by its place.
    places = F.array(*[F.struct(F.lit(t).alias("word"), F.lit(i).alias("place")) for i, t in enumerate(words)])
    starts = own.where(F.col("term").isin(*words)).select("doc", "term", "at", F.explode(places).alias("p")).where("term = p.word")
    starts = starts.select("doc", (F.col("at") - F.col("p.place")).alias("start"), "p.place")
    # Dealt by document, so that starts and then documents are told apart in one place.
    hit = _with_all(starts.repartition("doc"), ["doc", "start"], "place", range(len(words))).select("doc").distinct()
    return hit.join(held, "doc", "left_semi") if pieces else hit


def fuzzy_terms(index: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(place, term): for each wanted term the nearest few of the vocabulary within the
    edit distance; the index is gone through once for all of them, and of the vocabulary
    only terms near a wanted one are told apart."""
    size = F.char_length("term")
    close = [size.between(len(t) - FUZZY_EDITS, len(t) + FUZZY_EDITS) & (F.levenshtein("term", F.lit(t), FUZZY_EDITS) >= 0) for t in wanted]
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("word")) for i, t in enumerate(wanted)])
    met = index.select("term").where(reduce(or_, close)).distinct().select("term", F.explode(each).alias("q")).select("term", "q.place", "q.word")
    near = met.withColumn("edits", F.levenshtein("term", "word", FUZZY_EDITS)).where("edits >= 0")
    similar = near.where(1 - F.col("edits") / F.greatest(F.char_length("term"), F.char_length("word")) >= FUZZY_SIMILARITY)
    rank = F.row_number().over(Window.partitionBy("place").orderBy("edits", "term"))
    return similar.withColumn("rank", rank).where(F.col("rank") <= FUZZY_TERMS).select("place", "term")


def fuzzy_match(index: DataFrame, query: str, least: int = 1) -> DataFrame:
    """(doc): exact matches if there are ``least`` of them, else the documents that hold,
    for every query term, one of its near terms."""
    wanted = [*dict.fromkeys([*query_terms(query), *query_pieces(query)])]
    exact = match(index, query)
    if not wanted or exact.limit(least).count() >= least:
        return exact
    # At most FUZZY_TERMS rows a query term.
    met = index.join(F.broadcast(fuzzy_terms(index, wanted)), "term").select("doc", "place").distinct()
    return met.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("doc")


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, n): how many Latin terms each document has."""
    return docs.select(F.col(key).alias("doc"), F.size(terms(F.col(text))).alias("n"))


def held_lengths(index: DataFrame) -> DataFrame:
    """The same, read from an index."""
    return index.where("term IS NULL").select("doc", F.col("at").alias("n"))


def bm25(index: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """(doc, score) of the documents with any of the terms; ``lengths`` is (doc, n)."""
    wanted = sorted({*query_terms(query), *query_pieces(query)})
    own = index.where(F.col("term").isin(*wanted)).groupBy("term", "doc").agg(F.count("*").alias("tf"))
    df = own.groupBy("term").agg(F.count("*").alias("df"))  # one row a query term
    total = lengths.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    met = own.join(F.broadcast(df), "term").join(lengths, "doc").join(F.broadcast(total), F.lit(True))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return met.groupBy("doc").agg(F.sum(part).alias("score"))


def stats(index: DataFrame) -> DataFrame:
    index = index.where("term IS NOT NULL")
    each = index.groupBy("term").agg(F.count("*").alias("n"))
    found = each.agg(F.count("*").alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    return found.crossJoin(index.select("doc").distinct().agg(F.count("doc").alias("docs"))).select("terms", "docs", "tokens")
