"""Benchmark decontamination by a broadcast hash set of test n-grams.

Benchmark items become windows of ``WINDOW`` normalised words (a shorter item is one
window); their hashes are the set.  Each document's word windows are hashed and
probed against it, hits are verified word by word, and the words they cover are
counted, or the spans or documents removed.  DataFrame functions only.

The set is broadcast while its bytes are within ``BROADCAST_BYTES``.  A larger one is
shuffled: a bitmap of fixed size then holds back nearly all windows that aren't in
it, and the others travel as their own words, never as the whole document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import maybe_marked, table

WINDOW = 10
#: The set is broadcast up to so many bytes, its words and ROW_BYTES for each window.
BROADCAST_BYTES = 50 << 20
ROW_BYTES = 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before that.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    """A-Z in lower case; lower() does just that to ASCII, and faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(_lowered(F.coalesce(text, F.lit(""))), BETWEEN), "")


def windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, words, h): each item's distinct windows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    cut = items.select("item_id", n.alias("n"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"))
    cut = cut.select("item_id", "n", F.slice("w", F.col("at"), F.col("n")).alias("words"))
    return cut.withColumn("h", F.xxhash64("words")).distinct()


def _starts(size: Column, n: int) -> Column:
    """(at, n) of each window of n words."""
    each = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n")))
    return F.when(size >= n, each).otherwise(F.array().cast("array<struct<at:int,n:int>>"))


def _hits(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``rows`` (text and whatever names them) with ``n_words`` and, for each occurrence
    of an item's window, ``at`` from 0, ``n`` and ``item_id``; at least one row each, of
    nulls where nothing occurs.  Texts are read and cut once for all window lengths."""
    sought = windows(benchmark)
    weight = F.sum(ROW_BYTES + F.aggregate("words", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16))
    found = sought.agg(F.sort_array(F.collect_set("n")).alias("lengths"), weight.alias("bytes")).first()  # at most WINDOW numbers
    own = [c for c in rows.columns if c != "text"]
    split = rows.withColumn("_w", words_of(F.col("text"))).select(*own, F.size("_w").cast("long").alias("n_words"), "_w")
    if not found.lengths:
        return split.select(*own, "n_words", F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("item_id"))
    size = F.size("_w")
    if found.lengths == [WINDOW]:
        at, n = F.when(size >= WINDOW, F.sequence(F.lit(0), size - WINDOW)), F.lit(WINDOW)
        cut = split.withColumn("_at", F.explode_outer(at)).withColumn("_n", n)
    else:
        cut = split.withColumn("_of", F.explode_outer(F.concat(*[_starts(size, k) for k in found.lengths]))).withColumn("_at", F.col("_of.at")).withColumn("_n", F.col("_of.n")).drop("_of")
    part = F.slice("_w", F.col("_at") + 1, F.col("_n"))
    cut = cut.withColumn("_h", F.xxhash64(part))
    # A document's first window stands for it where it has no hit.
    first = F.col("_at").isNull() | ((F.col("_at") == 0) & (F.col("_n") == found.lengths[0]))
    sought = sought.select(F.col("item_id"), F.col("n").alias("_set_n"), F.col("words").alias("_set_words"), F.col("h").alias("_set_h"))
    if found.bytes <= BROADCAST_BYTES:
        sought = F.broadcast(sought)
    else:
        marked = maybe_marked(cut.withColumn("_first", first), "_h", sought.select("_set_h"), "_maybe").where("_maybe OR _first")
        cut = marked.select(*own, "n_words", "_at", "_n", "_h", part.alias("_part"))
        part = F.col("_part")
    met = cut.join(sought, F.col("_h") == F.col("_set_h"), "left").where(F.col("_set_h").isNotNull() | first)
    same = (F.col("_n") == F.col("_set_n")) & (part == F.col("_set_words"))
    # A hash that is equal by chance isn't a hit.
    item = F.when(same, F.col("item_id"))
    return met.select(*own, "n_words", F.when(same, F.col("_at")).alias("at"), F.when(same, F.col("_n")).alias("n"), item.alias("item_id"))


def _covered(spans: Column) -> Column:
    """Number of words in the union of the spans (at, n), sorted by at."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def step(state: Column, span: Column) -> Column:
        end = F.greatest(state["end"], span["at"] + span["n"])
        return F.struct(end.alias("end"), (state["total"] + end - F.greatest(state["end"], span["at"])).alias("total"))

    return F.aggregate(spans, start, step, lambda state: state["total"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Return (doc_id, n_words, n_hit, n_items, items, spans, contaminated) for each
    row of ``docs`` (doc_id, text); ``benchmark`` has item_id, text; other columns
    are ignored.

    ``items`` are the sorted ids (strings) of the items with an occurring window,
    ``spans`` the occurrences (at, n) in words.  Null, empty and wordless texts have
    no words and no hits; wordless items no windows.  Each row is judged by its own text,
    whatever its doc_id: null, repeated, or shared with another text.  Empty tables
    give empty or hitless results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    span = F.when(F.col("at").isNotNull(), F.struct("at", "n"))
    joined = _hits(rows, benchmark).groupBy("row", "doc_id", "n_words").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    n_hit = _covered(F.col("spans"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (n_hit > 0).alias("contaminated"))


def _hit_keys(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, hit): the documents with hits, by a hash of doc_id and text, and their hit words."""
    hits = _hits(docs.select(_key().alias("key"), "text"), benchmark).where(F.col("at").isNotNull())
    words = F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)
    return hits.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set(words))).alias("hit"))


def _key() -> Column:
    """The row's name: equal rows have equal hits.  A null is told from an empty text."""
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.col("text").isNull())


def drop_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all its columns, without the rows whose text has a hit."""
    hits = _hits(docs.select(_key().alias("key"), "text"), benchmark)
    keys = hits.where(F.col("at").isNotNull()).select("key").distinct()
    # Rows that the bitmap clears stay as they are; only the others are shuffled.
    marked = maybe_marked(docs.withColumn("_key", _key()), "_key", keys, "_maybe")
    clear = marked.where("NOT _maybe").select(*docs.columns)
    doubtful = marked.where("_maybe").join(keys, F.col("_key") == F.col("key"), "left_anti").select(*docs.columns)
    return clear.union(doubtful)


def drop_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text): texts without hit words; what stood between other words stays."""
    per_key = _hit_keys(docs, benchmark)
    parts = F.regexp_extract_all("text", F.lit(f"({WORD}|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"), F.lit(1))
    first_is_word = F.when(F.col("text").rlike(f"^{WORD}"), 0).otherwise(1)
    joined = docs.select("doc_id", "text", _key().alias("key")).join(per_key, "key", "left").withColumn("parts", parts).withColumn("shift", first_is_word)
    kept = F.filter("parts", lambda p, i: ((i - F.col("shift")) % 2 != 0) | ~F.array_contains("hit", ((i - F.col("shift")) / 2).cast("int")))
    return joined.select("doc_id", F.when(F.col("hit").isNull(), F.col("text")).otherwise(F.array_join(kept, "")).alias("text"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

QUERIES = {"op10_decontaminate": op10}
ORACLE = {
    "op10_decontaminate": f"""
        WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, pos, pos + least(len(w), 10) - 1) AS words
               FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM i WHERE len(w) > 0)),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        dw AS (SELECT doc_id, n, pos, list_slice(w, pos, pos + n - 1) AS words
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos
                     FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, pos, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.words = iw.words),
        covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit
                    FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM hit) GROUP BY 1),
        found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                         string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
}
