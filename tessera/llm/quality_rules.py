"""Quality rules: a hashed n-gram log-likelihood ratio, and counts for base rules.

Two multinomials over hashed n-grams, of a trusted target (documents labelled good)
and of the raw corpus (all documents), give each n-gram a log ratio; a document's
score is the mean over its n-grams, and a fixed threshold decides.  N-grams are the
whole words and the pairs of adjacent ones.  Both multinomials are smoothed by the same
share of their own size, so that an n-gram nobody has seen says nothing, whatever
the sizes of corpus and table.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import maybe_in, table, write_shared

BUCKETS = 1 << 18
#: Added to each bucket's count in the raw corpus, and in proportion in the target.
SMOOTHING = 10
#: Mean log ratio below which a document goes.
THRESHOLD = -0.2
#: Log ratios are rounded to a thousandth, so that sums don't depend on their order.
SCALE = 1000
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _bucket(*units: Column) -> Column:
    return F.pmod(F.xxhash64(*units), F.lit(BUCKETS)).cast("int")


def _grams(rows: DataFrame) -> DataFrame:
    """For each word of ``w``, at ``at`` from 0: its bucket and the pair's with the next
    word (null after the last); one row of nulls for a document without words."""
    at = F.explode_outer(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)))
    rows = rows.withColumn("at", at)
    word = lambda i: F.get("w", i)
    one = F.when(F.col("at").isNotNull(), _bucket(word(F.col("at"))))
    pair = F.when(F.col("at") + 1 < F.size("w"), _bucket(word(F.col("at")), word(F.col("at") + 1)))
    return rows.withColumn("one", one).withColumn("pair", pair)


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, weight): the log ratio target to raw, in thousandths, as a long; at
    most BUCKETS rows, some 12 MB, whatever the corpus."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct()
    texts = docs.select("doc_id", "text")
    # Only texts that may be trusted are shuffled to meet the trusted ids.
    trusted = maybe_in(texts, "doc_id", good).join(good.hint("shuffle_hash"), "doc_id")

    def counted(rows: DataFrame, raw: int, target: int) -> DataFrame:
        grams = _grams(rows.select(words_of(F.col("text")).alias("w"))).select(F.explode(F.array("one", "pair")).alias("bucket"))
        return grams.where(F.col("bucket").isNotNull()).groupBy("bucket").agg((raw * F.count("*")).alias("raw"), (target * F.count("*")).alias("target"))

    counts = counted(texts, 1, 0).union(counted(trusted, 0, 1)).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = write_shared(counts, "grams")
    total = counts.agg(F.sum("target").alias("t"), F.sum("raw").alias("r")).first()
    # (t / T + k / R) / (r / R + k / R), the shares' common denominators left out.
    ratio = (F.col("target") * F.lit(float(total.r) / total.t) + SMOOTHING) / (F.col("raw") + SMOOTHING) if total.t else F.lit(1.0)
    return counts.select("bucket", F.round(SCALE * F.log(ratio)).cast("long").alias("weight"))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words inside 5-word windows that are there twice or more, by window hashes:
    windows of one hash sorted beside each other, then the union of their spans."""
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(F.slice(w, i + 1, 5)))

    def doubled(h: Column) -> Column:
        keyed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def of(s: Column) -> Column:
            same = lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"])
            return F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["at"])

        found = F.sort_array(_let(keyed, of))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
        step = lambda st, at: F.struct((at + 5).alias("end"), (st["total"] + at + 5 - F.greatest(st["end"], at)).alias("total"))
        return F.aggregate(found, start, step, lambda st: st["total"])

    none = F.lit(0).cast("long")
    counted = _let(window, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(doubled(h)))
    return F.when(F.size(w) >= 6, counted).otherwise(none)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Return (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept) for each row of ``docs`` (doc_id, text); ``labels`` has
    doc_id, quality, toxic; other columns are ignored.

    Null and empty texts have no words, score 0 and base_failed.  Without trusted
    documents all weights and scores are 0, and the base rules alone decide.  Repeated rows repeat their result; rows with a null
    doc_id are scored like others; empty tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weights = log_ratios(docs, labels)
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        words_of(F.col("text")).alias("w"),
    ).withColumn("n_repeat_words", repeated_words(F.col("w")))
    own = ["doc_id", "row", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # Each word gives two rows; its characters and its count come from the first.
    grams = _grams(rows).select(*own, F.char_length(F.get("w", F.col("at"))).alias("chars"), F.posexplode(F.array("one", "pair")).alias("kind", "bucket"))
    weighed = grams.join(F.broadcast(weights), "bucket", "left")
    first = F.col("kind") == 0
    per_doc = weighed.groupBy(*own).agg(
        F.count(F.when(first, F.col("chars"))).alias("n_words"),
        F.coalesce(F.sum(F.when(first, F.col("chars"))), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.sum("weight") / F.count("bucket") / SCALE, F.lit(0.0)).alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return per_doc.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_rules": op9}
ORACLE: dict[str, str] = {}
