"""Cross-entropy difference of two matched n-gram models.

Target and background model share one vocabulary, the tokens of a fixed public
tokenizer, and one form: the share of a token among those that follow the one before,
mixed with a smoothed unigram share, so that the probabilities after each context sum
to 1.  The background is counted over all documents, the target over trusted ones.  A
document's score is the mean over its tokens of target loss less background loss: the
lower, the more like the target.

Counts are exact: a table of token pairs that grows with the corpus.  Of the pairs of
each hashed slot the most frequent is broadcast with its counts; a document's other
pairs meet the table in a join, each once a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import WordMemory, default_vocabulary, split_words, vocabulary
from tessera.llm.common import delete_shared, maybe_in, slices, table, write_shared

#: Slots of broadcast pairs, a power of two.
BUCKETS = 1 << 20
#: Weight of the bigram share, and what is added to each token's count.
MIX = 0.6
PRIOR = 0.1
#: Tokens that a counting task holds before it sums them up.
HELD = 1 << 20
#: Losses of joined pairs are summed in these parts of a nat, whatever their order.
PARTS = 1 << 32
_MIX64 = np.uint64(0x9E3779B97F4A7C15)


def slots_of(pairs: np.ndarray, slots: int) -> np.ndarray:
    """Slot of each pair."""
    return (pairs.astype(np.uint64) * _MIX64 >> np.uint64(44)).astype(np.int64) & (slots - 1)


def _width(size: int) -> str:
    """How a token of a vocabulary of this size is written."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _ids(tokens: pa.Scalar, width: str) -> np.ndarray:
    return np.frombuffer(tokens.as_buffer(), width).astype(np.int64)


def _tokenizer(path: str, width: str):
    """doc_id, text to doc_id, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        memory = WordMemory(lambda words: [np.array(i, width).tobytes() for i in vocab.encode_words([w.encode("utf-8", "replace") for w in words])])
        for batch in batches:
            for part in slices(batch, "text"):
                cut = [split_words(t or "") for t in part.column("text").to_pylist()]
                memory.learn(cut)
                tokens = [b"".join(map(memory.__getitem__, words)) for words in cut]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens, pa.binary())], ["doc_id", "tokens"])

    return run


def _counter(size: int, width: str):
    """Of the task's documents the counts of tokens (key: the token), of tokens that
    another follows (size more) and of pairs (2 * size + first * size + second)."""

    def summed(held: list) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000], pa.int64()), pa.array(n[at : at + 100_000], pa.int64())], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for tokens in batch.column("tokens"):
                ids = _ids(tokens, width)
                if len(ids):
                    held += [ids, size + ids[:-1], 2 * size + ids[:-1] * size + ids[1:]]
                    total += len(ids)
                if total >= HELD:
                    yield from summed(held)
                    held, total = [], 0
        if held:
            yield from summed(held)

    return run


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, tokens, row) of all documents, as a table: texts are cut once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = texts.mapInArrow(_tokenizer(path, _width(vocabulary(path).size)), "doc_id long, tokens binary")
    return write_shared(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")


def counts(tokens: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(key, background, target) over all documents and all trusted ones.  Only the
    tokens of documents that may be trusted are shuffled to meet the trusted ids."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = maybe_in(tokens.select("doc_id", "tokens"), "doc_id", good).join(good.hint("shuffle_hash"), "doc_id")
    count = lambda rows: rows.select("tokens").mapInArrow(_counter(size, _width(size)), "key long, n long")
    both = count(tokens).select("key", F.col("n").alias("background"), F.lit(0).cast("long").alias("target"))
    both = both.union(count(trusted).select("key", F.lit(0).cast("long").alias("background"), F.col("n").alias("target")))
    return both.groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


class Model:
    """Unigram shares and context totals of one corpus, from its counts by key."""

    def __init__(self, count: np.ndarray) -> None:
        self.size = len(count) // 2
        own = count[: self.size].astype(float) + PRIOR
        self.share, self.followed = own / own.sum(), count[self.size :].astype(float)

    def probabilities(self, pairs: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of each pair's second token after its first; ``count`` is the pairs' own."""
        share, total = self.share[pairs % self.size], self.followed[pairs // self.size]
        return np.where(total > 0, MIX * count / np.maximum(total, 1) + (1 - MIX) * share, share)

    def losses(self, pairs: np.ndarray, count: np.ndarray) -> np.ndarray:
        return -np.log(self.probabilities(pairs, count))


def _slotter(slots: int, size: int):
    """Adds the slot to counts of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("slot", pa.array(slots_of(np.asarray(batch.column("key")) - 2 * size, slots)))

    return run


def _pair_losses(models):
    """Counts of pairs to their losses in PARTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.asarray(batch.column("key")) - 2 * models.value[1][0].size
            found = [m.losses(pairs, np.asarray(batch.column(c))) for m, c in zip(models.value[1], ("background", "target"))]
            yield pa.RecordBatch.from_arrays([pa.array(pairs), *(pa.array(np.rint(x * PARTS).astype(np.int64)) for x in found)], ["pair", "background", "target"])

    return run


def _scorer(models, width: str):
    """Sums of losses in PARTS but for the pairs that must be joined, which are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, *counted), both = models.value
        size = both[0].size
        for batch in batches:
            n, sums, missed, times = [], ([], []), [], []
            for tokens in batch.column("tokens"):
                ids = _ids(tokens, width)
                n.append(len(ids))
                pairs = ids[:-1] * size + ids[1:]
                slots = slots_of(pairs, len(known))
                hit = known[slots] == pairs
                for own, model, count in zip(sums, both, counted):
                    first = -np.log(model.share[ids[:1]]).sum()
                    own.append(round((first + model.losses(pairs[hit], count[slots[hit]]).sum()) * PARTS))
                keys, count = np.unique(pairs[~hit], return_counts=True)
                missed.append(keys)
                times.append(count)
            ends = np.cumsum([0, *map(len, missed)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x), pa.int64())) if x else pa.array([], pa.list_(pa.int64())) for x in (missed, times)]
            arrays = [batch.column("row"), batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, *sums)), *lists]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_tokens", "background", "target", "missed", "times"])

    return run


def fit(found: DataFrame, size: int) -> tuple[np.ndarray, tuple[Model, Model]]:
    """From the table of counts: the broadcast pairs by slot (pair, background, target)
    and both models.  At most BUCKETS and 2 * size rows come to the driver, some 30 MB."""
    pairs = found.where(F.col("key") >= 2 * size)
    best = F.max_by(F.struct("key", "background", "target"), F.struct("background", "key"))
    slotted = pairs.mapInArrow(_slotter(BUCKETS, size), "key long, background long, target long, slot long")
    frequent = slotted.groupBy("slot").agg(best.alias("best")).select("slot", "best.*")
    single = found.where(F.col("key") < 2 * size).select(F.col("key").alias("slot"), "key", "background", "target")
    one, two = np.zeros((3, 2 * size), np.int64), np.zeros((3, BUCKETS), np.int64)
    two[0] = -1
    for rows, into in ((single, one), (frequent, two)):
        for batch in rows.toArrow().to_batches():
            into[:, np.asarray(batch.column("slot"))] = np.stack([np.asarray(batch.column(c)) for c in ("key", "background", "target")])
    two[0, two[0] >= 0] -= 2 * size
    return two, (Model(one[1]), Model(one[2]))


def score(docs: DataFrame, labels: DataFrame, path: str | None = None) -> DataFrame:
    """Return (doc_id, n_tokens, target_loss, background_loss, difference) for each row
    of ``docs`` (doc_id, text): mean losses a token in nats, and target less background.
    ``labels`` (doc_id, quality, toxic) names the trusted documents; other columns are
    ignored.  The result is a table in the shared folder; those it came from are deleted.

    Null and empty texts have no token and zeros.  Without trusted documents the
    target is uniform.  A null doc_id is trusted by no label; labels of a doc_id that
    several rows share hold for all of them.  Rows are independent; an empty table
    gives an empty result.
    """
    path = path or default_vocabulary()
    spark, size = docs.sparkSession, vocabulary(path).size
    tokens = tokenized(docs, path)
    found = write_shared(counts(tokens, labels, size), "ngrams")
    models = spark.sparkContext.broadcast(fit(found, size))
    schema = "row long, doc_id long, n_tokens long, background long, target long, missed array<long>, times array<long>"
    scored = write_shared(tokens.mapInArrow(_scorer(models, _width(size)), schema), "scored")
    listed = scored.select("row", F.explode(F.arrays_zip("missed", "times")).alias("of")).select("row", F.col("of.missed").alias("pair"), "of.times")
    known = found.where(F.col("key") >= 2 * size).mapInArrow(_pair_losses(models), "pair long, background long, target long")
    total = lambda c: F.sum(F.col("times") * F.col(c)).alias(f"more_{c}")
    whole = scored.drop("missed", "times").join(listed.join(known, "pair").groupBy("row").agg(total("background"), total("target")), "row", "left")
    mean = lambda c: F.when(F.col("n_tokens") > 0, (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))) / PARTS / F.col("n_tokens")).otherwise(F.lit(0.0)).alias(f"{c}_loss")
    result = whole.select("doc_id", "n_tokens", mean("target"), mean("background")).withColumn("difference", F.col("target_loss") - F.col("background_loss"))
    result = write_shared(result, "losses")
    for used in (tokens, found, scored):
        delete_shared(used)
    return result


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_lm_scoring": op1}
ORACLE: dict[str, str] = {}
