"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks of ``CHUNK`` that overlap by ``OVERLAP``
and cover all of it.  Learned filters of ``WIDTH`` bytes slide over each chunk (a
filter is a table of a weight for each byte at each place); a chunk keeps each
filter's highest value; the chunks' highest and mean values go through a logistic
unit into one probability.  Trained on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, table

CHUNK = 512
OVERLAP = 32
WIDTH = 6
FILTERS = 16
STRIDE = 1
#: Labelled documents that the network is trained on, at most: those of least hash.
SAMPLE = 4000
#: Bytes of theirs, at most: whole documents, in order of hash.
SAMPLE_BYTES = 8 << 20
EPOCHS = 14
#: Score from which a document is predicted to be good.
GOOD = 0.7
#: A short chunk is filled up with this byte, which UTF-8 never holds.
_FILL = 255


def chunked(data: bytes) -> np.ndarray:
    """(chunks, CHUNK) bytes covering all of ``data``; one chunk if it is empty."""
    step = CHUNK - OVERLAP
    n = 1 + max(0, -(-(len(data) - CHUNK) // step))
    padded = np.full((n - 1) * step + CHUNK, _FILL, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class Network:
    def __init__(self, seed: int = 5) -> None:
        rnd = np.random.default_rng(seed)
        self.taps = rnd.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.taps[:, _FILL] = 0
        self.weight = rnd.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.float32(0)

    def convolved(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, places, filters)"""
        end = CHUNK - WIDTH + 1
        out = self.taps[0].take(chunks[:, 0:end:STRIDE], axis=0)
        for k in range(1, WIDTH):
            out += self.taps[k].take(chunks[:, k : end + k : STRIDE], axis=0)
        return out

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Each chunk's highest filter values, a few chunks at a time to stay in cache."""
        return np.concatenate([np.maximum(self.convolved(chunks[at : at + 16]).max(axis=1), 0) for at in range(0, len(chunks), 16)])

    def combined(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities of documents whose chunks begin at ``starts``."""
        sizes = np.diff(np.append(starts, len(pooled)))[:, None]
        both = np.concatenate((np.maximum.reduceat(pooled, starts), np.add.reduceat(pooled, starts) / sizes), axis=1)
        return 1 / (1 + np.exp(-(both @ self.weight + self.bias).astype(np.float64)))

    def fit(self, docs: list[np.ndarray], y: np.ndarray, seed: int = 6) -> Network:
        """Adam on log loss; only the places of the highest values get gradients."""
        rnd, rate, names = np.random.default_rng(seed), 0.01, ("taps", "weight", "bias")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        step = 0
        for epoch in range(EPOCHS):
            for part in np.array_split(rnd.permutation(len(docs)), max(1, len(docs) // min(64, max(4, len(docs) // 16)))):
                chunks = np.concatenate([docs[i] for i in part])
                sizes = np.array([len(docs[i]) for i in part])
                starts = np.cumsum(sizes) - sizes
                convs = (self.convolved(chunks[at : at + 16]) for at in range(0, len(chunks), 16))
                found = [(c.argmax(axis=1), c.max(axis=1)) for c in convs]
                place = np.concatenate([f[0] for f in found])
                pooled = np.maximum(np.concatenate([f[1] for f in found]), 0)
                doc_of = np.repeat(np.arange(len(part)), sizes)
                top = np.maximum.reduceat(pooled, starts)
                both = np.concatenate((top, np.add.reduceat(pooled, starts) / sizes[:, None]), axis=1)
                error = ((1 / (1 + np.exp(-(both @ self.weight + self.bias))) - y[part]) / len(part)).astype(np.float32)
                down = (pooled == top[doc_of]) * (error[doc_of, None] * self.weight[:FILTERS])
                down += error[doc_of, None] * self.weight[FILTERS:] / sizes[doc_of, None]
                down *= pooled > 0
                taps = np.zeros_like(self.taps)
                rows, columns = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None]
                for k in range(WIDTH):
                    np.add.at(taps[k], (chunks[rows, place * STRIDE + k], columns), down)
                taps[:, _FILL] = 0
                step += 1
                for n, g in zip(names, (taps + 1e-5 * self.taps, both.T @ error + 1e-4 * self.weight, error.sum())):
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - rate * (0.5 if epoch > EPOCHS // 2 else 1) * move).astype(np.float32))
        return self


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on all chunks of at most SAMPLE labelled documents of at most SAMPLE_BYTES
    together; a document that alone has more can't be chosen."""
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select("doc_id", data.alias("data")).join(F.broadcast(chosen), "doc_id")
    sizes = rows.groupBy("doc_id").agg(F.sum(F.octet_length("data")).alias("size"), F.xxhash64("doc_id").alias("hash"))
    ids, left = [], SAMPLE_BYTES
    for r in sizes.orderBy("hash", "doc_id").collect():
        if r.size <= SAMPLE_BYTES:
            if r.size > left:
                break
            ids.append((r.doc_id,))
            left -= r.size
    network = Network()
    if ids:
        own = docs.sparkSession.createDataFrame(ids, sizes.select("doc_id").schema)
        found = rows.join(F.broadcast(own), "doc_id").select("doc_id", "quality", "data").toArrow().sort_by("doc_id")
        chunks = [chunked(bytes(d)) for d in found.column("data").to_pylist()]
        network.fit(chunks, np.asarray(found.column("quality"), np.float32))
    return network


def _scored(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                pooled, starts, at = [], [], 0
                for text in part.column("text").to_pylist():
                    pooled.append(network.pooled(chunked((text or "").encode("utf-8", "replace"))))
                    starts.append(at)
                    at += len(pooled[-1])
                p = network.combined(np.concatenate(pooled), np.array(starts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """Return (doc_id, score) for each row of ``docs`` (doc_id, text), the probability of
    label 1 by the network trained on ``labelled`` (doc_id, text) and ``labels``
    (doc_id, quality; the least of a repeated doc_id); other columns are ignored.

    Null texts count as empty ones, which get the score of a chunk of filling.  With
    nothing labelled the network is untrained.  A null doc_id is no label's, and is
    scored like others.  Rows are independent; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_scored(train(labelled, labels)), "doc_id long, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = score(docs, docs.where(~held_out), labels.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


QUERIES = {"op5_quality_cnn": op5}
ORACLE: dict[str, str] = {}
