import math

import numpy as np
import pytest

from tessera.llm import quality_cnn as cnn


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 992, 993, 5000])
def test_chunks_cover_everything(n):
    data = bytes(i % 250 for i in range(n))
    chunks = cnn.chunked(data)
    step = cnn.CHUNK - cnn.OVERLAP
    rebuilt = bytes(chunks[0]) + b"".join(bytes(c[cnn.OVERLAP :]) for c in chunks[1:])
    assert rebuilt[:n] == data and set(rebuilt[n:]) <= {255} and len(rebuilt) - n <= max(step, cnn.CHUNK)


def test_convolution_against_loops():
    network = cnn.Network()
    chunk = np.random.default_rng(0).integers(0, 255, (2, cnn.CHUNK)).astype(np.uint8)
    got = network.convolved(chunk)
    for place in (0, 7, got.shape[1] - 1):
        want = sum(network.taps[k][chunk[1, place * cnn.STRIDE + k]] for k in range(cnn.WIDTH))
        assert np.allclose(got[1, place], want, atol=1e-5)


def test_scores_against_loops(spark):
    """The whole query's path by loops over bytes, chunks and filters; null ids and clashing columns."""
    network = cnn.Network()
    network.bias = np.float32(0.3)
    texts = ["", "short é text", "abc " * 300, None]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in docs.select("doc_id", "text").mapInArrow(cnn._scored(network), "doc_id long, score double").collect()}
    for i, text in enumerate(texts):
        data, step, tops = list((text or "").encode()), cnn.CHUNK - cnn.OVERLAP, []
        at = 0
        while not tops or at + cnn.OVERLAP < len(data):
            chunk = (data[at : at + cnn.CHUNK] + [255] * cnn.CHUNK)[: cnn.CHUNK]
            places = range(0, cnn.CHUNK - cnn.WIDTH + 1, cnn.STRIDE)
            tops.append([max(0.0, max(sum(float(network.taps[k, chunk[p + k], f]) for k in range(cnn.WIDTH)) for p in places)) for f in range(cnn.FILTERS)])
            at += step
        parts = [max(c) for c in zip(*tops)] + [sum(c) / len(tops) for c in zip(*tops)]
        z = sum(float(w) * v for w, v in zip(network.weight, parts)) + float(network.bias)
        assert abs(got[i or None] - 1 / (1 + math.exp(-z))) < 1e-5
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    assert sorted(r.doc_id or 0 for r in cnn.score(docs, docs, labels).collect()) == [0, 1, 2, 3]


def test_training_lowers_the_loss():
    """Of documents of one chunk and of several."""
    rnd = np.random.default_rng(1)
    docs = [cnn.chunked(bytes(rnd.integers(97, 123, n).astype(np.uint8))) for n in (40, 700, 1500, 90)]
    y = np.array([0, 1, 1, 0], np.float32)

    def loss(net):
        chunks = np.concatenate(docs)
        starts = np.cumsum([0, *map(len, docs)])[:-1]
        p = net.combined(net.pooled(chunks), starts)
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    before = cnn.Network()
    after = cnn.Network().fit(docs, y)
    assert loss(after) < 0.5 * loss(before)


def test_learns_and_reads_the_whole_text(spark):
    words = [f"text number {i} about the house and the garden of the town " * 6 for i in range(120)]
    docs = [(i, w if i % 3 else "$$$ %%% !!! " * 30, int(i % 3 > 0)) for i, w in enumerate(words)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    late = words[1] * 30
    tested = spark.createDataFrame([(1, late), (2, "$$$ %%% !!! " * 900), (3, None), (4, ""), (1, late)], "doc_id long, text string")
    rows = [(r.doc_id, r.score) for r in cnn.score(tested, df, df).collect()]
    got = dict(rows)
    assert len(rows) == 5 and got[1] > 0.9 and got[2] < 0.1 and got[3] == got[4]
    assert all(0 <= s <= 1 for _, s in rows)
    assert cnn.score(tested.limit(0), df, df).collect() == []
    assert len(cnn.score(tested, df.limit(0), df.limit(0)).collect()) == 5


def test_held_out_accuracy(spark):
    rows = cnn.op5(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    tested = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(tested) > 50 and np.mean(tested) > 0.85


def test_training_sees_whole_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cnn.Network, "fit", lambda self, docs, y: seen.extend(docs) or self)
    texts = [f"{i} " * (i * 900) for i in range(1, 9)]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, quality int")
    cnn.train(df, df)
    assert sorted(c.tobytes() for c in seen) == sorted(cnn.chunked(t.encode()).tobytes() for t in texts)
    assert cnn.STRIDE == 1
    most = seen.clear() or len(texts[4])
    monkeypatch.setattr(cnn, "SAMPLE_BYTES", most)
    cnn.train(df, df)
    whole = {cnn.chunked(t.encode()).tobytes() for t in texts if len(t) <= most}
    assert seen and {c.tobytes() for c in seen} <= whole
