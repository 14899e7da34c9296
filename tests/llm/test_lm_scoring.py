import math
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import lm_scoring as lm
from tessera.llm.bpe import default_vocabulary, vocabulary

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"
SIZE = vocabulary(default_vocabulary()).size


def encoded(rows):
    encode = Tokenizer.from_file(default_vocabulary()).encode
    return [encode(t or "", add_special_tokens=False).ids for _, t in rows]


def probability(members):
    """p(token, token before or None) from the definition."""
    one, two, before = Counter(), Counter(), Counter()
    for ids in members:
        one.update(ids)
        two.update(zip(ids, ids[1:]))
        before.update(ids[:-1])
    total = sum(one.values())

    def p(token, context):
        alone = (one[token] + lm.PRIOR) / (total + lm.PRIOR * SIZE)
        if context is None or not before[context]:
            return alone
        return lm.MIX * two[context, token] / before[context] + (1 - lm.MIX) * alone

    return p


def brute(rows, trusted):
    """Losses of each row; trusted are places in rows."""
    ids = encoded(rows)

    def loss(p, seq):
        return sum(-math.log(p(t, seq[k - 1] if k else None)) for k, t in enumerate(seq)) / len(seq) if seq else 0.0

    target, background = probability([ids[k] for k in trusted]), probability(ids)
    return [(len(s), loss(target, s), loss(background, s)) for s in ids]


def check(got, rows, want, atol=1e-7):
    assert len(got) == len(rows)
    key = lambda r: tuple(map(repr, r))
    left = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got), key=lambda r: key((r[0], r[1])))
    right = sorted(((i, *w) for (i, _), w in zip(rows, want)), key=lambda r: key((r[0], r[1])))
    assert [x[:2] for x in left] == [x[:2] for x in right]
    assert np.allclose([x[2:] for x in left], [x[2:] for x in right], rtol=0, atol=atol)
    assert all(abs(r.difference - (r.target_loss - r.background_loss)) < 1e-12 for r in got)


@pytest.mark.parametrize("slots", [16, lm.BUCKETS])
def test_against_loops(spark, monkeypatch, slots):
    """With few slots nearly all pairs go through the join."""
    monkeypatch.setattr(lm, "BUCKETS", slots)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    labels = [(i, k % 2, 0) for k, (i, _) in enumerate(rows[:30])] + [(rows[40][0], 1, 1), (None, 1, 0)]
    trusted = [k for k in range(30) if k % 2]
    rows += [(None, rows[0][1]), (10_001, None), (10_002, ""), (10_003, "a"), (10_004, "word " * 20_000)]
    check(lm.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect(), rows, brute(rows, trusted))


def test_probabilities_sum_to_one(spark):
    """After contexts that many, few and no tokens follow, in both models."""
    rows = [(i, f"the house number {i} of the town " * (i % 4 + 1) + "end") for i in range(12)]
    tokens = lm.tokenized(spark.createDataFrame(rows, DOCS), default_vocabulary())
    found = lm.counts(tokens, spark.createDataFrame([(i, 1, 0) for i in range(4)], LABELS), SIZE).cache()
    _, models = lm.fit(found, SIZE)
    table = {r.key - 2 * SIZE: (r.background, r.target) for r in found.collect() if r.key >= 2 * SIZE}
    ids = encoded(rows)
    unseen = next(i for i in range(SIZE) if all(i not in x for x in ids))
    for context in {*ids[0], ids[0][-1], ids[11][-2], unseen}:
        for k, model in enumerate(models):
            pairs = context * SIZE + np.arange(SIZE)
            count = np.array([table.get(p, (0, 0))[k] for p in pairs.tolist()])
            assert abs(model.probabilities(pairs, count).sum() - 1) < 1e-6
    assert all(abs(m.share.sum() - 1) < 1e-9 for m in models)


def test_junk_scores_worse(spark):
    rows = {r.doc_id: r.difference for r in lm.op1(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [rows[r.doc_id] for r in labels if r.quality == 1]
    bad = [rows[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean([b > np.median(good) for b in bad]) > 0.9


def test_edges(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert lm.score(none, labels).collect() == []
    twice = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "x y")], DOCS).selectExpr("*", "1 AS trusted", "2 AS key", "3 AS row", "4 AS tokens")
    assert len({tuple(r)[1:] for r in lm.score(twice, labels).collect()}) == 1


def test_target_is_counted_whole(spark):
    rows = [(i, f"the house number {i} of the town " * (i + 1)) for i in range(20)]
    got = lm.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1, 0) for i in range(15)], LABELS)).collect()
    check(got, rows, brute(rows, range(15)))


def test_large_vocabularies(spark, monkeypatch):
    """Tokens of four bytes."""
    monkeypatch.setattr(lm, "_width", lambda size: "<u4")
    rows = [(i, f"the house number {i} of the town") for i in range(5)]
    check(lm.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, 1, 0)], LABELS)).collect(), rows, brute(rows, [1]))


def test_nothing_is_left_but_the_result(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    lm.score(spark.createDataFrame([(1, "a b c")], DOCS), spark.createDataFrame([(1, 1, 0)], LABELS)).collect()
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"losses"}
