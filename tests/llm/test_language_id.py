import math
import random
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string"


def test_forward_sums_all_segmentations():
    known = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "bab": 5}
    p = np.array([[0.1, 0.3], [0.2, 0.1], [0.05, 0.2], [0.3, 0.1], [0.1, 0.1], [0.2, 0.05], [1e-3, 1e-3], [0, 0]])

    def brute(word, k):
        @cache
        def total(at):
            if at == len(word):
                return 1.0
            return sum(p[known.get(word[at:e], len(known) if e == at + 1 else -1)][k] * total(e) for e in range(at + 1, len(word) + 1))

        return math.log(total(0))

    words = ["▁a", "▁ab", "▁abab", "▁xab", "▁" + "ab" * 15, "▁" + "ab" * 40]
    got = li.log_likelihoods(words, known, p)
    want = [[brute(w, k) for k in range(2)] for w in words]
    assert np.allclose(got, want)


def segmentations(word, known, p):
    """(pieces, probability) of each way to cut the word."""
    if not word:
        return [([], 1.0)]
    out = []
    for n in range(1, len(word) + 1):
        piece = known.get(word[:n], len(known) if n == 1 else None)
        if piece is not None:
            out += [([piece, *rest], p[piece] * q) for rest, q in segmentations(word[n:], known, p)]
    return out


def test_expected_counts_by_all_segmentations():
    known = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "bab": 5, "abab": 6}
    p = np.array([[0.1], [0.2], [0.05], [0.3], [0.1], [0.2], [0.05], [1e-3], [0]])
    words, weight = ["▁a", "▁ab", "▁ababab", "▁xabb", "▁bab"], np.array([3.0, 1, 2, 5, 1])
    want = np.zeros(9)
    for w, n in zip(words, weight):
        cuts = segmentations(w, known, p[:, 0])
        for pieces, q in cuts:
            for piece in pieces:
                want[piece] += n * q / sum(x for _, x in cuts)
    assert np.allclose(li._expected(words, weight, known, p), want)
    # Words that underflow unless they are scaled: each has as many signs as characters.
    known = {"▁": 0, "a": 1}
    got = li._expected(["▁" + "a" * 3000], np.array([2.0]), known, np.array([[1e-4], [1e-4], [1e-7], [0]]))
    assert np.allclose(got, [2, 6000, 0, 0])


def test_whole_text_scores_against_loops(spark):
    """Shares and leads of small texts from all segmentations of their words."""
    docs = spark.createDataFrame([(1, "the house", "en"), (2, "das haus", "de"), (3, "the haus ist ot", None)], SCHEMA).withColumn("score", F.lit("x")).withColumn("place", F.lit(0))
    got = {r.doc_id: r for r in li.identify(docs, docs).collect()}
    known = li.pieces(li.default_vocabulary())
    languages, p = li.fit({"en": Counter(li.words_of("the house")), "de": Counter(li.words_of("das haus"))}, known)
    for i, text in ((1, "the house"), (2, "das haus"), (3, "the haus ist ot")):
        words = li.words_of(text)
        total = [sum(math.log(sum(q for _, q in segmentations(w, known, p[:, k]))) for w in words) for k in range(3)]
        mean = [math.exp(t / len(words)) for t in total[:2]]
        best = max(range(2), key=lambda k: total[k])
        assert got[i].lang_pred == languages[best]
        assert math.isclose(got[i].score, max(mean) / sum(mean), rel_tol=1e-9)
        assert math.isclose(got[i].lead, (total[best] - total[2]) / len(words), rel_tol=1e-9)


def test_words_keep_their_marks(spark):
    assert li.words_of("हिन्दी भाषा l'été ١٢ a1b Ⅷ") == ["▁" + w for w in ("हिन्दी", "भाषा", "l", "été", "a", "b")]
    docs = spark.createDataFrame([(1, "हिन्दी भाषा", "hi"), (2, "the house", "en"), (2, None, "en"), (None, "der", "de")], SCHEMA)
    counts = li.sample_counts(docs)
    assert counts == {"hi": {"▁हिन्दी": 1, "▁भाषा": 1}, "en": {"▁the": 1, "▁house": 1}}


def test_sample_is_whole_documents(spark, monkeypatch):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " + "x" * 60, "en" if i % 4 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(li, "SAMPLE", 5)
    few = li.sample_counts(docs)
    assert all(sum(n for w, n in c.items() if w.startswith("▁x")) == 5 and "▁" + "x" * 60 in c for c in few.values()) and len(few) == 2
    monkeypatch.setattr(li, "SAMPLE_BYTES", 210)
    assert all(c["▁" + "x" * 60] == 3 for c in li.sample_counts(docs).values())


@pytest.mark.parametrize("n", [2, 4, 10])
def test_foreign_text_has_no_lead(spark, n):
    """Whatever the number of languages; those past four are English with moved letters."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND length(text) > 200").select("doc_id", "text", "lang")
    texts: dict = {}
    for r in docs.orderBy("doc_id").collect():
        texts.setdefault(r.lang, []).append(r.text)
    names = sorted(texts)[:n]
    move = lambda t, k: "".join(chr((ord(c) - 97 + k) % 26 + 97) if "a" <= c <= "z" else c for c in t.lower())
    for k in range(n - len(names)):
        texts[f"x{k}"] = [move(t, 3 + k) for t in texts["en"]]
        names.append(f"x{k}")
    known = li.pieces(li.default_vocabulary())
    languages, p = li.fit({m: Counter(w for t in texts[m][:60] for w in li.words_of(t)) for m in names}, known)

    def lead(text):
        words = li.words_of(text)
        total = li.log_likelihoods(words, known, p).sum(axis=0)
        return total[:-1].max() - total[-1]

    assert all(lead(t) > 0 for m in names for t in texts[m][60:90])
    rnd = random.Random(n)
    junk = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(40)) for _ in range(20)]
    foreign = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Все люди рождаются свободными и равными в своем достоинстве", "すべての人間は、生まれながらにして自由であり"]
    # Moved letters make languages of single letters, in which random ones are at home.
    assert all(lead(t) <= 0 for t in foreign + (junk if n <= 4 else []))


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in li.op7(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(rows) == len(docs)
    tested = [(rows[d.doc_id].lang_pred, d.lang) for d in docs if rows[d.doc_id].held_out and d.lang]
    assert len(tested) > 100 and np.mean([a == b for a, b in tested]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34 ²", None), (4, "the house and the garden", "en"), (5, "das haus und der garten", "de"), (6, "the " * 60_000, None), (7, "x" * 100_000, None), (7, "der", None)], SCHEMA)
    assert li.identify(empty, docs).collect() == []
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in li.identify(docs, docs).collect())
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert [g[1] for g in got[3:6]] == ["en", "de", "en"] and len(got) == 8
    assert {r.lang_pred for r in li.identify(docs, empty).collect()} == {"und"}
