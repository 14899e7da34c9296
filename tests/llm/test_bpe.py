import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def coded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.encode_decode(df).collect()}
    return [rows[i] for i in range(len(texts))]


def check(spark, reference, texts):
    for text, row in zip(texts, coded(spark, texts)):
        ids = reference.encode(text or "", add_special_tokens=False).ids
        assert row.ids == ",".join(map(str, ids)), text
        assert row.n_tokens == len(ids)
        assert row.decoded == reference.decode(ids, skip_special_tokens=False) == (text or "")


def test_edge_texts(spark, reference):
    texts = [None, "", " ", "\n\n a  b\t\x1c\x1d \x85\xa0x", "it's we'll I'M <|endoftext|> <|endoftext|>x", "aaaaaaaa" * 50, "日本語 ¹²³ 𝔘𝔫𝔦 🙂🙂", "=" * 3000, "x" * 100_000, "\x00\x7f", "ﬁ ½ Ⅷ"]
    check(spark, reference, texts)


def test_random_texts(spark, reference):
    rnd = random.Random(7)
    signs = "aabcdeeilnorst  \n'.,0129ÉßñéçA<|>_- あ\U0001f600"
    check(spark, reference, ["".join(rnd.choices(signs, k=rnd.randint(1, 200))) for _ in range(1500)])


def test_vocabulary_words(reference):
    """Every token joined with others: proposals that hold, and some that fail."""
    vocab, rnd = bpe.vocabulary(PATH), random.Random(1)
    pool = [t for t in vocab.bytes_of if t.isalpha()]
    words = [b"".join(rnd.choices(pool, k=rnd.randint(1, 4))) for _ in range(20_000)]
    for word, ids in zip(words, vocab.encode_words(words)):
        assert ids == reference.encode(word.decode(), add_special_tokens=False).ids == vocab.exact(word)


def test_small_scale_table(spark, reference):
    rows = bpe.op6(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(empty).collect() == []
    twice = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string").withColumn("ids", F.lit(1))
    assert [r.ids for r in bpe.encode_decode(twice).collect()] == ["64"] * 3


def test_memory_is_bounded_in_characters(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_CHARACTERS", 1000)
    memory = bpe.WordMemory(lambda words: [w.upper() for w in words])
    for i in range(200):
        cut = [["common", f"{'junk' * 20}{i}"]]
        memory.learn(cut)
        assert all(memory[w] == w.upper() for w in cut[0])
        assert sum(map(len, memory)) <= 1000
    assert "common" in memory
