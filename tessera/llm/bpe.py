"""Byte-level BPE, encoding and decoding: speculate and verify.

A text is cut into words by the vocabulary's pattern.  For each distinct word a
greedy longest match proposes tokens.  A proposal is what the merges give if, and
only if, each adjacent pair is compatible: no merge across its border comes before
the merges that made its two tokens.  That is tested for all new pairs at once, by
walking down the right edge of the left token's merge tree and the left edge of the
right token's.  Only the words that fail are merged exactly.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, table, trimmed

#: Words whose tokens a task remembers, and their characters.
REMEMBERED = 150_000
REMEMBERED_CHARACTERS = 8 << 20
#: Words of up to so many bytes are merged by plain rescans, longer ones with a heap.
SHORT = 48
_NEVER = np.int64(2**40)
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same pattern for texts of code points below 256, where the classes are short.
_LATIN_L, _LATIN_N, _LATIN_S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN_L}]+| ?[{_LATIN_N}]+| ?[^{_LATIN_S}{_LATIN_L}{_LATIN_N}]+|[{_LATIN_S}]+(?![^{_LATIN_S}])|[{_LATIN_S}]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def split_words(text: str) -> list[str]:
    """The words that tokens don't cross; special strings count as ordinary text."""
    if text.isascii():
        return _ASCII.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WORD.findall(text)
    return _LATIN.findall(text)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_sign() -> dict[str, int]:
    """The signs a vocabulary file writes bytes with: visible Latin-1 as it is, the
    rest as the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a ``tokenizers`` JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte, vocab = _byte_of_sign(), spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])])
        self.id_of: dict[bytes, int] = {}
        self.bytes_of: list[bytes] = [b""] * size
        for sign, i in vocab.items():
            self.bytes_of[i] = bytes(byte[c] for c in sign)
            self.id_of[self.bytes_of[i]] = i
        self.left, self.right, self.rank = np.arange(size), np.arange(size), np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            self.merges[a, b] = rank, made
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = a, b, rank
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        self.key_rank = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        # Length of the longest token, by its first three bytes.
        self.longest: dict[bytes, int] = {}
        for token in self.id_of:
            self.longest[token[:3]] = max(self.longest.get(token[:3], 0), len(token))
        self.decimal = list(map(str, range(size)))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def greedy(self, word: bytes) -> list[int]:
        out, at, end, id_of, longest = [], 0, len(word), self.id_of, self.longest
        while at < end:
            stop = min(end, at + longest.get(word[at : at + 3], 2))
            while (found := id_of.get(word[at:stop])) is None:
                stop -= 1
            out.append(found)
            at = stop
        return out

    def _across(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each a and b, _NEVER where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], _NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the merges leave each x followed by y as they are.

        Going back in time, the later made of the two edge tokens is taken apart; a
        merge of the edge tokens of some moment would have come first if its rank is
        below that of the merge that used up the left one, and not above that of
        the merge that used up the right one (equal ranks go from left to right).
        """
        good, at = np.ones(len(x), bool), np.arange(len(x))
        a, b = x.astype(np.int64), y.astype(np.int64)
        a_until, b_until = np.full(len(x), _NEVER), np.full(len(x), _NEVER)
        while len(at):
            m = self._across(a, b)
            bad = (m < a_until) & (m <= b_until) & (m < _NEVER)
            good[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, a_until, b_until, ra, rb = (v[go] for v in (at, a, b, a_until, b_until, ra, rb))
            first = ra > rb
            a_until, b_until = np.where(first, ra, a_until), np.where(first, b_until, rb)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, then from left to right."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        if len(ids) <= SHORT:
            merges, none = self.merges, (1 << 40, -1)
            found = [merges.get(p, none) for p in zip(ids, ids[1:])]
            while found and (best := min(found)) is not none:
                i = found.index(best)
                ids[i : i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = merges.get((ids[i - 1], ids[i]), none)
                if i < len(found):
                    found[i] = merges.get((ids[i], ids[i + 1]), none)
            return ids
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if i < len(ids) else len(ids)
            if ids[i] != pair[0] or j >= len(ids) or ids[j] != pair[1]:
                continue
            ids[i], ids[j], after[i] = self.merges[pair][1], -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids) and (p := (ids[k], ids[after[k]])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], k, p))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        proposed = [self.greedy(w) for w in words]
        flat = np.fromiter((i for p in proposed for i in p), np.int64)
        of = np.repeat(np.arange(len(words)), [len(p) for p in proposed])
        inner = of[1:] == of[:-1]
        pairs, back = np.unique(flat[:-1][inner] * self.size + flat[1:][inner], return_inverse=True)
        bad = ~self.compatible(pairs // self.size, pairs % self.size)[back]
        for k in np.unique(of[1:][inner][bad]).tolist():
            proposed[k] = self.exact(words[k])
        return proposed


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class WordMemory(dict):
    """What a task remembers of words: ``made(words)`` gives the entries of new ones."""

    def __init__(self, made: Callable[[list[str]], list]) -> None:
        self.made = made
        self.characters = 0

    def learn(self, cut: list[list[str]]) -> None:
        """Have an entry for each of these words; forget the others when there are many."""
        words = set().union(*cut)
        new = [w for w in words if w not in self]
        self.characters += sum(map(len, new))
        if len(self) + len(new) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            kept = {w: self[w] for w in words if w in self}
            self.clear()
            dict.update(self, kept)
            self.characters = sum(map(len, words))
        dict.update(self, zip(new, self.made(new)))


def encoder(path: str):
    """The function that mapInArrow runs: doc_id, text to doc_id, ids, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        special = vocab.special

        def made(words: list[str]) -> list[tuple[str, str]]:
            coded = vocab.encode_words([w.encode("utf-8", "replace") for w in words if w not in special])
            each, decimal, bytes_of = iter(coded), vocab.decimal, vocab.bytes_of
            out = []
            for w in words:
                ids = [special[w]] if w in special else next(each)
                # A word is whole code points, so that words decode one by one.
                text = b"".join([bytes_of[i] for i in ids]).decode("utf-8", "replace")
                out.append((",".join([decimal[i] for i in ids]), w if text == w else text))
            return out

        memory = WordMemory(made)
        for batch in batches:
            for part in slices(batch, "text"):
                cut = []
                for text in part.column("text").to_pylist():
                    parts = [text or ""] if vocab.special_pattern is None else vocab.special_pattern.split(text or "")
                    cut.append([w for k, p in enumerate(parts) for w in ([p] if k % 2 else split_words(p))] if len(parts) > 1 else split_words(parts[0]))
                memory.learn(cut)
                ids, texts = [], []
                for words in cut:
                    both = list(map(memory.__getitem__, words))
                    ids.append(",".join([x for x, _ in both]))
                    texts.append("".join([x for _, x in both]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Return (doc_id, n_tokens, ids, decoded) for each row of ``docs`` (doc_id long,
    text string; other columns are ignored).

    ``ids`` are decimal and comma-joined, as split(ids, ',') reads; ``decoded`` is the
    text the ids stand for.  Null and empty texts have no token and decode to ''.
    Special strings in a text become their one id.  Rows are independent: repeated
    rows give repeated results, an empty table none.
    """
    path = path or default_vocabulary()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = texts.mapInArrow(trimmed(encoder(path)), "doc_id long, ids string, decoded string")
    commas = F.octet_length("ids") - F.octet_length(F.replace("ids", F.lit(","), F.lit("")))
    n_tokens = F.when(F.col("ids") == "", 0).otherwise(commas + 1).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), "ids", "decoded")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op6_bpe": op6}
ORACLE: dict[str, str] = {}
